"""Token ids of texts by a vocabulary file, and byte files reachable from every task."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END = 50256
ID_TYPE = "<u2"
SEGMENT = 1 << 16
EDGE = re.compile(r"\S(?=\s)")


class Encoder:
    """Ids of a text. ``vocabulary`` is a path, or the name of a file of the installed vocabularies."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else str(public_tokenizers.path(vocabulary))
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str | None) -> np.ndarray:
        """The ids; none for null. Decoding them gives the text back."""
        parts = [self.encoding.encode_ordinary(s) for s in segments(text or "")]
        return np.array(parts[0] if len(parts) == 1 else [i for p in parts for i in p], ID_TYPE)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Bounded pieces of a text, cut in front of blanks where there are any.

    No token reaches over such a cut, so the ids are those of the whole text; only a run of over
    ``size`` characters without a blank, or of blanks alone, is cut inside.
    """
    start = 0
    while len(text) - start > size:
        cut = start + size
        for edge in EDGE.finditer(text, start + size // 2, start + size):
            cut = edge.end()
        yield text[start:cut]
        start = cut
    yield text[start:]


def filesystem(uri: str):
    """The file system and path of a folder or file that all executors reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def whole_file(uri: str, attempt: int):
    """A stream that becomes the file ``uri`` when the block ends without an error.

    A task that runs twice replaces its own file, and no reader sees half a file.
    """
    store, path = filesystem(uri)
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_{name}-{attempt}"
    with store.open_output_stream(draft) as out:
        yield out
    if store.get_file_info(path).type.name != "NotFound":
        store.delete_file(path)
    store.move(draft, path)
