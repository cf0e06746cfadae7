"""Files and directory trees.

Paths are data: Spark's own file listing hides names that start with ``_`` or ``.``, so a
listing frame is walked level by level on the executors and read by them.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.frames import numbered
from lorespark.functions.text import any_glob
from lorespark.operators.chunking import extension, tag_language
from lorespark.session import durable
from lorespark.sources.jsontext import indent_json
from lorespark.sources.metadata import merge_metadata

# Directory names that are never entered.
EXCLUDED_DIRS = [
    "__pycache__",
    "node_modules",
    ".git",
    ".venv",
    "venv",
    ".tox",
    ".mypy_cache",
    ".pytest_cache",
    ".ruff_cache",
    ".eggs",
    "dist",
    "build",
    ".idea",
    ".vscode",
    ".hg",
    ".svn",
]
IGNORE_FILE = ".gitignore"
BATCH_BYTES = 32 << 20
BATCH_ENTRIES = 10_000


def kept_path(rel_path: Column, ignore: Column | None) -> Column:
    """Whether a relative path survives hidden names, excluded directories and patterns.

    Each ancestor directory is tested like the file itself, so a pruned directory takes all
    beneath it along. ``ignore`` is one regex per row, or none.
    """
    segments = F.split(rel_path, "/")
    dirs = F.slice(segments, 1, F.size(segments) - 1)
    hidden = F.exists(segments, lambda s: s.startswith("."))
    excluded = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))
    kept = ~hidden & ~excluded
    if ignore is not None:
        prefixes = F.transform(
            F.sequence(F.lit(1), F.size(segments)),
            lambda n: F.array_join(F.slice(segments, 1, n), "/"),
        )
        hit = F.exists(F.concat(prefixes, segments), lambda p: F.rlike(p, ignore))
        kept = kept & ~F.coalesce(hit, F.lit(False))
    return kept


def filter_paths(listing: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Listing rows (``rel_path``) to read, given the ignore patterns of the root.

    The patterns become one regex, so this is a filter, not a join.
    """
    regex = any_glob(patterns or [])
    return listing.filter(kept_path(F.col("rel_path"), F.lit(regex) if regex else None))


def ignore_patterns(text: str) -> list[str]:
    lines = [line.strip() for line in text.splitlines()]
    return [line for line in lines if line and not line.startswith("#")]


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a plain path or URI; ``ValueError`` for what names neither."""
    if not isinstance(uri, str):
        raise ValueError("no location")
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _failure(uri: str, problem: BaseException) -> str:
    """One line on why a location cannot be read."""
    if isinstance(problem, FileNotFoundError):
        return f"no such file: {uri}"
    if isinstance(problem, OSError):
        return f"cannot read: {uri}"
    return f"not a location: {uri}"


def _entries(root: str, rel_path: str, ignore: str | None) -> tuple[list[pafs.FileInfo], str | None]:
    """What lies in a directory, and the pattern of names to ignore, which the root's own file gives.

    A root that is no directory is empty, and so is a directory that must not be entered.
    """
    files, base = located(posixpath.join(root, rel_path) if isinstance(root, str) else root)
    try:
        if not rel_path and files.get_file_info(base).type != pafs.FileType.Directory:
            return [], ignore
        found = files.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    except PermissionError:
        return [], ignore
    own = [f for f in found if not rel_path and f.base_name == IGNORE_FILE and f.is_file]
    if own:
        with files.open_input_stream(own[0].path) as stream:
            ignore = any_glob(ignore_patterns(stream.read().decode("utf-8", "replace")))
    return found, ignore


def _children(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries one level below each directory, or a row that says why it cannot be listed."""
    columns = [c.split()[0] for c in LISTING.split(", ")]
    for frame in frames:
        held: list[tuple] = []
        for row in frame.itertuples(index=False):
            try:
                found, ignore = _entries(row.root, row.rel_path, row.ignore)
            except (OSError, ValueError) as problem:
                error = _failure(f"{row.root}/{row.rel_path}".rstrip("/"), problem)
                held.append((row.source_id, row.root, row.rel_path, False, None, error))
                continue
            # Many small directories make one batch, a large one several.
            for f in found:
                path, is_dir = posixpath.join(row.rel_path, f.base_name), f.type == pafs.FileType.Directory
                held.append((row.source_id, row.root, path, is_dir, ignore, None))
                if len(held) >= BATCH_ENTRIES:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=columns)


LISTING = "source_id string, root string, rel_path string, is_dir boolean, ignore string, error string"


def list_tree(roots: DataFrame) -> DataFrame:
    """The files to read below ``roots(source_id, root)``, one distributed step per level.

    Gives ``(source_id, root, rel_path, path, part)``; ``part`` counts the files of a source in
    path order. Ignored directories are not entered. A missing root gives no rows.
    """
    return list_or_fail(roots).filter("error is null").drop("error")


def list_or_fail(roots: DataFrame) -> DataFrame:
    """As ``list_tree``, with a row whose ``error`` tells of a directory that cannot be listed."""
    level = roots.select(
        "source_id",
        "root",
        F.lit("").alias("rel_path"),
        F.lit(True).alias("is_dir"),
        F.lit(None).cast("string").alias("ignore"),
        F.lit(None).cast("string").alias("error"),
    )
    cores = roots.sparkSession.sparkContext.defaultParallelism
    levels: list[DataFrame] = []
    while True:
        found = level.repartition(cores, "root", "rel_path").mapInPandas(_children, LISTING)
        inner = F.when(F.col("is_dir"), F.concat("rel_path", F.lit("/x"))).otherwise(
            F.col("rel_path")
        )
        found = found.withColumn("keep", kept_path(inner, None) | F.col("error").isNotNull()).filter("keep").drop("keep")
        name = F.regexp_extract("rel_path", r"[^/]+$", 0)
        ignored = F.rlike("rel_path", F.col("ignore")) | F.rlike(name, F.col("ignore"))
        found = durable(found.filter(~F.coalesce(ignored, F.lit(False))))
        levels.append(found.filter("not is_dir"))
        level = found.filter("is_dir")
        if level.isEmpty():
            break
    files = levels[0]
    for more in levels[1:]:
        files = files.unionByName(more)
    path = F.concat_ws("/", F.regexp_replace("root", "/+$", ""), "rel_path")
    files = files.select(
        "source_id", "root", "rel_path", path.alias("path"), "error", F.split("rel_path", "/").alias("_at")
    )
    placed = numbered(files, ["source_id"], ["_at"], "_n")
    return placed.withColumn("part", (F.col("_n") - 1).cast("int")).drop("_at", "_n")


READ = ["source_id", "path", "part", "data", "error"]


def _file_bytes(uri: str) -> bytes:
    files, path = located(uri)
    kind = files.get_file_info(path).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if kind != pafs.FileType.File:
        raise OSError(uri)
    # The bytes as they are, whatever the name's ending says about compression.
    with files.open_input_stream(path, compression=None) as stream:
        return stream.read()


def _read_bytes(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """File bytes, a bounded number of megabytes per batch, or why a file cannot be read."""
    for frame in frames:
        held, size = [], 0
        for row in frame.itertuples(index=False):
            data, error = None, row.error
            if error is None:
                try:
                    data = _file_bytes(row.path)
                except (OSError, ValueError) as problem:
                    error = _failure(row.path, problem)
            held.append((row.source_id, row.path, row.part, data, error))
            size += len(data or b"")
            if size >= BATCH_BYTES:
                yield pd.DataFrame(held, columns=READ)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=READ)


def read_corpus(listing: DataFrame) -> DataFrame:
    """``(source_id, path, part, text, metadata)`` of listed files (``source_id, path, part``).

    Bad UTF-8 is replaced, line ends become ``\\n``, JSON files are re-indented. Files without
    text drop out, and so do those that ``read_or_fail`` gives an error for.
    """
    return read_or_fail(listing).filter("error is null").drop("error")


def read_or_fail(listing: DataFrame) -> DataFrame:
    """Listed files as rows of one stream: a text, or the ``error`` that stands in its way.

    Each file is opened once. A missing or unreadable file, a path that names no location, and a
    type that this library does not parse (PDF) are errors; those of the listing pass through.
    """
    kind = extension(F.col("path"))
    cores = listing.sparkSession.sparkContext.defaultParallelism
    known = F.col("error") if "error" in listing.columns else F.lit(None).cast("string")
    unsupported = F.concat(F.lit("unsupported file type: "), "path")
    listed = listing.select(
        "source_id", "path", "part", F.coalesce(known, F.when(kind == ".pdf", unsupported)).alias("error")
    )
    loaded = listed.repartition(cores, "path").mapInPandas(
        _read_bytes, "source_id string, path string, part int, data binary, error string"
    )
    text = F.regexp_replace(F.make_valid_utf8(F.col("data").cast("string")), "\r\n?", "\n")
    rows = loaded.select(
        "source_id", "path", "part", text.alias("text"), kind.alias("file_type"), "error"
    )
    # One pass for all types: a union of two would open every file twice.
    json = F.col("file_type").eqNullSafe(".json")
    rows = rows.withColumn("_json", indent_json(F.when(json, F.col("text"))))
    rows = rows.withColumn("text", F.when(json, F.col("_json")).otherwise(F.col("text")))
    metadata = F.create_map(
        F.lit("file_path"), F.col("path"), F.lit("file_type"), F.col("file_type")
    )
    return rows.filter((F.length("text") > 0) | F.col("error").isNotNull()).select(
        "source_id", "path", "part", "text", metadata.alias("metadata"), "error"
    )


def read_files(sources: DataFrame) -> DataFrame:
    """Contents of single-file sources (``uri`` is the path), or why there are none."""
    listing = sources.select("source_id", F.col("uri").alias("path"), F.lit(0).alias("part"))
    return _contents(sources, read_or_fail(listing))


def read_tree(sources: DataFrame) -> DataFrame:
    """Contents of directory sources: every file that survives the filters, one part each.

    A directory that is missing is empty; a file in it that cannot be read is an error.
    """
    roots = sources.select("source_id", F.col("uri").alias("root"))
    return _contents(sources, read_or_fail(list_or_fail(roots)))


def read_codebase(sources: DataFrame) -> DataFrame:
    """As ``read_tree``, with the language of each file in its metadata."""
    return tag_language(read_tree(sources))


def _contents(sources: DataFrame, corpus: DataFrame) -> DataFrame:
    """Corpus rows as contents, with the source's own metadata on top."""
    user = sources.select("source_id", "kb_id", F.col("metadata").alias("user"))
    return corpus.join(user, "source_id").select(
        "source_id",
        "kb_id",
        "part",
        "text",
        merge_metadata(F.col("metadata"), F.col("user")).alias("metadata"),
        "error",
    )
