"""Token windows and code symbols. All narrow: one row in, its chunks out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.arrays import bind
from lorespark.functions.text import token_units
from lorespark.schemas import CHUNK_OVERLAP, CHUNK_SIZE

Tokenizer = Callable[[Column], Column]

# File extension -> language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".lua": "lua",
    ".sh": "shell",
    ".bash": "shell",
}

# How a top-level class or function starts, per language; group 1 is its name.
CLASS_START = {
    "python": r"class\s+([\p{L}\p{N}_]+)",
    "javascript": r"class\s+([\p{L}\p{N}_]+)",
    "typescript": r"(?:export\s+)?class\s+([\p{L}\p{N}_]+)",
}
FUNCTION_START = {
    "python": r"def\s+([\p{L}\p{N}_]+)",
    "javascript": r"(?:export\s+)?(?:async\s+)?function\s+([\p{L}\p{N}_]+)",
    "typescript": r"(?:export\s+)?(?:async\s+)?function\s+([\p{L}\p{N}_]+)",
}


def chunk_config(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> tuple[int, int]:
    """Validated window settings."""
    if size <= 0:
        raise ValueError(f"chunk size must be positive, got {size}")
    if overlap < 0:
        raise ValueError(f"chunk overlap must not be negative, got {overlap}")
    if overlap >= size:
        raise ValueError(f"chunk overlap ({overlap}) must be less than chunk size ({size})")
    return size, overlap


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """``array<string>`` of overlapping windows, one at every multiple of the step.

    A last window that lies inside the one before it is kept: there are ``ceil(n / step)``.
    """
    step = max(1, size - overlap)

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(t) - 1, F.lit(step))
        return F.transform(starts, lambda at: F.array_join(F.slice(t, at + 1, size), ""))

    return bind(tokens, lambda t: F.when(F.size(t) > 0, cut(t)))


def token_chunk(
    contents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    tokenizer: Tokenizer = token_units,
) -> DataFrame:
    """Overlapping token windows of ``text``; other columns are copied to each chunk.

    The default token is a word with the blanks before it. A vocabulary-based tokenizer plugs
    in as any expression (or ``pandas_udf``) from text to ``array<string>`` of token texts;
    the window arithmetic does not change.
    """
    size, overlap = chunk_config(size, overlap)
    kept = [c for c in contents.columns if c != "text"]
    return contents.select(
        *kept,
        F.posexplode(windows(tokenizer(F.col("text")), size, overlap)).alias(
            "chunk_index", "content"
        ),
    )


def extension(path: Column) -> Column:
    """Lower-case suffix of the last path segment; a leading dot alone is not a suffix."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def tag_language(contents: DataFrame, path: str = "metadata.file_path") -> DataFrame:
    """Put ``language`` into the metadata, from the extension of the file path."""
    tagged = F.map_concat(
        F.map_filter("metadata", lambda k, _: k != "language"),
        F.create_map(F.lit("language"), language_of(F.col(path))),
    )
    return contents.withColumn("metadata", tagged)


def _blocks(text: Column, language: str) -> Column:
    """``array<struct<symbol_type,symbol_name,block>>``; null when nothing starts a symbol."""
    cls, fun = CLASS_START[language], FUNCTION_START[language]
    # A block takes its whole start first, so that a start of several lines is not cut within.
    head = F.regexp_extract(text, rf"(?md)\A(?!{cls}|{fun})[\s\S]*?(?=^(?:{cls}|{fun})|\z)", 0)
    blocks = F.regexp_extract_all(text, F.lit(rf"(?md)^(?:{cls}|{fun})[\s\S]*?(?=^(?:{cls}|{fun})|\z)"), F.lit(0))
    pieces = F.concat(F.array(head), blocks)
    starts_class, starts_fun = rf"\A{cls}", rf"\A{fun}"

    def describe(block: Column) -> Column:
        kind = (
            F.when(block.rlike(starts_class), "class")
            .when(block.rlike(starts_fun), "function")
            .otherwise("module")
        )
        name = (
            F.when(block.rlike(starts_class), F.regexp_extract(block, starts_class, 1))
            .when(block.rlike(starts_fun), F.regexp_extract(block, starts_fun, 1))
        )
        return F.struct(
            kind.alias("symbol_type"), name.alias("symbol_name"), block.alias("block")
        )

    found = text.rlike(f"(?md)^(?:{cls}|{fun})")
    solid = F.filter(pieces, lambda b: b.rlike(r"\S"))
    return F.when(found, F.transform(solid, describe))


def subdivide(
    block: Column, size: int, overlap: int, tokenizer: Tokenizer = token_units
) -> Column:
    """A block of at most ``size`` tokens stays whole, a larger one is cut into windows."""
    return bind(
        tokenizer(block),
        lambda t: F.when(F.size(t) <= size, F.array(block)).otherwise(windows(t, size, overlap)),
    )


def symbol_chunk(
    contents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    tokenizer: Tokenizer = token_units,
) -> DataFrame:
    """Split code at top-level classes and functions; needs ``metadata.language``.

    Text before the first symbol becomes a ``module`` block. Other languages, and files
    without a symbol, get plain token windows. Adds ``symbol_type`` and ``symbol_name``.
    """
    size, overlap = chunk_config(size, overlap)
    language = F.col("metadata")["language"]
    blocks = F.lit(None)
    for name in CLASS_START:
        blocks = F.when(language == name, _blocks(F.col("text"), name)).otherwise(blocks)

    def plain(text: Column) -> Column:
        return F.transform(
            windows(tokenizer(text), size, overlap),
            lambda w: F.struct(
                F.lit(None).cast("string").alias("symbol_type"),
                F.lit(None).cast("string").alias("symbol_name"),
                w.alias("content"),
            ),
        )

    def by_symbol(found: Column) -> Column:
        return F.flatten(
            F.transform(
                found,
                lambda b: F.transform(
                    subdivide(b["block"], size, overlap, tokenizer),
                    lambda w: F.struct(
                        b["symbol_type"].alias("symbol_type"),
                        b["symbol_name"].alias("symbol_name"),
                        w.alias("content"),
                    ),
                ),
            )
        )

    pieces = bind(blocks, lambda b: F.when(b.isNull(), plain(F.col("text"))).otherwise(by_symbol(b)))
    kept = [c for c in contents.columns if c != "text"]
    out = contents.select(*kept, F.posexplode(pieces).alias("chunk_index", "piece"))
    return out.select(*kept, "chunk_index", "piece.*")


def assign_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Deterministic id from source, part and position, so a recomputed task agrees."""
    key = F.concat_ws(":", "source_id", F.col("part"), F.col("chunk_index"))
    return chunks.withColumn("chunk_id", F.sha2(key, 256))
