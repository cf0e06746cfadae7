"""Main text of raw web pages, by declared rules that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose whole content is not main text.
BOILERPLATE = ["head", "script", "style", "noscript", "nav", "header", "footer", "aside", "form"]
# Elements that begin and end a line.
LINE_BREAKING = "p|div|h[1-6]|li|ul|ol|br|hr|table|tr|section|article|main|blockquote|pre|dl|dt|dd"
# Character references; the ampersand itself must come last.
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&amp;", "&"),
]
TITLE = r"(?is)<title[^>]*>(.*?)</title"

# Comments and boilerplate elements, whichever begins first.
SKIPPED = "|".join(
    [
        r"<!--.*?-->",
        *[rf"<{tag}(?:[ \t\r\n][^>]*)?>.*?</{tag}[ \t\r\n]*>" for tag in BOILERPLATE],
    ]
)
# The rule chain as (pattern, replacement), shared with any engine that has plain regexes.
RULES: list[tuple[str, str]] = [
    (rf"(?is){SKIPPED}", ""),
    (rf"(?i)</?(?:{LINE_BREAKING})(?:[ \t\r\n/][^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
    *ENTITIES,
    (r"[ \t\r\x{00A0}]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]
TITLE_RULES: list[tuple[str, str]] = [*ENTITIES, (r"[ \t\r\n]+", " "), (r"^ | $", "")]


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        if (pattern, new) in ENTITIES:
            text = F.replace(text, F.lit(pattern), F.lit(new))
        else:
            text = F.regexp_replace(text, pattern, new)
    return text


def page_title(html: Column) -> Column:
    return rewritten(F.regexp_extract(html, TITLE, 1), TITLE_RULES)


def page_body(html: Column) -> Column:
    return rewritten(html, RULES)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``text`` and ``title`` beside each page's other columns; pages without text drop out.

    The emptiness test is part of the row generator: as a filter it would be pushed down and
    run the whole rule chain a second time.
    """
    kept = [c for c in pages.columns if c != "html"]
    html = F.col("html")
    found = F.array(F.struct(page_title(html).alias("title"), page_body(html).alias("text")))
    return pages.select(*kept, F.inline(F.filter(found, lambda p: F.length(p["text"]) > 0)))
