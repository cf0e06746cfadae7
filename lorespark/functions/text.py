"""Text expressions: token units, search terms, file names, glob patterns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_UNIT = r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+$"
TERM = r"[\p{L}\p{N}]+"
# Fixed value: marks that stand above or below the letter before and belong to its word.
MARKS = r"[\x{0300}-\x{0331}]+"
# Fixed value: how pages name each other.
WIKILINK = r"\[\[([^\[\]]+)\]\]"


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with a diacritic and the plain letter under each."""
    accented, plain = [], []
    for code in range(0x00C0, 0x0250):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)
        if len(base) > 1 and base[0].isascii() and base[0].islower():
            accented.append(letter)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


FOLD_FROM, FOLD_TO = _folding()


def token_units(text: Column) -> Column:
    """Words with the blanks before them; joined again they give back the exact text."""
    return F.regexp_extract_all(text, F.lit(TOKEN_UNIT), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without diacritics, whether they are part of the letter or follow it."""
    return F.translate(F.lower(F.regexp_replace(text, MARKS, "")), FOLD_FROM, FOLD_TO)


def terms(text: Column) -> Column:
    """Search terms: runs of letters and digits, lower-cased, without diacritics."""
    return F.regexp_extract_all(fold(text), F.lit(TERM), F.lit(0))


def normalized(text: Column) -> Column:
    """The terms of a text between single blanks, for phrase and prefix tests."""
    return F.concat(F.lit(" "), F.array_join(terms(text), " "), F.lit(" "))


def wikilinks(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(WIKILINK), F.lit(1))


def file_stem(title: Column) -> Column:
    """A page title as a file name without extension: its letters and digits, joined by dashes."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def isoformat(ts: Column) -> Column:
    """UTC timestamp as ISO text; the fraction shows only when there is one."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    shown = F.when(fraction == ".000000", F.lit("")).otherwise(fraction)
    return F.concat(seconds, shown, F.lit("+00:00"))


def glob_regex(glob: str) -> str:
    """A shell glob as a regex body; ``*`` also crosses ``/``."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        close = glob.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = glob[at + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            body = "^" + body[1:] if body.startswith("!") else re.sub(r"^\^", r"\\^", body)
            out.append(f"[{body}]")
            at = close
        else:
            out.append(re.sub(r"([^\w/ ])", r"\\\1", c))
        at += 1
    return "".join(out)


def any_glob(globs: list[str]) -> str | None:
    """One anchored regex for "matches any of the globs", with and without trailing ``/``."""
    bodies = []
    for glob in globs:
        for form in (glob, glob.rstrip("/")):
            if form and glob_regex(form) not in bodies:
                bodies.append(glob_regex(form))
    return rf"(?s)\A(?:{'|'.join(bodies)})\z" if bodies else None
