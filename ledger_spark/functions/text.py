"""Text helpers: account numbers, prefixes, extraction artefacts, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledger_spark import rules


def normalized_account(number: Column) -> Column:
    """Without blanks and dashes, masks as X, upper case; null is empty."""
    return F.upper(F.translate(F.coalesce(number, F.lit("")), "* -", "X"))


def shown_account(number: Column) -> Column:
    """Made-up numbers (account-...) are shown as null."""
    return F.when(~number.rlike("(?i)^account-[a-z0-9]{6,}$"), number)


def prefix(description: Column, words: int = 3) -> Column:
    return F.array_join(F.slice(F.split(F.lower(F.trim(F.coalesce(description, F.lit("")))), r"\s+"), 1, words), " ")


def clean_cell(value: Column) -> Column:
    """Letters and marks that extraction repeated three times or more, once; digits as they are; white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"([A-Za-z$.,:/#])\1{2,}", "$1"), r"\s+", " "))


def clean_ocr(value: Column) -> Column:
    """White space squeezed, thousands' commas out, O, I and B between digits as digits; texts of up to 3 characters go."""
    out = F.regexp_replace(value, r"\s+", " ")
    for pattern, to in ((r"(\d),(\d{3})", "$1$2"), (r"O(\d)", "0$1"), (r"(\d)I(\d)", "$1 1 $2"), (r"(\d)B(\d)", "$1 8 $2")):
        out = F.regexp_replace(out, pattern, to)
    out = F.trim(out)
    return F.when(F.length(out) > 3, out).otherwise("")


def markers(content: Column, mark: str = "%%EOF") -> Column:
    """Occurrences of a mark in bytes but the first: saves after the first one."""
    return F.greatest(F.size(F.split(F.decode(content, "ISO-8859-1"), "\\Q" + mark + "\\E")) - 2, F.lit(0))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(rules.EXTENSIONS)
