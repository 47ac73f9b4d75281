"""Small text and list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value in the raw files.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# First characters that a spreadsheet would read as a formula.
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r")


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~F.coalesce(c, F.lit("")).isin(*NULL_TOKENS), c)


def safe_cell(c: Column) -> Column:
    """Quote a text that would start a formula."""
    return F.when(F.substring(c, 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), c)).otherwise(c)


def safe_header(name: str) -> str:
    return "'" + name if name[:1] in FORMULA_STARTS else name


def split_names(c: Column, separator: str = ", ") -> Column:
    """Delimited text to an array of trimmed, non-empty names."""
    parts = F.split(F.coalesce(c, F.lit("")), separator.replace(" ", "[ ]"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    """Key of an unordered pair."""
    return F.least(a, b), F.greatest(a, b)


def orientation_flip(seed: int, date_text: Column, a: Column, b: Column) -> Column:
    """Coin that depends on the contest's own key only: first bit of a sha-256."""
    lo, hi = pair_key(a, b)
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), date_text, lo.cast("string"), hi.cast("string")), 256)
    byte = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    return byte.bitwiseAND(F.lit(1)) == 1


def hash_unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) from 32 bits of md5, equal on every engine and every retry."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
