"""Text normalisation as column expressions; only the ASCII fold needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Company designations that are dropped from names.
LEGAL_WORDS = (
    r"private\s+limited", r"pvt\s+ltd", r"pvt\s+limited", r"p\s+ltd", r"p\s+limited", "llp", "llc", "inc", "incorporated", "corp", "corporation", "ltd", "limited", "co", "company",
    "gmbh", "sa", "sarl", "sas", "sasu", "eurl", "spa", "bv", "nv", "traders", "enterprises", "services", "solutions", "systems", "group", "holdings", "technologies", "associates",
    "partners", "center", "shop", "store",
)
#: Address words that are written out.
ADDRESS_WORDS = {"rd": "road", "st": "street", "ave": "avenue", "ln": "lane", "blvd": "boulevard", "apt": "apartment", "no": "number"}


def present(c: Column) -> Column:
    """The text, or '' if it is null, empty or the word None."""
    return F.when(c.isNull() | (c == "None"), F.lit("")).otherwise(c)


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"))


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition without what is not ASCII."""
    return _fold(present(c))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


# -- frame normalisers: whole columns, Unicode kept -----------------------------
def frame_name(c: Column) -> Column:
    lowered = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(lowered, r"(?U)[^\w\s]", " "))


def frame_address(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "))


def frame_country(c: Column) -> Column:
    return F.trim(F.upper(F.coalesce(c, F.lit("UNKNOWN"))))


# -- pair normalisers: ASCII, for features -----------------------------------
def name_of_folded(folded: Column) -> Column:
    spaced = F.replace(F.replace(F.lower(folded), F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" "))
    plain = F.regexp_replace(spaced, r"[^\w\s]", " ")
    return squeeze(F.regexp_replace(plain, rf"\b(?:{'|'.join(LEGAL_WORDS)})\b", " "))


def normalize_name(c: Column) -> Column:
    return name_of_folded(ascii_fold(c))


def address_of_folded(folded: Column) -> Column:
    out = F.lower(folded)
    for short, long in ADDRESS_WORDS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return squeeze(F.regexp_replace(out, r"[^\w\s]", " "))


def normalize_address(c: Column) -> Column:
    return address_of_folded(ascii_fold(c))


def normalize_country(c: Column) -> Column:
    return F.when(c.isNull() | c.isin("", "None"), F.lit("UNKNOWN")).otherwise(F.upper(F.trim(ascii_fold(c))))


def numeric_tokens(c: Column) -> Column:
    """Distinct runs of one to six digits that stand as words."""
    return F.array_distinct(F.regexp_extract_all(present(c), F.lit(r"(?U)\b\d{1,6}\b"), 0))


def significant_tokens(normalised: Column, least: int = 3) -> Column:
    """Distinct words of at least ``least`` letters or digits of a name-normalised ASCII text, without legal words."""
    return F.array_distinct(F.regexp_extract_all(name_of_folded(normalised), F.lit(rf"\b[a-z0-9]{{{least},}}\b"), 0))


def id_list(c: Column) -> Column:
    """The ids of a comma list: trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def f_half(p: Column, r: Column) -> Column:
    """F0.5, zero if both parts are."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))
