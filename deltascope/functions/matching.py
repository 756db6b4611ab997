"""Reading what a user typed, and comparing it with what was written."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted date notations, in the order they are tried.
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy")

#: Inverse of the odd number in `deletion_keys`, modulo 2 ** 64.
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def amount(text: Column) -> Column:
    """'1 234,56' -> 1234.56; white space of any kind goes, a comma is a point; NULL if that isn't a number."""
    return F.translate(F.regexp_replace(text, r"(?U)\s", ""), ",", ".").try_cast("decimal(38,10)")


def typed_day(text: Column) -> Column:
    shaped = F.trim(text)
    patterns = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$")
    return F.coalesce(*[F.when(shaped.rlike(p), F.try_to_date(shaped, f)) for p, f in zip(patterns, DATE_FORMATS, strict=True)])


def one_edit_apart(a: Column, b: Column) -> Column:
    """Optimal string alignment distance at most 1: an insertion, deletion, substitution, or swap of neighbours."""
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b,
    )
    return F.levenshtein(a, b, 1).between(0, 1) | ((F.length(a) >= 2) & (F.length(a) == F.length(b)) & swapped)


@F.pandas_udf(T.ArrayType(T.LongType()))
def deletion_keys(texts: pd.Series) -> pd.Series:
    """Hashes of a text and of the text without any one of its characters.

    Texts that are one edit apart (an insertion, deletion, substitution, or swap of
    neighbours) share one of these. A text's hash is a sum over its characters with
    the powers of an odd number, so all variants come from one prefix sum: as many
    steps as the text has characters.
    """
    step = np.uint64(0x9E3779B97F4A7C15)

    def keys(text: str | None):
        if text is None:
            return None
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        n, rest = len(codes), max(len(codes) - 1, 0)
        powers, upto = np.full(n + 1, step), np.zeros(n + 1, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        # character i counts with power n - 1 - i, so what stands before a gap moves down by one
        np.cumsum(codes * powers[:n][::-1], out=upto[1:])
        without = upto[:n] * INVERSE + (upto[n] - upto[1:])
        # the length counts too: equal sums of different lengths are no match
        sizes = powers[[n, rest]] * np.array([n, rest], np.uint64)
        return np.unique(np.concatenate([upto[n:] + sizes[:1], without + sizes[1:]])).view(np.int64)

    with np.errstate(over="ignore"):
        return texts.map(keys)


def glob(name: Column, patterns) -> Column:
    """Whether a name matches any of the patterns with * and ?, in any case."""
    found = F.lit(False)
    for p in patterns:
        regex = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else "\\" + c for c in p.lower())
        found = found | F.lower(name).rlike(f"^{regex}$")
    return found


def trivial(text: Column) -> Column:
    """Of a canonical text: NULL, blank or zero."""
    from .canonical import body, number, tag

    return (tag(text) == "N") | ((tag(text) == "T") & (F.trim(body(text)) == "")) | F.coalesce(number(text) == 0, F.lit(False))
