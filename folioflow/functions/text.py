"""Text columns: words, families, distances, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_list(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def collapsed(text: Column) -> Column:
    """ASCII white space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def url_family(url: Column) -> Column:
    """The host of a URL, lower-cased."""
    return F.lower(F.regexp_extract(url, "^[a-z]+://([^/]+)", 1))


def html_text(html: Column) -> Column:
    """Text of markup: scripts and styles go, tags become spaces, white space collapses."""
    plain = F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return collapsed(F.regexp_replace(plain, "(?s)<[^>]*>", " "))


def seeded_rank(seed: str, *parts: Column) -> Column:
    """A pseudorandom rank: SHA-256 of the seed and the parts with NUL between."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), *(p.cast("string") for p in parts)), 256)


def first_divergence(a: Column, b: Column) -> Column:
    """First index (from 0) where two arrays differ; the shorter length if one is a prefix; null if equal."""
    at = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: F.get(a, i - 1).eqNullSafe(F.get(b, i - 1))), False)
    return F.when(a == b, None).when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b)))
