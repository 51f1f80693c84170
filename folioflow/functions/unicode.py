"""Unicode normal forms of text columns, over Arrow batches (Arrow's own utf8_normalize leaves composed forms decomposed)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.strings import collapsed_white
from folioflow.sources.workspace import small_batches

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


@functools.cache
def _form(form: str):
    if form not in FORMS:
        raise ValueError(f"{form} is none of {', '.join(FORMS)}")

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def normal_form(text: Column, form: str = "NFC") -> Column:
    """A text in a Unicode normal form; null stays null."""
    return _form(form)(text)


def in_forms(rows: DataFrame, text: str, forms: str) -> DataFrame:
    """The rows with a text brought into the forms that the array ``forms`` names, one after another; one Python worker a task, however many forms."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [t if t is None or t.isascii() else functools.reduce(lambda x, f: unicodedata.normalize(f, x), f or (), t) for t, f in zip(batch[text].to_pylist(), batch[forms].to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, pa.string()))

    return rows.mapInArrow(run, rows.schema).drop(forms)


def normal_text(text: Column) -> Column:
    """NFC with every run of white space (29 code points) as one space, none at the ends."""
    return collapsed_white(normal_form(text, "NFC"))


def furniture(text: Column, least: int = 4) -> Column:
    """A header or footer by its letters alone: NFKC without decimal digits, marks, white space and ``_``, lower-cased; null below ``least``."""
    plain = F.lower(F.regexp_replace(normal_form(text, "NFKC"), r"[^\p{L}\p{Nl}\p{No}]+", ""))
    return F.when(F.length(plain) >= least, plain)
