"""JSON of any depth by Spark's VARIANT: canonical text, walks, non-finite numbers, the first object inside noise."""

from __future__ import annotations

import functools
import json as python_json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.sources.workspace import stored


def canonical(json: Column) -> Column:
    """A JSON value with sorted names at every depth and no spaces; null for what isn't JSON or repeats a name.

    Numbers come as VARIANT holds them: decimals keep all their digits, ``1.0`` is ``1``.
    """
    return F.to_json(F.try_parse_json(json))


def json_digest(json: Column) -> Column:
    return F.sha2(canonical(json), 256)


def _as_python(texts: pa.Array) -> pa.Array:
    def one(text):
        try:
            return python_json.dumps(python_json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())


def canonical_float64(json: Column) -> Column:
    """As ``canonical``, with numbers as Python's json module writes them (64-bit floats), for digests made by it; the last of equal names wins."""
    return F.arrow_udf(_as_python, "string")(json)


def _first(texts: pa.Array) -> pa.Array:
    decoder = python_json.JSONDecoder()

    def one(text):
        start = text.find("{")
        if start < 0:
            return None
        try:
            return text[start : decoder.raw_decode(text, start)[1]]
        except (ValueError, RecursionError):
            return None

    return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())


def first_object(text: Column) -> Column:
    """The JSON object that begins at the first brace of a noisy text, as written; null if none is whole there."""
    return F.arrow_udf(_first, "string")(text)


def walk(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, name, kind, value): everything inside a JSON column, at any depth.

    ``path`` has a place for each depth (from 0, names in sorted order), ``name`` is null for items of an array, ``kind`` is
    object, array, string, number, boolean or null, and ``value`` the string itself or the JSON text of other leaves. Text
    that isn't JSON and a bare scalar have no inside. Each depth is a job over the containers of the one above.
    """
    said = F.schema_of_variant("value")
    kinds = {"object": said.startswith("OBJECT"), "array": said.startswith("ARRAY"), "string": said == "STRING", "boolean": said == "BOOLEAN", "null": said == "VOID"}
    kind = functools.reduce(lambda w, k: w.when(kinds[k], k), kinds, F).otherwise("number")
    text = F.when(F.col("kind") == "string", F.variant_get("value", "$", "string")).when(~F.col("kind").isin("object", "array"), F.to_json("value"))
    holders = rows.select(F.col(key).alias("row"), F.array().cast("array<int>").alias("path"), F.try_parse_json(json).alias("holder")).where("holder is not null")
    levels = []
    while not levels or not holders.isEmpty():
        inside = holders.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("holder").outer()))
        inside = inside.select("row", F.concat("path", F.array("pos")).alias("path"), F.col("key").alias("name"), kind.alias("kind"), "value")
        held = F.when(F.col("kind").isin("object", "array"), F.col("value")).alias("holder")
        levels.append(stored(inside.select("row", "path", "name", "kind", text.alias("value"), held), "json-level"))
        holders = levels[-1].where("holder is not null").select("row", "path", "holder")
    return functools.reduce(DataFrame.unionByName, [x.drop("holder") for x in levels]).withColumnRenamed("row", key)


def strings(walked: DataFrame, key: str) -> DataFrame:
    """(key, text): every string and every name of an object that ``walk`` found."""
    return walked.where("name is not null").select(key, F.col("name").alias("text")).union(walked.where("kind = 'string'").select(key, "value"))


def named(rows: DataFrame, key: str, json: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name): which of ``names`` a JSON column names at any depth.

    A part of a string or object name, cut at ``/``, ``\\`` and ``:``, names a file by its name or stem, URL-quoted or not, with
    or without one more extension.
    """
    parts = strings(walk(rows, key, json), key).select(key, F.explode(F.split("text", r"[/\\:]")).alias("part"))
    # quoted plus signs stay, and so does what isn't a quotation
    plain = F.coalesce(F.try_url_decode(F.replace("part", F.lit("+"), F.lit("%2B"))), F.col("part"))
    forms = parts.select(key, F.explode(F.array_distinct(F.array("part", plain))).alias("part"))
    forms = forms.select(key, F.explode(F.array_distinct(F.array("part", F.regexp_replace("part", r"\.[^.]*$", "")))).alias("part")).distinct()
    stem = F.regexp_replace(F.col(name), r"(?<=.)\.[^.]*$", "")
    known = names.select(F.col(name).alias("whole"), F.explode(F.array_distinct(F.array(F.col(name), stem))).alias("part")).distinct()
    return forms.join(known, "part").select(key, F.col("whole").alias(name)).distinct()


#: What a bare word for a number that isn't finite looks like.
_BARE = r"(^|[\[:,\s])-?(NaN|Infinity)($|[\],}\s])"


def has_non_finite(json: Column) -> Column:
    """Whether a JSON text holds a number that isn't finite, at any depth: a bare NaN or Infinity, or one beyond 64-bit floats.

    Strings are cut out first, so their text doesn't count; null stays null.
    """
    plain = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', '""')
    beyond = F.exists(F.regexp_extract_all(plain, F.lit(r"(-?\d+(?:\.\d+)?[eE][-+]?\d+|-?\d{300,})"), 1), lambda n: F.abs(n.cast("double")) == float("inf"))
    return plain.rlike(_BARE) | beyond


def non_finite_columns(df: DataFrame) -> Column:
    """The names of a row's columns that hold NaN or an infinity at any depth of arrays, structs and maps."""

    def bad(column: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.DoubleType | T.FloatType):
            return F.coalesce(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(False))
        if isinstance(kind, T.StructType):
            found = [b for f in kind.fields if (b := bad(column[f.name], f.dataType)) is not None]
            return functools.reduce(Column.__or__, found) if found else None
        if isinstance(kind, T.MapType):
            return bad(F.map_entries(column), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
        if isinstance(kind, T.ArrayType):
            probe = bad(F.lit(None).cast(kind.elementType), kind.elementType)
            return None if probe is None else F.coalesce(F.exists(column, lambda x: bad(x, kind.elementType)), F.lit(False))
        return None

    found = [F.when(b, f.name) for f in df.schema.fields if (b := bad(df[f.name], f.dataType)) is not None]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
