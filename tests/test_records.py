"""File and record sources, resume and sinks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import edits as E
from folioflow.functions import json_walk as J
from folioflow.functions import strings as S
from folioflow.sources import files, records


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_lists_images_and_folders(spark, tmp_path):
    put(tmp_path / "list.txt", "﻿a.png\r\n\r\n # no\n  b.png \n#c\na.png")
    got = [(r.place, r.entry) for r in files.read_list(spark, str(tmp_path / "list.txt")).orderBy("place").collect()]
    assert got == [(0, "a.png"), (3, "b.png"), (5, "a.png")]
    with pytest.raises(Exception, match="gone.txt"):
        files.read_list(spark, str(tmp_path / "gone.txt")).collect()
    put(tmp_path / "in/a/x.png", b"\x89PNG\r\n\x1a\nrest")
    put(tmp_path / "in/y.jpg", b"\xff\xd8\xff\xe0")
    put(tmp_path / "in/z.png", b"text")
    fine, bad = files.checked_images(spark, str(tmp_path / "in"))
    assert sorted(r.kind for r in fine.collect()) == ["jpeg", "png"] and [r.file.endswith("z.png") for r in bad.collect()] == [True]
    put(tmp_path / "md/a/x.md", "# one")
    put(tmp_path / "md/y.txt", "no")
    assert [r.text for r in files.text_files(spark, str(tmp_path / "md")).collect()] == ["# one"]
    put(tmp_path / "json/p1.json", json.dumps({"text": "long enough"}))
    put(tmp_path / "json/p2.json", json.dumps({"text": "no"}))
    manifest = spark.createDataFrame([("p1", 7), ("p2", 8), ("p3", 9)], "page string, w int")
    assert [(r.page, r.w) for r in files.json_folder(spark, str(tmp_path / "json"), "text string", manifest, "page", 5).collect()] == [("p1", 7)]


def test_page_numbers(spark):
    specs = {"1-3,5-": [1, 2, 3, 5, 6], "2, 2,1": [1, 2], "7": None, "0-1": None, "3-2": None, "x": None, "6-": [6], "": None}
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    got = {r.s: r.n for r in df.select("s", files.page_numbers(F.col("s"), F.lit(6)).alias("n")).collect()}
    assert got == specs


def test_tolerant_scan_and_resume(spark, tmp_path):
    lines = ['﻿{"path":"a","page":1,"text":"x"}', '{"path":"a","page":2,"error":"e"}', '{"path":"b","page":1,"text":"y"}\0', "", '{"path":"c","pa', "hello", '{"path":"d","page":1}', '{"path":"e","text":"no page"}']
    put(tmp_path / "out/part.jsonl", "\n".join(lines))
    rows = records.scan(spark, str(tmp_path / "out"))
    assert sorted(r.kind for r in rows.collect()) == ["blank", "cut", "damaged", "error", "foreign", "foreign", "record", "record"]
    inputs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("e", 1)], "path string, page int")
    assert sorted(tuple(r) for r in records.pending(inputs, rows).collect()) == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError, match="twice"):
        records.pending(inputs.union(inputs.limit(1)), rows)
    assert {r.status: r.n for r in records.summary(inputs, rows).collect()} == {"done": 2, "failed": 1, "not_run": 1}
    assert records.scan(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="no record"):
        records.repaired(spark, str(tmp_path / "out"), str(tmp_path / "fixed"))
    put(tmp_path / "cut/part.jsonl", "\n".join([lines[1], lines[7], lines[4]]))
    assert sorted(r.kind for r in records.repaired(spark, str(tmp_path / "cut"), str(tmp_path / "fixed")).collect()) == ["error", "record"]


def test_sinks(spark, tmp_path):
    one, two = spark.range(5).toDF("x"), spark.range(1, 6).toDF("x")
    path = str(tmp_path / "new")
    records.write_new(one, path)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        records.write_new(one, path)
    assert records.freeze(one.repartition(4), path) == "identical"
    with pytest.raises(ValueError, match="other rows"):
        records.freeze(two, path)
    records.publish(two, str(tmp_path / "put"))
    assert spark.read.parquet(str(tmp_path / "put")).count() == 5 and not (tmp_path / "put.part").exists()
    run = str(tmp_path / "run")
    assert records.prepared(spark, run, {"a": 1}) is False
    assert records.prepared(spark, run, {"a": 1}, resume=True) is True
    for change, resume in (({"a": 1}, False), ({"a": 2}, True)):
        with pytest.raises(ValueError, match="holds a run"):
            records.prepared(spark, run, change, resume)
    rows, expected = spark.createDataFrame([(1,), (1,), (2,), (9,)], "k int"), spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert {r.k: r.problem for r in records.complete(rows, expected, "k").collect()} == {1: "repeated", 3: "missing", 9: "unexpected"}


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.without_stops(F.lit("  a b　<|end|><|endoftext|>"))) == "a b"
    assert one(S.without_tail(F.array(*map(F.lit, [5, 1, 2, 1, 2])), [1, 2])) == [5]
    assert one(S.numbers(F.lit("a -1.5 b 2,000 c3"))) == ["-1.5", "2,000", "3"]
    assert one(S.document_family(F.lit("deck_slide_12.png"))) == "deck" and one(S.document_family(F.lit("plain"))) == "plain"
    assert one(S.assignments(F.lit("# c\nA:BOOL=ON\nB:STRING=x=y\nA:BOOL=OFF\nbad"))) == {"A": "OFF", "B": "x=y"}
    assert one(J.first_object(F.lit('x {"a":{"b":1}} {"c":2}'))) == '{"a":{"b":1}}' and one(J.first_object(F.lit("none"))) is None
    assert one(S.markdown_links(F.lit("[a](x.md#h) [b](http://q) [c](#f) [d](y/z.md)"))) == ["x.md", "y/z.md"]
    assert one(E.edits(F.split(F.lit("a b c d"), " "), F.split(F.lit("a x c"), " "))) == 2
    assert one(E.relative_edits(F.lit("abc"), F.lit("abd"))).value == pytest.approx(1 / 3) and one(E.relative_edits(F.lit(""), F.lit(""))).value == 0
    assert one(S.table_text(F.lit("a<b>x</b><table><tr><td>1</td></tr></table>c"))).split() == ["a<b>x</b>", "1", "c"]
    assert one(J.canonical(F.lit('{"b": 1, "a": "x"}'))) == '{"a":"x","b":1}'


def test_runs_kept_either_way(spark, tmp_path):
    put(tmp_path / "run/a.json", json.dumps({"result": {"text": "x", "n": 1}}))
    put(tmp_path / "run/b.json", json.dumps({"error": "none"}))
    put(tmp_path / "run/c.txt", "no")
    put(tmp_path / "report.json", json.dumps({"inputs": [{"path": "pages/p1/i.png"}, {"path": "pages/p2/i.png"}, {"path": "pages/p3/i.png"}], "samples": [{"outputs": [{"text": "y", "n": 2}, {"text": None}]}, {"outputs": []}]}))
    got = lambda name: sorted((r.page, r.result.text, r.result.n) for r in files.run_outputs(spark, str(tmp_path / name), "text:string,n:int").collect())
    assert got("run") == [("a", "x", 1)] and got("report.json") == [("p1", "y", 2), ("p2", None, None)]
    put(tmp_path / "none.json", "{}")
    assert got("none.json") == []


def test_families_categories_and_names(spark):
    from folioflow.operators import select

    names = ["book_page_3.png", "talk_page_12.pdf_5", "deck_page_7.pptx", "plain.png", None]
    rows = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.deck_family(F.col("n"))).collect()]
    assert rows[3:] == ["plain.png", None] and rows[0] == "book" and rows[2] == "deck"
    df = spark.createDataFrame([("a", 5), (None, 100), (None, 99), (None, None)], "c string, n int")
    assert [r[0] for r in df.select(select.gate_category(F.col("c"), F.col("n"))).collect()] == ["a", "other", None, None]
    kept, dropped = select.without_named(spark.createDataFrame([("x/a1.png",), ("y\\a1.png",), ("a1/b.png",), (None,)], "p string"), "p", "^a")
    assert sorted(r.p or "" for r in kept.collect()) == ["", "a1/b.png"] and [r.name for r in dropped.collect()] == ["a1.png"]
