"""The records data source: byte ranges, damage, refusals, repair and append, failed writes."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.sources import record_source as R


def record(k, text="x", **more):
    return json.dumps({"path": f"p{k}", "page": k, "text": text, **more}, ensure_ascii=False)


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


@pytest.fixture
def read(spark):
    R.register(spark)
    return lambda path, **options: spark.read.format("records").options(**options).load(str(path))


def test_every_range_gives_each_line_once(read, tmp_path):
    lines = [record(k, "é" * (k * 7 % 50)) for k in range(60)] + ["", '{"path":"e","page":2,"error":"bad"}', record(99) + "\0", "\r"]
    data = b"\xef\xbb\xbf" + "\n".join(lines).encode() + b"\n" + b'{"path":"cut","text":"\xc3'
    put(tmp_path / "in", "a.jsonl", data)
    put(tmp_path / "in", "b.jsonl", record(7).encode())
    put(tmp_path / "in", "empty.jsonl", b"")
    put(tmp_path / "in", "_hidden", b"\xff")
    want = None
    for size in (1 << 20, 1000, 64, 7, 1):
        rows = read(tmp_path / "in", range=size).select(F.regexp_extract("file", "[^/]+$", 0).alias("f"), "offset", "kind", "path", "page").collect()
        got = sorted(map(tuple, rows))
        want = want or got
        assert got == want and len(got) == 66
    assert [k for _, _, k, _, _ in want].count("record") == 61 and {k for _, _, k, _, _ in want} == {"record", "error", "cut", "damaged", "blank"}
    for _, offset, kind, path, _ in want[:5]:
        assert data[offset:].removeprefix(b"\xef\xbb\xbf").startswith(f'{{"path": "{path}"'.encode()) and kind == "record"
    assert read(tmp_path / "none").count() == 0


def test_foreign_lines_and_bytes(read, tmp_path):
    put(tmp_path / "notes", "a", b"hello\n" + record(1).encode() + b"\n[1]\n{\"x\":1}\n")
    with pytest.raises(Exception, match="byte 0: no record"):
        read(tmp_path / "notes").collect()
    assert sorted(r.kind for r in read(tmp_path / "notes", foreign="keep").collect()) == ["foreign"] * 3 + ["record"]
    put(tmp_path / "bytes", "a", record(1).encode() + b'\n{"path":"\xff"}\n')
    with pytest.raises(Exception, match="not UTF-8"):
        read(tmp_path / "bytes", foreign="keep").collect()


def test_append_repairs_the_end(spark, read, tmp_path):
    out = tmp_path / "out"
    put(out, "a.jsonl", record(1).encode() + b"\n" + b'{"path":"cut","te')
    put(out, "b.jsonl", record(2).encode())
    put(out, "c.jsonl", record(3).encode() + b"\n")
    before = (out / "c.jsonl").stat().st_mtime_ns
    more = spark.createDataFrame([(record(k),) for k in range(10, 40)], "line string").repartition(3)
    more.write.format("records").mode("append").save(str(out))
    rows = read(out).collect()
    assert sorted(r.page for r in rows if r.kind == "record") == [1, 2, 3, *range(10, 40)] and len(rows) == 33
    assert (out / "a.jsonl").read_bytes() == record(1).encode() + b"\n" and (out / "b.jsonl").read_bytes().endswith(b"\n")
    assert (out / "c.jsonl").stat().st_mtime_ns == before and not [p for p in out.iterdir() if p.name.startswith("_")]
    more.limit(0).write.format("records").mode("append").save(str(out))
    more.write.format("records").mode("append").save(str(tmp_path / "new"))
    assert read(out).count() == 33 and read(tmp_path / "new").count() == 30
    with pytest.raises(Exception, match="never overwritten"):
        more.write.format("records").mode("overwrite").save(str(out))


def test_a_failed_write_changes_nothing(spark, read, tmp_path):
    out = tmp_path / "out"
    put(out, "a.jsonl", record(1).encode() + b"\n" + b'{"path":"cut')
    old = (out / "a.jsonl").read_bytes()
    bad = spark.range(20).select(F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise(F.lit(record(5))).cast("string").alias("line"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("records").mode("append").save(str(out))
    assert (out / "a.jsonl").read_bytes() == old and [p.name for p in out.iterdir()] == ["a.jsonl"]
    put(tmp_path / "list", "inputs.txt", b"a.png\nb.png")
    with pytest.raises(Exception, match="nothing is appended"):
        spark.createDataFrame([(record(1),)], "line string").write.format("records").mode("append").save(str(tmp_path / "list"))
    assert [p.name for p in (tmp_path / "list").iterdir()] == ["inputs.txt"]
