"""Archive and web sources, and the audits' edges, on small fixtures."""

import http.server
import io
import tarfile
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.operators import audits
from folioflow.sources import archives, web


def tar_bytes(entries, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        folder = tarfile.TarInfo("a")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, content in entries:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    at = tmp_path_factory.mktemp("shards")
    (at / "one.tar").write_bytes(tar_bytes([("a/1.pdf", b"p1"), ("a/2.txt", b"t2"), ("a/3.pdf", b""), ("a/1.pdf", b"again")]))
    (at / "two.tar.gz").write_bytes(tar_bytes([("b/1.pdf", b"x" * 100_000), ("b/ü.pdf", b"u")], "w:gz"))
    whole = tar_bytes([("c/1.pdf", b"first"), ("c/2.pdf", b"y" * 9000)])
    (at / "cut.tar").write_bytes(whole[: whole.index(b"y") + 700])
    (at / "none.tar").write_bytes(b"")
    (at / "junk.tar").write_bytes(b"no archive" * 99)
    (at / "sub dir").mkdir()
    with zipfile.ZipFile(at / "sub dir" / "three.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/1.pdf", b"z1")
        z.writestr("d/1.jpg", b"j1")
    (at / "bad.zip").write_bytes(b"PK nothing")
    return str(at)


def test_members_of_archives(spark, shards):
    rows = [(r.archive.rsplit("/", 1)[1], r.member, r.content and bytes(r.content), r.problem) for r in archives.members(spark, shards, "*.pdf").collect()]
    fine = sorted((a, m, len(c)) for a, m, c, p in rows if p is None)
    assert fine == [("cut.tar", "c/1.pdf", 5), ("one.tar", "a/1.pdf", 2), ("one.tar", "a/1.pdf", 5), ("one.tar", "a/3.pdf", 0), ("three.zip", "d/1.pdf", 2), ("two.tar.gz", "b/1.pdf", 100_000), ("two.tar.gz", "b/ü.pdf", 1)]
    assert {a for a, m, c, p in rows if p is not None and m is None and c is None} == {"cut.tar", "junk.tar", "bad.zip"}


def test_wanted_members(spark, shards):
    wanted = spark.createDataFrame([("one.tar", "a/2.txt"), ("one.tar", "a/2.txt"), ("three.zip", "d/1.jpg"), ("three.zip", "d/9.jpg"), ("gone.tar", "x"), (None, "a/1.pdf"), ("two.tar.gz", None)], "archive string, member string")
    got = sorted((r.member, bytes(r.content), r.problem) for r in archives.members(spark, shards, wanted=wanted).collect())
    assert got == [("a/2.txt", b"t2", None), ("d/1.jpg", b"j1", None)]
    assert archives.members(spark, shards, wanted=wanted.limit(0)).count() == 0


def test_fetched_and_pending(spark):
    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            number = int(self.path.strip("/"))
            self.send_response(404 if number % 5 == 0 else 200)
            self.end_headers()
            self.wfile.write(b"page %d" % number)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}/"
    try:
        rows = spark.range(1, 41).select("id", F.concat(F.lit(base), "id").alias("url"), F.lit("x").alias("key"))
        odd = spark.createDataFrame([(100, None, "x"), (101, "nonsense", "x"), (102, "http://127.0.0.1:1/", "x")], "id long, url string, key string")
        got = {r.id: r for r in web.fetched(rows.union(odd), "id", "url", workers=3, seconds=5).collect()}
        assert len(got) == 43
        for i in range(1, 41):
            assert (got[i].status, got[i].content, got[i].problem) == ((404, None, "HTTP 404") if i % 5 == 0 else (200, b"page %d" % i, None))
        assert got[100].problem == "no URL" and all(got[i].problem and got[i].status is None for i in (100, 101, 102))
        earlier = spark.createDataFrame(list(got.values()), "id long, status int, content binary, problem string")
        assert {r.id for r in web.pending(rows, earlier, "id").collect()} == set(range(5, 41, 5))
        assert web.fetched(rows.limit(0), "id", "url").count() == 0
    finally:
        server.shutdown()


def test_audits_on_edges(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (4, "d"), (6, "f")], "k int, h string")
    two = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "d"), (5, "e"), (6, "f"), (6, "f")], "k int, h string")
    assert {r.k: r.problem for r in audits.matched(one, two, "k", "h").collect()} == {2: "other content", 4: "repeated", 5: "unexpected", 6: "repeated"}
    assert {r.problem for r in audits.matched(one, two.limit(0), "k", "h").collect()} == {"missing"}
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("b", 3), ("b", 3)], "c string, s int")
    assert {r.s for r in audits.shared_stratum(rows, "c", "s").collect()} == {1}
    assert audits.shared_stratum(rows.where("c = 'a' and s = 1 or c = 'b' and s = 2"), "c", "s").count() == 0
    assert audits.shared_stratum(rows.limit(0), "c", "s").count() == 0
    over = spark.createDataFrame([(1, "z"), (1, "y"), (9, "n")], "s int, family string")
    got = sorted((r.c, r.s, r.family) for r in audits.families(rows, "s", over, [(F.col("c") == "a", F.lit("ruled"))], F.lit("last")).collect())
    assert got == [("a", 1, "y"), ("a", 2, "ruled"), ("b", 1, "y"), ("b", 2, "last")] + [("b", 3, "last")] * 3
