"""Rank and select, cuts and round trips against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from folioflow.llm import fill_in_middle as fim
from folioflow.llm import queries
from tests.oracle import same

TEXTS = [None, "", "a", "\n", "\n\n\n", "one\ntwo", "one\ntwo\n", "é\nü\n\n日本\n😀 end", "has <S> inside\nb", "<P", "x\n<\nS>\n", "<\n" * 40, "line of words\n" * 30_000, "no end " * 20_000, "a\r\nb\x85c d\n"]


def plain(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [1, 63, 64, 65, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0, 0.01, 0.5, 1])
def test_rank_and_select(size, share):
    flags = np.random.default_rng(size).random(size) < share
    bits, ones = fim.BitVector(flags), np.flatnonzero(flags)
    assert bits.rank(np.arange(size + 1)).tolist() == np.r_[0, np.cumsum(flags)].tolist()
    assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()


@pytest.mark.parametrize(("percent", "spm"), [(100, 50), (60, 0), (30, 100), (0, 50)])
def test_by_plain_version(spark, percent, spm):
    rng = random.Random(5)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc", "x"), (-3, "a\nb\nc", "x")]
    rows += [(100 + i, "".join(rng.choice("ab é\n<PSM>日😀") for _ in range(rng.randrange(60))), "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    out = fim.transformed(docs, percent=percent, spm_percent=spm)
    got = out.withColumn("back", fim.restored(out["output"], out["form"])).collect()
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(repr(plain(d, t, percent, spm)) for d, t, _ in rows)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t, _ in rows)
    assert fim.transformed(docs.limit(0)).count() == 0


def test_query_against_sql(spark, sf):
    same(queries.QUERIES["op12_fill_in_middle"](spark, sf), queries.SQL["op12_fill_in_middle"], sf)
