"""The pipeline against a plain version of its decisions, stage by stage and as a whole."""

import collections
import random

import pytest

from tests.llm.test_models import plain_posteriors
from tests.llm.test_operators import plain_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Documents, benchmark items, and the ids that hold an item."""
    rng = random.Random(12)
    syllables = {"en": ["an", "th", "er", "ing", "ou"], "de": ["üb", "ö", "sch", "ung", "ei"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 6)))
    items = [(k, " ".join(word("en") + str(k) for _ in range(40))) for k in range(3)]
    rows, leaky = [], set()
    for i in range(90):
        lang = rng.choice(["en", "en", "de"])
        words = [word(lang) for _ in range(rng.randrange(60, 120))]
        if i % 17 == 3:
            words[10:10] = items[i % 3][1].split()
            leaky.add(i)
        rows.append((i, words, lang, rng.choice(["a", "a", "b", None])))
        if i % 6 == 1:  # a near copy with one word changed, and an exact one
            near = list(words)
            near[len(near) // 2] = word(lang)
            rows += [(200 + i, near, lang, "b"), (300 + i, words, lang, "c")]
            leaky |= {200 + i, 300 + i} if i in leaky else set()
    docs = [(i, " ".join(w), lang if rng.random() < 0.8 else None, source, 1) for i, w, lang, source in rows]
    docs += [(500, None, "en", "a", 1), (501, "", "de", "a", 1), (502, "123 !!! 4", "en", "b", 1), (None, docs[0][1] + " more", "en", "a", 1), (0, docs[5][1] + " other", "de", "b", 1)]
    return docs, items, leaky


def plain_groups(rows):
    """The rows that stay: the least doc_id of each group of similar texts; rows without doc_id stay."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((r[1] or "").lower().split() for r in rows)]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    heads = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            heads.setdefault(top(i), []).append(r)
    return [min(g, key=lambda r: r[0]) for g in heads.values()] + [r for r in rows if r[0] is None]


def test_run_by_plain_decisions(spark, tmp_path):
    import corpus_pipeline as p

    docs, items, leaky = corpus()
    folder = str(tmp_path / "sf")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    stages, now = [f for _, f in p.STAGES], spark.read.parquet(f"{folder}/documents.parquet")

    known = rows(stages[0](spark, now, folder))
    labelled = [(r[0], r[1], r[2], r[3]) for r in docs]
    judged = {r[1]: plain_posteriors(labelled, r[1]) for r in docs}
    assert known == sorted((r for r in docs if judged[r[1]][0] != "und" and judged[r[1]][1] >= 0.5), key=repr) and 502 not in {r[0] for r in known}

    now = spark.createDataFrame(known, SCHEMA)
    once = rows(stages[1](spark, now, folder))
    assert once == sorted(plain_groups(known), key=repr) and not {r[0] for r in once} & set(range(200, 400))

    now = spark.createDataFrame(once, SCHEMA)
    clean = rows(stages[2](spark, now, folder))
    assert clean == [r for r in once if not any(item in r[1] for _, item in items)] and {r[0] for r in once} - {r[0] for r in clean} <= leaky | {0}

    now = spark.createDataFrame(clean, SCHEMA)
    mixed = rows(stages[3](spark, now, folder))
    sizes, copies = collections.Counter(), collections.Counter(mixed)
    for r in clean:
        sizes[r[3]] += len(r[1].split())
    taken = collections.Counter()
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    assert set(mixed) <= set(clean) and max(copies.values()) <= 2
    longest = max(len(r[1].split()) for r in clean)
    assert all(abs(taken[s] - t) <= 128 + longest * sum(r[3] == s for r in clean) ** 0.5 for s, t in plain_targets(dict(sizes)).items())

    last = stages[4](spark, spark.createDataFrame(mixed, SCHEMA), folder).collect()
    assert collections.Counter((r.doc_id, r.text) for r in last) == collections.Counter((r[0], r[1]) for r in mixed) if "text" in last[0] else len(last) == len(mixed)
    slots = collections.defaultdict(list)
    for r in last:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())

    whole = p.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.shard) for r in whole) == collections.Counter((r.doc_id, r.shard) for r in last)


def test_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert len(names) == 5 and p.ORACLE_SQL is None
    known = p.STAGES[0][1](spark, docs, sf)
    assert known.columns == docs.columns and known.count() == docs.where("text rlike '[a-zA-Z]'").count()
    rows = [(1, "a b c d e f g h", "en", "s", 1), (2, "a b c d e f g h", "en", "s", 1), (3, None, "en", "s", 1), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1)]
    small = spark.createDataFrame(rows, docs.schema)
    assert sorted((r.doc_id or 0) for r in p.keep_one_of_group(spark, small, sf).collect()) == [0, 0, 1, 3]
    assert p.drop_benchmark(spark, small, sf).count() == 5


@pytest.mark.parametrize("n", [0])
def test_empty(spark, sf, n):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(n)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_repeated_rows_stay_once(spark, monkeypatch):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    rows = [(k, text(k), "en", "s", 1) for k in range(20)]
    rows += [(3, text(3), "de", "t", 2), (3, text(3), "en", "s", 1), (3, text(99), "en", "s", 1), (4, text(4), None, "s", 1), (50, text(5), "en", "s", 1), (None, text(6), "en", "s", 1), (60, " ", "en", "s", 1), (60, " ", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = p.keep_one_of_group(spark, docs, "")
    wanted = [r for r in rows[:20] if r[0] not in (3, 4)] + [(3, text(3), "de", "t", 2), (3, text(99), "en", "s", 1), (4, text(4), None, "s", 1), *rows[-3:]]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(wanted, key=repr)
    for option in ("-1", "10m"):  # by a join of texts where many rows come twice
        monkeypatch.setattr(p, "stored", lambda df, name: df)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", option)
        try:
            assert sorted(map(tuple, p.keep_one_of_group(spark, docs, "").collect()), key=repr) == sorted(wanted, key=repr)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
