"""The learned operators against plain loops: log-probabilities, posteriors, gradients, scores."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import language_id, toxicity


def labelled():
    rng = random.Random(2)
    syllables = {"aa": ["an", "th", "er"], "bb": ["üb", "ö", "er"], "cc": ["na", "日本", "x"], "dd": ["qu", "th", "é"]}
    rows = []
    for i in range(120):
        lang = rng.choice([*syllables, None])
        text = " ".join("".join(rng.choice(syllables[lang or "aa"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 60)))
        rows.append((i, text if rng.random() < 0.97 else None, lang, "s"))
    return rows + [(500, "!!! 12", "aa", "s"), (501, "", "bb", "s"), (502, "th " * 30_000, "aa", "s"), (502, "an", "aa", "s"), (None, "er an", "aa", "s")]


def plain_posteriors(rows, text):
    """(language, score) by dictionaries of counts."""
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang, _ in rows:
        if lang is not None and t and (found := language_id.gram_buckets(t)) is not None:
            counts[lang].update(found.tolist())
            docs[lang] += 1
    found = language_id.gram_buckets(text) if text else None
    if found is None:
        return "und", 0.0
    logs = {}
    for lang, c in counts.items():
        whole = sum(c.values()) + 0.5 * (1 << language_id.BITS)
        logs[lang] = sum(math.log((c[g] + 0.5) / whole) * n for g, n in collections.Counter(found.tolist()).items())
    prior = {lang: math.log(n / sum(docs.values())) for lang, n in docs.items()}
    best = min(logs, key=lambda x: (-(logs[x] + prior[x]), x))
    weak = {x: logs[x] * min(1.0, 200 / len(found)) + prior[x] for x in logs}
    return best, 1 / sum(math.exp(weak[x] - weak[best]) for x in weak)


def test_languages_by_plain_loops(spark):
    rows = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    texts = [r[1] for r in rows if r[1] and len(r[1]) < 5000][:25] + [None, "", "12 %", "th th an", "日本 na"]
    want = {t: plain_posteriors(rows, t) for t in texts}
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for labels in (256, 1, 3):  # one block, a block for each language, two blocks
        model = language_id.train(docs, labels=labels)
        assert sum((b.value.langs for b in model), []) == ["aa", "bb", "cc", "dd"] and all(len(b.value.langs) <= labels for b in model)
        for r in language_id.predict(asked, model, "doc_id").collect():
            lang, score = want[texts[r.doc_id]]
            assert r.lang_pred == lang and abs(r.score - score) < 1e-4
        kept = language_id.accepted(docs, model, 0.5)
        assert kept.columns == docs.columns and kept.count() == language_id.predict(docs, model).where("lang_pred <> 'und' and score >= 0.5").count()


def test_equal_languages_tie_to_the_lesser_name(spark):
    docs = spark.createDataFrame([(1, "same words", "zz"), (2, "same words", "aa")], "doc_id long, text string, lang string")
    for labels in (256, 1):
        assert [r.lang_pred for r in language_id.predict(docs, language_id.train(docs, labels=labels), "doc_id").collect()] == ["aa", "aa"]
    nothing = language_id.train(docs.where("lang is null"))
    assert nothing == [] and {(r.lang_pred, r.score) for r in language_id.predict(docs, nothing, "doc_id").collect()} == {("und", 0.0)}


def test_slope_by_finite_differences():
    rng = np.random.default_rng(1)
    n, pairs, size, pull = 30, 12, 40, 0.7
    y = (rng.random(n) < 0.4).astype(float)
    cells = rng.integers(0, n, 200), rng.integers(0, size, 200)
    own, other = ((rng.integers(0, pairs, 50), rng.integers(0, size, 50)) for _ in range(2))

    def loss(w, b):
        logits = [b + sum(w[c] for r, c in zip(*cells, strict=True) if r == i) for i in range(n)]
        change = [sum(w[c] for r, c in zip(*own, strict=True) if r == i) - sum(w[c] for r, c in zip(*other, strict=True) if r == i) for i in range(pairs)]
        return sum(math.log1p(math.exp(-z if t else z)) for z, t in zip(logits, y, strict=True)) / n + pull * sum(c * c for c in change) / pairs

    w, b, h = rng.normal(0, 0.3, size), 0.2, 1e-5
    g, gb = toxicity.slope(w, b, y, cells, pairs, own, other, pull)
    for k in range(size):
        step = np.zeros(size)
        step[k] = h
        assert abs((loss(w + step, b) - loss(w - step, b)) / (2 * h) - g[k]) < 1e-6
    assert abs((loss(w, b + h) - loss(w, b - h)) / (2 * h) - gb) < 1e-6


def test_scores_by_a_plain_loop(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) + (" Scum, scumbag!" if i % 4 == 0 else "")) for i in range(160)]
    rows += [(7, "another text of document seven"), (160, None), (161, ""), (162, "scum " * 20_000), (None, "scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)] + [(4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    weights, intercept = toxicity.train(docs, labels.where(~language_id.held_out(F.col("doc_id"), 5, 0)))
    memo, got = toxicity.Features(), toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for doc, text in rows:
        logit = float(intercept)
        for f in {f for w in toxicity.plain_words(text) for f in memo[w]}:
            logit += float(weights[f])
        want[doc, round(1 / (1 + math.exp(-max(-30, min(30, logit)))), 4)] += 1
    assert collections.Counter((r.doc_id, round(r.score, 4)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted for r in got if r.doc_id is not None and r.doc_id % 4 == 0 and r.doc_id < 160) >= 36
