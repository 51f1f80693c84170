"""Features and model against plain versions; both ways of scoring agree."""

import collections
import math
import random
import re

import pytest

from folioflow.llm import quality, queries
from tests.oracle import same

SCHEMA = "doc_id long, lang string, text string, bits string, kept string"


def documents():
    rng = random.Random(4)
    syllables = {"a": "an th on er in re ha".split(), "b": "üb ö schn ie 日 ß".split(), None: ["na", "😀"]}
    rows = []
    for i in range(150):
        lang = rng.choice(["a", "a", "b", None])
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", ".", "&&&", "7"]) for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.3 and words:
            words += words[: rng.randrange(1, 20)]
        rows.append((i, lang, "".join(w + rng.choice([" ", " ", "\n", "  ", "\t\n", "\r"]) for w in words)))
    rows += [(200, "a", None), (201, "a", ""), (202, None, " \n\t"), (203, "a", "x"), (3, "b", "zz " * 4000), (3, "b", "zz " * 4000), (None, "a", "an\nan\nan\n\n\nan "), (204, "c", "!!! \x02\x03 $$"), (205, "a", "p q r s t p q r s t u v\x85w x　y z")]
    return [(*r, "x", "y") for r in rows]


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def modelled(text):
    text = re.sub("[0-9]", "0", re.sub(r"[\x00-\x1f]", " ", text))
    return "\x02" * 4 + re.sub(" +", " ", text).lstrip(" ") + "\x03"


class PlainModel:
    """Modified Kneser-Ney by dictionaries, one language."""

    def __init__(self, texts):
        self.counts = {5: collections.Counter(t[i : i + 5] for t in map(modelled, texts) for i in range(len(t) - 4))}
        for k in (4, 3, 2, 1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.take, self.total, self.spare = {}, {}, {}
        for k, counts in self.counts.items():
            n = [0, *(sum(c == j for c in counts.values()) for j in (1, 2, 3, 4))]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            self.take[k] = [0, *(max(0.1, j - (j + 1) * y * n[j + 1] / n[j]) if n[1] and n[j] else j / 2 for j in (1, 2, 3))]
            for g, c in counts.items():
                self.total[g[:-1], k] = self.total.get((g[:-1], k), 0) + c
                self.spare[g[:-1], k] = self.spare.get((g[:-1], k), 0) + self.take[k][min(c, 3)]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.counts[1]) + 1)
        if (gram[:-1], k) not in self.total:
            return self.p(gram[1:])
        c, total = self.counts[k].get(gram, 0), self.total[gram[:-1], k]
        return (c - self.take[k][min(c, 3)]) / total + self.spare[gram[:-1], k] / total * self.p(gram[1:])

    def nats(self, text):
        t = modelled(text)
        return -sum(math.log(self.p(t[i : i + 5])) for i in range(len(t) - 4))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def test_features_and_bits_by_plain_version(spark, docs):
    rows = documents()
    models = {lang: PlainModel([r[2] for r in rows if r[1] == lang and re.search(r"[^\x20\x09-\x0D]", r[2] or "")]) for lang in {r[1] for r in rows}}
    want = []
    for d, lang, text, *_ in rows:
        f = plain_features(text or "")
        letters = sum(c.isalpha() or c == "0" for c in modelled(text or ""))
        want.append((str(d), f, round(models[lang].nats(text) / math.log(2) / max(letters, 1), 6) if f[0] else None, f[0] < 10 or 100 * f[4] > 20 * f[0]))
    for most in (quality.MOST, 10):  # by arrays and by joins
        out = quality.judged(docs, most=most).collect()
        got = [(str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), None if r.bits is None else round(r.bits, 6), r.base_failed) for r in out]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert not any(r.kept and r.base_failed for r in out)
    assert quality.judged(docs.limit(0)).count() == 0


def test_unseen_texts_back_off_alike(spark, docs):
    rows = documents()
    model, _ = quality.fitted(quality.counted(docs))
    new = [(1, "a", "than qüx 99 !?\nin"), (2, "b", "日日 x"), (3, "zz", "no such language")]
    table = quality.with_words(spark.createDataFrame(new, "doc_id long, lang string, text string"))
    plain = {lang: PlainModel([r[2] for r in rows if r[1] == lang and re.search(r"[^\x20\x09-\x0D]", r[2] or "")]) for lang in "ab"}
    for out in (quality.measured(table, quality.arrays(model)), quality.measured_by_join(table, model)):
        got = {r.doc_id: r.nats for r in out.collect()}
        assert got[3] is None and all(abs(got[d] - plain[lang].nats(text)) < 1e-9 * got[d] for d, lang, text in new[:2])


def test_many_different_characters(spark):
    """More characters than packed codes hold: the same counts."""
    text = "".join(chr(0x4E00 + k) for k in range(9000)) * 2
    docs = spark.createDataFrame([(1, "zh", text), (2, "zh", text[:50])], "doc_id long, lang string, text string")
    got = {r.gram: r.c for r in quality.counted(docs).collect()}
    want = collections.Counter(t[i : i + 5] for t in map(modelled, (text, text[:50])) for i in range(len(t) - 4))
    assert got == dict(want)


def test_bands_by_sorting(spark):
    rng = random.Random(1)
    rows = [(lang, int(rng.gauss(900, 40))) for lang in "xy" for _ in range(301)] + [("z", 5)]
    got = {r.lang: (r.middle, r.low, r.high) for r in quality.bands(spark.createDataFrame(rows, "lang string, step long")).collect()}
    half = lambda values: sorted(values)[(len(values) + 1) // 2 - 1]
    for lang in "xyz":
        steps = [s for x, s in rows if x == lang]
        middle = half(steps)
        assert got[lang] == (middle, max(4, half([middle - s for s in steps if s <= middle])), max(4, half([s - middle for s in steps if s >= middle])))


def test_query_against_sql(spark, sf):
    same(queries.QUERIES["op13_quality_rules"](spark, sf), queries.SQL["op13_quality_rules"], sf)
