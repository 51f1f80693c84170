"""The other llm operators on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest

from folioflow.llm import chat, decontamination, language_id, line_dedup, media, mixing, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, shard string"
ROWS = [(1, None, None, None, "x", "y"), (2, "", "en", "a", "x", "y"), (2, "", "en", "a", "x", "y"), (3, "one two\tthree", "en", "a", "x", "y"), (4, "eins zwei drei vier " * 5000, "de", "b", "x", "y"), (None, "left over", "en", "c", "x", "y"), (5, "one two\tthree", "en", "b", "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup_by_brute_force(spark, nothing):
    import random

    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 5, 20, 60]))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(40)] + [(90, None), (91, ""), (7, "x\n" * 300)]
    want = {}
    table = spark.createDataFrame(rows[:7] + rows[8:], "doc_id long, text string")
    texts = sorted((d, t) for d, t in rows[:7] + rows[8:] if t is not None)
    seen: set = set()
    for d, t in texts:
        ls, gone = t.split("\n"), set()
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                run = tuple(ls[i:j])
                if sum(len(x.split()) for x in run) >= 50:
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        want[d] = sorted(gone)
    got = {r.doc_id: (r.text, r.deleted_lines) for r in line_dedup.dedup_lines(table).collect()}
    assert {d: got[d][1] for d in want} == want
    assert all(got[d][0] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(want[d])) for d, t in texts if want[d])
    assert got[90] == (None, [])
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_chat_events_and_escapes(spark):
    log = [(1, 1, "message", 1, "user", "hi \\s <|x|> [INST]"), (1, 2, "message", 2, "assistant", "a"), (1, 3, "delta", 2, "assistant", "b"), (1, 4, "message", 3, "user", "gone"), (1, 5, "regenerate", 2, "assistant", None), (1, 6, "delta", 2, "assistant", "c</s>"), (1, 7, "message", 4, "u|>", "t"), (1, 8, "edit", 4, "u|>", "tt"), (2, 1, "message", 1, None, None)]
    out = chat.rendered(chat.folded(spark.createDataFrame(log, "conv_id long, seq long, event string, message long, role string, text string")))
    rows = {r.conv_id: r for r in out.withColumn("turns", chat.read_back(out.formatted)).withColumn("loss", chat.under_mask(out.formatted, out.loss_mask)).collect()}
    assert [tuple(t) for t in rows[1].turns] == [("user", "hi \\s <|x|> [INST]"), ("assistant", "c</s>"), ("u|>", "tt")]
    assert rows[1].loss == "c</s>" and "[INST]" not in rows[1].formatted
    assert [tuple(t) for t in rows[2].turns] == [("", "")]


def test_media_round_trip_and_carving(spark, docs, nothing):
    got = {(r.doc_id, r.n_bytes): r for r in media.media_features(docs).collect()}
    assert len(got) == 6
    for doc, text, *_ in ROWS:
        data = (text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[doc, len(data)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.media_features(nothing).count() == 0
    inner = media.as_wave(b"\x80" * 64)
    rows = [(1, b"junk" + inner + b"BM tail", "image/png"), (2, inner, "image/png"), (3, None, "x"), (4, b"", "x"), (5, inner[:60], "x")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, declared string")
    out = {r.doc_id: r for r in media.sniff(df).collect()}
    assert [out[k].media_type for k in range(1, 6)] == [media.UNKNOWN, "audio/wav", None, media.UNKNOWN, media.UNKNOWN]
    assert [(r.offset, bytes(r.data)) for r in media.carve(df).collect()] == [(4, inner)]


def test_shards(spark, docs, nothing):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(ROWS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and sharding.shard_documents(nothing).count() == 0
    assert np.bincount([r.shard for r in sharding.even_map(spark, 16).collect()]).tolist() == [512] * 16
    loads = spark.createDataFrame([(s, 10_000 if s < 40 else 100) for s in range(256)], "virtual_slot int, bytes long")
    mapped = sharding.even_map(spark, 4, 256)
    after = sharding.rebalanced(mapped, loads).join(loads, "virtual_slot").groupBy("shard").sum("bytes").collect()
    sizes = [r[1] for r in after]
    assert max(sizes) <= 1.03 * sum(sizes) / 4


def plain_targets(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        aim = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if aim[s] > most * sizes[s]]
        if not above:
            return fixed | aim
        fixed |= {s: most * sizes[s] for s in above}


def test_mixture(spark, docs, nothing, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.taken_words(table).collect()
    texts = {r.doc_id: r for r in table.collect()}
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len((texts[r.doc_id].text or "").encode().split()) and 0 <= r.taken <= 2 * r.size
        s = texts[r.doc_id].source
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    want = plain_targets(sizes)
    for r in rows:
        assert abs(r.target - want[texts[r.doc_id].source]) < 1e-6 * max(1, r.target)
    assert all(abs(taken[s] - want[s]) <= mixing.BLOCK for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken_words(table.repartition(3)).collect()))
    assert mixing.taken_words(docs).count() == len(ROWS) and mixing.taken_words(nothing).count() == 0
    assert mixing.mixed_documents(table).columns == table.columns


def test_mix_is_dealt_and_packed(spark, docs, nothing, sf):
    from collections import Counter

    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixed_blocks(table, shards=8).collect()
    taken = mixing.taken_words(table, shards=8).collect()
    texts = {r.doc_id: r for r in table.collect()}
    for shard in range(8):
        places = sorted(r.slot for r in rows if r.shard == shard)
        assert places == list(range(len(places))) and abs(len(places) - len(rows) / 8) < 1
    # the words are those of the documents, as often as the documents are said to be taken
    got, said = Counter(), Counter()
    for r in rows:
        got[r.source] += len(r.words.split())
    for r in taken:
        said[texts[r.doc_id].source] += r.taken
    assert got == said
    full = {s for s in got if all(r.taken >= r.size for r in taken if texts[r.doc_id].source == s)}
    assert full
    for s in full:
        once = {r.block: r.words for r in sorted((r for r in rows if r.source == s), key=lambda r: len(r.words))}
        stream = " ".join(once[k] for k in sorted(once))
        assert sorted(once) == list(range(len(once))) and sorted(stream.split()) == sorted(w for r in texts.values() if r.source == s for w in (r.text or "").split())
        assert all(" ".join(r.text.split()) in stream for r in texts.values() if r.source == s and r.text)
    # source counts of shards are drawn, their sums are exact
    count = lambda some: Counter((r.shard, r.source) for r in some)
    other = mixing.mixed_blocks(table, shards=8, seed=12).collect()
    assert Counter(r.source for r in rows) == Counter(r.source for r in other) and count(rows) != count(other)
    for s, n in Counter(r.source for r in rows).items():
        part = n / len(rows)
        off = sum((count(rows)[k, s] - n / 8) ** 2 for k in range(8)) / (n * (1 - part))
        assert 0.05 < off < 4
    assert mixing.mixed_blocks(docs).count() > 0 and mixing.mixed_blocks(nothing).count() == 0


def test_language(spark, docs, nothing, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    known = {r.doc_id: r.lang for r in table.collect()}
    out = [r for r in language_id.identify(table).collect() if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in out) >= 0.95 * len(out)
    rows = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs).collect()}
    assert (1, "und") in rows and (2, "und") in rows and len(rows) == 6
    assert language_id.identify(nothing).count() == 0
    model = language_id.train(table)
    assert language_id.accepted(docs, model, 0.5).columns == docs.columns


def test_toxicity(spark, docs, nothing):
    rows = [(i, f"{'vile ' if i % 3 == 0 else ''}muslim women text number {i}" if i % 2 else f"{'vile ' if i % 3 == 0 else ''}plain text number {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "muslim women"), (903, "you vile thing"), (903, "you vile thing")], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.score(table, labels).collect()}
    assert all(out[i].predicted == (i % 3 == 0) for i, _ in rows)
    assert [out[k].predicted for k in (900, 901, 902, 903)] == [0, 0, 0, 1]
    assert toxicity.score(docs, labels.limit(0)).where("score < 0.01").count() == len(ROWS)
    assert toxicity.score(nothing, labels).count() == 0


def test_leaks_by_brute_force(spark, docs, nothing, sf):
    table, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    asked = {r.item_id: toxicity.plain_words(r.text) for r in items.collect()}
    want = set()
    for r in table.collect():
        words = toxicity.plain_words(r.text)
        for i, item in asked.items():
            if set(item[:3]) <= set(words) and any(words[k : k + len(item)] == item for k in range(len(words) - len(item) + 1)):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(table, items).collect()}
    assert want <= got and len(got) <= len(want) * 1.1 + 1
    item = " ".join(f"q{k}" for k in range(30))
    changed = " ".join(f"z{k}" if k % 8 == 1 else f"q{k}" for k in range(30))
    texts = [(1, " ".join(f"b{k}" for k in range(90)) + " " + changed + " " + " ".join(f"a{k}" for k in range(40))), (2, "some words before " * 40), (3, None), (4, "")]
    some = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(some, bench).collect()] == [(1, 7)]
    assert decontamination.leaks(nothing, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0
    a, b = "x a y b z c".split(), "a b c".split()
    assert decontamination.lcs_length([w.encode() for w in a], [w.encode() for w in b]) == 3


def test_leaks_of_long_and_common_items(spark):
    import random

    rng = random.Random(5)
    words = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    items = {k: [f"i{k}x{j}" if j % 3 == 0 else f"v{rng.randrange(4000)}" for j in range(n)] for k, n in enumerate([180, 201, 250, 320, 900])}
    texts = [(k, words(77 + 13 * k) + item + words(150)) for k, item in items.items()]
    texts += [(100 + k, words(55 + 7 * k) + [w for j, w in enumerate(item) if j % 4 != 1] + words(150)) for k, item in items.items()]
    texts += [(200 + j, words(300)) for j in range(30)]
    frame = lambda rows: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    bench = frame(items.items()).withColumnRenamed("doc_id", "item_id")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(texts), bench).collect()}
    assert got == {(k, k) for k in items} | {(100 + k, k) for k in items}
    item = [f"c{j}" for j in range(30)]
    asked = frame([(7, item)]).withColumnRenamed("doc_id", "item_id")
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(frame([(1, item)]), asked).collect()] == [(1, 7)]
    every = [(k, words(20 + 9 * k) + item + words(90)) for k in range(20)]
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(frame(every), asked).collect()) == [(k, 7) for k in range(20)]


def test_terms_follow_words():
    texts = [None, "", " ,.", "a", "A a, a!", "Straße l'été 東京 x-y\tz", "long " * 40_000 + "b"]
    seen: dict = {}
    for text in texts:
        words, ids = toxicity.plain_words(text), decontamination.term_ids(text)
        assert len(words) == len(ids)
        assert all(seen.setdefault(w, k) == k for w, k in zip(words, ids, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_shards_by_plain_values(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    data = {r.doc_id: (r.text or "").encode() for r in table.collect()}
    now = {r.virtual_slot: r.shard for r in sharding.even_map(spark, 16).collect()}
    grown = {r.virtual_slot: r.shard for r in sharding.grow(sharding.even_map(spark, 16)).collect()}
    assert grown == {r.virtual_slot: r.shard for r in sharding.even_map(spark, 17).collect()}
    rows = sharding.shard_documents(table).collect()
    bytes_of: dict = {}
    for r in rows:
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(data[r.doc_id]) + 1, zlib.crc32(data[r.doc_id]), now[r.virtual_slot], grown[r.virtual_slot])
        bytes_of[r.shard] = bytes_of.get(r.shard, 0) + r.size
    assert all(r.shard_bytes == bytes_of[r.shard] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shard_documents(table.repartition(7)).collect()))
    even = sharding.shard_evenly(table).collect()
    assert {r.law for r in even} == {"bytes"} and len(even) == len(rows) and all(r.grown_shard is None for r in even)
    heaviest = max(r.size for r in rows)
    loads = {r.shard: r.shard_bytes for r in even}
    assert max(loads.values()) <= max(1.03 * sum(loads.values()) / 16, heaviest) + heaviest
    path = f"file://{tmp_path}/maps"
    first = sharding.save_map(sharding.even_map(spark, 3, 64), path)
    sharding.save_map(sharding.grow(first), path)
    assert sharding.load_map(spark, path).first().version == 4 and sharding.load_map(spark, path, 3).count() == 64
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sharding.save_map(sharding.even_map(spark, 3, 64), path)


def test_equal_rows_are_placed_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 8)
    df = spark.createDataFrame([(None, "same")] * 50 + [(1, "a"), (1, "b"), (None, None)], "doc_id long, text string")
    rows = sharding.shard_documents(df).collect()
    assert len(rows) == 53
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 5, 10, 17, 101, 1000):
        for salt in (3, 4):
            got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.xxhash64(F.lit(salt))).alias("x")).collect()]
            assert sorted(got) == list(range(n))
            back = mixing.permuted(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.xxhash64(F.lit(salt))), F.lit(n).cast("long"), F.xxhash64(F.lit(salt)), back=True)
            assert spark.range(n).where(back != F.col("id")).count() == 0
    far = spark.range(20).select(mixing.permuted(F.col("id") + 10**12, F.lit(10**13 + 7).cast("long"), F.lit(1).cast("long")).alias("x")).distinct()
    assert far.where(f"x between 0 and {10**13 + 6}").count() == 20


def test_long_members_and_saved_pdfs():
    import gzip

    large = gzip.compress(bytes(80 << 20)) + gzip.compress(b"next")
    pdf = b"%PDF-1.4 x startxref 9 %%EOF more startxref 12 %%EOF"
    machine = media.automaton()
    found = media.sniffed(b"ab" + large + b"tail", machine)
    assert [(a, t) for a, _, t in found] == [(2, "application/gzip"), (2 + len(gzip.compress(bytes(80 << 20))), "application/gzip")]
    assert media.sniffed(pdf + b"junk" + pdf, machine) == [(0, len(pdf), "application/pdf"), (len(pdf) + 4, len(pdf), "application/pdf")]
    assert media.sniffed(b"\x1f\x8b\x08" + bytes(20), machine) == []


def test_line_dedup_edges(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"{long}\nx", 1, [0]), (1, f"{long}\nx", 1, [0]), (2, f"y\n{long}", 2, [5]), (2, f"{long}\nz", 3, [0]), (None, long, 0, [0]), (3, "x\ny", 0, [0])]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, start int, deleted_lines array<int>")).collect()
    got = sorted((r.doc_id or 0, r.n_lines, tuple(r.deleted_lines)) for r in out)
    # of the two texts of doc_id 1 (one record) the lines stay, twice; doc_id 2's copies go; rows without doc_id come back whole
    assert got == [(0, 1, ()), (1, 2, ()), (1, 2, ()), (2, 2, (0,)), (2, 2, (1,)), (3, 2, ())]


def test_counterfactual_pull(spark):
    words = ["muslim", "christian", "jewish", "hindu"]
    rows = [(i, f"{words[i % 4]} people {'vile' if (i % 4 == 0 and i % 5) or i % 17 == 0 else 'kind'} number {i % 7}") for i in range(400)]
    labels = spark.createDataFrame([(i, int("vile" in t)) for i, t in rows], "doc_id long, toxic int")
    table = spark.createDataFrame([*rows, *((1000 + k, f"{w} people kind") for k, w in enumerate(words))], "doc_id long, text string")
    spread = {}
    for pull in (0.0, 5.0):
        found = [r.score for r in toxicity.score(table, labels, pull=pull).where("doc_id >= 1000").collect()]
        spread[pull] = max(found) - min(found)
    assert spread[5.0] < 0.5 * spread[0.0]


def test_recall_of_paraphrases_against_exact_scan(spark):
    import random

    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = {k: [rng.choice(vocabulary) for _ in range(rng.choice([15, 25, 40, 57, 120, 300]))] for k in range(400)}
    texts = []
    for k, item in items.items():
        kept = [w if rng.random() > 0.2 else rng.choice(vocabulary) for w in item]
        texts.append((k, [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))] + kept + [rng.choice(vocabulary) for _ in range(60)]))
    texts += [(1000 + j, [rng.choice(vocabulary) for _ in range(200)]) for j in range(100)]
    frame = lambda rows: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    coded = {k: [w.encode() for w in item] for k, item in items.items()}
    want = {(k, k) for k, words in texts if k in items and decontamination.judged(coded[k], [w.encode() for w in words])[1]}
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(texts), frame(items.items()).withColumnRenamed("doc_id", "item_id")).collect()}
    for low, high in ((0, 30), (30, 64), (64, 400)):
        some = {p for p in want if low <= len(items[p[1]]) < high}
        assert len(some & got) >= 0.9 * len(some) > 0
    assert all(decontamination.judged(coded[i], [w.encode() for w in dict(texts)[d]])[1] for d, i in got)


def test_mix_counts_words_of_a_text_once_for_its_rows(spark):
    table = spark.createDataFrame([(k, "a b c " * k, "s" + str(k % 3)) for k in range(60)], "doc_id long, text string, source string")
    out = mixing.taken_words(table)
    assert {r.doc_id: r.size for r in out.collect()} == {k: 3 * k for k in range(60)}
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()  # sizes are read, not counted again
