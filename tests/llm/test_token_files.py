"""Token files: ids as the tokenizer gives them for whole texts, exact round trips, order and edges."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm.token_files import WordIds, pack, read_documents, unpack, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def whole(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from("abAB .,'<|>sİΣé́  \x1c\x85\n\t3²½;!")), max_size=40))
def test_word_ids_equal_whole_text(text):
    assert WordIds.of(PATH).ids(pa.array([text]))[0].tolist() == whole(text)


def test_special_tokens_and_case():
    for text in ("été ñandú größe œuvre ßa ªb ºc ŉx ǆ ıI ſs þorn élève naïve. straße,", "a<|endoftext|>b", "<|ENDOFTEXT|> X", "It's. THE'LL, 3.5,", "ΑΣ. ΑΣ", "x…. y»,"):
        assert WordIds.of(PATH).ids(pa.array([None, text, "", text]))[3].tolist() == whole(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.integers(0, 40_000))
def test_planes_round_trip(ids, more):
    data = np.array(ids + list(range(more)), "<u4")
    assert unpack(pack(data)).tolist() == data.tolist()


def test_files_round_trip(spark):
    rows = [(5, "One two.", 0), (1, None, 0), (3, "", 0), (3, "again", 1), (9, "word " * 70_000, 0), (2, "Été, ça!", 0), (5, "One two.", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_documents(write_tokens(df, PATH)).collect())
    at, want = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*whole(text), 2], "<u4")
        want.append((at, doc, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_empty(spark):
    assert read_documents(write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH)).collect() == []


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert WordIds.of(PATH).by_words and not WordIds.of(path).by_words
    texts = [(None, None), (1, "Two words\n here. "), (2, ""), (2, "")]
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in read_documents(write_tokens(spark.createDataFrame(texts, "doc_id long, text string"), path)).collect())
    other, at, want = Tokenizer.from_file(path), 0, []
    for _, t in texts:
        ids = np.array([*other.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_words_are_forgotten_and_learnt_again():
    memo = WordIds(PATH, most=50)
    texts = [" ".join(f"w{k}{j}, {k}x" for j in range(30)) for k in range(20)]
    for t in texts + texts:
        assert memo.ids(pa.array([t]))[0].tolist() == whole(t)
