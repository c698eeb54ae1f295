import random

import public_tokenizers
import pytest
import sentencepiece

from riverlens.llm import counts, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["the", "an", " ", " ", "\n", "\t", "▁", "x", "é", "ß", "漢", "😀", "<s>", "</s>", "<unk>", "<0x0A>", ".", ",", "!!", "'s", "0", "2024", "\x00", "‍", "́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    return counts.proved(MODEL)


def test_random_texts_as_the_library(library, counter):
    r = random.Random(5)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(20_000)]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_proofs_hold(library, counter):
    """Whole words stay one token; no merge crosses a place whose two characters no piece joins."""
    some = sorted(counter.whole - {""})
    assert len(some) > 10_000
    assert {len(x) for x in library.encode(some)} == {1}
    for a, mark in [("word", "."), ("word", "\n"), ("x", "漢")]:
        assert (a[-1] + mark in counter.joined) or library.encode(a + mark)[: len(library.encode(a))] == library.encode(a)
    assert counter.ends_apart


def test_most_words_of_plain_text_need_no_merge(counter):
    counter.forget()
    asked = []
    merged = counter.merged
    counter.merged = lambda words: asked.extend(words) or merged(words)
    try:
        counter.count("the time of the year when all the people of the town come to the water and the sun is high.")
    finally:
        del counter.merged
    assert not asked


def test_known_words_are_bounded(counter, monkeypatch):
    monkeypatch.setattr(counts, "CACHE_WORDS", 10)
    counter.forget()
    for i in range(100):
        assert counter.count(f"qx{i}zz") > 0
        assert len(counter._known) <= len(counter.whole) + 11


def test_long_texts_in_seconds(library, counter):
    for text in ("x" * 1_000_000, " " * 1_000_000, "\n" * 500_000, "ab\n" * 300_000, "▁ " * 200_000):
        assert counter.count(text) == len(library.encode(text))


def test_defined_cases(spark, library):
    schema = "n_tokens string, doc_id long, text string, over_limit int, x int"
    rows = [("a", 1, None, 0, 0), ("a", 2, "", 0, 0), ("a", 3, "the sun", 0, 0), ("b", 3, "the sun", 1, 1), (None, None, "</s> ▁", None, None), ("c", 5, "word " * 5000, 0, 0)]
    out = counts.over_limit(spark.createDataFrame(rows, schema), MODEL)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for _, i, t, _, _ in rows]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert counts.over_limit(spark.createDataFrame([], schema), MODEL).count() == 0


def test_query_as_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in queries.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d.doc_id: len(library.encode(d.text or "")) for d in docs}


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        counts.proved(str(tmp_path / "m.model"))
