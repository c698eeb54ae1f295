import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riverlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "don't", "we'll", "The", "the", "été", "12", "３", "aaa", "aaaaaaaa", "...", "!?", "日本", "😀", "<|endoftext|>", "<|endo", "ſ", "é", "Ω", "_", "$%"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return ["", " ", "  ", " a", "a ", "a  b", "a \n b", *made, " ".join(made)]


def test_encodes_and_decodes_as_the_library(library):
    coder = bpe.Bpe(open(PATH).read())
    for text, ids in zip(texts(), coder.encode(texts()), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_round_trip_with_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, "The the  été\n", 7), (1, "The the  été\n", 7), (2, None, None), (None, "x", 1), (3, "", 0)]
    got = sorted(map(tuple, bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()), key=str)

    def want(i, t, _):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert got == sorted((want(*r) for r in rows), key=str)
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_decode_undoes_encode(spark):
    docs = spark.createDataFrame([(1, "Ein Bär, zwei Bären"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert got == {1: "Ein Bär, zwei Bären", 2: ""}


def test_one_very_long_pretoken(library):
    coder = bpe.Bpe(open(PATH).read())
    for text in ("ab" * 100_000, "é" * 30_000, " " * 50_000 + "x", "=" * 70_000):
        want = library.encode(text, add_special_tokens=False).ids
        ids = coder.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == want and coder.decode(ids) == text
