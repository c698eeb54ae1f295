import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riverlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, pieces, length):
    lib = Tokenizer.from_file(PATH)
    want = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, _ in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
        assert p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start : p.start + p.length].tobytes())
        assert p.doc_tokens == len(want[p.doc_id])
    assert by_doc.keys() == want.keys()
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(want[i])
    for s, ps in by_seq.items():
        at = 0
        for offset, n in sorted(ps):
            assert offset == at
            at += n
        assert at == length or s == max(by_seq)


def some_rows(n=300):
    rng = np.random.default_rng(1)
    words = ["The", "idea", "été", "a b", "don't", "<|endoftext|>", "ΑΣ", "12,5", "\x1c", "x" * 50, "End.", "END!!", "été,", "É%%%", "e\u0301.", "a\u0338,", "don't!", "~", "a~b", "...", "3.", "»,", "<|endoftext|>."]
    rows = []
    for i in range(n):
        text = "".join(str(rng.choice(words)) + str(rng.choice([" ", "\n", "  ", "\t"])) for _ in range(int(rng.integers(0, 120))))
        rows.append((i, text, ["a", "a", "a", "b", None][i % 5]))
    return [*rows, (n, None, "c"), (n + 1, "", "c")]


def test_every_id_once_and_gapless(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    check(rows, packing.pack(docs, PATH, length=256, window=512).collect(), 256)


def test_windows_hold_the_targets(spark):
    rows = [(i, "one two three four five six seven " * 20, "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    source = {i: s for i, _, s in rows}
    share = defaultdict(int)
    pieces = packing.pack(docs, PATH, targets={"a": 3.0, "b": 1.0}, length=256, window=256).collect()
    check(rows, pieces, 256)
    for p in pieces:
        if source[p.doc_id] == "a":
            share[p.sequence_id] += p.length
    assert all(abs(share[s] - 192) <= 4 for s in range(60))


def test_shared_queue_and_empty_table(spark):
    rows = [(i, "word " * i, f"s{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, packing.pack(docs, PATH, length=64, window=128, queues=3).collect(), 64)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string"), PATH).count() == 0


def test_shares_are_monotone_and_whole():
    s = packing.Shares([1000, 37, 1, 12345], [1, 1, 0, 2], 100)
    last = [0] * 4
    for w in range(1, -(-s.end // 100) + 1):
        now = s.all(w)
        assert all(a <= b for a, b in zip(last, now, strict=True))
        last = now
    assert last == [1000, 37, 1, 12345]


def test_sources_beyond_the_queues_hold_their_shares(spark):
    rows = [(i, "one two three four five six seven " * 20, f"s{i % 12:02}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(docs, PATH, length=480, window=480, queues=3).collect()
    check(rows, pieces, 480)
    share = defaultdict(int)
    for p in pieces:
        share[p.sequence_id, p.doc_id % 12] += p.length
    assert all(abs(share[s, k] - 40) <= 20 for s in range(max(p.sequence_id for p in pieces) - 1) for k in range(12))


def test_named_source_beyond_the_queues_keeps_its_target(spark):
    rows = [(i, "one two three four five six seven " * 20, "abc"[min(2, i // 10)]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(docs, PATH, targets={"a": 1.0, "c": 3.0}, length=256, window=256, queues=1).collect()
    check(rows, pieces, 256)
    share = [sum(p.length for p in pieces if p.sequence_id == s and p.doc_id < 10) for s in range(15)]
    assert all(abs(x - 64) <= 4 for x in share)


def test_ids_of_random_strings_as_the_library():
    """Combining marks, letters that change their number in lower case, the mark between words."""
    rng = np.random.default_rng(7)
    parts = ["İ", "i\u0307", "I\u0307", "BELEDİYESİ", "ß", "ẞ", "ŉ", "ǰ", "K", "Å", "A\u030a", "e\u0301", "가", "\u1100\u1161", "ﬁ", "ſ", "ά", "ΑΣ", "\u0338", "\u0345", "ⅷ", "²", "x", "Qu", "'s", "don't", "~", "~~", "<|", "<|endoftext|>", ".", ",", "!?", "#", "|", "%", "$", "\u200d", "😀", "́", "7", "\u1e9e", "\u00b7", "\u02b0", "\u0e33", "\u2167"]
    texts = ["".join(rng.choice(parts) + (str(rng.choice([" ", "\n", "\u00a0", "\u2003"])) if rng.random() < 0.3 else "") for _ in range(int(rng.integers(1, 14)))) for _ in range(6000)]
    texts += ["BELEDİYESİ. son", "İ.", "aİ,", None, ""]
    lib = Tokenizer.from_file(PATH)
    with open(PATH) as f:
        got = packing.Ids(f.read(), "<u4")(texts)
    for t, x in zip(texts, got, strict=True):
        assert np.frombuffer(x, "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(1_000_000))
    rows = [(1, "one two", "a"), (1, "one two", "a"), (None, "three", "a"), (2, None, None), (3, long, "b")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, source string, length string, start int, offset int, queue int")
    got = packing.pack(docs, PATH).collect()
    assert sum(p.length for p in got if p.doc_id == 1) == 2 * 3 and sum(p.length for p in got if p.doc_id is None) == 2
    check([r for r in rows if r[0] in (2, 3)], [p for p in packing.pack(docs.where("doc_id > 1"), PATH).collect()], 4096)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_tempered_mixture(spark):
    """Each window holds the sources in the proportion of their tokens to a power, until one runs dry."""
    rows = [(i, "one two three four five six seven " * 20, "aaaaaaaab"[i % 9]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(docs, PATH, temper=0.5, length=256, window=1024).collect()
    check(rows, pieces, 256)
    source, share = {i: s for i, _, s in rows}, defaultdict(int)
    for p in pieces:
        if p.sequence_id < 40:
            share[p.sequence_id // 4, source[p.doc_id]] += p.length
    want = 1024 / (1 + 8**0.5)
    assert all(abs(share[w, "b"] - want) <= 1 for w in range(10))


def served(shares, totals, window, windows):
    """Tokens of each source in the first windows, by where its tokens lie."""
    out = [[0] * len(totals) for _ in range(windows)]
    for i, t in enumerate(totals):
        for k, place in shares.places(i, 0, t):
            while k and place < windows * window:
                some = min(k, window - place % window)
                out[place // window][i] += some
                place, k = place + some, k - some
    return out


@pytest.mark.parametrize("queues", [1, 2, 3, 10])
def test_tempered_shares_hold_beyond_the_queues(queues):
    """Whatever number of queues a round-robin has, a source's share goes with its tokens to the power."""
    totals, window = [90_000, 80_000, 40_000, 10_000], 4096
    weights = [t**0.5 for t in totals]
    got = served(packing.Nested(totals, weights, window, queues, set()), totals, window, 20)
    for w in range(20):
        assert sum(got[w]) == window
    for i, x in enumerate(weights):
        assert abs(sum(g[i] for g in got) - 20 * window * x / sum(weights)) <= 8


def test_windows_as_a_plain_round_robin():
    """Token by token: each window gives a queue its quantum and what it kept of the last one."""
    totals, window, weights = [5000, 3000, 900, 400], 100, [3.0, 2.0, 1.0, 0.5]
    nested = packing.Nested(totals, weights, window, 10, set())
    line, deficit, left = [], [Fraction(0)] * 4, list(totals)
    while all(x > window for x in left):
        for i in range(4):
            deficit[i] += Fraction(window) * Fraction(weights[i]) / Fraction(sum(weights))
            take = int(deficit[i])
            deficit[i] -= take
            line += [(i, totals[i] - left[i] + k) for k in range(take)]
            left[i] -= take
    want = {x: p for p, x in enumerate(line)}
    got = {}
    for i, t in enumerate(totals):
        first = 0
        for k, place in nested.places(i, 0, t):
            got |= {(i, first + d): place + d for d in range(k)}
            first += k
    assert sorted(got.values()) == list(range(sum(totals)))
    assert len(want) > 3000 and all(got[x] == p for x, p in want.items())
