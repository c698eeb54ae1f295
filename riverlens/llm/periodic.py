"""Periodic runs of words, found in the grammar of each text.

The word ids of a batch of texts are compressed by Re-Pair: the most frequent pair of neighbours of a
text becomes a nonterminal, until no pair of it occurs twice. All texts of the batch are worked on at
once, and in one round every occurrence that is more frequent than the pairs it overlaps is replaced.
Any stretch of two words or more crosses the boundary of exactly one node of the derivation, so each run
lies whole inside the expansion of a node whose boundary it crosses. Runs that cross a nonterminal's
boundary are computed once, in one expansion, and translated to all its derivation positions; what stays
uncompressed at the top is a balanced tree over its symbols. Pieces of one run that several nodes see
are merged to maximal intervals.

Words equal to those `q` places on are compared by ranks of stretches of 1, 2, 4, .. words (prefix
doubling), so the work is near-linear in the words even where a text is one long run. Places where no
run can be are known beforehand: every five words inside of a run occur again in its text.

Defined cases: a null or empty text has no words and no runs; very long texts are read whole; repeated
rows have the same runs; an empty table gives an empty result. Columns other than id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ship

#: Shortest run, and how often it holds its period at least.
LEAST, TIMES = 6, 4
#: Words of the stretches that a run repeats: LEAST less a period of one.
STRETCH = LEAST - 1
#: Words of a batch of texts that is compressed together, and pairs (boundary, period) tried at once.
BATCH_WORDS, TRIED = 500_000, 4_000_000


def repair(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start, mid, end) of every occurrence of a nonterminal, and the places at which the
    symbols left over begin. sym: ids of words that no two texts share, below 2^31."""
    n = len(sym)
    sym = np.r_[-1, sym, -2].astype(np.int64)  # places are moved by one: both ends have a neighbour
    nxt, prv = np.arange(1, n + 3), np.arange(-1, n + 1)
    prv[0] = 0
    priority = np.zeros(n + 2, np.int64)
    at, rule, out = np.arange(1, n), max(2, int(sym.max()) + 1), []
    alive = np.ones(n + 2, bool)
    while len(at):
        key = (sym[at] << 32) | sym[nxt[at]]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        count = count[which]
        more = count > 1
        at, which, count = at[more], which[more], count[more]
        if not len(at):
            break
        # the more frequent pair first; of equally frequent ones the order is scrambled, for flat trees
        own = (count << 32) | ((which * 0x9E3779B1) & 0xFFFFFFFF)
        priority[at] = own
        before, after = priority[prv[at]], priority[nxt[at]]
        # equal neighbours are one pair over and over (a a a): every other one is taken
        i = np.arange(len(at))
        odd = (i - np.maximum.accumulate(np.where(before == own, 0, i))) % 2
        win = (before <= own) & (after <= own) & (odd == 0)
        priority[at] = 0
        w = at[win]
        _, w_rule = np.unique(which[win], return_inverse=True)
        second = nxt[w]
        end = nxt[second]
        out.append((w_rule + rule, w - 1, second - 1, end - 1))
        sym[w] = w_rule + rule
        rule += int(w_rule.max()) + 1
        nxt[w], prv[end] = end, w
        alive[second] = False
        at = np.unique(np.r_[at, w, prv[w]])
        at = at[alive[at] & (at > 0) & (nxt[at] <= n)]
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
    return (*parts, np.flatnonzero(alive[1:-1]))


class _Ranks:
    """Ranks of all stretches of 2^k words of an array, by which common stretches are measured."""

    def __init__(self, words: np.ndarray, longest: int):
        self.n = len(words)
        _, rank = np.unique(words, return_inverse=True)
        self.levels = [rank.astype(np.int32)]
        while (2 << len(self.levels)) <= 2 * longest:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            ahead = np.full(self.n, -1, np.int64)
            ahead[: max(0, self.n - half)] = last[half:]
            _, rank = np.unique((last.astype(np.int64) << 32) | (ahead + 1), return_inverse=True)
            self.levels.append(rank.astype(np.int32))

    def common(self, a: np.ndarray, b: np.ndarray, room: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that are equal from places a and b on (or before them, backwards), at most `room`."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            size = 1 << k
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                fits = got + size <= room
                x, y = (a - got - size, b - got - size) if back else (a + got, b + got)
                level = self.levels[k]
                fits &= level[np.where(fits, x, 0)] == level[np.where(fits, y, 0)]
                got[fits] += size
        return got


def _repeated(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place, whether the STRETCH words from it on occur again in their text (or, by a clash
    of hashes, seem to)."""
    n = len(word) - STRETCH + 1
    out = np.zeros(len(word), bool)
    if n <= 0:
        return out
    h = mix(word.astype(np.uint64) + np.uint64(1))
    g = np.zeros(n, np.uint64)
    for j in range(STRETCH):
        g = mix(g + h[j : j + n])
    inside = np.flatnonzero(text[:n] == text[STRETCH - 1 :])
    g = g[inside]
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    out[inside[order[np.r_[same, False] | np.r_[False, same]]]] = True
    return out


def _boundaries(sym, text, where):
    """Arrays (lo, mid, hi, rule): each boundary to be looked at once with the stretch around it that a run
    may fill, and the occurrences of rules. where: stretches that runs lie in, (begin, end) by place."""
    rule, start, mid, end, top = repair(sym)
    first = np.unique(rule, return_index=True)[1]
    long = first[end[first] - start[first] >= LEAST]
    # the symbols left over: boundaries inside of each stretch, as a balanced tree in order
    begin, stop = where
    b = top[(begin[top] >= 0) & (begin[top] < top) & (top > 0)]
    b = b[text[b] == text[b - 1]]
    home = begin[b]
    head = np.r_[True, home[1:] != home[:-1]] if len(b) else np.zeros(0, bool)
    heads = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    size = np.diff(np.r_[heads, len(b)])
    i = np.arange(len(b)) - heads[group] + 1 if len(b) else np.zeros(0, np.int64)
    low = i & -i
    left = np.where(i - low > 0, b[np.maximum(heads[group] + i - low - 1, 0)], begin[b]) if len(b) else b
    right = np.where(i + low <= size[group], b[np.minimum(heads[group] + i + low - 1, len(b) - 1)], stop[b]) if len(b) else b
    los = np.r_[np.maximum(start[long], begin[mid[long]]), left]
    his = np.r_[np.minimum(end[long], stop[mid[long]]), right]
    mids, rules = np.r_[mid[long], b], np.r_[rule[long], np.full(len(b), -1)]
    ok = (begin[mids] >= 0) & (begin[mids] < mids) & (his - los >= LEAST)
    return (los[ok], mids[ok], his[ok], rules[ok]), (rule, mid)


def find_runs(sym: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, ordered by start. sym: ids of words that no two texts share;
    text: the text of each word."""
    none = np.empty(0, np.int64)
    hits = _repeated(sym, text)
    covered = np.zeros(len(sym) + 1, np.int64)
    at = np.flatnonzero(hits)
    np.add.at(covered, at, 1)
    np.add.at(covered, np.minimum(at + STRETCH, len(sym)), -1)
    covered = np.cumsum(covered[:-1]) > 0
    edge = covered & ~np.r_[False, covered[:-1] & (text[1:] == text[:-1])]
    begins = np.flatnonzero(edge)
    if not len(begins):
        return none, none, none
    shut = covered & ~np.r_[covered[1:] & (text[1:] == text[:-1]), False]
    stops = np.flatnonzero(shut) + 1
    stretch = np.cumsum(edge) - 1
    begin, stop = np.where(covered, begins[stretch], -1), np.where(covered, stops[stretch], -1)
    (lo, mid, hi, rule), (rules, mids) = _boundaries(sym, text, (begin, stop))
    # ranks are made of the stretches alone, one after the other
    place = np.cumsum(covered) - 1
    ranks = _Ranks(sym[covered], int((stops - begins).max()))
    word = sym
    found = []
    # a run has two periods or more on one side of the boundary that it crosses
    for right in (True, False):
        most = np.maximum((hi - mid) // 2 if right else (mid - lo) // 2, 0)
        edges = np.r_[0, np.cumsum(most)]
        i = 0
        while i < len(lo):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + TRIED, "right")) - 1)
            of = np.repeat(np.arange(i, j), most[i:j])
            q = np.arange(len(of)) - np.repeat(edges[i:j] - edges[i], most[i:j]) + 1
            m = mid[of]
            s = q if right else -q
            near = (word[m] == word[np.clip(m + s, 0, len(word) - 1)]) & (word[m - 1] == word[np.clip(m - 1 + s, 0, len(word) - 1)])
            of, q, m = of[near], q[near], m[near]
            a, b, y = place[m], place[lo[of]], place[hi[of] - 1] + 1
            if right:  # words from the boundary on equal those a period later; then backwards
                on = ranks.common(a, a + q, y - a - q)
                back = ranks.common(a, a + q, a - b, back=True)
                s0, e0 = m - back, m + q + on
            else:
                back = ranks.common(a - q, a, a - q - b, back=True)
                on = ranks.common(a - q, a, y - a)
                s0, e0 = m - q - back, m + on
            ok = (e0 - s0 >= np.maximum(LEAST, TIMES * q)) & (s0 < m) & (e0 > m)
            found.append((s0[ok], e0[ok], q[ok], m[ok], rule[of[ok]]))
            i = j
    if not found:
        return none, none, none
    s, e, q, m, r = (np.concatenate(x) for x in zip(*found, strict=True))
    # from the expansion that was looked at to all derivation positions
    order = np.argsort(rules, kind="stable")
    by_rule = rules[order]
    a, b = np.searchsorted(by_rule, r, "left"), np.searchsorted(by_rule, r, "right")
    times = np.where(r >= 0, b - a, 1)
    of = np.repeat(np.arange(len(s)), times)
    k = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    moved = np.where(r[of] >= 0, mids[order[np.minimum(a[of] + k, max(len(order) - 1, 0))]] - m[of], 0) if len(order) else np.zeros(len(of), np.int64)
    return _maximal(s[of] + moved, e[of] + moved, q[of])


def _maximal(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of equal period that share a period or more are one run; of runs with the same words the
    least period counts."""
    if not len(s):
        return s, e, q
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    high = int(e.max()) + 1
    upto = np.maximum.accumulate(e + q * high) - q * high  # periods ascend, so none reaches into the next
    new = np.r_[True, (q[1:] != q[:-1]) | (s[1:] > upto[:-1] - q[1:])]
    at = np.flatnonzero(new)
    s, e, q = s[at], np.maximum.reduceat(e, at), q[at]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    least = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])]
    return s[least], e[least], q[least]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), size)
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, len(text))
    sym = np.unique(text * max(1, len(ids)) + word, return_inverse=True)[1] if len(text) else word
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    first = np.cumsum(size) - size
    s, e, q = find_runs(sym.astype(np.int64), text) if len(text) >= LEAST else (word[:0],) * 3
    for a, b, p, t in zip(s.tolist(), e.tolist(), q.tolist(), text[s].tolist(), strict=True):
        at = int(first[t])
        out[t].append((a - at, b - a, p))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _each(batches, make):
    """(id, words, runs) of every row, in batches of texts whose words are compressed together."""
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        at, words, n = 0, [], 0
        for i, t in enumerate(texts):
            w = (t.as_buffer().to_pybytes() if t.is_valid else b"").split()
            words.append(w)
            n += len(w)
            if n >= BATCH_WORDS or i == len(texts) - 1:
                yield make(ids.slice(at, len(words)), words, runs_of(words))
                at, words, n = i + 1, [], 0


def _over(docs: DataFrame, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("x"))
    return d.mapInArrow(lambda batches: _each(batches, make), schema)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period), a row for each run; words are numbered from 0."""

    def make(ids, words, found):
        of = np.repeat(np.arange(len(words)), [len(x) for x in found])
        cols = [pa.array([r[k] for x in found for r in x], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *cols], ["doc_id", "start", "length", "period"])

    return _over(docs, id_col, text_col, make, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, text): each text with one period left of every run, words joined by a space."""

    def make(ids, words, found):
        kept = [b" ".join(kept_words(w, r)) for w, r in zip(words, found, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(map(len, found), pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_runs", "text"])

    return _over(docs, id_col, text_col, make, "doc_id long, n_runs long, text string")


_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the run of greatest length (start, length, period, exponent_milli; nulls without
    any) and hashes of the list of runs and of the collapsed text, a row for each row of docs."""

    def make(ids, words, found):
        best = [min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None) for r in found]
        longs = [[len(r) for r in found], *([b[k] for b in best] for k in range(3)), [1000 * b[1] // b[2] if b[2] else None for b in best]]
        listed = ["".join(f"{s},{n},{p}\n" for s, n, p in r).encode() for r in found]
        kept = [b" ".join(kept_words(w, r)) for w, r in zip(words, found, strict=True)]
        cols = [*(pa.array(x, pa.int64()) for x in longs), *(pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (listed, kept))]
        return pa.RecordBatch.from_arrays([ids, *cols], [x.split()[0] for x in _DIGEST.split(", ")])

    return _over(docs, id_col, text_col, make, _DIGEST)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a period planted in one document of ten: with h the CRC-32 of its id and
    g = h div 10, word i >= a is word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("_h", F.crc32(F.col("doc_id").cast("string")))
    own = F.expr(r"""
        transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')), w -> case when size(w) = 0 then text else
            transform(array(_h div 10), g -> transform(array(cast(g % size(w) as int)), a ->
                transform(array(cast(1 + (size(w) - a) div (3 + g % 8) as int)), p -> array_join(
                    transform(w, (x, i) -> case when i < a then x else w[cast(a + (i - a) % p as int)] end), ' '))[0])[0])[0] end)[0]""")
    return d.select("doc_id", F.when(F.col("_h") % 10 == 0, own).otherwise(F.col("text")).alias("text"))
