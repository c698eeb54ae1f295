"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct new pretokens of a partition's batch are laid out in one array. An index maps each pair
that has a rank to its positions; the active ranks are applied in ascending order, each to all its
positions at once, and only the lists of the pairs beside a merge are updated.

Defined cases: a null or empty text has no ids and decodes to the empty string; strings of added
tokens in a text are those tokens, as in the library; very long texts and pretokens are encoded whole;
repeated rows are encoded alike; an empty table gives an empty result. Columns other than id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, ship

#: Fixed value: the pattern of byte-level pretokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 letters for
    themselves, the other bytes from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary in the tokenizers library's JSON form."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        byte_of = byte_letters()
        vocab = model["vocab"]
        raw = {i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode() for token, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        raw |= {i: token.encode() for token, i in self.added.items()}
        self.raw = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.first = np.zeros(256, np.int64)
        for letter, b in byte_of.items():
            self.first[b] = vocab[letter]
        self.rank: dict[tuple[int, int], int] = {}
        self.pair: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if made.get(x, -1) >= r or made.get(y, -1) >= r:
                raise ValueError("a merge comes before the merges that make its parts")
            made.setdefault(z, r)
            self.rank.setdefault((x, y), r)
            self.pair.append((x, y, z))
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pretoken = regex.compile(PATTERN)
        self.mixed_space = re.compile(r" \s|\s ")
        self.ids: dict[str, bytes] = {}

    def encode_pretokens(self, items: list[bytes]) -> list[list[int]]:
        """Ids of each item; all items are worked on together, rank after rank."""
        joined = np.frombuffer(b"".join(items), np.uint8)
        length = np.fromiter(map(len, items), np.int64, len(items))
        ends = np.cumsum(length)
        # a symbol is an id; -1 is merged away. Items meet where `last` is true.
        sym = self.first[joined].tolist()
        n = len(sym)
        last = np.zeros(n, bool)
        last[ends - 1] = True
        inside = np.flatnonzero(~last)
        places: dict[int, list[int]] = {}
        rank, pair = self.rank, self.pair
        for p in inside.tolist():
            r = rank.get((sym[p], sym[p + 1]))
            if r is not None:
                if r in places:
                    places[r].append(p)
                else:
                    places[r] = [p]
        right = np.where(last, -1, np.arange(1, n + 1)).tolist()
        left = np.where(np.r_[True, last[:-1]], -1, np.arange(-1, n - 1)).tolist()
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, c = pair[r]
            found = places.pop(r)
            if a == b:
                found.sort()
            for p in found:
                q = right[p]
                if sym[p] != a or q < 0 or sym[q] != b:
                    continue  # changed since it was listed
                sym[p], sym[q] = c, -1
                after = right[q]
                right[p] = after
                if after >= 0:
                    left[after] = p
                    s = rank.get((c, sym[after]))
                    if s is not None:
                        if s in places:
                            places[s].append(p)
                        else:
                            places[s] = [p]
                            heapq.heappush(active, s)
                before = left[p]
                if before >= 0:
                    s = rank.get((sym[before], c))
                    if s is not None:
                        if s in places:
                            places[s].append(before)
                        else:
                            places[s] = [before]
                            heapq.heappush(active, s)
        out, start = [], 0
        for end in ends.tolist():
            out.append([x for x in sym[start:end] if x >= 0])
            start = end
        return out

    def _chunks(self, text: str) -> list[str]:
        """Stretches that can be encoded apart from each other. A single space between two other
        characters that aren't white space always begins a pretoken."""
        if self.mixed_space.search(text):
            return self.pretoken.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def _learn(self, chunks: set[str]) -> None:
        split = {c: self.pretoken.findall(c) for c in chunks}
        items = list({p for ps in split.values() for p in ps})
        ids = dict(zip(items, self.encode_pretokens([p.encode() for p in items]), strict=True)) if items else {}
        for c, ps in split.items():
            self.ids[c] = np.array([i for p in ps for i in ids[p]], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts, new = [], set()
        for t in texts:
            own: list = []
            if t:
                for i, x in enumerate(self.special.split(t) if self.special and self.special.search(t) else [t]):
                    if i % 2:
                        own.append(np.array([self.added[x]], "<u4").tobytes())
                    elif x:
                        own += self._chunks(x)
            parts.append(own)
            new.update(x for x in own if x.__class__ is str)
        new = new.difference(self.ids)
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids.clear()
            new = {x for own in parts for x in own if x.__class__ is str}
        if new:
            self._learn(new)
        get = self.ids.get
        return [b"".join([get(x) if x.__class__ is str else x for x in own]) for own in parts]

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_BPE: dict[int, Bpe] = {}


def _bpe(text: str) -> Bpe:
    key = zlib.crc32(text.encode())
    if key not in _BPE:
        _BPE.clear()
        _BPE[key] = Bpe(text)
    return _BPE[key]


def _over_texts(spec, make):
    """mapInArrow over (id, text) in slices small enough for their index to stay in memory."""

    def run(batches):
        bpe = _bpe(spec.value)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                yield make(bpe, c.column(0), c.column(1).to_pylist())

    return run


def _input(docs: DataFrame, id_col: str, col: str, kind: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(col).cast(kind).alias("x"))


def _spec(docs: DataFrame, path: str):
    with open(path) as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def make(bpe, ids, texts):
        return pa.RecordBatch.from_arrays([ids, pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(texts)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _input(docs, id_col, text_col, "string").mapInArrow(_over_texts(_spec(docs, tokenizer_path), make), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of encode()'s form; null ids give the empty string."""

    def make(bpe, ids, rows):
        return pa.RecordBatch.from_arrays([ids, pa.array([bpe.decode(np.array(x or [], "<u4").tobytes()) for x in rows], pa.string())], ["doc_id", "text"])

    return _input(encoded, id_col, ids_col, "array<int>").mapInArrow(_over_texts(_spec(encoded, tokenizer_path), make), "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, in one pass."""

    def make(bpe, ids, texts):
        coded = bpe.encode(texts)
        cols = [
            pa.array([len(x) // 4 for x in coded], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
            pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in coded]),
        ]
        return pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _input(docs, id_col, text_col, "string").mapInArrow(_over_texts(_spec(docs, tokenizer_path), make), schema)
