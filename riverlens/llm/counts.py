"""Token counts of whole texts by the whole-token shortcut, for a sentencepiece BPE vocabulary.

What holds for every text is proved once, on the driver, from the vocabulary alone. A place between two
characters that stand side by side in no piece is never merged across, so a text falls apart there and
its parts are encoded independently. That holds before every space (no piece has one behind another
character), on both sides of a line's end where no piece has one, and before many marks that end a
word. And each string of the vocabulary is encoded alone: those that stay one token are `whole`.

A text is cut into words at the proved places. Words that are whole count one, a mark at a word's end
that no piece joins to it counts one more, and only the rest is merged, by the library, each
distinct word of a task once. The proofs are as large as the vocabulary and are what tasks receive.

Defined cases: a null or empty text has no tokens and no bytes; very long texts and words are counted
whole; strings of control pieces in a text are ordinary text, and characters that the vocabulary lacks
count as their bytes, both as in the library; repeated rows are counted alike; an empty table gives an
empty result. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, ship

#: The mark that stands for a space in a piece.
SPACE = "▁"
#: Characters of words that a task keeps the counts of.
KNOWN_CHARS = 16_000_000
#: A space with all spaces before it and the word behind it.
_WORDS = re.compile(r" +[^ ]*")


class TokenCounter:
    """Counts tokens by word. A word is what follows a space; where line ends are apart, one that begins
    with a line's end follows none, and one that follows both begins with SPACE."""

    def __init__(self, proto: bytes, whole: frozenset, joined: frozenset, single: frozenset):
        """whole: words of one token. joined: pairs of characters that some piece holds side by side.
        single: characters that are pieces."""
        self.proto, self.whole, self.joined, self.single = proto, whole, joined, single
        self.ends_apart = not any("\n" in pair for pair in joined)
        self._library, self._known, self._chars = None, {}, 0

    def __reduce__(self):
        return TokenCounter, (self.proto, self.whole, self.joined, self.single)

    def merged(self, words: list[str]) -> list[int]:
        """What the library makes of words, each put behind a space."""
        if self._library is None:
            self._library = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        return [len(x) for x in self._library.encode(words, num_threads=1)]

    def forget(self) -> None:
        self._known, self._chars = dict.fromkeys(self.whole, 1), 0

    def _learn(self, new: set[str]) -> None:
        known, joined, single, rest = self._known, self.joined, self.single, []
        for w in new:
            if w[-1:] in single and w[-2:] not in joined and w[:-1] in known:
                known[w] = known[w[:-1]] + 1  # a mark that no piece joins to what is before it
            else:
                rest.append(w)
        for w, n in zip(rest, self.merged([w.removeprefix(SPACE) for w in rest]), strict=True):
            # the space that the library puts before a line's end is a token of its own
            known[w] = n - 1 if self.ends_apart and w[:1] == "\n" else n
        self._chars += sum(map(len, new))

    def words(self, text: str) -> list[str]:
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] in " \n" or " \n" in text:
            words = [w[1:] for w in _WORDS.findall(" " + text)]
            return [SPACE + w if w[:1] == "\n" else w for w in words] if self.ends_apart else words
        return (text.replace("\n", " \n") if self.ends_apart else text).split(" ")

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        words = self.words(text)
        new = set(words).difference(self._known)
        if new:
            if not self._known or self._chars > KNOWN_CHARS or len(self._known) + len(new) > CACHE_WORDS + len(self.whole):
                self.forget()
                new = set(words).difference(self._known)
            self._learn(new)
        return sum(map(self._known.__getitem__, words))


def proved(model_path: str) -> TokenCounter:
    """The counter of a sentencepiece model, or ValueError where its settings are not those that the
    shortcut is proved for: BPE, text left as it is but for a space put in front, spaces kept, and no
    piece with a space behind another character."""
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    if model.trainer_spec.model_type != model.trainer_spec.BPE or not plain or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("no BPE model of plain text with a space in front")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("models with user-defined or unused pieces are not handled")
    pieces = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece holds a space behind another character")
    joined = frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))
    words = [p[1:].replace(SPACE, " ") for p in pieces if p[0] == SPACE]
    whole = frozenset(w for w, ids in zip(words, library.encode(words), strict=True) if len(ids) == 1)
    single = frozenset(p for p in pieces if len(p) == 1)
    if SPACE not in single:
        raise ValueError("a space is no piece")
    return TokenCounter(library.serialized_model_proto(), whole | {""}, joined, single)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, in one scan without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(proved(model_path))

    def run(batches):
        counter = shared.value
        for b in batches:
            texts = b.column(1)
            n = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])
        counter.forget()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("x"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def over_limit(docs: DataFrame, model_path: str, limit: int = 4096, **cols) -> DataFrame:
    """token_counts() and whether a text has more than `limit` tokens."""
    return token_counts(docs, model_path, **cols).withColumn("over_limit", F.col("n_tokens") > limit)
