"""Token counts with a public tokenizer, without keeping ids."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.words import by_bytes, utf8

MEMO = 1_000_000  # pieces and words that a worker remembers; beyond that it starts afresh
BATCH_BYTES = 1 << 18  # bytes that one call of the library gets
TOGETHER = 1000  # words encoded as one text
MARKS = b".,;:!?%#*&$"
WORD_END = "</w>"  # of the last token of a word, in vocabularies that mark it
_KEPT: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Ids of whole texts, put together from the ids of their pieces.

    Where a tokenizer drops white space, a text may be cut at ASCII white space: no token, no
    normalisation and no special string reaches across. Pieces repeat, so each is encoded once per
    worker, in calls balanced by bytes. A tokenizer that keeps white space gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        last = np.zeros(0, bool)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
            self.size = model.get_piece_size()
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_padding()
            model.no_truncation()
            self.size = model.get_vocab_size()
            batch = getattr(model, "encode_batch_fast", model.encode_batch)  # the same ids without offsets, where there is one
            self._encode = lambda texts: [e.ids for e in batch(texts, add_special_tokens=False)]
            tokens = sorted(model.get_vocab().items(), key=lambda t: t[1])
            last = np.zeros(tokens[-1][1] + 1, bool)
            last[[i for t, i in tokens if t.endswith(WORD_END)]] = True
        probes = ["a b", "a\n b", "A\t.b", "é  1x", "Don't .,", "x9 %%%"]
        ends = ["Ab .,", "é !?", "9 ***"]  # here the blank itself must not matter
        self.cuts = all(
            self._encode([p])[0] == [i for part in p.split() for i in self._encode([part])[0]] for p in probes
        ) and all(self._encode([p])[0] == self._encode([p.replace(" ", "").lower()])[0] for p in ends)
        self.ends = last if self.cuts and last.any() else None
        self._memo: dict = {}

    @classmethod
    def of(cls, path: str, use: str) -> Encoder:
        """The encoder that this worker keeps from task to task for one use."""
        if (path, use) not in _KEPT:
            _KEPT[path, use] = cls(path)
        return _KEPT[path, use]

    def pieces(self, text: bytes) -> list[bytes]:
        return text.split() if self.cuts else [text] if text else []

    def learn(self, pieces: set[bytes], kind: np.dtype | type[tuple] | None = None) -> dict:
        """The ids of every piece as bytes of ``kind`` or as tuples, or without it their number; asks the library only for new words."""
        if len(self._memo) > MEMO or not self.cuts:
            self._memo = {}
        memo = self._memo
        asked = pieces.difference(memo)
        ends = [p for p in asked if p[-1] in MARKS]
        stems = list(map(self._word, ends))
        tails = [p[len(w) :] for p, w in zip(ends, stems)]
        asked.difference_update(compress(ends, tails))
        asked.update(compress(stems, tails))
        asked.update(tails)
        asked.discard(b"")
        asked.difference_update(memo)
        words = list(asked)
        calls = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // BATCH_BYTES
        cuts = [*(np.flatnonzero(np.diff(calls)) + 1).tolist(), len(words)]
        for start, stop in zip([0, *cuts], cuts):
            self._ask(words[start:stop], kind)
        for piece, stem, tail in zip(ends, stems, tails):
            if tail:
                memo[piece] = memo[stem] + memo[tail]
        return memo

    def _ask(self, words: list[bytes], kind: np.dtype | type[tuple] | None) -> None:
        """Remembers the ids of each word. Words of letters alone end in one token that says so: they are encoded as one
        text and its ids cut at those tokens, unless their number is another one; then, and otherwise, each is a text.
        """
        # where texts are cut at white space, no word holds a blank
        texts = b" ".join(words).decode().split(" ") if self.cuts and words else [w.decode() for w in words]
        if self.ends is not None:
            letters = list(map(str.isalpha, texts))
            plain, spelled = list(compress(words, letters)), list(compress(texts, letters))
            other = [not x for x in letters]
            words, texts = list(compress(words, other)), list(compress(texts, other))
            starts = range(0, len(plain), TOGETHER)
            for at, ids in zip(starts, self._encode([" ".join(spelled[a : a + TOGETHER]) for a in starts])):
                group, ids = plain[at : at + TOGETHER], np.array(ids, np.int64)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(group) and cuts[-1] == len(ids):
                    self._memo.update(zip(group, _cut(ids, cuts, kind)))
                else:
                    words += group
                    texts += spelled[at : at + TOGETHER]
        if words:
            found = self._encode(texts)
            cuts = np.cumsum([len(ids) for ids in found])
            self._memo.update(zip(words, _cut(np.array([i for ids in found for i in ids], np.int64), cuts, kind)))

    def _word(self, piece: bytes) -> bytes:
        """The piece without the marks at its end: a letter or digit and a mark never share a token where white
        space may be cut. Pieces with ``<`` may hold special strings and stay whole.
        """
        word = piece.rstrip(MARKS)
        if not word or not self.cuts or b"<" in piece:
            return piece
        if word[-1:].isalnum() or word[-1] > 127 and word[-16:].decode(errors="ignore")[-1:].isalnum():
            return word
        return piece


def _cut(ids: np.ndarray, cuts: np.ndarray, kind: np.dtype | type[tuple] | None) -> list:
    """What lies between the cuts: bytes of ``kind`` or tuples, or without it how many ids."""
    if kind is None:
        return np.diff(cuts, prepend=0).tolist()
    if kind is tuple:
        given, at = ids.tolist(), cuts.tolist()
        return [tuple(given[a:b]) for a, b in zip([0, *at], at)]
    packed, at = ids.astype(kind).tobytes(), (cuts * kind.itemsize).tolist()
    return [packed[a:b] for a, b in zip([0, *at], at)]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids keep their own rows; an empty
    table gives no rows. Other columns of ``docs`` are not read. ``tokenizer`` is a file every executor has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, "count")
        for batch in by_bytes(batches, "text"):
            texts = [t or b"" for t in utf8(batch.column("text"))]
            pieces = [encoder.pieces(t) for t in texts]
            known = encoder.learn(set().union(*pieces))
            sums = [sum(map(known.__getitem__, p)) for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(sums, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
