"""Spelling variants: words are reduced to a few symbols, and reduced words one edit apart are compared as words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.words import U, by_bytes, mix, signed, utf8
from wardline.plans.scale import work_folder

LEAST = 7  # code points of a word
TIMES = 10  # a form is so many times as frequent as its variant
TYPO = 31  # one run in so many loses a letter
LETTERS = [*range(97, 123), *range(0xC0, 0x100)]  # after A-Z are lower-cased
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 22  # characters searched at a time
_KEPT = 1 << 19  # words counted before they are sent on
_BASE = 0x9E3779B97F4A7C15


def runs(text: str) -> Iterator[list[str]]:
    """Runs of letters of a lower-cased text; long texts in blocks that end outside a run."""
    at = 0
    while at < len(text):
        end = at + _BLOCK
        if end < len(text):
            tail = _RUN.match(text, end)
            end = tail.end() if tail else end
        yield _RUN.findall(text, at, end)
        at = end


def text_words(text: bytes, name: bytes, least: int = LEAST) -> Iterator[Counter]:
    """Words of one document with their counts: one run in ``TYPO``, chosen by crc32 of ``name:run``, loses a letter."""
    start = zlib.crc32(name + b":")
    for found in runs(text.translate(_LOW).decode()):
        out: Counter = Counter()
        for run, n in Counter(r for r in found if len(r) >= least).items():
            h = zlib.crc32(run.encode(), start)
            if h % TYPO == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            out[run] += n
        yield out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, twice: int = 2) -> DataFrame:
    """``word`` and ``n`` of all words of at least ``least`` code points that occur ``twice`` or more.

    A null text has no words; a null id is written as empty text in the name that chooses the letters.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in by_bytes(batches, "text"):
            for name, text in zip(utf8(batch.column("name")), utf8(batch.column("text"))):
                for words in text_words(text or b"", name, least):
                    held.update(words)
                if len(held) > _KEPT:
                    yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= twice)


def alphabet(words: DataFrame, symbols: int) -> str:
    """Symbol of each of ``LETTERS``: they are dealt in order of frequency, so that symbols are about equally frequent."""
    letters = words.select(F.explode(F.split("word", "")).alias("x")).groupBy("x").count().collect()  # at most 90 rows
    often = {r[0]: r[1] for r in letters}
    load, dealt = [0] * symbols, {}
    for x in sorted(map(chr, LETTERS), key=lambda x: (-often.get(x, 0), x)):
        least = min(range(symbols), key=lambda s: (load[s], s))
        dealt[x] = chr(65 + least)
        load[least] += often.get(x, 0) + 1
    return "".join(dealt[chr(c)] for c in LETTERS)


def reduce_word(column: str, deal: str) -> Column:
    return F.translate(F.col(column), "".join(map(chr, LETTERS)), deal)


class _Texts:
    """Hashes of many reduced words at once, each from powers of a base, so that edits are sums."""

    def __init__(self, column: pa.Array):
        texts = utf8(column)
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) - U(64)  # symbols from 1
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = data
        n = len(data) + 1
        self.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, _BASE, U)]), dtype=U)
        back = pow(_BASE, -1, 1 << 64)
        self.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, back, U)]), dtype=U)
        self.sums = np.zeros(n, U)
        np.cumsum(data * self.up[: n - 1], out=self.sums[1:])

    @staticmethod
    def name(value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(value + size.astype(U) * U(0xC2B2AE3D27D4EB4F))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        value = (self.sums[self.ends] - self.sums[self.starts]) * self.down[self.starts]
        return value, self.name(value, self.sizes)

    def neighbours(self, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the word itself, of each word with a greater symbol in one place, and with one place less.

        Of two reduced words one edit apart exactly one has the other in its list: the one with the smaller symbol,
        or the longer one. So the lists hold each pair of the full neighbourhoods once.
        """
        value, own = self.own()
        rows, names = [np.arange(len(own))], [own]
        row = np.repeat(np.arange(len(own)), self.sizes)
        place = np.arange(len(self.data))
        weight = self.up[place - self.starts[row]]
        for step in range(1, symbols):
            held = self.data + U(step) <= U(symbols)
            rows.append(row[held])
            names.append(self.name(value[row[held]] + U(step) * weight[held], self.sizes[row[held]]))
        first = np.ones(len(row), bool)  # of a run of equal symbols one deletion is enough
        first[1:] = (self.data[1:] != self.data[:-1]) | (row[1:] != row[:-1])
        r, at = row[first], place[first]
        back = self.down[1] if len(self.down) > 1 else U(1)
        left = self.sums[at] - self.sums[self.starts[r]]
        right = (self.sums[self.ends[r]] - self.sums[at + 1]) * back
        rows.append(r)
        names.append(self.name((left + right) * self.down[self.starts[r]], self.sizes[r] - 1))
        return np.concatenate(rows), np.concatenate(names)


def _with_names(words: DataFrame, deal: str) -> DataFrame:
    """Words with the hash of their reduced form."""
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Texts(batch.column("reduced")).own()[1]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(signed(own))], ["word", "n", "own"])

    return words.select("word", "n", reduce_word("word", deal).alias("reduced")).mapInArrow(name, "word string, n long, own long")


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by one inserted, deleted or replaced code point, both ways.

    ``words`` is a stored table (word, n) of distinct words over ``LETTERS``. By default there are as many symbols as make
    the reduced words of ``LEAST`` symbols as many as the words, so few words share a reduced form whatever the vocabulary.
    Reduced words one edit apart, or equal, are joined by 64-bit hashes; equal hashes of other words only cost a comparison.
    """
    if symbols is None:
        count = max(2, words.count())
        symbols = next(s for s in range(4, 27) if s**LEAST >= count or s == 26)
    deal = alphabet(words, symbols)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                texts = _Texts(batch.column("reduced").slice(at, 4096))
                row, names = texts.neighbours(symbols)
                yield pa.RecordBatch.from_arrays([pa.array(signed(texts.own()[1][row])), pa.array(signed(names))], ["own", "other"])

    named = _with_names(words, deal)
    reduced = words.select(reduce_word("word", deal).alias("reduced")).distinct()
    known = named.select(F.col("own").alias("other")).distinct()
    pairs = reduced.mapInArrow(expand, "own long, other long").join(known, "other", "left_semi")
    # letters of a word as bits: one edit changes at most two
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x).bitwiseAND(63))
    marks = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda held, x: held.bitwiseOR(bit(x)))
    marked = named.withColumn("marks", marks)
    side = lambda p, key: marked.select(F.col("own").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("word", "n", "marks")])
    left = pairs.join(side("a", "own"), "own")
    right = side("b", "_other")
    alike = (
        (F.col("other") == F.col("_other"))
        & ((F.col("own") != F.col("other")) | (F.col("a_word") < F.col("b_word")))
        & (F.bit_count(F.col("a_marks").bitwiseXOR(F.col("b_marks"))) <= 2)
        & (F.levenshtein("a_word", "b_word", 1) == 1)
    )
    found = left.join(right, alike).select("a_word", "a_n", "b_word", "b_n")
    both = F.array(*[
        F.struct(F.col(f"{p}_word").alias("word"), F.col(f"{p}_n").alias("n"), F.col(f"{q}_word").alias("near"), F.col(f"{q}_n").alias("near_n"))
        for p, q in (("a", "b"), ("b", "a"))
    ])
    return found.select(F.inline(both)).distinct()  # a pair met under two equal hashes counts once


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, symbols: int | None = None) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``count_words``.

    A form is the nearest word of largest ``n`` (ties: smallest in code-point order) if that is at least ``times`` the word's
    own; the root follows forms to the last. Counts grow ``times``-fold from form to form, so chains are short and a few
    joins of the form table with itself reach every root. Repeated rows count as often as they occur; null and empty
    texts have no words, an empty table gives no rows; other columns are not read.
    """
    folder = work_folder(docs.sparkSession, "spelling")
    count_words(docs, id_col, text_col).write.parquet(f"{folder}/words")
    words = docs.sparkSession.read.parquet(f"{folder}/words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    found = near_words(words, symbols).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    follows = -F.col("best.less") >= times * F.col("n")
    found = found.select("word", "n_near", F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n"))
    found.write.parquet(f"{folder}/near")
    near = docs.sparkSession.read.parquet(f"{folder}/near")
    roots = near.filter("form is not null").select("word", F.col("form").alias("root"))
    most, links = words.agg(F.max("n")).first()[0] or 1, 0
    while times ** (links + 1) <= most:
        links += 1  # forms that can follow each other
    reach = 1
    while reach < links:
        on = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        roots = roots.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
        reach *= 2
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
