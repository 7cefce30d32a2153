"""Packing of token sequences into fixed windows by non-negative least squares over a length histogram."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.tokens import Encoder
from wardline.llm.words import by_bytes, utf8
from wardline.plans.scale import shared_folder

WINDOW = 4096
END = 2  # id put after every document
RANK_GROUP = 2000  # rows that are ranked together, on average


def combinations(hist: np.ndarray, window: int, common: int = 48) -> np.ndarray:
    """Up to four lengths that fill the window exactly, as rows padded with 0; only lengths that occur.

    All pairs, all triples with two equal lengths, and the triples and quadruples built on the ``common`` most
    frequent lengths.
    """
    have = hist > 0
    have[0] = False
    lengths = np.flatnonzero(have)
    top = lengths[np.argsort(-hist[lengths], kind="stable")[:common]]
    first, second = (x.ravel() for x in np.meshgrid(lengths, top, indexing="ij"))
    zero = np.zeros_like(lengths)
    a3, b3, c3 = (x.ravel() for x in np.meshgrid(top, top, top, indexing="ij"))
    stems = np.concatenate([
        np.stack([lengths, zero, zero], 1), np.stack([lengths, lengths, zero], 1),
        np.stack([first, second, np.zeros_like(first)], 1), np.stack([a3, b3, c3], 1),
    ])
    rest = window - stems.sum(axis=1)
    fits = (rest > 0) & (rest < window)
    rows = np.concatenate([stems, rest[:, None]], 1)[fits]
    rows = np.sort(rows[have[rows[:, 3]]], axis=1)[:, ::-1]
    return np.unique(rows, axis=0)


def repeat_counts(hist: np.ndarray, combos: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Whole repeat counts of the combinations: non-negative least squares against the histogram by
    multiplicative updates, rounded, and held to what is there.
    """
    if not len(combos):
        return np.zeros(0, np.int64)
    used, size = combos > 0, len(hist)

    def spent(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), weights=(x[:, None] * used).ravel(), minlength=size)

    want = np.where(used, hist[combos], 0).sum(axis=1).astype(float)
    x = np.where(used, hist[combos], hist.max()).min(axis=1) / 4 + 1e-3
    for _ in range(rounds):
        x *= want / (np.where(used, spent(x)[combos], 0).sum(axis=1) + 1e-9)
    counts, left = np.zeros(len(combos), np.int64), hist.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        n = int(x[j] + 0.5)
        if not n:
            break
        lengths, times = np.unique(combos[j][used[j]], return_counts=True)
        n = min(n, int((left[lengths] // times).min()))
        counts[j] = n
        left[lengths] -= n * times
    return counts


def plan(hist: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where the remainders go: rows (length, first rank, last rank + 1, sequence, offset) and the ends of a stream.

    The document of rank r in such a run lies whole in ``sequence + r - first rank`` at ``offset``. Repeats of
    the least-squares combinations come first, then what greedy filling - the longest that fits, again and
    again - fills exactly. The rest is laid end to end: a row with sequence -1 starts at ``offset`` of this
    stream, and the stream is cut into sequences at the ends that are returned, with the first sequence in
    front. These are full windows, and at last powers of two, which need no padding. The work depends on the
    lengths, not on the number of documents.
    """
    left, rank = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64)
    left[0] = 0
    rows, made = [], 0

    def emit(parts: list[int], times: int) -> None:
        nonlocal made
        offset = 0
        for length in parts:
            rows.append((length, rank[length], rank[length] + times, made, offset))
            rank[length] += times
            left[length] -= times
            offset += length
        made += times

    combos = combinations(left, window)
    counts = repeat_counts(left, combos)
    for j in np.flatnonzero(counts):
        emit([int(p) for p in combos[j] if p], int(counts[j]))
    for length in range(window - 1, 0, -1):
        while left[length]:
            parts, room, spare = [length], window - length, left.copy()
            spare[length] -= 1
            while room and len(fits := np.flatnonzero(spare[: room + 1])):
                parts.append(int(fits[-1]))
                spare[parts[-1]] -= 1
                room -= parts[-1]
            if room:
                break
            emit(parts, min(int(left[p]) // parts.count(p) for p in set(parts)))
    at = 0
    for length in np.flatnonzero(left):
        rows.append((length, rank[length], rank[length] + left[length], -1, at))
        at += int(length * left[length])
    ends, rest = [at // window * window], at % window
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    return np.array(rows, np.int64).reshape(-1, 5), np.array([made, *ends], np.int64)


def stream_pieces(at: int, length: int, ends: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(start, piece, sequence, offset) of a document that lies at ``at`` of the stream of ``plan``."""
    first, full, out, start = int(ends[0]), int(ends[1]), [], 0
    while start < length:
        pos = at + start
        if pos < full:
            sequence, begin, end = pos // window, pos // window * window, (pos // window + 1) * window
        else:
            j = int(np.searchsorted(ends[1:], pos, "right"))
            sequence, begin, end = full // window + j - 1, int(ends[j]), int(ends[j + 1])
        piece = min(length - start, end - pos)
        out.append((start, piece, first + sequence, pos - begin))
        start += piece
    return out


def sequences_of(ends: np.ndarray, window: int = WINDOW) -> int:
    return int(ends[0] + ends[1] // window + len(ends) - 2)


def encode(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and ``END``, written to ``folder`` and read back: uid, id, n, ids (packed)."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = Encoder.of(tokenizer, "ids"), zstandard.ZstdCompressor(level=1)
        uid, kind = TaskContext.get().partitionId() << 33, _kind(tokenizer)
        end = np.array([END], kind).tobytes()
        for batch in by_bytes(batches, "text", 2 << 20):
            pieces = [encoder.pieces(t or b"") for t in utf8(batch.column("text"))]
            known = encoder.learn(set().union(*pieces), kind)
            packed = [b"".join(map(known.__getitem__, p)) + end for p in pieces]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(uid, uid + len(packed)), pa.int64()), batch.column("id"),
                pa.array([len(p) // kind.itemsize for p in packed], pa.int64()),
                pa.array([press.compress(p) for p in packed], pa.binary()),
            ], ["uid", "id", "n", "ids"])
            uid += len(packed)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows.mapInArrow(ids_of, f"uid long, id {kind}, n long, ids binary").write.option("compression", "none").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _kind(tokenizer: str) -> np.dtype:
    """Two bytes an id where the vocabulary allows it."""
    encoder = Encoder.of(tokenizer, "ids")
    return np.dtype("<u2" if encoder.size <= 1 << 16 else "<u4")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         folder: str | None = None) -> DataFrame:
    """Places every token of every text in exactly one piece of a sequence of at most ``window`` tokens.

    A document gives as many full windows as it holds; the remainders are packed by ``plan``, which sees their
    histogram of ``window`` counts only. A document's place among those of its length comes from ranks inside
    small hash groups plus the sizes of earlier groups, so no length, however common, meets in one task.

    A null text is an empty one: a single end id. Repeated rows and null ids are packed one by one; an empty
    table gives no rows; other columns are not read. Token ids and places are stored once in ``folder`` (new, shared).
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    stored = encode(docs, tokenizer, f"{folder}/ids", id_col, text_col)
    sizes = stored.select("uid", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).alias("full"))
    hist = np.zeros(window, np.int64)
    for rest, n in sizes.groupBy("rest").count().collect():
        hist[rest] = n
    pieces, ends = plan(hist, window)
    sequences = sequences_of(ends, window)
    by_length = {int(n): pieces[pieces[:, 0] == n] for n in np.unique(pieces[:, 0])}

    groups = int(max(1, hist.sum() // RANK_GROUP))
    sizes = sizes.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    ranked = Window.partitionBy("rest", "group").orderBy("uid")
    before = Window.partitionBy("rest").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    held = sizes.groupBy("rest", "group").agg(F.count(F.lit(1)).alias("n"))
    held = held.select("rest", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranks = sizes.withColumn("rank", F.row_number().over(ranked)).join(held, ["rest", "group"])
    ranks = ranks.select("uid", (F.col("rank") - 1 + F.col("earlier")).alias("rank"))
    # full windows are numbered the same way; groups are few beside rows, so one window over them is small
    long = sizes.filter("full > 0")
    running = Window.partitionBy("group").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    sums = long.groupBy("group").agg(F.sum("full").alias("n")).select(
        "group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")
    )
    firsts = long.withColumn("before", F.coalesce(F.sum("full").over(running), F.lit(0))).join(sums, "group")
    firsts = firsts.select("uid", (F.col("before") + F.col("earlier") + sequences).alias("first"))
    # written one after the other: the driver holds all stages of a plan at once
    ranks.write.parquet(f"{folder}/ranks")
    firsts.write.parquet(f"{folder}/firsts")
    places = spark.read.parquet(f"{folder}/ranks").join(spark.read.parquet(f"{folder}/firsts"), "uid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, kind = zstandard.ZstdDecompressor(), _kind(tokenizer)
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, source = [], []
                for i, (n, z, rank, first) in enumerate(zip(*(part.column(c).to_pylist() for c in ("n", "ids", "rank", "first")))):
                    ids = np.frombuffer(open_.decompress(z), kind).astype("<u4")
                    full = n // window * window
                    spans = [(s, window, first + s // window, 0) for s in range(0, full, window)]
                    if n > full:
                        runs = by_length[n - full]
                        _, a, _, sequence, offset = runs[np.searchsorted(runs[:, 1], rank, "right") - 1].tolist()
                        if sequence >= 0:
                            spans.append((full, n - full, sequence + rank - a, offset))
                        else:
                            spans += [(full + s, *x) for s, *x in stream_pieces(offset + (rank - a) * (n - full), n - full, ends, window)]
                    for start, length, sequence, offset in spans:
                        rows.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), n, sequence, offset))
                        source.append(i)
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["id", *names]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = stored.join(places, "uid").select("id", "n", "ids", "rank", "first").mapInArrow(
        cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return out.withColumnRenamed("id", id_col)

