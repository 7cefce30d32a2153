"""Repeated passages by a compacted de Bruijn graph of word k-mers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.bits import BitFilter
from wardline.llm.words import U, by_bytes, mix, signed, utf8, window_hashes, word_hashes
from wardline.plans.scale import shared_folder

K = 20  # words of a window, the k-mer
M = 6  # words of the minimizer that names where a k-mer is looked up


def minimizers(words: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, place) of the smallest m-gram of every window, and each window's number among them."""
    grams, width = window_hashes(words, m), k - m + 1
    if len(grams) < width:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    new = np.concatenate([[True], at[1:] != at[:-1]])  # places never go back
    return grams[at[new]], np.cumsum(new) - 1


def _id_hash(value) -> int:
    """Spark's ``xxhash64`` of the id as text."""
    return xxhash.xxh64_intdigest(b"" if value is None else str(value).encode(), seed=42)


def _text_hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, seed=42)


def _ties(ids: list, texts: list[bytes], shared: BitFilter) -> list[int]:
    """Digest of each text whose id another text may have, else 0: with the id it names the text."""
    hit = shared.has(np.array([_id_hash(i) for i in ids], U))
    return signed(np.array([_text_hash(t) if h else 0 for t, h in zip(texts, hit.tolist())], U)).tolist()


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First values and lengths of runs of consecutive numbers."""
    new = np.concatenate([[True], np.diff(starts) != 1])
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts)))


def removed_spans(docs: DataFrame, folder: str, k: int = K, m: int = M, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, BitFilter, BitFilter]:
    """Windows of distinct texts that also start earlier, as (id, tie, start, n) for ``n`` windows from ``start`` on,
    a filter of the texts that occur more than once, and one of the ids that several texts have. Of equal texts only
    the one with the smallest id is looked at; ``tie`` tells the texts of one id apart and is 0 for other ids.

    1. A k-mer repeats only if its minimizer does, so a bit filter of the minimizers with two places or texts picks
       the k-mers that become edges. The edges of one slice of texts are reduced to their first place there.
    2. Edges that start once are dropped. Two repeated edges that follow each other, with one way in and one way
       out and equal counts, are one step of a path; paths without branches are compacted to their two ends.
    3. Only the ends are joined with the places of all edges. A place is a copy of the whole path if both ends lie
       at the right distance; a place with one end only counts for that window.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            hashes, places = [], []
            for text in utf8(batch.column("text")):
                h, number = minimizers(word_hashes(text), k, m)
                hashes.append(h)
                places.append(mix(U(_text_hash(text)) ^ (np.arange(len(h), dtype=U) << U(1))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(hashes))), pa.array(signed(np.concatenate(places)))], ["h", "place"]
            )

    found = rows.select("text").mapInArrow(seeds, "h long, place long").groupBy("h")
    found = found.agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b").select("h")
    found.write.parquet(f"{folder}/minimizers")
    found = spark.read.parquet(f"{folder}/minimizers")
    wanted = BitFilter(found, found.count())
    again = rows.select(F.xxhash64("text").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    copies = BitFilter(again, again.count())

    several = rows.groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).filter("a <> b")
    several.select(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("h")).write.parquet(f"{folder}/ids")
    several = spark.read.parquet(f"{folder}/ids")
    shared = BitFilter(several, several.count())

    def edges_of(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        ties = _ties(ids, texts, shared)
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], ties[i]))
        parts = []
        for n, i in enumerate(order):
            words = word_hashes(texts[i])
            h, number = minimizers(words, k, m)
            if not len(h):
                continue
            starts = np.flatnonzero(wanted.has(h)[number])
            if len(starts):
                a, b = window_hashes(words, k)[starts], window_hashes(words, k, 1)[starts]
                around = np.concatenate([np.zeros(1, U), words, np.zeros(1, U)])
                around = mix(around[starts] * U(3) + around[starts + k + 1])
                parts.append((np.full(len(starts), n), starts, a, b, around))
        names, types = ["id", "tie", "start", "a", "b", "around", "n"], [None, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        place, tie = pa.array([ids[i] for i in order], _arrow(kind)), pa.array([ties[i] for i in order], pa.int64())
        if not parts:
            empty = [pa.nulls(0, t or place.type) for t in types]
            return pa.RecordBatch.from_arrays(empty, names)
        doc, start, a, b, around = (np.concatenate(c) for c in zip(*parts))
        by = np.lexsort((start, doc, b, a))
        first = np.ones(len(by), bool)
        first[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
        keep = np.zeros(len(by), bool)
        keep[by[first]] = True
        # the others certainly start earlier, in this slice; rows without an edge name them
        gone = np.flatnonzero(~keep)
        spot, length = _runs(doc[gone].astype(np.int64) * (1 << 32) + start[gone]) if len(gone) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        none = len(spot)
        doc, start = np.concatenate([doc[keep], spot >> 32]), np.concatenate([start[keep], spot & ((1 << 32) - 1)])
        return pa.RecordBatch.from_arrays([
            place.take(pa.array(doc, pa.int64())), tie.take(pa.array(doc, pa.int64())), pa.array(start.astype(np.int32)),
            pa.concat_arrays([pa.array(signed(a[keep])), pa.nulls(none, pa.int64())]),
            *(pa.concat_arrays([pa.array((x[keep] >> U(32)).astype(np.uint32).view(np.int32)), pa.nulls(none, pa.int32())]) for x in (b, around)),
            pa.array(np.concatenate([np.ones(int(keep.sum()), np.int32), length.astype(np.int32)])),
        ], names)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8 << 20):
            texts = utf8(batch.column("text"))
            alone = np.flatnonzero(~copies.has(np.array([_text_hash(t) for t in texts], U)))
            ids = batch.column("id").to_pylist()
            yield edges_of([ids[i] for i in alone], [texts[i] for i in alone])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in by_bytes(batches, "text"):
            texts = utf8(batch.column("text"))
            picked = np.flatnonzero(copies.has(np.array([_text_hash(t) for t in texts], U)))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(picked)), pa.array([hashlib.md5(texts[i]).digest() for i in picked], pa.binary()),
                pa.array([press.compress(texts[i]) for i in picked], pa.binary()),
            ], ["id", "key", "z"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield edges_of(part.column("id").to_pylist(), [open_.decompress(z) for z in part.column("z").to_pylist()])

    schema = f"id {kind}, tie long, start int, a long, b int, around int, n int"
    some = rows.mapInArrow(pack, f"id {kind}, key binary, z binary").groupBy("key").agg(F.min(F.struct("id", "z")).alias("r"))
    edges = rows.mapInArrow(direct, schema).unionByName(some.select("r.id", "r.z").mapInArrow(unpacked, schema))
    edges.write.option("compression", "zstd").parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")

    place = F.struct("id", "tie", "start")
    graph = edges.filter("a is not null").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("times"), F.min(place).alias("first"), F.min("around").alias("low"), F.max("around").alias("high"),
    ).filter("times > 1")
    graph = graph.select("a", "b", "times", "first.id", "first.tie", "first.start", (F.col("low") == F.col("high")).alias("plain"))
    line = Window.partitionBy("id", "tie").orderBy("start", "a", "b")
    follows = (
        (F.lag("start").over(line) == F.col("start") - 1) & F.lag("plain").over(line) & F.col("plain")
        & (F.lag("times").over(line) == F.col("times"))
    )
    graph = graph.withColumn("head", ~F.coalesce(follows, F.lit(False)))
    graph = graph.withColumn("tail", F.coalesce(F.lead("head").over(line), F.lit(True)))
    graph = graph.withColumn("path", F.max(F.when(F.col("head"), F.col("start"))).over(line))
    ends = graph.filter("head or tail").select(
        "a", "b", F.col("id").alias("from_id"), F.col("tie").alias("from_tie"), F.col("path").alias("from_start"),
        (F.col("start") - F.col("path")).alias("along"), "head", "tail",
    )
    met = edges.filter("a is not null").select("id", "tie", "start", "a", "b").join(ends, ["a", "b"])
    met = met.withColumn("at", F.col("start") - F.col("along")).filter(
        ~(F.col("id").eqNullSafe(F.col("from_id")) & (F.col("tie") == F.col("from_tie")) & (F.col("at") == F.col("from_start")))
    )
    met = met.groupBy("id", "tie", "at", "from_id", "from_tie", "from_start").agg(
        F.max("along").alias("last"), F.max("head").alias("head"), F.max("tail").alias("tail"), F.max("start").alias("only")
    )
    whole = F.col("head") & F.col("tail")
    start, n = F.when(whole, F.col("at")).otherwise(F.col("only")), F.when(whole, F.col("last") + 1).otherwise(1)
    copied = met.select("id", "tie", start.alias("start"), n.alias("n"))
    return copied.unionByName(edges.filter("a is null").select("id", "tie", "start", "n")), copies, shared


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def drop_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Removes every word that a window of ``k`` words covers which also starts earlier in the table.

    Earlier means a smaller id, or the same document and an earlier start; windows are judged on the input. Words
    are runs of anything but ASCII white space, unchanged. Returns id, ``n_words``, ``n_removed``, ``kept`` (the
    other words joined by one space) and ``kept_sha256``.

    Null and wordless texts have no words. A null id comes first. Different texts under one id, null included,
    are documents of their own, the one with the smaller ``xxhash64`` first; equal rows are kept each and never
    remove each other. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/substring-{uuid.uuid4().hex}"
    kind = docs.schema[id_col].dataType.simpleString()
    spans, copies, shared = removed_spans(docs, folder, k, min(M, k), id_col, text_col)
    by_doc = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # at most a document's windows
    by_doc.write.parquet(f"{folder}/spans")
    by_doc = spark.read.parquet(f"{folder}/spans")
    touched = BitFilter(by_doc.select(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))).bitwiseXOR(F.col("tie"))), by_doc.count())
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def special(batch: pa.RecordBatch) -> tuple[list[bytes], list[int], np.ndarray]:
        texts, ids = [t or b"" for t in utf8(batch.column("text"))], batch.column("id").to_pylist()
        hit, ties = copies.has(np.array([_text_hash(t) for t in texts], U)), _ties(ids, texts, shared)
        named = np.array([_id_hash(i) for i in ids], U) ^ np.array(ties, np.int64).view(U)
        return texts, ties, hit | touched.has(named)

    names = ["id", "n_words", "n_removed", "kept", "kept_sha256"]

    def result(ids: pa.Array, cut: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            ids, pa.array([n for n, _, _ in cut], pa.int64()), pa.array([r for _, r, _ in cut], pa.int64()),
            pa.array([t.decode() for _, _, t in cut], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for _, _, t in cut], pa.string()),
        ], names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts, _, hit = special(batch)
            picked = np.flatnonzero(~hit)
            words = [texts[i].split() for i in picked]
            yield result(batch.column("id").take(pa.array(picked)), [(len(w), 0, b" ".join(w)) for w in words])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in by_bytes(batches, "text"):
            texts, ties, hit = special(batch)
            picked = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(picked)), pa.array([ties[i] for i in picked], pa.int64()), pa.array([hashlib.md5(texts[i]).digest() for i in picked], pa.binary()),
                pa.array([press.compress(texts[i]) for i in picked], pa.binary()),
            ], ["id", "tie", "key", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for z, copy, spans in zip(*(part.column(c).to_pylist() for c in ("z", "copy", "spans"))):
                    words = open_.decompress(z).split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if copy and len(words) >= k:
                        gone[0] = 1
                    for s in () if copy else spans or ():
                        gone[s["start"]] += 1
                        gone[s["start"] + s["n"] + k - 1] -= 1
                    keep = np.cumsum(gone[:-1]) == 0
                    left = words if keep.all() else [w for w, yes in zip(words, keep.tolist()) if yes]
                    out.append((len(words), len(words) - len(left), b" ".join(left)))
                yield result(part.column("id"), out)

    schema = f"id {kind}, n_words long, n_removed long, kept string, kept_sha256 string"
    packed = rows.mapInArrow(pack, f"id {kind}, tie long, key binary, z binary")
    firsts = rows.mapInArrow(pack, f"id {kind}, tie long, key binary, z binary").select("id", "key").groupBy("key").agg(
        F.min(F.struct("id")).alias("f"), F.max(F.struct("id")).alias("l")
    ).filter("f <> l").select(F.col("key").alias("first_key"), F.col("f.id").alias("first_id"))
    packed = packed.join(firsts, F.col("key") == F.col("first_key"), "left")
    packed = packed.withColumn("copy", F.col("first_key").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))).drop("first_key", "first_id", "key")
    by_doc = by_doc.withColumnsRenamed({"id": "span_id", "tie": "span_tie"})
    packed = packed.join(by_doc, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("tie") == F.col("span_tie")), "left")
    out = packed.select("id", "z", "copy", "spans").mapInArrow(cut, schema).unionByName(rows.mapInArrow(untouched, schema))
    return out.withColumnRenamed("id", id_col)
