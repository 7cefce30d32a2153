"""Benchmark passages in documents by greedy string tiling, whatever the order of their parts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.words import by_bytes, utf8, window_hashes, word_hashes

TILE = 5  # words of the shortest tile
COVERAGE = 0.5  # share of an item's words that tiles must cover
BLOCK_BYTES = 32 << 20  # texts of items that one pass over the documents gets
_KEEP = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def normal_words(text: bytes) -> np.ndarray:
    """Hashes of the words in small ASCII letters, without ASCII punctuation."""
    return word_hashes(text.translate(_KEEP), lower=True)


class Index:
    """Seeds of a block of items: windows of ``tile`` words, or a shorter item as one window of its own length."""

    def __init__(self, items: list[tuple[int, bytes]], tile: int):
        self.tile = tile
        self.words = [normal_words(text) for _, text in items]
        self.ids = [item for item, _ in items]
        hashes, owner, place = [], [], []
        for i, words in enumerate(self.words):
            seeds = window_hashes(words, min(tile, len(words))) if len(words) else words
            hashes.append(seeds)
            owner.append(np.full(len(seeds), i))
            place.append(np.arange(len(seeds)))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.seeds = hashes[order]
        self.owner = (np.concatenate(owner) if len(owner) else np.zeros(0, int))[order]
        self.place = (np.concatenate(place) if len(place) else np.zeros(0, int))[order]
        self.sizes = sorted({min(tile, len(w)) for w in self.words if len(w)})

    def joined(self, words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every item that shares a seed: starts in the document, starts in the item, and seed lengths."""
        docs, items, places, sizes = [], [], [], []
        for size in self.sizes:
            seeds = window_hashes(words, size)
            if not len(seeds):
                continue
            low = np.searchsorted(self.seeds, seeds, "left")
            found = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == seeds)
            if not len(found):
                continue
            n = np.searchsorted(self.seeds, seeds[found], "right") - low[found]
            at = np.repeat(low[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            docs.append(np.repeat(found, n))
            items.append(self.owner[at])
            places.append(self.place[at])
            sizes.append(np.full(len(at), size))
        if not docs:
            return {}
        docs, items, places, sizes = map(np.concatenate, (docs, items, places, sizes))
        return {int(i): (docs[m], places[m], sizes[m]) for i in np.unique(items) for m in [items == i]}


def tiles(doc: np.ndarray, item: np.ndarray, starts: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest match of unmarked words is marked, again and again, down to ``least``.

    Karp-Rabin seeds on one diagonal that touch or overlap are one match, confirmed word by word. A match that
    lost words to a longer one is split and goes back to the queue. Of equally long matches the first in the
    document, then in the item, is taken. Returns (start in the document, start in the item, length).
    """
    at, place, size = starts
    order = np.lexsort((at, at - place))
    at, place, size = at[order], place[order], size[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at - place) != 0) | (np.diff(at) > size[:-1])
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(at)) - 1
    queue = [(-(int(at[e]) + int(size[e]) - int(at[h])), int(at[h]), int(place[h])) for h, e in zip(heads, ends)]
    queue = [q for q in queue if np.array_equal(doc[q[1] : q[1] - q[0]], item[q[2] : q[2] - q[0]])]
    heapq.heapify(queue)
    marked_doc, marked_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    covered, whole = 0, len(item)
    while queue and covered < whole:
        length, d, i = heapq.heappop(queue)
        free = ~(marked_doc[d : d - length] | marked_item[i : i - length])
        if free.all():
            marked_doc[d : d - length] = marked_item[i : i - length] = True
            out.append((d, i, -length))
            covered -= length
            continue
        edge = np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b - a >= least:
                heapq.heappush(queue, (a - b, d + a, i + a))
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded bytes, one block at a time on the driver."""
    held, size = [], 0
    rows = items.filter(F.col(text_col).isNotNull()).select(id_col, text_col)
    for item, text in rows.toLocalIterator():
        raw = text.encode()
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append((item, raw))
        size += len(raw)
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", tile: int = TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents whose tiles cover at least ``coverage`` of the words of an item: one row per document and item.

    Returns the id, the item id, the item's words, how many of them tiles cover, the number of tiles, the
    longest tile and the coverage. Words are compared in small ASCII letters without ASCII punctuation.

    The items go to the executors in blocks of at most ``block_bytes`` (one longer item is a block of its own),
    with one pass over the documents for each block, so no broadcast grows with the items. Null or wordless
    texts and items match nothing; repeated rows give repeated rows, so equal (document, item) results are
    merged; a null id is kept as it is. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, item_words long, covered long, tiles long, longest long"
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("text").isNotNull())
    found = spark.createDataFrame([], schema)
    for block in blocks(items, item_col, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, tile)
            for batch in by_bytes(batches, "text"):
                out, source = [], []
                for n, text in enumerate(utf8(batch.column("text"))):
                    words = normal_words(text)
                    for i, starts in index.joined(words).items():
                        item = index.words[i]
                        if coverage > 0 and len(np.unique(np.concatenate([starts[1] + k for k in range(tile)]))) < coverage * len(item):
                            continue  # the seeds cannot cover enough
                        marked = tiles(words, item, starts, min(tile, len(item)))
                        covered = sum(t[2] for t in marked)
                        if covered >= coverage * len(item):
                            out.append((index.ids[i], len(item), covered, len(marked), max(t[2] for t in marked)))
                            source.append(n)
                columns = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(source, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, _fields(item_kind)))],
                    ["id", "item", "item_words", "covered", "tiles", "longest"],
                )

        found = found.unionByName(rows.mapInArrow(search, schema))
    found = found.withColumn("coverage", F.col("covered") / F.col("item_words")).distinct()
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def _fields(item_kind: str) -> list[pa.Field]:
    item = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    return [pa.field("item", item), *(pa.field(n, pa.int64()) for n in ("item_words", "covered", "tiles", "longest"))]
