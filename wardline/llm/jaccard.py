"""Groups of documents whose sets of word n-grams are similar, by prefix-tree joins."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.bits import BitFilter
from wardline.llm.words import U, by_bytes, shingle_set, signed, utf8, word_hashes
from wardline.plans.scale import shared_folder

COUNTERS, CHUNK = 1 << 23, 1 << 18  # counters of the sketch that orders n-grams by frequency, and of one row of it
SKETCHED = 50_000  # texts counted before a sketch is handed on: 16 bits hold their counts
CELL = 4_000_000  # n-grams in the sets of one trie, on average
FEW = 4  # classes at an n-gram that meet by a plain join; more meet in a trie
WIDE = 4096  # classes of either side in a trie of beginnings, on average


def similar(common, size_a, size_b, num: int, den: int):
    """Whether ``common / union >= num / den``, in whole numbers."""
    return den * common >= num * (size_a + size_b - common)


def prefix_length(size: int, num: int, den: int) -> int:
    """How many of its first n-grams a set must store to meet every similar set."""
    return size - (num * size + den - 1) // den + 1


def least_common(size_a, size_b, num: int, den: int):
    """How many n-grams the beginnings of two similar sets share at least: the rest lies behind one of them."""
    need = -(-num * (size_a + size_b) // (num + den))
    return np.maximum(1, need - (-(-num * np.maximum(size_a, size_b) // den) - 1))


class Trie:
    """Sets, ordered by one global order, as paths that share their beginnings.

    Nodes are runs of n-grams between branchings, kept in arrays. A query walks the tree level by level with
    the overlap of each path, and leaves a subtree when even the best of its sets could not be similar.
    """

    def __init__(self, sets: list[np.ndarray], whole: np.ndarray | None = None):
        """``whole`` are the sizes of the sets that ``sets`` are the beginnings of."""
        tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
        place = place.astype(np.int32)
        often = np.bincount(place)
        rank = np.empty(len(tokens), np.int32)
        rank[np.lexsort((tokens, -often))] = np.arange(len(tokens), dtype=np.int32)  # frequent first: long shared paths
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        ranked = [np.sort(rank[place[a:b]]) for a, b in zip(bounds, bounds[1:])]
        # sets in the middle of the crowd are asked first: they meet most others
        self.order = np.argsort([-often[place[a:b]].mean() for a, b in zip(bounds, bounds[1:])], kind="stable")
        self.sets, self.size = ranked, np.diff(bounds)
        self.whole = self.size if whole is None else whole
        walk = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
        self.flat = np.concatenate([ranked[i] for i in walk])
        at = np.concatenate([[0], np.cumsum(self.size[walk])])
        self.width = len(tokens)
        begin, end, offset, parent, low, high = [0], [0], [0], [-1], [0], [0]  # node 0 is the root
        self.leaf, stack = np.zeros(len(sets), np.int64), [0]
        for j, i in enumerate(walk):
            mine = ranked[i]
            if j:
                other = ranked[walk[j - 1]]
                n = min(len(mine), len(other))
                differ = np.flatnonzero(mine[:n] != other[:n])
                shared = int(differ[0]) if len(differ) else n
                while end[stack[-1]] > shared:
                    node = stack.pop()
                    if begin[node] < shared:  # split the run where the new set leaves it
                        begin.append(begin[node]), end.append(shared), offset.append(offset[node]), parent.append(parent[node])
                        offset[node] += shared - begin[node]
                        begin[node], parent[node] = shared, len(end) - 1
                        stack.append(len(end) - 1)
                        break
            if len(mine) > end[stack[-1]]:
                top = stack[-1]
                begin.append(end[top]), end.append(len(mine)), offset.append(int(at[j]) + end[top]), parent.append(top)
                stack.append(len(end) - 1)
            self.leaf[i] = stack[-1]
        self.begin, self.end, self.offset, self.parent = (np.array(x, np.int64) for x in (begin, end, offset, parent))
        # sizes below each node: leaves upwards, deepest first
        low = np.full(len(end), np.iinfo(np.int64).max)
        high = np.zeros(len(end), np.int64)
        np.minimum.at(low, self.leaf, self.whole)
        np.maximum.at(high, self.leaf, self.whole)
        for node in np.argsort(-self.end, kind="stable"):
            p = self.parent[node]
            if p >= 0:
                low[p], high[p] = min(low[p], low[node]), max(high[p], high[node])
        self.low, self.high = low, high
        kids = np.argsort(self.parent, kind="stable")
        self.kids = kids
        self.first = np.searchsorted(self.parent[kids], np.arange(len(end)), "left")
        self.last = np.searchsorted(self.parent[kids], np.arange(len(end)), "right")
        self._member = np.zeros(self.width, np.int32)

    def _overlaps(self, i: int, keep) -> np.ndarray:
        """Common n-grams of set ``i`` and every set, or -1 below nodes that ``keep(nodes, overlaps, n-grams left)`` gives up."""
        mine, size = self.sets[i], int(self.size[i])
        self._member[mine] = 1
        overlap = np.full(len(self.end), -1, np.int64)
        overlap[0] = 0
        level = np.zeros(1, np.int64)
        while len(level):
            n = self.last[level] - self.first[level]
            at = np.repeat(self.first[level] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            level = self.kids[at]
            if not len(level):
                break
            runs = self.end[level] - self.begin[level]
            heads = np.concatenate([[0], np.cumsum(runs)[:-1]])
            spots = np.repeat(self.offset[level] - heads, runs) + np.arange(runs.sum())
            gained = np.add.reduceat(self._member[self.flat[spots]], heads)
            overlap[level] = overlap[self.parent[level]] + gained
            deepest = self.flat[self.offset[level] + runs - 1]
            level = level[keep(level, overlap[level], size - np.searchsorted(mine, deepest, "right"))]
        self._member[mine] = 0
        return overlap[self.leaf]

    def query(self, i: int, num: int, den: int) -> np.ndarray:
        """The sets similar to set ``i``."""
        size = int(self.size[i])

        def keep(node, common, left):
            best = np.clip(self.end[node] + left, self.low[node], self.high[node])  # the size that could do best
            return similar(common + np.minimum(left, best - self.end[node]), size, best, num, den)

        common = self._overlaps(i, keep)
        return np.flatnonzero((common > 0) & similar(common, size, self.size, num, den))

    def meet(self, i: int, num: int, den: int) -> np.ndarray:
        """The sets that may be similar to set ``i`` as far as their beginnings tell."""
        size = int(self.whole[i])

        def keep(node, common, left):
            least = np.minimum(least_common(size, self.low[node], num, den), least_common(size, self.high[node], num, den))
            return common + left >= least

        common = self._overlaps(i, keep)
        near = den * np.minimum(size, self.whole) >= num * np.maximum(size, self.whole)
        return np.flatnonzero((common > 0) & near & (common >= least_common(size, self.whole, num, den)))


def clusters(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For every set the smallest index of the sets it is joined with. Sets that a query met are not asked again."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    trie, met = Trie(sets), np.zeros(len(sets), bool)
    for i in trie.order.tolist():
        if met[i]:
            continue
        found = trie.query(i, num, den)
        met[found] = True
        for j in found.tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))])


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _id_hash(value) -> int:
    """Spark's ``xxhash64`` of the id as text."""
    return xxhash.xxh64_intdigest(b"" if value is None else str(value).encode(), seed=42)


class Sketch:
    """How many texts hold the n-grams of each of ``COUNTERS`` hash values. It orders n-grams and decides no result."""

    def __init__(self):
        self.counts, self.seen = np.zeros(COUNTERS, np.uint16), set()

    def add(self, sets: list[np.ndarray], digests: list[tuple[int, int]]) -> None:
        """Counts the sets that are not copies of one that was counted here."""
        new = []
        for s, key in zip(sets, digests):
            if len(s) and key not in self.seen:
                self.seen.add(key)
                new.append(s)
        if new:
            np.add.at(self.counts, np.concatenate(new) & U(COUNTERS - 1), np.uint16(1))

    def rows(self) -> list[tuple[int, bytes]]:
        """(chunk, packed counts of up to 255) of all counters."""
        small, codec = np.minimum(self.counts, 255).astype(np.uint8), pa.Codec("zstd", 1)
        return [(at // CHUNK, codec.compress(small[at : at + CHUNK].tobytes(), asbytes=True)) for at in range(0, COUNTERS, CHUNK)]


def levels(sketches: DataFrame) -> np.ndarray:
    """One byte a counter, higher for more frequent n-grams: ``COUNTERS`` bytes whatever the input.

    ``sketches`` (chunk, counts) are added up where they lie after one shuffle, row by row.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, codec = {}, pa.Codec("zstd")
        for batch in batches:
            for chunk, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault(chunk, np.zeros(CHUNK, np.uint64))
                total += np.frombuffer(codec.decompress(counts, CHUNK), np.uint8)
        for chunk, total in sums.items():
            noise = np.median(total)  # what n-grams that meet by chance make of a counter
            level = np.clip(100 + 24 * np.arcsinh((total - noise) / np.sqrt(noise + 1)), 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["chunk", "level"])

    out = np.zeros(COUNTERS, np.uint8)
    for row in sketches.repartition("chunk").mapInArrow(add_up, "chunk int, level binary").collect():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.level, np.uint8)
    return out


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) with the smallest node reachable over ``edges`` (a, b), by label spreading and jumping.

    Every round is written to ``folder``, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both.write.parquet(f"{folder}/edges")
    both = spark.read.parquet(f"{folder}/edges")
    labels, step = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), 0
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        new = new.join(jump, F.col("label") == F.col("via")).select("node", "old", F.least("label", "beyond").alias("label"))
        new.write.parquet(f"{folder}/labels-{step}")
        new = spark.read.parquet(f"{folder}/labels-{step}")
        if new.filter("old is distinct from label").isEmpty():
            return new.select("node", "label")
        labels, step = new.select("node", "label"), step + 1


def group_similar(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                  folder: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id it is linked to.

    Two documents link when their sets of ``words``-grams (A-Z in small letters, words between ASCII white
    space) have a Jaccard similarity of at least ``num / den``; components are what links connect. A text with
    fewer words is one n-gram; one without words, or null, has an empty set and is linked with nothing. Rows
    that share an id count as one document each and may share a component through it; null ids come last in a
    component. Other columns are not read.

    1. Equal sets become one class. Classes with the same first n-gram in hash order share a trie (large groups
       are dealt over tries of ``CELL`` n-grams), which joins most of what is similar.
    2. Every class stores the beginning of its set in one global order: rare n-grams first by a sketch of fixed size
       that all texts are counted in, hash order where it sees no difference. Similar sets share one of these n-grams
       at a fitting size. Bit filters drop the others where they lie.
    3. Beginnings that still connect different groups are met at each of their n-grams: up to ``FEW`` classes by a
       join, more in a trie of what the beginnings share, which prunes by the number of common n-grams that sizes
       demand. Every pair left is compared. This step makes the result exact whatever step 1 did.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/jaccard-{uuid.uuid4().hex}"
    kind = docs.schema[id_col].dataType.simpleString()

    def sets_of(texts: list[bytes | None]) -> list[np.ndarray]:
        return [shingle_set(word_hashes(t or b"", lower=True), words) for t in texts]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "d", "e", "first", "chunk", "counts"]

        def counted(sketch: Sketch) -> pa.RecordBatch:
            chunks, counts = zip(*sketch.rows())
            none = pa.nulls(len(chunks), pa.int64())
            ids = none.cast(id_type)
            return pa.RecordBatch.from_arrays([ids, none, none, none, none, pa.array(chunks, pa.int32()), pa.array(counts, pa.binary())], names)

        sketch, id_type = Sketch(), None
        for batch in by_bytes(batches, "text"):
            sets, id_type = sets_of(utf8(batch.column("text"))), batch.column("id").type
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in digests], pa.int64()),
                pa.array([x[1] for x in digests], pa.int64()),
                pa.array([int(signed(s[:1])[0]) if len(s) else None for s in sets], pa.int64()), pa.nulls(len(sets), pa.int32()),
                pa.nulls(len(sets), pa.binary()),
            ], names)
            sketch.add(sets, digests)
            if len(sketch.seen) > SKETCHED:
                yield counted(sketch)
                sketch = Sketch()
        if sketch.seen:
            yield counted(sketch)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {kind}, n long, d long, e long, first long, chunk int, counts binary"
    rows.mapInArrow(profile, schema).write.parquet(f"{folder}/profile")
    profiles = spark.read.parquet(f"{folder}/profile")
    classes = profiles.filter("chunk is null").select("id", "n", "d", "e", "first")
    frequency = spark.sparkContext.broadcast(levels(profiles.filter("chunk is not null").select("chunk", "counts")))

    def beginning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = frequency.value
        for batch in by_bytes(batches, "text", 2 << 20):
            seen, out = set(), []
            for s in sets_of(utf8(batch.column("text"))):
                key = _digest(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                order = np.argsort(level[s & U(COUNTERS - 1)], kind="stable")
                out.append((s[order[: prefix_length(len(s), num, den)]], key[0], key[1], len(s)))
            lengths = [len(o[0]) for o in out]
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(np.concatenate([o[0] for o in out])) if out else [], pa.int64()),
                *(pa.array(np.repeat(np.array([o[k] for o in out], np.int64), lengths)) for k in (1, 2)),
                pa.array(np.repeat(np.array([o[3] for o in out], np.int32), lengths)),
                pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]) if out else [], pa.int32()),
            ], ["token", "d", "e", "n", "place"])

    texts = rows.select("text").mapInArrow(beginning, "token long, d long, e long, n int, place int")
    texts.write.parquet(f"{folder}/beginnings")
    starts = spark.read.parquet(f"{folder}/beginnings")
    # of two classes alone at an n-gram the sizes are known; more, or copies of one class, are looked at later
    shared = starts.groupBy("token").agg(
        F.min("d").alias("a"), F.max("d").alias("b"), F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")
    ).filter((F.col("a") != F.col("b")) & ((F.col("rows") > 2) | (den * F.col("low") >= num * F.col("high")))).select("token")
    shared.write.parquet(f"{folder}/tokens")
    shared = spark.read.parquet(f"{folder}/tokens")
    met = BitFilter(shared, shared.count())

    def may_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(met.has(batch.column("token").to_numpy())))

    starts.mapInArrow(may_meet, starts.schema).write.parquet(f"{folder}/shared")
    starts = spark.read.parquet(f"{folder}/shared")

    def named(ids: DataFrame, name: str) -> BitFilter:
        """Filter of documents by the hash of their id as text. The hashes are written: they are counted, then read."""
        hashes = ids.select(F.xxhash64(F.coalesce(F.col(ids.columns[0]).cast("string"), F.lit(""))).alias("h"))
        hashes.write.parquet(f"{folder}/{name}")
        hashes = spark.read.parquet(f"{folder}/{name}")
        return BitFilter(hashes, hashes.count())

    def sets_where(wanted: BitFilter, unless: BitFilter | None = None) -> DataFrame:
        """Sets of the documents that the filter lets through: some others may come too."""

        def keep_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "text", 2 << 20):
                ids = np.array([_id_hash(i) for i in batch.column("id").to_pylist()], np.uint64)
                hit = wanted.has(ids) & ~unless.has(ids) if unless else wanted.has(ids)
                texts = utf8(batch.column("text"))
                sets = [x for x in sets_of([texts[i] for i in np.flatnonzero(hit)]) if len(x)]
                digests = [_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in digests], pa.int64()), pa.array([x[1] for x in digests], pa.int64()),
                    pa.array([int(signed(x[:1])[0]) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()),
                ], ["d", "e", "first", "tokens"])

        return rows.mapInArrow(keep_sets, "d long, e long, first long, tokens binary")

    carriers = classes.filter("n > 0").groupBy("d", "e").agg(F.min("id").alias("id"), F.first("first").alias("first"), F.first("n").alias("n"))
    carriers.write.parquet(f"{folder}/classes")
    carriers = spark.read.parquet(f"{folder}/classes")
    firsts = carriers.groupBy("first").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size")).filter("sets > 1")
    firsts = firsts.select("first", F.ceil(F.col("size") / CELL).alias("cells"))
    # copies beside a carrier stay away from the tries; what that filter keeps away by mistake, step 3 still finds
    copies = classes.filter("n > 0").select("id", "d", "e").join(carriers.withColumnRenamed("id", "own"), ["d", "e"]).filter(~F.col("id").eqNullSafe(F.col("own")))
    dealt = sets_where(named(carriers.join(firsts, "first", "left_semi").select("id"), "dealt"), named(copies.select("id"), "copies")).join(firsts, "first")
    dealt = dealt.withColumn("cell", F.pmod("d", "cells"))

    def join_trie(table: pa.Table) -> pa.Table:
        table = table.group_by(["d", "e"], use_threads=False).aggregate([("tokens", "min")])
        found = clusters([np.frombuffer(t, np.uint64) for t in table.column("tokens_min").to_pylist()], num, den)
        d, e = (table.column(c).to_numpy() for c in ("d", "e"))
        return pa.table({"d": d, "e": e, "group_d": d[found], "group_e": e[found]})

    schema = "d long, e long, group_d long, group_e long"
    joined = dealt.select("first", "cell", "d", "e", "tokens").groupBy("first", "cell").applyInArrow(join_trie, schema)
    joined.write.parquet(f"{folder}/joined")
    joined = spark.read.parquet(f"{folder}/joined").filter("d <> group_d or e <> group_e")
    key, group = F.struct("d", "e"), F.struct(F.col("group_d").alias("d"), F.col("group_e").alias("e"))
    known = joined.select(key.alias("key"), group.alias("group"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                a, b = ([np.frombuffer(t, np.uint64) for t in part.column(c).to_pylist()] for c in ("a_tokens", "b_tokens"))
                yes = [similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), num, den) for x, y in zip(a, b)]
                yield part.filter(pa.array(yes, pa.bool_())).select(["a", "b"])

    def in_groups(places: DataFrame, known: DataFrame) -> DataFrame:
        """Places at n-grams that different groups hold, with their groups."""
        placed = places.join(known, "key", "left").withColumn("group", F.coalesce("group", "key"))
        mixed = placed.select("token", F.xxhash64("group").alias("g")).groupBy("token").agg(F.min("g").alias("a"), F.max("g").alias("b"))
        return placed.join(mixed.filter("a <> b").select("token"), "token", "left_semi")

    def meet_in_trie(table: pa.Table) -> pa.Table:
        """Pairs of classes of different groups that may be similar and have no earlier n-gram in common."""
        keys = list(zip(table.column("d").to_pylist(), table.column("e").to_pylist()))
        groups, token = table.column("g").to_numpy(), table.column("token")[0].as_py()
        sets = [np.array(t, np.int64).view(np.uint64) for t in table.column("tokens").to_pylist()]
        before = [set(s[: int(np.flatnonzero(s == np.uint64(token & 0xFFFFFFFFFFFFFFFF))[0])].tolist()) for s in sets]
        trie = Trie(sets, table.column("n").to_numpy().astype(np.int64))
        names, members = np.unique(groups, return_counts=True)
        largest, left, right = names[members.argmax()], [], []
        for i in np.flatnonzero(groups != largest).tolist():  # one of two groups is not the largest
            for j in trie.meet(i, num, den).tolist():
                if groups[j] != groups[i] and (groups[j] == largest or i < j) and before[i].isdisjoint(before[j]):
                    a, b = (i, j) if keys[i] < keys[j] else (j, i)
                    left.append(a), right.append(b)
        side = [table.column(c).to_numpy()[at].astype(np.int64) for at in (np.array(left, int), np.array(right, int)) for c in ("d", "e")]
        return pa.table(dict(zip(("a_d", "a_e", "b_d", "b_e"), map(pa.array, side))))

    def linked_groups(placed: DataFrame) -> DataFrame:
        """(node, label) of the groups that links between ``placed`` classes (token, key, group, n, place) connect."""
        held = placed.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
        held.filter(F.col("held") > FEW).write.parquet(f"{folder}/hot")
        hot = spark.read.parquet(f"{folder}/hot")
        tokens = placed.join(hot, "token", "left").withColumn("hot", F.col("held").isNotNull().cast("int"))
        lists = tokens.groupBy("key", "group", "n").agg(F.sort_array(F.collect_list(F.struct("place", "token", "hot"))).alias("at"))
        lists = lists.select("key", "group", "n", F.expr("transform(at, x -> x.token)").alias("tokens"),
                             F.expr("filter(at, x -> x.hot = 1)").alias("at"))
        lists.write.parquet(f"{folder}/lists")
        lists = spark.read.parquet(f"{folder}/lists")
        # many classes: tries of the n-grams that beginnings share, in blocks of classes
        many = lists.select("key", "group", "n", "tokens", F.expr("explode(transform(at, x -> x.token))").alias("token")).join(hot, "token")
        cells, own = F.ceil(F.col("held") / WIDE), F.pmod(F.xxhash64("key"), F.ceil(F.col("held") / WIDE))
        many = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)))
        many = many.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "key.d", "key.e",
                           F.xxhash64("group").alias("g"), F.col("n").cast("long").alias("n"), "tokens")
        found = many.groupBy("token", "low", "high").applyInArrow(meet_in_trie, "a_d long, a_e long, b_d long, b_e long").distinct()
        # written one after the other: the driver holds all stages of a plan at once
        found.write.parquet(f"{folder}/tries")
        found = spark.read.parquet(f"{folder}/tries").select(F.expr("struct(a_d as d, a_e as e)").alias("a_key"), F.expr("struct(b_d as d, b_e as e)").alias("b_key"))
        # few classes: at most FEW * (FEW - 1) / 2 pairs an n-gram
        few = tokens.filter("hot = 0").join(lists.select("key", F.size("at").alias("often")), "key")
        few.select("token", "key", "group", "n", "place", "often").write.parquet(f"{folder}/few")
        few = spark.read.parquet(f"{folder}/few")
        left, right = (few.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("key", "group", "n", "place", "often")]) for side in "ab")
        # before the shared n-gram at most the shorter beginning is common, after it at most the shorter rest
        most = F.least("a_place", "b_place") + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
        pairs = left.join(right, "token").filter(
            (F.col("a_key") < F.col("b_key")) & (F.col("a_group") != F.col("b_group"))
            & (den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n"))
            & ((num + den) * most >= num * (F.col("a_n") + F.col("b_n")))
        ).groupBy("a_key", "b_key", "a_n", "b_n", "a_often", "b_often").agg(F.count(F.lit(1)).alias("common"))
        # what is not among the common beginnings lies behind the beginning of one of the two
        rest = F.floor((num * F.greatest("a_n", "b_n") + (den - 1)) / den) - 1 + F.least("a_often", "b_often")
        pairs = pairs.filter((num + den) * (F.col("common") + rest) >= num * (F.col("a_n") + F.col("b_n")))
        pairs.select("a_key", "b_key").unionByName(found).distinct().write.parquet(f"{folder}/pairs")
        pairs = spark.read.parquet(f"{folder}/pairs")
        asked = pairs.select(F.col("a_key").alias("key")).unionByName(pairs.select(F.col("b_key").alias("key"))).distinct()
        asked = asked.join(carriers.select(key.alias("key"), "id"), "key").select("id")
        held = sets_where(named(asked, "asked")).select(key.alias("key"), "tokens").join(lists.select("key", "group"), "key")
        for side in "ab":
            pairs = pairs.join(held.withColumnsRenamed({"key": f"{side}_key", "tokens": f"{side}_tokens", "group": side}), f"{side}_key")
        links = pairs.select("a", "b", "a_tokens", "b_tokens").mapInArrow(compare, "a struct<d:long,e:long>, b struct<d:long,e:long>")
        return components(links, folder)

    def merged(known: DataFrame, label: DataFrame) -> DataFrame:
        """(key, group) of all classes in groups, with the groups that ``label`` connects put together."""
        old = known.join(label, F.col("group") == F.col("node"), "left").select("key", F.coalesce("label", "group").alias("group"))
        alone = label.join(known, F.col("node") == F.col("key"), "left_anti").select(F.col("node").alias("key"), F.col("label").alias("group"))
        return old.unionByName(alone)

    places = starts.select("token", key.alias("key"), "n", "place").distinct()  # copies repeat their class
    in_groups(places, known).write.parquet(f"{folder}/mixed")
    final = merged(known, linked_groups(spark.read.parquet(f"{folder}/mixed")))
    final.select("key.d", "key.e", F.col("group").alias("label")).write.parquet(f"{folder}/labels")
    final = spark.read.parquet(f"{folder}/labels")  # the rows below read it more than once
    out = classes.join(final, ["d", "e"], "left").select("id", "n", F.coalesce("label", F.struct("d", "e")).alias("label"))
    first = out.filter("n > 0").groupBy("label").agg(F.min("id").alias("component_id"))
    linked = out.filter("n > 0").join(first, "label").select("id", "n", "component_id")
    every = linked.unionByName(out.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
