"""How far the words of sources lie apart: bitmaps of the terms that a group has with one count, intersected pair by pair."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.words import by_bytes, utf8
from wardline.plans.scale import work_folder

LEAST_DOCS = 3  # documents of a language that hold a kept term
TOP = 200  # ranks of the term part
SCALE = 1_000_000_000
_LETTER = bytes(32 if b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 if b <= 90 else b for b in range(256))
_BLOCK = 1 << 22  # bytes of a text split at a time
_KEPT = 1 << 19  # terms counted before they are sent on
_CELLS = 1 << 22  # numbers of a block of joint cells
FEW, MANY = 1 << 10, 1 << 6  # terms of a bitmap: of rare ones, with few counts, and of frequent ones, with nearly as many counts as terms
RARE = 8  # bits of the count of a rare term

STORE = "lang string, terms array<string>, totals array<long>, sources array<string>, counts array<long>, sizes array<long>, bits array<binary>"


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in blocks: runs of letters and of all that is not ASCII, A-Z lower-cased."""
    data, at = text.translate(_LETTER), 0
    while at < len(data):
        end = data.find(b" ", at + _BLOCK) if at + _BLOCK < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split(b" ")
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, added up over many documents."""
    total: dict[tuple, Counter] = {}
    seen: dict[tuple, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in total.items():
            docs, n = seen[lang, source], len(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64()),
            ], ["lang", "source", "term", "n", "docs"])
        total.clear()
        seen.clear()

    held = 0
    for batch in by_bytes(batches, "text"):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8(batch.column("text"))):
            counts, docs = total.setdefault((lang, source), Counter()), seen.setdefault((lang, source), Counter())
            before, once = len(counts), set()
            for terms in text_terms(text):
                counts.update(terms)
                once.update(terms)
            docs.update(once)
            held += len(counts) - before
        if held > _KEPT:
            yield from out()
            held = 0
    yield from out()


def _slice(lang: str, terms: list, totals: np.ndarray, names: list[str], owner: np.ndarray, source: np.ndarray, n: np.ndarray) -> dict:
    """One row of the store: its terms, and for each (source, count) the bitset of the terms that have it."""
    order = np.lexsort((n, source))
    owner, source, n = owner[order], source[order], n[order]
    new = np.ones(len(n), bool)
    new[1:] = (source[1:] != source[:-1]) | (n[1:] != n[:-1])
    level, at = np.cumsum(new) - 1, np.flatnonzero(new)
    held = np.zeros((len(at), -(-len(terms) // 64) * 64), np.uint8)
    held[level, owner] = 1
    bits = np.packbits(held, axis=1, bitorder="little")
    return {
        "lang": lang, "terms": terms, "totals": totals.tolist(), "sources": [names[s] for s in source[at].tolist()], "counts": n[at].tolist(),
        "sizes": np.bincount(level, minlength=len(at)).tolist(), "bits": [row.tobytes() for row in bits],
    }


class _Builder:
    """Takes rows sorted by language and term and gives slices of terms of one language and of about one frequency."""

    def __init__(self, least: int):
        self.least, self.lang = least, None
        self.names: list[str] = []
        self.place: dict[str, int] = {}
        self.held: dict[int, list] = {}

    def cut(self, size: int, ready: list) -> Iterator[dict]:
        """Slices of up to ``size`` terms from (terms, totals, lengths, source, n) parts."""
        terms = [t for part in ready for t in part[0]]
        totals, lengths, source, n = (np.concatenate([part[i] for part in ready]) for i in range(1, 5))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for at in range(0, len(terms), size):
            end = min(len(terms), at + size)
            a, b = ends[at], ends[end]
            yield _slice(self.lang, terms[at:end], totals[at:end], self.names, np.repeat(np.arange(end - at), lengths[at:end]), source[a:b], n[a:b])

    def flush(self) -> Iterator[dict]:
        for bits, parts in self.held.items():
            yield from self.cut(FEW if bits <= RARE else MANY, parts)
        self.held, self.names, self.place = {}, [], {}

    def add(self, lang: str, terms: pa.Array, source: list[str], n: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> Iterator[dict]:
        """All rows of some terms of one language; ``starts`` are the first rows of the terms."""
        if lang != self.lang:
            yield from self.flush()
            self.lang = lang
        for name in set(source) - self.place.keys():
            self.place[name] = len(self.names)
            self.names.append(name)
        source = np.array([self.place[s] for s in source], np.int64)
        lengths = np.diff(np.append(starts, len(n)))
        total = np.add.reduceat(n, starts)
        kept = np.add.reduceat(docs, starts) >= self.least
        size = np.frexp(total.astype(np.float64))[1]
        for bits in np.unique(size[kept]).tolist():
            chosen = kept & (size == bits)
            rows = np.repeat(chosen, lengths)
            parts = self.held.setdefault(bits, [])
            parts.append((terms.filter(pa.array(chosen)).to_pylist(), total[chosen], lengths[chosen], source[rows], n[rows]))
            width = FEW if bits <= RARE else MANY
            if sum(len(p[0]) for p in parts) >= 8 * width:
                self.held[bits] = []
                yield from self.cut(width, parts)


def bitmaps(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS) -> DataFrame:
    """The store: rows of up to ``FEW`` terms of one language with a bitset for each (source, count > 0).

    Each term lies in one row with its counts in all sources, so joint cells of two sources add up over rows. A term has
    a row a source at most when it is shuffled from any task that read it, so no key gathers more than tasks x sources rows.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").filter("term <> ''")
    found = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _Builder(least)
        schema = pa.schema([
            ("lang", pa.string()), ("terms", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())),
            ("counts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bits", pa.list_(pa.binary())),
        ])

        def whole(table: pa.Table, last: bool) -> tuple[list[dict], pa.Table | None]:
            """Slices of the terms that are complete, and the rows of the last term, which may go on."""
            lang, term = table.column("lang").combine_chunks(), table.column("term").combine_chunks()
            new = np.ones(len(term), bool)
            if len(term) > 1:
                new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            end = len(term) if last else starts[-1]
            out, starts = [], starts[starts < end]
            if len(starts):
                first = lang.take(pa.array(starts))
                change = np.ones(len(starts), bool)
                change[1:] = pc.not_equal(first[1:], first[:-1]).to_numpy(zero_copy_only=False)
                cuts = np.append(np.flatnonzero(change), len(starts))
                source = table.column("source").to_pylist()
                n, docs = table.column("n").to_numpy(), table.column("docs").to_numpy()
                for a, b in zip(cuts, cuts[1:]):
                    lo, hi = starts[a], starts[b] if b < len(starts) else end
                    out += builder.add(first[int(a)].as_py(), term.take(pa.array(starts[a:b])), source[lo:hi], n[lo:hi], docs[lo:hi], starts[a:b] - lo)
            return out, table.slice(end) if end < len(term) else None

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            out, rest = whole(pa.concat_tables([rest, table]) if rest is not None else table, False)
            if out:
                yield from pa.Table.from_pylist(out, schema).to_batches()
        out = whole(rest, True)[0] if rest is not None else []
        out += builder.flush()
        if out:
            yield from pa.Table.from_pylist(out, schema).to_batches()

    return found.sortWithinPartitions("lang", "term").mapInArrow(build, STORE)


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (n + v)), exact for counts of any size."""
    if not len(counts) or int(counts.max()) < (1 << 62) // SCALE:
        return 1 + SCALE * (counts + 1) // (n + v)
    return np.array([1 + SCALE * (c + 1) // (n + v) for c in counts.tolist()], np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits into 64 bits."""
    return (p - q) * (p - q) // q


def _joint(bits: np.ndarray, counts: np.ndarray, sizes: np.ndarray, edges: np.ndarray, terms: int, p: np.ndarray, zero: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of ``gap`` over the terms of a slice for all pairs of sources, some sources at a time.

    Levels ``edges[s]:edges[s + 1]`` belong to source s. AND and popcount give the terms that two sources have with two
    counts; those that a source does not have are the complement: the level's size less its joint terms.
    """
    sources, levels = len(edges) - 1, len(counts)
    owner = np.repeat(np.arange(sources), np.diff(edges))
    present = np.zeros(sources, np.int64)
    np.add.at(present, owner, sizes)
    held = np.flatnonzero(np.diff(edges))  # sources with a level; reduceat needs runs that are not empty
    step = max(1, _CELLS // max(1, levels * bits.shape[1]))

    def by_source(cells: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cells), sources), np.int64)
        if levels:
            out[:, held] = np.add.reduceat(cells, edges[held], axis=1)
        return out

    block = max(1, _CELLS // max(sources, 1))
    for first in range(0, sources, block):
        last = min(sources, first + block)
        value, met, common = (np.zeros((last - first, k), np.int64) for k in (sources, levels, sources))
        for at in range(edges[first], edges[last], step):
            rows = np.arange(at, min(edges[last], at + step))
            both = np.zeros((len(rows), levels), np.int64)
            for w in range(bits.shape[1]):
                both += np.bitwise_count(bits[rows, w][:, None] & bits[:, w][None, :])
            shared = by_source(both)
            sums = by_source(both * gap(p[rows][:, None], p[None, :])) + (sizes[rows][:, None] - shared) * gap(p[rows][:, None], zero[None, :])
            np.add.at(value, owner[rows] - first, sums)
            np.add.at(met, owner[rows] - first, both)
            np.add.at(common, owner[rows] - first, shared)
        mine = zero[first:last, None]
        value += by_source((sizes[None, :] - met) * gap(mine, p[None, :]))
        value += (terms - present[first:last, None] - present[None, :] + common) * gap(mine, zero[None, :])
        yield first, value


class _Best:
    """The first ``top`` (value descending, term ascending) of a group, cut down now and then."""

    def __init__(self, top: int):
        self.top, self.least, self.parts, self.n = top, -1, [], 0

    def add(self, value: np.ndarray, term: np.ndarray) -> None:
        held = value >= self.least
        if held.any():
            self.parts.append((value[held], term[held]))
            self.n += int(held.sum())
            if self.n > 64 * self.top:
                self.cut()

    def cut(self) -> list[tuple[int, str]]:
        if not self.parts:
            return []
        value, term = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        if len(value) > self.top:
            least = np.partition(value, len(value) - self.top)[len(value) - self.top]
            value, term = value[value >= least], term[value >= least]
        rows = sorted(zip((-value).tolist(), term.tolist()))[: self.top]
        self.parts = [(-np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], object))]
        self.n = len(rows)
        if len(rows) == self.top:
            self.least = -rows[-1][0]
        return [(-v, t) for v, t in rows]


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how far each source lies from the others of its language,
    and the terms it has more often than its language.

    Null texts, languages and sources are empty strings; a repeated row is a further document; an empty table gives no
    rows; a language without kept terms gives its pairs the value 0. All arithmetic is on integers. Ranks go by value,
    then item. The driver and the tasks hold one (language, source, sum) per group; the result has their pairs.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "divergence")
    bitmaps(docs, lang_col, source_col, text_col).write.parquet(f"{folder}/bitmaps")
    store = spark.read.parquet(f"{folder}/bitmaps")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    mass = store.select("lang", F.inline(F.arrays_zip("sources", "counts", "sizes")))
    mass = mass.groupBy("lang", F.col("sources").alias("source")).agg(F.sum(F.col("counts") * F.col("sizes")).alias("n"))
    kept = {r[0]: r[1] for r in store.groupBy("lang").agg(F.sum(F.size("terms"))).collect()}
    groups: dict[str, dict[str, int]] = {}
    for lang, source, n in docs.select(*named).distinct().join(mass, ["lang", "source"], "left").collect():
        groups.setdefault(lang, {})[source] = n or 0
    known = spark.sparkContext.broadcast({
        lang: (sorted(of), np.array([of[s] for s in sorted(of)], object), sum(of.values()), kept.get(lang, 0)) for lang, of in groups.items()
    })

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        best: dict[tuple[str, str], _Best] = {}
        names = ["lang", "source", "part", "item", "value"]

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, first), value in sums.items():
                of = known.value[lang][0]
                for i, row in enumerate(value):
                    others = [j for j in range(len(of)) if j != first + i]
                    n = len(others)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([of[first + i]] * n), pa.array(["pair"] * n), pa.array([of[j] for j in others], pa.string()), pa.array(row[others], pa.int64())], names)
            for (lang, source), held in best.items():
                if rows := held.cut():
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), pa.array(["term"] * n), pa.array([t.decode() for _, t in rows], pa.string()), pa.array([v for v, _ in rows], pa.int64())], names)
            sums.clear()
            best.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                take = lambda c: batch.column(c)[row].values
                lang, (of, n, all_n, v) = batch.column("lang")[row].as_py(), known.value[batch.column("lang")[row].as_py()]
                place = {s: i for i, s in enumerate(of)}
                owner = np.array([place[s] for s in take("sources").to_pylist()], np.int64)
                order = np.argsort(owner, kind="stable")
                owner, counts, sizes = owner[order], take("counts").to_numpy()[order], take("sizes").to_numpy()[order]
                bits = np.frombuffer(b"".join(take("bits").to_pylist()), np.uint64).reshape(len(owner), -1)[order]
                edges = np.searchsorted(owner, np.arange(len(of) + 1))
                p = np.empty(len(owner), np.int64)
                for s in np.unique(owner).tolist():
                    p[edges[s] : edges[s + 1]] = shares(counts[edges[s] : edges[s + 1]], n[s], v)
                zero = np.array([1 + SCALE // (m + v) for m in n.tolist()], np.int64)
                totals = take("totals").to_numpy()
                for first, value in _joint(bits, counts, sizes, edges, len(totals), p, zero):
                    sums[lang, first] = sums.get((lang, first), 0) + value
                terms = np.array(take("terms").cast(pa.binary()).to_pylist(), object)
                q = shares(totals, all_n, v)
                level, term = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little"))
                cuts = np.searchsorted(owner[level], np.arange(len(of) + 1))
                for s in np.unique(owner).tolist():
                    mine, t = p[level[cuts[s] : cuts[s + 1]]], term[cuts[s] : cuts[s + 1]]
                    more = mine > q[t]
                    best.setdefault((lang, of[s]), _Best(top)).add(gap(mine[more], q[t[more]]), terms[t[more]])
                if sum(x.size for x in sums.values()) > _CELLS or len(best) * 64 * top > _CELLS:
                    yield from out()
        yield from out()

    parts = store.mapInArrow(compare, "lang string, source string, part string, item string, value long")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    flat = docs.select(*named).distinct()
    other = flat.select("lang", F.col("source").alias("item"))
    all_pairs = flat.join(other, "lang").filter("source <> item").join(pairs, ["lang", "source", "item"], "left")
    all_pairs = all_pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)
    return all_pairs.withColumn("rank", F.row_number().over(by_rank)).unionByName(terms)
