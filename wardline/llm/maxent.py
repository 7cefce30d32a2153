"""Log-probabilities of texts: a class-factored softmax over hashed n-gram and skip features.

The probability of a token is that of its class among ``WIDTH`` classes times its probability in the class. The
``WIDTH * HEAD_CLASSES`` most frequent words fill the first classes in order of frequency; both softmaxes there read
the context through hashed features: the word before, the two words before, and the word before the last. All other
known words share classes by count and shape. Such a class is a binary tree with a word in each leaf: a softmax of two
outcomes over the same features at each node, which starts from the shares of both sides in the class's tokens. One
further class stands for a word never seen in training.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.words import U, by_bytes, mix, utf8
from wardline.plans.scale import work_folder

FOLDS, FOLD = 7, 2  # the fold that is held out
WIDTH = 32  # classes, and words of a class of frequent words
HEAD_CLASSES, SHAPES, BINS = 9, 2, 11
UNSEEN = HEAD_CLASSES + SHAPES * BINS  # class of words that training does not hold
ROWS = 1 << 14  # rows of hashed features of either softmax
TEMPLATES = 3
STEP = 1 << 12  # tokens of a gradient step
RATE = 0.5
ROUNDS = 1  # passes over all training documents; after each the tasks' weights are averaged
SLOT_BITS = 10
SLOTS = 1 << SLOT_BITS  # groups of words by hash: the upper levels of the trees of the classes of rarer words
TREE_STEP = 1 << 14  # tokens of a gradient step in the trees
TREE_RATE = 0.5
PART = 1 << 22  # tokens, at least, of a task that learns: it sends weights of fixed size
CHUNK = 1 << 20  # tokens coded together
SALT = 16
_SLICE = 256  # rows sent together
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 22
_START = np.uint32(0x5BD1E995)
END = b""  # no word is empty


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are scored without having been learnt from; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == FOLD, F.lit(False))


def text_tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in blocks cut at white space, then the end."""
    data, at = text.translate(_LOW), 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        if end < len(data):
            rest = data[end : end + _BLOCK]
            while rest and len(gap := rest.split(None, 1)[0] if not rest[:1].isspace() else b"") == len(rest):
                end += len(rest)
                rest = data[end : end + _BLOCK]
            end += len(gap) if rest else 0
        yield data[at:end].split()
        at = end
    yield [END]


CODED = "chunk long, row array<long>, id array<long>, lead array<int>, size array<int>, train array<boolean>, tokens binary"


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK) -> DataFrame:
    """Documents as numbers into a list of words kept for about ``size`` tokens; a longer document goes on in the next chunk.

    ``lead`` tokens at the beginning of a piece are those before it, read as context only. ``n`` are occurrences in
    training documents. Rows are numbered by task and place, so repeated and null ids stay apart.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, seen = TaskContext.get().partitionId() << 32, 0, 0
        schema = pa.schema([
            ("chunk", pa.int64()), ("row", pa.list_(pa.int64())), ("id", pa.list_(pa.int64())), ("lead", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())),
            ("train", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())),
        ])
        place: dict[bytes, int] = {}
        pieces: list[tuple] = []
        parts: list[np.ndarray] = []
        total = 0

        def out() -> pa.RecordBatch:
            nonlocal place, pieces, parts, total, made
            tokens = np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)
            counted = np.repeat([p[4] for p in pieces], [p[3] for p in pieces]).astype(bool)
            at = 0
            for p in pieces:
                counted[at : at + p[2]] = False
                at += p[3]
            n = np.bincount(tokens[counted], minlength=len(place))
            packed = zstandard.ZstdCompressor(level=1).compress(tokens.view(np.uint8).reshape(-1, 4).T.tobytes())
            row = [task + made, *[[p[i] for p in pieces] for i in (0, 1, 2, 3, 4)], packed, list(place), n.tolist()]
            place, pieces, parts, total = {}, [], [], 0
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in by_bytes(batches, "text"):
            for name, train, text in zip(batch.column("id").to_pylist(), batch.column("train").to_pylist(), utf8(batch.column("text"))):
                seen += 1
                before: list[bytes] = []
                open_piece: list[np.ndarray] = []
                lead = 0
                for words in text_tokens(text):
                    for at in range(0, len(words), size):
                        part = words[at : at + size]
                        if total + len(part) > size and total:
                            if open_piece:
                                pieces.append((task + seen, name, lead, sum(map(len, open_piece)), train))
                                parts += open_piece
                            yield out()
                            lead = len(before)
                            open_piece = [np.array([place.setdefault(w, len(place)) for w in before], np.int64)] if before else []
                        open_piece.append(np.array([place.setdefault(w, len(place)) for w in part], np.int64))
                        total += len(part)
                        before = (before + part[-2:])[-2:]
                pieces.append((task + seen, name, lead, sum(map(len, open_piece)), train))
                parts += open_piece
        if pieces:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), (~held_out(id_col)).alias("train"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(code, f"{CODED}, words array<binary>, n array<long>")


def unpack(tokens: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def shapes(words: list[bytes]) -> np.ndarray:
    """Whether a word holds anything but ASCII."""
    return np.array([not w.isascii() for w in words], np.int64)


NUMBERED = "chunk long, block binary, word binary, count long, slot int, shape int, words long"


def block_of(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, of numbers from 0 on, as compressed bytes."""
    raw = np.concatenate(arrays).astype(np.int64).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def open_block(block: bytes, arrays: int = 3) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(arrays, -1)


def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of whole slots and their ranks among the words of slot and shape, rarest first.

    Of each chunk one block: places, counts and ranks of its words. Then the words that may be frequent, with their counts, and how
    many words a (slot, shape, count) has. Words without training tokens have rank 0.
    """
    rows = list(batches)
    if not sum(b.num_rows for b in rows):
        return
    schema = pa.schema([
        ("chunk", pa.int64()), ("block", pa.binary()), ("word", pa.binary()), ("count", pa.int64()), ("slot", pa.int32()), ("shape", pa.int32()), ("words", pa.int64()),
    ])
    table = pa.Table.from_batches(rows)
    coded = pc.dictionary_encode(table.column("words")).combine_chunks()
    chunk, place, n, slot = (table.column(c).to_numpy() for c in ("chunk", "place", "n", "slot"))
    of, words = coded.indices.to_numpy(), coded.dictionary
    counts = np.bincount(of, n, len(words)).astype(np.int64)
    slots, shape = np.zeros(len(words), np.int64), shapes(words.to_pylist())
    slots[of] = slot
    later = np.zeros(len(words), np.int64)
    later[pc.sort_indices(words, sort_keys=[("", "descending")]).to_numpy()] = np.arange(len(words))

    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    order = np.lexsort((later, counts, shape, slots))
    order = order[counts[order] > 0]
    group = slots[order] * SHAPES + shape[order]
    new = np.diff(group, prepend=-1) != 0
    ranks = np.zeros(len(words), np.int64)
    ranks[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else 0
    first = np.flatnonzero(new | (np.diff(counts[order], prepend=0) != 0))
    at = order[first]
    yield batch(len(at), slot=slots[at], shape=shape[at], count=counts[at], words=np.diff(np.append(first, len(order))))
    often = np.lexsort((-later, -counts))[: WIDTH * HEAD_CLASSES]
    often = often[counts[often] > 0]
    yield batch(len(often), word=words.take(pa.array(often)), count=counts[often])
    by_chunk = np.lexsort((place, chunk))
    cuts = np.flatnonzero(np.diff(chunk[by_chunk], prepend=-1, append=-1))
    for start, end in zip(cuts, cuts[1:]):
        k = by_chunk[start:end]
        yield batch(1, chunk=chunk[k[:1]], block=[block_of(place[k], counts[of[k]], ranks[of[k]])])


def node_hash(key: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return (mix(mix(key.astype(U)) + kind.astype(U)) >> U(32)).astype(np.uint32)


def spread(starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of the groups ``ids``, which begin at ``starts``, and which of ``ids`` each belongs to."""
    n = starts[ids + 1] - starts[ids]
    of = np.repeat(np.arange(len(ids)), n)
    return of, np.arange(len(of)) + np.repeat(starts[ids] - np.cumsum(n) + n, n)


class Model:
    """Counts that fix the classes, and the weights of both softmaxes."""

    def __init__(self, tokens: int, known: int, head: list[tuple[bytes, int]], bounds: np.ndarray, mass: np.ndarray, drop: np.ndarray):
        """``head``: frequent words with their counts; ``bounds``: least counts of the bins; ``mass``: training tokens of
        each (bin, shape); ``drop``: the same when each token is counted without itself, unseen words in the last place.
        """
        self.tokens, self.known, self.bounds, self.mass = tokens, known, bounds, mass
        self.head = {w: i for i, (w, _) in enumerate(head)}
        self.least = min((n for _, n in head), default=1 << 62)
        often = np.zeros((HEAD_CLASSES, WIDTH))
        often.ravel()[: len(head)] = [n for _, n in head]
        classes = np.zeros(WIDTH)
        classes[:HEAD_CLASSES] = often.sum(1)
        classes[HEAD_CLASSES:UNSEEN] = np.where(mass > 0, np.maximum(drop[:-1], 0.5), 0)
        classes[UNSEEN] = max(drop[-1], 0.5)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.prior = np.log(classes / classes.sum()).astype(np.float32)
            self.inside = np.nan_to_num(np.log(often / often.sum(1, keepdims=True)), nan=-np.inf).astype(np.float32)
        # of the classes, of the words of a class of frequent words, and of the nodes of the trees, ``WIDTH`` in a row
        self.weights = [np.zeros((ROWS, WIDTH), np.float32) for _ in range(3)]
        self.scale = [np.full(ROWS, 1e-3, np.float32) for _ in range(3)]
        self.words: np.ndarray | None = None

    def plant(self, words: np.ndarray, tokens: np.ndarray, table: dict[tuple[int, int], int]) -> None:
        """Trees of the classes of rarer words. ``words`` and ``tokens``: how many words and training tokens a (class, slot)
        holds; ``table``: how many words a (count, shape) has.
        """
        self.words = words.astype(np.int64)
        below = self.words.reshape(-1, SHAPES, SLOTS)
        self.first = (np.cumsum(below, 0) - below).reshape(words.shape)  # place of a class among the words of its slot and shape
        self.upto = np.hstack([np.zeros((len(words), 1)), np.cumsum(tokens, 1)])
        # share of a class's tokens that its rarest words hold, by their share of its words: a line between two counts
        groups: dict[int, list[tuple[int, int]]] = {}
        for (n, kind), k in sorted(table.items()):
            if k:
                groups.setdefault(int(self.bin_of(np.array([n]))[0]) * SHAPES + kind, []).append((n, k))
        at, share = [np.zeros(0)], [np.zeros(0)]
        for z in sorted(groups):
            n, k = np.array(groups[z], np.float64).T
            at.append(2 * z + np.append(0, np.cumsum(k) / k.sum()))
            share.append(np.append(0, np.cumsum(n * k) / (n * k).sum()))
        self.at, self.share = np.concatenate(at), np.concatenate(share)
        # the way to each slot of a class is the same for all its words
        kind, slot = np.divmod(np.arange(self.words.size), SLOTS)
        upper, keep = [], []
        for level in range(SLOT_BITS):
            half = 1 << (SLOT_BITS - 1 - level)
            low = slot // (2 * half) * (2 * half)
            left, right = self.upto[kind, low + half] - self.upto[kind, low], self.upto[kind, low + 2 * half] - self.upto[kind, low + half]
            keep.append((left > 0) & (right > 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                upper.append((node_hash(low + half, kind), slot & half > 0, np.log(right / left).astype(np.float32)))
        keep = np.stack(keep, 1)
        self.upper = [np.append(0, np.cumsum(keep.sum(1))), *[np.stack(x, 1)[keep] for x in zip(*upper)]]

    def paths(self, counts: np.ndarray, shape: np.ndarray, heads: np.ndarray, names: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """The way to each word in the tree of its class: where its nodes begin and, of each node, a hash, the side and
        what the shares of the sides give the second one in the logarithm. Nodes of which one side is empty are left out.
        """
        of = np.flatnonzero((heads < 0) & (counts > 0))
        z, slot = self.bin_of(counts[of]) * SHAPES + shape[of], (names[of] & (SLOTS - 1)).astype(np.int64)
        cell = z * SLOTS + slot
        which, at = spread(self.upper[0], cell)
        out = [(of[which], *[x[at] for x in self.upper[1:]])]
        size, place = self.words.ravel()[cell], ranks[of] - self.first.ravel()[cell]
        low, high = np.zeros(len(of), np.int64), size.copy()
        first, last = np.zeros(len(of)), np.ones(len(of))
        k = np.flatnonzero(size > 1)
        # only the words that are not yet alone go on; their columns shrink with them
        columns = [x[k] for x in (of, z, SLOTS + slot, size, place, low, high, first, last)]
        while len(columns[0]):
            of, z, slot, size, place, low, high, first, last = columns
            middle = (low + high) >> 1
            part = np.interp(2 * z + middle / size, self.at, self.share)
            side = place >= middle
            out.append((of, node_hash((middle << 32) + (high - low << 12) + slot, z), side, np.log((last - part) / (part - first)).astype(np.float32)))
            low, high = np.where(side, middle, low), np.where(side, high, middle)
            first, last = np.where(side, part, first), np.where(side, last, part)
            k = np.flatnonzero(high - low > 1)
            columns = [x[k] for x in (of, z, slot, size, place, low, high, first, last)]
        word, hashes, side, offset = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(word, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(word, minlength=len(counts))))
        return starts, hashes[order], side[order], offset[order]

    def steps(self, paths: tuple[np.ndarray, ...], ids: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each node on the ways of the tokens: the token, the side, places of its weights, logarithm of the odds of its second side."""
        starts, hashes, side, offset = paths
        of, at = spread(starts, ids)
        name, places, odds = hashes[at], [], offset[at]
        weights = self.weights[2].ravel()
        for feature in (features >> U(32)).astype(np.uint32):
            place = (feature[of] ^ name) * np.uint32(0x9E3779B1) >> np.uint32(32 - (ROWS * WIDTH - 1).bit_length())
            places.append(place.astype(np.intp))
            odds += weights.take(places[-1])
        return of, side[at], places, odds

    def climb(self, paths: tuple[np.ndarray, ...], ids: np.ndarray, features: np.ndarray, count: np.ndarray) -> None:
        """One step down the gradient at all nodes on the ways of the tokens; a row of weights has one rate, as in ``learn``."""
        _, side, places, odds = self.steps(paths, ids, features)
        slope = (1 / (1 + np.exp(-odds)) - side).astype(np.float64)
        sums = sum(np.bincount(p, slope, ROWS * WIDTH) for p in places).astype(np.float32).reshape(ROWS, WIDTH)
        self.scale[2] += np.einsum("ij,ij->i", sums, sums)
        self.weights[2] -= sums * (TREE_RATE / np.sqrt(self.scale[2]))[:, None]
        count += sum(np.bincount(p >> (WIDTH - 1).bit_length(), minlength=ROWS) for p in places)

    def bin_of(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, counts, side="right") - 1

    def codes(self, counts: np.ndarray, heads: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Class of each word by its count; words of the head keep theirs."""
        tail = np.where(counts > 0, HEAD_CLASSES + self.bin_of(counts) * SHAPES + shape, UNSEEN)
        return np.where(heads >= 0, heads // WIDTH, tail)

    def in_tail(self, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Log-probability of a known word in its class of rarer words as far as no context is known: its share of the class's tokens."""
        return np.log(np.maximum(counts, 1)) - np.log(np.maximum(self.mass[np.maximum(self.bin_of(counts), 0) * SHAPES + shape], 1))

    def features(self, names: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hash of each context template at each token; ``place`` counts from the beginning of the document's piece."""
        one, two = np.full(len(names), _START), np.full(len(names), _START)
        one[1:] = np.where(place[1:] >= 1, names[:-1], _START)
        two[2:] = np.where(place[2:] >= 2, names[:-2], _START)
        one, two = one.astype(U), two.astype(U)
        return np.stack([mix(one + U(1 << 32)), mix((one << U(32)) ^ two ^ U(0x9E37)), mix(two + U(3 << 32))])

    @staticmethod
    def rows(features: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Rows of weights for the features, of the first softmax or of the one inside each class ``of``."""
        if of is not None:
            features = mix(features + of.astype(U) * U(0x9E3779B97F4A7C15))
        return (features >> U(20)).astype(np.int64) & (ROWS - 1)

    def logs(self, part: int, offset: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log-probabilities of all ``WIDTH`` outcomes for each token."""
        z = self.sums(part, offset, rows)
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return z

    def sums(self, part: int, offset: np.ndarray, rows: np.ndarray) -> np.ndarray:
        weights = self.weights[part]
        z = weights.take(rows[0], 0)
        for r in rows[1:]:
            z += weights.take(r, 0)
        z += offset
        return z

    def learn(self, part: int, offset: np.ndarray, rows: np.ndarray, target: np.ndarray, count: np.ndarray) -> None:
        """One step down the gradient; each row has its own rate, which falls with the gradients it has met."""
        slope = self.sums(part, offset, rows)
        slope -= slope.max(1, keepdims=True)
        np.exp(slope, out=slope)
        slope /= slope.sum(1, keepdims=True)
        slope[np.arange(len(target)), target] -= 1
        weights, scale, flat = self.weights[part], self.scale[part], rows.ravel().astype(np.int16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        last = np.append(np.flatnonzero(flat[1:] != flat[:-1]), len(flat) - 1)
        held = np.cumsum(slope.take(order % len(target), 0), axis=0)
        sums = held.take(last, 0)
        sums[1:] -= held.take(last[:-1], 0)
        at = flat[last].astype(np.int64)
        met = scale[at] + np.einsum("ij,ij->i", sums, sums)
        scale[at] = met
        sums *= (RATE / np.sqrt(met))[:, None]
        weights[at] = weights.take(at, 0) - sums
        count[at] += np.diff(last, prepend=-1)


class Chunk:
    """A coded chunk as arrays of tokens."""

    def __init__(self, row: dict):
        self.ids = unpack(row["tokens"])
        sizes = np.asarray(row["size"], np.int64)
        self.sizes, self.lead = sizes, np.asarray(row["lead"], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.place = np.arange(len(self.ids)) - np.repeat(self.starts, sizes)
        self.train = np.repeat(np.asarray(row["train"], bool), sizes)
        self.scored = self.place >= np.repeat(self.lead, sizes)
        self.piece = np.repeat(np.arange(len(sizes)), sizes)
        # a lead is as far from the beginning of the document as the pieces before it are long: never at a start
        self.place += np.repeat(np.where(self.lead > 0, 2, 0), sizes)
        self.counts, self.names = (np.frombuffer(row[c], t) for c, t in (("counts", np.int64), ("names", np.uint32)))
        self.heads, self.shape = (np.frombuffer(row[c], t).astype(np.int64) for c, t in (("heads", np.int32), ("shapes", np.int8)))
        self.ranks = np.frombuffer(row["ranks"], np.int32) if "ranks" in row else None

    def paths(self, model: Model) -> tuple[np.ndarray, ...]:
        return model.paths(self.counts, self.shape, self.heads, self.names, self.ranks)


def train_chunk(model: Model, row: dict, counts: list[np.ndarray]) -> None:
    """Steps over the training tokens of a chunk. A word's class is that of its count without the token itself, so words
    seen once teach what an unseen word's context is like."""
    c = Chunk(row)
    code = model.codes(np.where(c.heads >= 0, c.counts, np.maximum(c.counts - 1, 0)), c.heads, c.shape)
    if not len(c.ids):
        return
    features = model.features(c.names[c.ids], c.place)
    used = np.flatnonzero(c.train & c.scored)
    # without the token itself its word may fall into a class that holds no word: then it teaches the word's own class
    code = np.where(np.isfinite(model.prior[code]), code, model.codes(c.counts, c.heads, c.shape))
    target, heads = code[c.ids], c.heads[c.ids]
    for at in range(0, len(used), STEP):
        t = used[at : at + STEP]
        model.learn(0, model.prior, model.rows(features[:, t]), target[t], counts[0])
        t = t[heads[t] >= 0]
        if len(t):
            model.learn(1, model.inside[target[t]], model.rows(features[:, t], target[t]), heads[t] % WIDTH, counts[1])
    # in the trees every word is in its own class, which is the one that holds it
    rarer = used[heads[used] < 0] if model.words is not None else used[:0]
    paths = c.paths(model) if len(rarer) else ()
    for at in range(0, len(rarer), TREE_STEP):
        t = rarer[at : at + TREE_STEP]
        model.climb(paths, c.ids[t], features[:, t], counts[2])


def score_chunk(model: Model, row: dict) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: tokens known, base score and the model's score, both as log10."""
    c = Chunk(row)
    code = model.codes(c.counts, c.heads, c.shape)
    base = np.log10((c.counts + 1) / (model.tokens + model.known + 1))
    rarer = (c.heads < 0) & (c.counts > 0)
    tail = np.where(rarer, model.in_tail(c.counts, c.shape), 0.0) if model.words is None else np.zeros(len(c.counts))
    log = np.zeros(len(c.ids))
    features = model.features(c.names[c.ids], c.place) if len(c.ids) else None
    target, heads = code[c.ids], c.heads[c.ids]
    for at in range(0, len(c.ids), STEP):
        t = np.arange(at, min(len(c.ids), at + STEP))
        log[t] = model.logs(0, model.prior, model.rows(features[:, t]))[np.arange(len(t)), target[t]] + tail[c.ids[t]]
        t = t[heads[t] >= 0]
        if len(t):
            log[t] += model.logs(1, model.inside[target[t]], model.rows(features[:, t], target[t]))[np.arange(len(t)), heads[t] % WIDTH]
    rarer = np.flatnonzero(rarer[c.ids]) if model.words is not None else np.zeros(0, np.int64)
    paths = c.paths(model) if len(rarer) else ()
    for at in range(0, len(rarer), TREE_STEP):
        t = rarer[at : at + TREE_STEP]
        of, side, _, odds = model.steps(paths, c.ids[t], features[:, t])
        against = np.where(side, -odds, odds)
        log[t] -= np.bincount(of, np.maximum(against, 0) + np.log(1 + np.exp(-np.abs(against))), len(t))
    add = lambda x: np.bincount(c.piece, weights=np.where(c.scored, x, 0.0), minlength=len(c.sizes))
    return c, add(c.counts[c.ids] > 0).astype(np.int64), add(base[c.ids]), add(log) / np.log(10)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each slice; a task holds one slice of weights at a time for each slice it gets, never all rows."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, piece, value in zip(*[batch.column(c).to_pylist() for c in ("part", "slice", "value")]):
            value = np.frombuffer(value, np.float32)
            if (part, piece) in held:
                held[part, piece] += value
            else:
                held[part, piece] = value.copy()
    keys = list(held)
    yield pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([0] * len(keys), pa.int32()),
        pa.array([held[k].tobytes() for k in keys], pa.binary()),
    ], ["part", "slice", "salt", "value"])


SUMS = "part int, slice int, salt int, value binary"


def train(coded: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Gradient steps of every task over its own chunks from common weights, then one average, ``rounds`` times.

    A row's new weight is the mean over tasks, each counted by the tokens that met the row. Tasks of at least ``PART`` tokens send weights of fixed
    size in slices, which are added in two rounds of tasks; the driver gets one sum.
    """
    spark = coded.sparkSession
    for _ in range(rounds if model.tokens else 0):
        shared = spark.sparkContext.broadcast(model)

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, some = shared.value, False
            own.weights, own.scale = [w.copy() for w in own.weights], [s.copy() for s in own.scale]
            counts = [np.zeros(ROWS, np.float32) for _ in range(3)]
            for batch in batches:
                for i in range(batch.num_rows):
                    train_chunk(own, {c: batch.column(c)[i].as_py() for c in batch.schema.names}, counts)
                    some = True
            salt = TaskContext.get().partitionId() % SALT
            for part in range(3) if some else ():
                n = counts[part][:, None]
                value = np.hstack([own.weights[part] * n, own.scale[part][:, None] * n, n])
                cut = list(range(0, ROWS, _SLICE))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(cut), pa.int32()), pa.array([c // _SLICE for c in cut], pa.int32()), pa.array([salt] * len(cut), pa.int32()),
                    pa.array([value[c : c + _SLICE].tobytes() for c in cut], pa.binary()),
                ], ["part", "slice", "salt", "value"])

        parts = coded.coalesce(max(1, model.tokens // PART))
        sums = parts.mapInArrow(descend, SUMS).repartition("part", "slice", "salt").mapInArrow(_add, SUMS)
        sums = sums.repartition("part", "slice").mapInArrow(_add, SUMS)
        for part, piece, value in sums.select("part", "slice", "value").collect():  # ROWS rows of weights a softmax
            value = np.frombuffer(value, np.float32).reshape(_SLICE, WIDTH + 2)
            met, rows = value[:, -1] > 0, np.arange(piece * _SLICE, (piece + 1) * _SLICE)
            model.weights[part][rows[met]] = value[met, :WIDTH] / value[met, -1:]
            model.scale[part][rows[met]] = value[met, WIDTH] / value[met, -1]
        shared.unpersist()
    return model


def bin_bounds(most: int) -> np.ndarray:
    """Least counts of the bins of rarer words: 1 to 4 alone, then up to ``most`` in equal steps of the logarithm."""
    if most <= 4:
        return np.arange(1, BINS + 1)
    steps = np.unique(np.round(np.exp(np.linspace(np.log(5), np.log(most), BINS - 3))).astype(np.int64))[: BINS - 4]
    return np.concatenate([np.arange(1, 5), steps])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    Null texts are empty and have one token, the end. Rows with a null id are learnt from. Repeated rows are rows of their own;
    an empty table gives no rows; without training documents every score is 0. Scores depend on how tasks divide the
    training documents, so they agree between runs to about two digits. All training tokens are counted and learnt from, in
    the classes and in the class of their word.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "maxent")
    chunks(docs, id_col, text_col).write.parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")
    # a word has one row a chunk, so no word gathers more than a small part of the rows
    places = stored.select("chunk", F.posexplode(F.arrays_zip("words", "n")).alias("place", "w"))
    places = places.select("chunk", "place", "w.words", "w.n", (F.crc32("w.words") % SLOTS).cast("int").alias("slot"))
    places.repartition("slot").mapInArrow(number, NUMBERED).write.parquet(f"{folder}/counts")
    counted = spark.read.parquet(f"{folder}/counts")
    groups = counted.filter("words is not null")
    tokens, known = groups.agg(F.coalesce(F.sum(F.col("words") * F.col("count")), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    head = [(bytes(r[0]), r[1]) for r in counted.filter("word is not null").orderBy(F.desc("count"), "word").limit(WIDTH * HEAD_CLASSES).select("word", "count").collect()]
    least = min((n for _, n in head), default=1)
    bounds = bin_bounds(least)
    # counts beyond the least of the head are words of the head; those with the same count are taken out below
    rarer = groups.filter(F.col("count") <= least)
    by_count = rarer.groupBy("count", "shape").agg(F.sum("words").alias("k"))
    kind = sum([(F.col("count") >= int(b)).cast("int") for b in bounds], F.lit(-1)) * SHAPES + F.col("shape")
    by_slot = rarer.groupBy(kind.alias("kind"), "slot").agg(F.sum("words").alias("k"), F.sum(F.col("words") * F.col("count")).alias("n"))
    words, held = (np.zeros((BINS * SHAPES, SLOTS)) for _ in range(2))
    for z, slot, k, n in by_slot.collect() if head else ():  # a fixed number of classes and slots
        words[z, slot], held[z, slot] = k, n
    mass, drop = np.zeros(BINS * SHAPES), np.zeros(BINS * SHAPES + 1)
    table: dict[tuple[int, int], int] = {(r[0], r[1]): r[2] for r in by_count.collect()} if head else {}
    place = lambda n, kind: (np.searchsorted(bounds, n, side="right") - 1) * SHAPES + kind
    for word, n in head:
        if n == least:
            table[n, int(shapes([word])[0])] -= 1
            at = place(n, int(shapes([word])[0])), zlib.crc32(word) % SLOTS
            words[at] -= 1
            held[at] -= n
    for (n, kind), k in table.items():
        mass[place(n, kind)] += n * k
    for (n, kind), k in table.items():
        less = place(n - 1, kind) if n > 1 else -1
        drop[less if n == 1 or mass[less] > 0 else place(n, kind)] += n * k
    model = Model(tokens, known, head, bounds, mass, drop)
    model.plant(words, held, table)

    frequent, limit = model.head, model.least

    def code(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts, hashes and classes of the words of a chunk beside its tokens."""
        row = left.slice(0, 1)
        words = row.column("words")[0].as_py()
        counts, ranks = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        for block in right.column("block").to_pylist():
            at, n, rank = open_block(block)
            counts[at], ranks[at] = n, rank
        heads = np.full(len(words), -1, np.int32)
        for i in np.flatnonzero(counts >= limit).tolist():
            heads[i] = frequent.get(words[i], -1)
        names = np.array([zlib.crc32(w) for w in words], np.uint32)
        out = row.select([f.name for f in row.schema if f.name not in ("words", "n")])
        for name, values in (("counts", counts), ("names", names), ("heads", heads), ("shapes", shapes(words).astype(np.int8)), ("ranks", ranks)):
            out = out.append_column(name, pa.array([values.tobytes()], pa.binary()))
        return out

    numbers = counted.filter("chunk is not null").select("chunk", "block")
    paired = stored.groupBy("chunk").cogroup(numbers.groupBy("chunk"))
    paired.applyInArrow(code, f"{CODED}, counts binary, names binary, heads binary, shapes binary, ranks binary").write.parquet(f"{folder}/coded")
    coded = spark.read.parquet(f"{folder}/coded")
    shared = spark.sparkContext.broadcast(train(coded, model, rounds))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                c, seen, base, value = score_chunk(shared.value, row)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["row"], pa.int64()), pa.array(row["id"], pa.int64()), pa.array([not t for t in row["train"]], pa.bool_()),
                    pa.array(c.sizes - c.lead), pa.array(seen), pa.array(base), pa.array(value),
                ], ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    pieces = coded.mapInArrow(judge, "row long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    kind = docs.schema[id_col].dataType.simpleString()
    return pieces.groupBy("row", "id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]).select(
        F.col("id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
