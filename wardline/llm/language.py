"""Language of a text by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.words import by_bytes

UNKNOWN = "und"
PROFILE = 400  # n-grams of a language profile, and of a document's
BLOCK = 1 << 18  # characters counted at a time
_CLASS = np.zeros(0x110000, np.uint8)  # 0 not seen yet, 1 letter, 2 other


def _letters(codes: np.ndarray) -> np.ndarray:
    new = np.unique(codes[_CLASS[codes] == 0])
    _CLASS[new] = [1 if chr(c).isalpha() else 2 for c in new.tolist()]
    return _CLASS[codes] == 1


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """1-, 2- and 3-grams of the lower-cased letters, each packed into one number, with their counts.

    Runs of anything but letters become one gap; grams may touch a gap but do not hold it inside alone.
    """
    keys, counts = [], []
    text = text.lower()  # as a whole: the small form of a letter may depend on its neighbours
    tail, last = np.zeros(1, np.uint64), None  # the two codes before a block, and the last one it had, gap or not
    for at in range(0, len(text), BLOCK):
        # surrogates cannot be in a text that came through UTF-8
        codes = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le"), np.uint32).astype(np.uint64)
        codes = np.where(_letters(codes.astype(np.int64)), codes, np.uint64(0))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        keep[0] = last is None or last != 0 or codes[0] != 0
        last, old = codes[-1], len(tail)
        end = np.zeros(1 if at + BLOCK >= len(text) else 0, np.uint64)
        codes = np.concatenate([tail, codes[keep], end])
        two = (codes[:-1] << np.uint64(21)) | codes[1:]
        three = (two[:-1] << np.uint64(21)) | codes[2:]
        tail = codes[-2:]
        one, two = codes[old:], two[old - 1 :]  # every gram belongs to the block in which it ends
        three = three[max(0, old - 2) :]
        grams = np.concatenate([one[one != 0], two[two != 0], three[three != 0]])
        k, c = np.unique(grams, return_counts=True)
        keys.append(k)
        counts.append(c)
    if len(keys) == 1:
        return keys[0], counts[0]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def top_grams(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent grams in rank order; ties go to the smaller gram."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        held = counts >= least
        keys, counts = keys[held], counts[held]
    return keys[np.lexsort((keys, -counts))][:size]


def fit_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
                 per_language: int = 2000, size: int = PROFILE) -> dict[str, list[int]]:
    """Rank-ordered profile of every language among the labelled rows.

    The model is fitted on whole texts, about ``per_language`` of each language, or all where there are fewer: those
    whose id has a small hash. Null languages and null texts are left out. The driver gets ``size`` numbers a language.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    share = F.create_map(*[F.lit(x) for lang, n in rows.groupBy("lang").count().collect() for x in (lang, per_language / n)] or [F.lit(""), F.lit(0.0)])
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                parts = [gram_counts(texts[i]) for i in np.flatnonzero(langs == lang)]
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                sums = np.bincount(place, weights=np.concatenate([c for _, c in parts]), minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(sums.astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    grams = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(top.select("lang", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):
        profiles.setdefault(lang, []).append(gram)
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text",
            size: int = PROFILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``lang_pred`` and ``score`` of every whole text by the smallest out-of-place distance.

    The distance adds, over the document's most frequent grams, how far each lies from its place in the
    profile, or ``size`` where it is absent; ``score`` is 1 less the share of the largest possible distance.
    Ties go to the language that sorts first. A null text, one without letters, and every text when there is
    no profile give ``und`` and 0. ``keep`` names columns to hand through; other columns are not read.
    """
    names = sorted(profiles)
    grams = np.unique(np.array([g for lang in names for g in profiles[lang]], np.int64).view(np.uint64))
    ranks = np.full((len(grams) + 1, len(names)), -1, np.int64)
    for j, lang in enumerate(names):
        ranks[np.searchsorted(grams, np.array(profiles[lang], np.int64).view(np.uint64)), j] = np.arange(len(profiles[lang]))

    def judge(text: str | None) -> tuple[str, float]:
        top = top_grams(*gram_counts(text), size) if text else grams[:0]
        if not len(top) or not names:
            return UNKNOWN, 0.0
        at = np.searchsorted(grams, top)
        at[grams[np.minimum(at, len(grams) - 1)] != top] = len(grams)
        places = ranks[at]
        far = np.where(places < 0, size, np.minimum(np.abs(places - np.arange(len(top))[:, None]), size)).sum(axis=0)
        best = int(far.argmin())
        return names[best], 1.0 - float(far[best]) / (size * len(top))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_text"):
            found = [judge(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )

    held = dict.fromkeys([id_col, *keep])
    rows = docs.select(F.col(text_col).alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(held)])
    kinds = [docs.schema[c].dataType.simpleString() for c in held]
    schema = ", ".join([*(f"_{i} {kind}" for i, kind in enumerate(kinds)), "lang_pred string", "score double"])
    out = rows.mapInArrow(label, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(held)], "lang_pred", "score")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Documents that no model may learn from."""
    return F.crc32(F.col(id_col).cast("string")) % folds == 0
