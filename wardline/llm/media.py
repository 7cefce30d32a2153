"""Texts as stored media in a content-addressed chunk store.

A text becomes a mono 8-bit WAV file. Rolling-hash cuts split the file into chunks, each chunk is stored
once, and an ordered list of digests rebuilds the file, which is checked before samples are used.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.bits import BitFilter
from wardline.llm.words import by_bytes, mix, utf8
from wardline.plans.scale import shared_folder

UNIT = 192  # payload bytes come in multiples of this
RATE = 8000
LEAST, MASK_BITS, MOST = 512, 11, 8192  # shortest chunk, mean of 2**11 bytes beyond it, longest chunk
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_BLOCK = 1 << 20


def payload_of(text: bytes) -> bytes:
    """The text, filled with spaces up to a positive multiple of ``UNIT``."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 1, RATE, len(payload), "NONE", "not compressed"))
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit samples")
        return f.readframes(f.getnframes())


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 32 bytes has ``MASK_BITS`` zero bits on top."""
    raw, hits = np.frombuffer(data, np.uint8), []
    for at in range(0, len(raw), _BLOCK):
        back = min(at, 31)
        h = GEAR[raw[at - back : at + _BLOCK]]
        for step in (1, 2, 4, 8, 16):  # doubling: after it h covers 2 * step bytes
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        hits.append(np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + (at - back + 1))
        hits[-1] = hits[-1][hits[-1] > at]
    ends, start = [], 0
    for end in np.concatenate(hits).tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(end)
            start = end
    while len(data) - start > MOST:
        start += MOST
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def media_id(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def feature(payload: bytes) -> str:
    """Mean, root mean square, zero crossings and the loudest of eight frequency bands of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    power = np.zeros(8)
    for at in range(0, len(x), UNIT * 1024):
        spectra = np.abs(np.fft.rfft(x[at : at + UNIT * 1024].reshape(-1, UNIT), axis=1)[:, 1:])
        power += (spectra.reshape(len(spectra), 8, -1) ** 2).sum(axis=(0, 2))
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};band={int(power.argmax())}"


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


BUNDLE = "media_id binary, media_sha256 binary, digests array<binary>, owners array<binary>, own array<binary>, lends array<boolean>"


def _bundles(texts: list[bytes], roles: list[dict[int, bytes | None]]) -> pa.RecordBatch:
    """Rows of the store. ``roles``: chunk number to the media that holds it, or to None if it is held here and lent."""
    names = [c.split()[0] for c in BUNDLE.split(", ")]
    types = [pa.binary(), pa.binary(), *[pa.list_(pa.binary())] * 3, pa.list_(pa.bool_())]
    rows = []
    for text, role in zip(texts, roles):
        media = to_wav(payload_of(text))
        parts = chunks(media)
        away = [role.get(i) for i in range(len(parts))]
        rows.append((
            media_id(text), hashlib.sha256(media).digest(), [digest(c) for c in parts], away,
            [c if owner is None else None for c, owner in zip(parts, away)],
            [i in role and owner is None for i, owner in enumerate(away)],
        ))
    return _rows(names, types, rows)


def _spark_hash(value: int) -> int:
    """``xxhash64`` of a long."""
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little"), seed=42)


def store(docs: DataFrame, folder: str, text_col: str = "text") -> None:
    """Writes ``folder``/bundles: one row per distinct text with its ordered chunk digests, the place of
    each chunk's only copy, and those copies that this row owns.

    Columns: media_id (first half of the text's SHA-256), media_sha256, digests, owners (media_id that holds the chunk,
    null for itself), own (chunks held here), lends (whether another place uses a chunk held here). The
    copy belongs to the smallest (media_id, position). Null texts count as empty. Equal texts are stored once,
    whatever their number.

    Only media that occur twice or share chunks need their text beside the other side of a join. A bit filter
    names them, and some others; the rest is stored where it is read.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["media_id", "at", "digest"], [pa.binary(), pa.int32(), pa.binary()]
        for batch in by_bytes(batches, "text"):
            rows, seen = [], {}
            for t in utf8(batch.column("text")):
                key = media_id(t or b"")
                if key not in seen:
                    seen[key] = [(key, i, digest(c)) for i, c in enumerate(chunks(to_wav(payload_of(t or b""))))]
                    rows += seen[key]
                else:
                    rows.append(seen[key][0])  # says that the text occurs again
            yield _rows(names, types, rows)

    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    texts.mapInArrow(cut, "media_id binary, at int, digest binary").write.parquet(f"{folder}/places")
    places = spark.read.parquet(f"{folder}/places")
    owner = places.groupBy("digest").agg(
        F.min(F.struct("media_id", "at")).alias("o"), F.max(F.struct("media_id", "at")).alias("last")
    )
    shared = owner.filter("o <> last").select("digest", F.col("o.media_id").alias("owner"), F.col("o.at").alias("owner_at"))
    roles = places.join(shared, "digest").filter("media_id <> owner or at <> owner_at").select("media_id", "at", "owner")
    roles = roles.distinct().unionByName(
        shared.select(F.col("owner").alias("media_id"), F.col("owner_at").alias("at"), F.lit(None).cast("binary").alias("owner"))
    )
    roles.groupBy("media_id").agg(F.collect_list(F.struct("at", "owner")).alias("roles")).write.parquet(f"{folder}/roles")
    roles = spark.read.parquet(f"{folder}/roles")
    again = places.filter("at = 0").groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    special = roles.select("media_id").unionByName(again.select("media_id")).distinct()
    special = special.select(F.conv(F.hex(F.substring("media_id", 1, 7)), 16, 10).cast("long").alias("h")).select(F.xxhash64("h"))
    held = BitFilter(special, special.count())

    def joins(keys: list[bytes]) -> np.ndarray:
        return held.has(np.array([_spark_hash(int.from_bytes(k[:7], "big")) for k in keys], np.uint64))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            texts_ = [t or b"" for t in utf8(batch.column("text"))]
            alone = [t for t, yes in zip(texts_, joins([media_id(t) for t in texts_])) if not yes]
            yield _bundles(alone, [{}] * len(alone))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in by_bytes(batches, "text"):
            found = {media_id(t): t for t in (t or b"" for t in utf8(batch.column("text")))}
            yield _rows(["media_id", "text"], [pa.binary(), pa.binary()], [
                (k, press.compress(t)) for (k, t), yes in zip(found.items(), joins(list(found))) if yes
            ])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in by_bytes(batches, "text", 1 << 19):
            yield _bundles(
                [open_.decompress(z) for z in batch.column("text").to_pylist()],
                [{x["at"]: x["owner"] for x in r or ()} for r in batch.column("roles").to_pylist()],
            )

    media = texts.mapInArrow(pack, "media_id binary, text binary").dropDuplicates(["media_id"])
    bundles = media.join(roles, "media_id", "left").mapInArrow(split, BUNDLE)
    bundles = bundles.unionByName(texts.mapInArrow(direct, BUNDLE))
    bundles.write.option("compression", "zstd").parquet(f"{folder}/bundles")


def rebuild(spark: SparkSession, folder: str, compute, columns: str) -> DataFrame:
    """``compute(media, payload)`` of every stored medium: chunk list, chunks from wherever they lie, check, decode.

    ``columns`` is the schema of what ``compute`` returns. A medium whose chunks or whole do not match their
    digests raises an error.
    """
    bundles = spark.read.parquet(f"{folder}/bundles")
    names = [c.split()[0] for c in columns.split(", ")]

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in columns.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    lent = {x["digest"]: x["data"] for x in r.get("lent") or ()}
                    parts = [o if o is not None else lent[d] for o, d in zip(r["own"], r["digests"])]
                    media = b"".join(parts)
                    if [digest(p) for p in parts] != r["digests"] or hashlib.sha256(media).digest() != r["media_sha256"]:
                        raise ValueError(f"chunks do not rebuild {r['media_id'].hex()}")
                    rows.append((r["media_id"], *compute(media, from_wav(media))))
                yield _rows(["media_id", *names], [pa.binary(), *kinds], rows)

    schema = f"media_id binary, {columns}"
    lends = F.exists("owners", lambda o: o.isNotNull())
    whole = bundles.filter(~lends).select("media_id", "media_sha256", "digests", "own").mapInArrow(join_up, schema)
    rest = bundles.filter(lends)
    wanted = rest.select("media_id", F.explode(F.arrays_zip("digests", "owners")).alias("c")).filter("c.owners is not null")
    wanted = wanted.select("media_id", F.col("c.digests").alias("digest")).distinct()
    # each digest has one holder, so this join adds no rows
    held = bundles.select(F.explode(F.arrays_zip("digests", "own", "lends")).alias("c")).filter("c.lends")
    held = held.select(F.col("c.digests").alias("digest"), F.col("c.own").alias("data"))
    lent = wanted.join(held, "digest").groupBy("media_id").agg(F.collect_list(F.struct("digest", "data")).alias("lent"))
    mended = rest.join(lent, "media_id").select("media_id", "media_sha256", "digests", "own", "lent").mapInArrow(join_up, schema)
    return whole.unionByName(mended)


HASHES = ("payload_sha256", "media_sha256")


def describe(media: bytes, payload: bytes) -> tuple:
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media),
        hashlib.sha256(media).hexdigest(), feature(payload),
    )


DESCRIBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text, reads it back and describes it; one row per row of ``docs``.

    Null texts are empty ones, which are stored as one unit of spaces; null or repeated ids keep their rows;
    other columns are not read. ``folder`` (new, on storage all executors share) gets the chunk store.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    store(docs, folder, text_col)
    described = rebuild(spark, folder, describe, DESCRIBED)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.left(F.sha2(text, 256), F.lit(32))).alias("media_id")
    )
    described = described.withColumns({c: F.unhex(c) for c in HASHES})
    rows = rows.join(described, "media_id").drop("media_id")
    return rows.withColumns({c: F.lower(F.hex(c)) for c in HASHES})
