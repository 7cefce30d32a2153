"""Near-duplicate lines by a join of deletion neighbourhoods. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.plans.scale import shared_folder

FILTER_BITS = 1 << 22
MIN_CHARS = 20  # shorter lines (blank ones, brackets, bullets) are never removed


def _key(*parts: Column) -> list[Column]:
    """96-bit name of a text; equal names are still verified by their edit distance."""
    return [F.xxhash64(*parts).alias("k"), F.hash(*parts).alias("k2")]


def _spans(line: Column) -> Column:
    """Where the only edit may lie: the line of length L as the equal of one of L letters, or of one of L - 1."""
    n = F.char_length(line)
    return F.transform(F.array(n, n - 1), lambda m: F.struct(m.alias("n"), F.lit(0).alias("lo"), m.alias("hi")))


def _pieces(spans: Column, parts: int, least: int) -> Column:
    """Every span cut into ``parts`` pieces, or fewer so that a piece has ``least`` letters."""
    def cut(c: Column) -> Column:
        wide = c["hi"] - c["lo"]
        p = F.least(F.lit(parts), F.greatest(F.lit(1), F.floor(wide / least).cast("int")))
        edge = lambda i: c["lo"] + F.floor(wide * i / p).cast("int")
        return F.transform(F.sequence(F.lit(0), p - 1), lambda i: F.struct(c["n"].alias("n"), edge(i).alias("lo"), edge(i + 1).alias("hi")))

    return F.flatten(F.transform(spans, cut))


def _around(line: Column, c: Column) -> Column:
    """Name of all that lies around a piece: what stays equal when the edit is inside."""
    return F.xxhash64(c["n"], c["lo"], c["hi"], F.left(line, c["lo"]), F.right(line, c["n"] - c["hi"]))


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` with the filter of surroundings of ``spans`` that two different lines have."""
    keys = rows.select(F.xxhash64("line").alias("k"), F.explode(F.transform("spans", lambda c: _around(F.col("line"), c))).alias("key"))
    shared = keys.groupBy("key").agg(F.min("k").alias("a"), F.max("k").alias("b")).filter("a <> b").select("key")
    return rows.withColumn("_words", bit_filter(shared))


def _narrow(rows: DataFrame, parts: int, least: int, path: str) -> DataFrame:
    """``spans`` cut into pieces, of which only those stay whose surroundings another line has; and lines that keep one."""
    rows = rows.withColumn("spans", _pieces(F.col("spans"), parts, least))
    held = F.filter("spans", lambda c: may_hold(F.col("_words"), _around(F.col("line"), c)))
    # written before it is used again: the plan would repeat the filter wherever ``spans`` is read
    _shared(rows).select("line", "first", held.alias("spans")).write.parquet(path)
    return rows.sparkSession.read.parquet(path).filter(F.size("spans") > 0)


def _spots(key: Column) -> list[Column]:
    return [F.pmod(key, F.lit(FILTER_BITS)), F.pmod(F.shiftright(key, 32), F.lit(FILTER_BITS))]


def bit_filter(keys: DataFrame) -> Column:
    """The longs of a bit filter over a column of 64-bit names; ``FILTER_BITS`` bits for any input."""
    bit = keys.select(F.explode(F.array(*_spots(F.col(keys.columns[0])))).alias("bit"))
    words = bit.select(F.floor(F.col("bit") / 64).alias("cell"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("w"))
    none = keys.sparkSession.range(FILTER_BITS // 64).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("w"))
    words = words.unionByName(none).groupBy("cell").agg(F.bit_or("w").alias("w"))
    ordered = F.array_sort(F.collect_list(F.struct("cell", "w")))
    return words.agg(F.transform(ordered, lambda c: c["w"]).alias("words")).scalar()


def may_hold(words: Column, key: Column) -> Column:
    return F.forall(F.array(*_spots(key)), lambda spot: F.getbit(F.get(words, F.floor(spot / 64).cast("int")), (spot % 64).cast("int")) == 1)


def near_lines(rows: DataFrame, folder: str) -> DataFrame:
    """For the lines of ``rows`` (line, id, at): the first place of another line within one edit, as (k, k2, near).

    One edit leaves all but one piece of a line as it is, so a line only needs variants in pieces around which it
    equals another line. Pieces are narrowed from halves to a few letters by bit filters of shared surroundings, where
    the lines are read; long lines so need no more variants than short ones. Variants are a piece without its i-th
    letter. Lines of one length that agree without their i-th letter are one substitution apart; a variant that
    equals a whole piece is one insertion apart. Groups are reduced to their earliest line before any join, so no group
    is expanded into pairs, and every pair found is verified by its edit distance.
    """
    line = F.col("line")
    halves = _shared(rows.withColumn("spans", _pieces(_spans(line), 2, 1)))
    some = halves.filter(F.exists("spans", lambda c: may_hold(F.col("_words"), _around(line, c))))
    some.groupBy("line").agg(F.min(F.struct("id", "at")).alias("first")).write.parquet(f"{folder}/lines")
    some = rows.sparkSession.read.parquet(f"{folder}/lines").withColumn("spans", _spans(line))
    for step, least in enumerate((4, 8, 8)):
        some = _narrow(some, 16, least, f"{folder}/pieces-{step}")

    piece = some.select(*_key(line), "first", F.char_length("line").alias("size"), "line", F.explode("spans").alias("c"))
    piece = piece.select(
        "k", "k2", "first", (F.col("size") > F.col("c.n")).alias("longer"), _around(line, F.col("c")).alias("around"),
        F.substr(line, F.col("c.lo") + 1, F.col("size") - F.col("c.n") + F.col("c.hi") - F.col("c.lo")).alias("mid"),
    )
    cut = F.transform(F.sequence(F.lit(1), F.char_length("mid")), lambda i: F.struct(
        i.alias("i"), F.concat(F.left(F.col("mid"), i - 1), F.substr(F.col("mid"), i + 1)).alias("v"),
    ))
    cuts = piece.filter(F.char_length("mid") > 0).select("k", "k2", "first", "longer", "around", F.explode(cut).alias("x"))
    own = [F.col("k"), F.col("k2"), F.col("first")]
    named = lambda *parts: [F.xxhash64(*parts).alias("v"), F.hash(*parts).alias("v2")]
    # one length: the same variant at the same letter
    places = cuts.filter(~F.col("longer")).select(*own, *named(F.col("around"), F.col("x.i"), F.col("x.v")))
    # one letter more: a variant that equals a whole piece
    sizes = cuts.filter("longer").select(*own, "longer", *named(F.col("around"), F.col("x.v"))).unionByName(
        piece.filter(~F.col("longer")).select(*own, "longer", *named(F.col("around"), F.col("mid")))
    )

    def earliest(frame: DataFrame, by: list[str]) -> DataFrame:
        return frame.groupBy(*by).agg(F.min(F.struct("first", "k", "k2")).alias("near"), F.count(F.lit(1)).alias("n"))

    same = earliest(places, ["v", "v2"]).filter("n > 1").drop("n")
    found = places.join(same, ["v", "v2"]).select("k", "k2", "near")
    tips = earliest(sizes, ["v", "v2", "longer"]).drop("n").withColumn("longer", ~F.col("longer"))
    found = found.unionByName(sizes.join(tips, ["v", "v2", "longer"]).select("k", "k2", "near"))
    found = found.filter((F.col("near.k") != F.col("k")) | (F.col("near.k2") != F.col("k2"))).distinct()
    texts = some.select(*_key(line), "line")
    other = texts.select(F.col("k").alias("o"), F.col("k2").alias("o2"), F.col("line").alias("other"))
    found = found.join(texts, ["k", "k2"]).join(other, (F.col("near.k") == F.col("o")) & (F.col("near.k2") == F.col("o2")))
    return found.filter(F.levenshtein("line", "other", 1) == 1).groupBy("k", "k2").agg(F.min("near.first").alias("near"))


def drop_near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1,
                    min_chars: int = MIN_CHARS, folder: str | None = None) -> DataFrame:
    """Removes every line that comes after an equal line, or after one at an edit distance of ``edits`` (0 or 1).

    Lines are judged on the input: "after" means a larger id, or the same document and a later line. Lines
    shorter than ``min_chars`` letters stay. All columns of ``docs`` are kept, the text holds the lines that
    stay, and ``n_lines`` and ``n_removed`` are added. A null text stays null with 0 lines; an empty text has
    one empty line; a null id comes before all others; rows that share an id share its places. ``folder`` (new,
    shared) takes the lines that come close to another.
    """
    if edits not in (0, 1):
        raise ValueError("edits is 0 or 1")
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = docs.select(key.alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    rows = rows.filter(F.char_length("line") >= min_chars)
    named = rows.select("id", "row", "at", *_key(F.col("line")))
    lines = named.groupBy("k", "k2").agg(F.min(F.struct("id", "at")).alias("first"), F.max(F.struct("id", "at")).alias("last"))
    if edits:
        near = near_lines(rows.select("line", "id", "at"), folder or f"{shared_folder(docs.sparkSession)}/lines-{uuid.uuid4().hex}")
        lines = lines.join(near, ["k", "k2"], "left")
    else:
        lines = lines.withColumn("near", F.lit(None).cast(lines.schema["first"].dataType))
    cuts = lines.filter((F.col("first") < F.col("last")) | (F.col("near") < F.col("first")))
    cuts = cuts.select("k", "k2", F.least("first", F.coalesce("near", "first")).alias("cut"))
    marked = named.join(cuts, ["k", "k2"]).filter(F.struct("id", "at") > F.col("cut"))
    gone = marked.groupBy("id", "row").agg(F.collect_set("at").alias("gone"))  # at most the lines of one document

    taken = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*[F.col(f"`{c}`") for c in taken], F.xxhash64(text).alias("_row")).join(
        gone.select(F.col("id").alias("_id"), F.col("row").alias("_row2"), F.col("gone").alias("_gone")),
        key.eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_row2")), "left",
    )
    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in taken],
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )
