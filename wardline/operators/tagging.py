"""Tagging narratives by keyword tables, row by row and without shuffles.

A literal piece of each keyword pattern is looked for first, so regular expressions run only for
the few keywords a text can hold.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import strip
from wardline.plans.scale import once
from wardline.rules import tagging as fixed

SEP = "\u0001"
MARKS = ("\u0001", "\u0002")  # around an occurrence and between its parts
INNER = r"[^.?!;\n]"


def literal_start(pattern: str) -> str:
    """Leading literal of a keyword pattern: no text without it can match."""
    head = re.match(r"[A-Za-z0-9 \-]*", pattern).group(0)
    rest = pattern[len(head):]
    if rest[:1] in ("?", "*", "{"):
        head = head[:-1]
    return "" if "|" in re.sub(r"\([^)]*\)", "", pattern) else head.lower()


def _zip(*columns: Sequence[str]) -> Column:
    """Literal array of structs with fields 0, 1, …; one string literal per column."""
    return F.arrays_zip(*[F.split(F.lit(SEP.join(c)), SEP) for c in columns])


def _context(before: Column, word: Column, after: Column, key: Column, control: Column, field: str) -> Column:
    """negated / corrective_action / incidental / direct_event for one occurrence."""
    has = lambda text, pattern: text.rlike("(?iU)" + pattern)
    negated = (
        has(after, fixed.NEGATION_AFTER)
        | has(before, fixed.NEGATION_BEFORE)
        | has(before, fixed.WITHOUT_ACTIVITY_BEFORE)
        | (has(before, fixed.WITHOUT_BEFORE) & (control == "0"))
        | ((key == fixed.COLD_KEYWORD) & has(before, fixed.COLD_BEFORE))
    )
    around = F.concat_ws(" ", before, word, after)
    corrective = F.lit(True) if field in fixed.CORRECTIVE_FIELDS else has(around, fixed.CORRECTIVE_AROUND)
    incidental = has(before, fixed.INCIDENTAL_BEFORE) | has(after, fixed.INCIDENTAL_AFTER)
    return (
        F.when(negated, "negated").when(corrective, "corrective_action").when(incidental, "incidental")
        .otherwise("direct_event")
    )


def _occurrences(text: Column, low: Column, in_context: Column, table: Column, field: str) -> Column:
    """array<struct<rule,word,field,kind>> of every keyword occurrence in one text.

    ``in_context`` tells whether the text holds a context word at all; where it does not, every
    mention is direct and only the keywords themselves are extracted.
    """
    candidates = F.filter(table, lambda k: F.contains(low, k["2"]))
    plain_kind = "corrective_action" if field in fixed.CORRECTIVE_FIELDS else "direct_event"

    def row(k: Column, word: Column, kind: Column) -> Column:
        return F.struct(
            k["0"].alias("rule"), F.lower(word).alias("word"), F.lit(field).alias("field"), kind.alias("kind")
        )

    def plain(k: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iU)\b(?:"), k["1"], F.lit(r")\b"))
        return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda w: row(k, w, F.lit(plain_kind)))

    def contextual(k: Column) -> Column:
        # the look-ahead keeps the costly look-behind away from places without the keyword
        word = F.concat(F.lit(r"\b(?:"), k["1"], F.lit(r")\b"))
        pattern = F.concat(
            F.lit("(?iU)(?="), word, F.lit(rf")(?<=((?:^|[.?!;\n]){INNER}{{0,59}}|{INNER}{{60}}))("), word,
            F.lit(rf")(?=({INNER}{{0,60}}))"),
        )
        # one pass marks each occurrence with its context; a text that holds such marks itself is searched once a part
        marked = F.regexp_replace(text, pattern, F.lit(f"{MARKS[0]}$1{MARKS[1]}$2{MARKS[1]}$3{MARKS[0]}"))
        cut = F.filter(F.split(marked, MARKS[0]), lambda _, i: i % 2 == 1)
        single = F.transform(cut, lambda x: F.split(x, MARKS[1]))
        apart = F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2, 3)])
        apart = F.transform(apart, lambda p: F.array(p["0"], p["1"], p["2"]))
        parts = F.when(text.rlike(f"[{''.join(MARKS)}]"), apart).otherwise(single)
        return F.transform(parts, lambda p: row(k, p[1], _context(
            F.regexp_replace(p[0], r"^[.?!;\n]", ""), p[1], p[2], k["1"], k["3"], field
        )))

    return F.flatten(
        F.when(in_context, F.transform(candidates, contextual)).otherwise(F.transform(candidates, plain))
    )


def tag_rules(
    df: DataFrame,
    id_col: str,
    fields: Mapping[str, str],
    rules: Mapping[str, Sequence[str]] = fixed.LIFE_SAVING_KEYWORDS,
    contexts: bool = True,
) -> DataFrame:
    """(id, rule, keywords, fields, match_type, strength) for each rule a report touches.

    Without ``contexts`` every mention counts as direct.

    ``fields`` maps field names to columns. Negated occurrences do not count; the best context of
    the rest sets type and strength. Keywords and fields are sorted.
    """
    rows = [(rule, kw, literal_start(kw), str(int(kw.lower() in fixed.CONTROL_TERMS)))
            for rule, keywords in rules.items() for kw in keywords]
    table = _zip(*[[r[i] for r in rows] for i in range(4)])
    texts = once(df, **{f"_t{i}": F.coalesce(F.col(c), F.lit("")) for i, c in enumerate(fields.values())})
    prepared = {f"_l{i}": F.lower(F.col(f"_t{i}")) for i in range(len(fields))}
    for i in range(len(fields)):
        worded = F.col(f"_t{i}").rlike("(?iU)" + fixed.CONTEXT_WORDS)
        prepared[f"_c{i}"] = worded if contexts else F.lit(False)
    lowered = once(texts, **prepared)
    parts = [
        _occurrences(F.col(f"_t{i}"), F.col(f"_l{i}"), F.col(f"_c{i}"), table, field) for i, field in enumerate(fields)
    ]
    found = once(
        lowered.select(id_col, *[f"_{x}{i}" for i in range(len(fields)) for x in "tlc"]),
        _found=F.filter(F.concat(*parts), lambda o: o["kind"] != "negated"),
    ).select(id_col, "_found")
    names = F.array_sort(F.array_distinct(F.transform("_found", lambda o: o["rule"])))

    def summary(rule: Column) -> Column:
        mine = F.filter("_found", lambda o: o["rule"] == rule)
        pick = lambda name: F.array_sort(F.array_distinct(F.transform(mine, lambda o: o[name])))
        kinds = F.transform(mine, lambda o: o["kind"])
        kind = F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(k)) for k in fixed.STRENGTHS])
        return F.struct(
            rule.alias("rule"), pick("word").alias("keywords"), pick("field").alias("fields"), kind.alias("match_type")
        )

    tags = found.select(id_col, F.inline(F.transform(names, summary)))
    strength = F.coalesce(*[F.when(F.col("match_type") == k, F.lit(v)) for k, v in fixed.STRENGTHS.items()])
    return tags.withColumn("strength", strength)


def dedupe_tags(tags: DataFrame, keys: Sequence[str] = ("incident_id", "rule", "version")) -> DataFrame:
    """One row per (incident, rule, version)."""
    return tags.dropDuplicates(list(keys))


def _hits(low: Column, table: Column, word: str) -> Column:
    return F.filter(table, lambda k: F.contains(low, k[word]))


def keyword_tags(
    df: DataFrame, id_col: str, text: str, table: Mapping[str, tuple[str, Sequence[str]]] = fixed.PRECURSORS
) -> DataFrame:
    """(id, class, severity, keywords) for every class with a keyword in the text; keywords in table order."""
    rows = [(name, severity, kw) for name, (severity, words) in table.items() for kw in words]
    literal = _zip(*[[r[i] for r in rows] for i in range(3)])
    found = once(once(df.select(id_col, text), _low=F.lower(F.col(text))), _hit=_hits(F.col("_low"), literal, "2"))
    classes = F.array_distinct(F.transform("_hit", lambda h: F.struct(h["0"].alias("class"), h["1"].alias("severity"))))

    def row(c: Column) -> Column:
        words = F.transform(F.filter("_hit", lambda h: h["0"] == c["class"]), lambda h: h["2"])
        return F.struct(c["class"].alias("class"), c["severity"].alias("severity"), words.alias("keywords"))

    return found.select(id_col, F.inline(F.transform(classes, row)))


def best_class(
    df: DataFrame,
    id_col: str,
    text: str,
    table: Mapping[str, Sequence[str]] = fixed.BEST_RULE_KEYWORDS,
    none: str = "Unclassified",
) -> DataFrame:
    """(id, class, score): most keywords found, the earlier class on a tie, ``none`` for no keyword."""
    counts = [
        F.struct(
            sum((F.contains(F.col("_low"), F.lit(w)).cast("long") for w in words), F.lit(0).cast("long")).alias("n"),
            F.lit(-i).alias("order"), F.lit(name).alias("class"),
        )
        for i, (name, words) in enumerate(table.items())
    ]
    found = once(once(df.select(id_col, text), _low=F.lower(F.col(text))), _best=F.greatest(*counts))
    return found.select(
        id_col, F.when(F.col("_best.n") > 0, F.col("_best.class")).otherwise(none).alias("class"),
        F.coalesce("_best.n", F.lit(0).cast("long")).alias("score"),
    )


def find_concepts(
    df: DataFrame, id_col: str, text: str, cues: Sequence[tuple[str, str, Sequence[str]]] = fixed.CONCEPT_CUES
) -> DataFrame:
    """(id, concept, cue_class, cue): the first cue found of each concept and class."""
    low = F.col("_low")
    rows = [
        F.struct(
            F.lit(concept).alias("concept"), F.lit(kind).alias("cue_class"),
            F.coalesce(*[F.when(low.contains(cue), F.lit(cue)) for cue in words]).alias("cue"),
        )
        for concept, kind, words in cues
    ]
    found = once(df.select(id_col, text), _low=F.lower(F.col(text)))
    return found.select(id_col, F.inline(F.array(*rows))).filter(F.col("cue").isNotNull())


def find_temporal(
    df: DataFrame, id_col: str, text: str, families: Sequence[tuple] = fixed.TEMPORAL_CUES
) -> DataFrame:
    """(id, cue, phase, role, contemporaneous) for every temporal cue in the text."""
    rows = [(cue, phase, role, str(now).lower()) for phase, role, now, words in families for cue in words]
    literal = _zip(*[[r[i] for r in rows] for i in range(4)])
    found = once(df.select(id_col, text), _low=F.lower(F.col(text)))
    hits = found.select(id_col, F.explode(_hits(F.col("_low"), literal, "0")).alias("h"))
    return hits.select(
        id_col, F.col("h.0").alias("cue"), F.col("h.1").alias("phase"), F.col("h.2").alias("role"),
        (F.col("h.3") == "true").alias("contemporaneous"),
    )


def failure_phrases(
    df: DataFrame,
    id_col: str,
    text: str,
    patterns: Sequence[tuple[str, str]] = fixed.FAILURE_PHRASES,
    cues: Sequence[str] = fixed.FAILURE_CUES,
    width: int | None = None,
) -> DataFrame:
    """(id, phrases): labels of matching patterns, then sentences with a failure cue (``width`` letters at most), no repeats."""
    raw = F.coalesce(F.col(text), F.lit(""))
    base = once(df.select(id_col, text), _low=F.lower(raw), _sentences=F.split(raw, r"[.\n]"))
    labels = F.array_compact(F.array(*[F.when(F.col("_low").rlike(p), F.lit(label)) for p, label in patterns]))

    def wanted(s: Column) -> Column:
        low = F.lower(s)
        hit = F.lit(False)
        for cue in cues:
            hit = hit | low.contains(cue)
        return hit if width is None else hit & (F.length(s) <= width)

    trimmed = F.transform("_sentences", strip)
    either = F.concat(labels, F.filter(trimmed, wanted))
    listed = once(base, _all=either).select(id_col, "_all")
    lowered = once(listed, _lower=F.transform("_all", F.lower))
    first = F.filter("_all", lambda s, i: F.array_position("_lower", F.lower(s)) == i + 1)
    return lowered.select(
        id_col, F.when(F.size("_all") == 0, F.array(F.lit(fixed.NONE_DETECTED))).otherwise(first).alias("phrases")
    )
