"""Activity, location and barriers of a report, from structured values first and the narrative next."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.patterns import guard_text, may_match
from wardline.functions.text import any_of, collapse, strip
from wardline.operators.filters import DEFICIENT_STATES
from wardline.operators.patterns import EFFECTIVE_STATES
from wardline.plans.scale import once
from wardline.rules import extraction as fixed
from wardline.rules.extraction import ActivityRules, BarrierRule

SEP, PAIR = "\u0001", "\u0002"
ARTICLES = r"(?i)^(?:the|a|an|routine)\s+"


def _exact(table: Mapping[str, str], key: Column) -> Column:
    text = SEP.join(f"{k}{PAIR}{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit(SEP), F.lit(PAIR)), key)


def _entries(table: Mapping[str, str]) -> Column:
    """The table as one literal array of structs with fields 0 (key) and 1 (value)."""
    return F.arrays_zip(F.split(F.lit(SEP.join(table)), SEP), F.split(F.lit(SEP.join(table.values())), SEP))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _inside(table: Mapping[str, str], phrase: Column) -> Column:
    """Value of the first table key held by the phrase."""
    return _bound(phrase, lambda p: F.get(F.filter(_entries(table), lambda e: F.contains(p, e["0"])), F.lit(0))["1"])


def _words(text: Column) -> Column:
    return F.size(F.split(text, " "))


def extract_activity(
    df: DataFrame, raw: str | None, narrative: str, rules: ActivityRules = ActivityRules()
) -> DataFrame:
    """Adds ``activity``, ``activity_category`` and ``activity_method``.

    A structured value counts unless it is really a rule, barrier, hazard or bare equipment name; then
    come the temporal phrases, the keyword families and the grammar phrases of the narrative.
    """
    given = F.lit("") if raw is None else collapse(F.coalesce(F.col(raw), F.lit("")))
    df = once(df, _raw=given, _text=F.lower(collapse(F.coalesce(F.col(narrative), F.lit("")))))
    df = once(df, _key=F.when(F.lower("_raw").isin(*fixed.NO_VALUE), "").otherwise(F.lower("_raw")))
    key, text = F.col("_key"), F.col("_text")
    blocked = key.isin(*rules.blocked)
    usable = (key != "") & ~blocked
    none = F.lit(None).cast("struct<category:string,method:string>")

    def found(category: Column, method: str) -> Column:
        return _bound(category, lambda c: F.when(c.isNotNull(), F.struct(c.alias("category"), F.lit(method).alias("method"))).otherwise(none))

    def phrase(pattern: str) -> Column:
        return F.regexp_replace(F.trim(F.regexp_extract(text, f"(?U){pattern}", 1)), ARTICLES, "")

    steps = [
        F.when(usable, found(_exact(rules.aliases, key), "exact_alias")),
        F.when(usable, found(
            F.get(F.filter(_entries(rules.aliases), lambda e: F.contains(key, e["0"]) | F.contains(e["0"], key)), F.lit(0))["1"],
            "substring_alias")),
    ]
    for pattern in rules.temporal:
        said = phrase(pattern)
        steps.append(F.when(said != "", found(_exact(rules.aliases, said), "temporal_narrative_alias")))
        steps.append(F.when(said != "", found(_inside(rules.aliases, said), "temporal_narrative_subphrase")))
    for category, pattern in rules.families:
        guard = may_match(text, [pattern])
        hit = text.rlike(f"(?U){pattern}")
        hit = hit if guard is None else guard & hit
        steps.append(F.when(hit, found(F.lit(category), f"narrative_keyword_{category.lower()}")))
    stop = r"(?U)\b(?:" + "|".join(rules.stop_words) + r")\b"
    for pattern in rules.active:
        said = phrase(pattern)
        fine = (said != "") & ~said.rlike(stop)
        steps.append(F.when(fine, found(_exact(rules.aliases, said), "active_pattern_alias")))
        steps.append(F.when(fine, found(_inside(rules.aliases, said), "active_pattern_substring")))
    steps.append(F.when(blocked, found(_exact(rules.remap, key), "operational_remapping")))
    steps.append(F.when(usable & (_words(key) <= 4), found(F.lit("OTHER_KNOWN_ACTIVITY"), "structured_identity")))
    df = once(df, _hit=F.coalesce(*steps, found(F.lit("UNKNOWN_ACTIVITY"), "unknown_indeterminate")))
    label = F.coalesce(_exact(rules.labels, F.col("_hit.category")), F.col("_hit.category"))
    shown = (F.col("_hit.method") == "exact_alias") & F.col("_key").isin(*rules.shown)
    name = F.when(F.col("_hit.method") == "structured_identity", F.initcap("_raw")).when(shown, F.col("_raw")).otherwise(label)
    return df.withColumns({
        "activity": name, "activity_category": F.col("_hit.category"), "activity_method": F.col("_hit.method"),
    }).drop("_raw", "_text", "_key", "_hit")


def extract_location(
    df: DataFrame,
    location: str | None,
    narrative: str,
    department: str | None = None,
    metadata: Sequence[str] = (),
    aliases: Mapping[str, str] = fixed.LOCATION_ALIASES,
    site_names: Sequence[str] = (),
) -> DataFrame:
    """Adds ``place``, ``place_field`` and ``place_method``.

    Structured location (a bare site name does not count), metadata columns, names in the narrative,
    a capitalised phrase after a preposition that is no body part, the department, else unknown.
    """
    empty = F.lit("")
    value = lambda c: empty if c is None else collapse(F.coalesce(F.col(c), empty))
    df = once(
        df, _loc=value(location), _text=F.coalesce(F.col(narrative), empty),
        _dep=F.lower(value(department)), **{f"_m{i}": value(c) for i, c in enumerate(metadata)},
    )
    low = F.lower("_loc")
    given = (low != "") & ~low.isin(*[s.lower() for s in site_names]) if site_names else low != ""

    def hit(place: Column, source: str, method: str) -> Column:
        return _bound(place, lambda p: F.when(p.isNotNull(), F.struct(
            p.alias("place"), F.lit(source).alias("field"), F.lit(method).alias("method"))))

    steps = [
        F.when(given, hit(F.coalesce(_exact(aliases, low), _inside(aliases, low)), "location", "exact_alias")),
        F.when(given, hit(F.initcap("_loc"), "location", "structured_identity")),
    ]
    for i, column in enumerate(metadata):
        m = F.col(f"_m{i}")
        steps.append(F.when(m != "", hit(_exact(aliases, F.lower(m)), f"metadata.{column}", "exact_alias")))
        steps.append(F.when(m != "", hit(F.initcap(m), f"metadata.{column}", "metadata_identity")))
    # the first name in table order that stands as whole words in the narrative
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower("_text"), r"(?U)[^\w]+", " "), F.lit(" "))
    framed = {" " + a + " ": c for a, c in aliases.items()}
    steps.append(hit(_inside(framed, text), "narrative", "narrative_extraction"))
    # the costly phrase is looked for once, and only where nothing was found so far
    df = once(df, _found=F.coalesce(*steps))
    phrase = F.regexp_replace(F.trim(F.regexp_extract("_text", fixed.PLACE_AFTER_PREPOSITION, 1)), r"(?i)^(?:the|a|an)\s+", "")
    df = once(df, _phrase=F.when(F.col("_found").isNull(), phrase))
    phrase, steps = F.col("_phrase"), [F.col("_found")]
    body = r"(?iU)(?:^|\s)(?:" + "|".join(fixed.ANATOMY) + r")(?:\s|$)"
    steps.append(F.when(phrase != "", hit(_exact(aliases, F.lower(phrase)), "narrative", "narrative_extraction")))
    steps.append(F.when(
        (phrase != "") & ~phrase.rlike(body) & (F.regexp_count(phrase, F.lit(r"\S+")) <= 4),
        hit(F.initcap(phrase), "narrative", "narrative_extraction"),
    ))
    for word, part, place in fixed.DEPARTMENT_PLACES:
        matches = F.col("_dep").contains(word) if part else F.col("_dep") == word
        steps.append(F.when(matches, hit(F.lit(place), "department", "inferred")))
    df = once(df, _hit=F.coalesce(*steps, hit(F.lit("UNKNOWN LOCATION"), "none", "unknown")))
    return df.withColumns({
        "place": F.col("_hit.place"), "place_field": F.col("_hit.field"), "place_method": F.col("_hit.method"),
    }).drop("_loc", "_text", "_dep", "_found", "_phrase", "_hit", *[f"_m{i}" for i in range(len(metadata))])


def _first_of(text: Column, low: Column, patterns: Sequence[str]) -> Column:
    """(at, words) of the first pattern in list order that occurs, null when none does."""
    steps = []
    for p in patterns:
        guard = may_match(low, [p])
        hit = text.rlike(any_of([p]))
        hit = hit if guard is None else guard & hit
        steps.append(F.when(hit, F.struct(
            F.regexp_instr(text, F.lit(any_of([p]))).alias("at"), F.regexp_extract(text, any_of([p]), 0).alias("words"))))
    return F.coalesce(*steps)


def _window(text: Column, span: Column, around: int) -> Column:
    start = F.greatest(F.lit(1), span["at"] - around)
    stop = F.least(F.length(text), span["at"] + F.length(span["words"]) - 1 + around)
    cut = strip(F.substring(text, start, stop - start + 1))
    return F.concat(
        F.when(start > 1, "...").otherwise(""), cut, F.when(stop < F.length(text), "...").otherwise("")
    )


def _state_of(words: Column) -> Column:
    low = F.lower(words)
    state = None
    for name, cues in fixed.DEFICIENT_WORDS:
        hit = F.lit(False)
        for cue in cues:
            hit = hit | low.contains(cue)
        state = F.when(hit, name) if state is None else state.when(hit, name)
    return state.otherwise("FAILED")


def extract_barriers(
    df: DataFrame,
    id_col: str,
    texts: Sequence[str],
    condition: str | None = None,
    control_type: str | None = None,
    failed: str | None = None,
    rules: Sequence[BarrierRule] = fixed.BARRIER_RULES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, category, barrier, role, state, is_effective, is_deficient, evidence, words) per barrier.

    A barrier counts when a trigger occurs and it is neither only stored nor only recommended. Its state
    follows the deficient or the effective wording, the one nearer to the trigger when both occur, then
    the structured condition, then the default. Reports without any barrier fall back on the structured
    control.
    """
    text = F.trim(F.concat_ws(" ", *[strip(F.coalesce(F.col(c), F.lit(""))) for c in texts]))
    cond = F.lit("") if condition is None else F.lower(strip(F.coalesce(F.col(condition), F.lit(""))))
    kind = F.lit("") if control_type is None else strip(F.coalesce(F.col(control_type), F.lit("")))
    broken = F.lit(False) if failed is None else F.coalesce(F.col(failed), F.lit(False))
    df = once(df, _text=text, _cond=cond, _kind=kind, _broken=broken)
    df = once(df, _guard=guard_text(F.col("_text")))
    body, low = F.col("_text"), F.col("_guard")
    found = {}
    for i, r in enumerate(rules):
        trigger = _first_of(body, low, r.triggers)
        found[f"_t{i}"] = trigger
    df = once(df, **found)
    states = {}
    for i, r in enumerate(rules):
        seen = F.col(f"_t{i}").isNotNull()
        states[f"_d{i}"] = F.when(seen, _first_of(body, low, r.deficient))
        states[f"_e{i}"] = F.when(seen, _first_of(body, low, r.effective))
        states[f"_w{i}"] = F.when(seen, _window(body, F.col(f"_t{i}"), 140))
    df = once(df, **states)
    by_condition = None
    for name, words in fixed.CONDITION_STATES:
        hit = F.col("_cond").isin(*words)
        by_condition = F.when(hit, name) if by_condition is None else by_condition.when(hit, name)
    known = by_condition.when(F.col("_cond").isin(*fixed.UNKNOWN_CONDITIONS), "UNKNOWN")
    rows = []
    for i, r in enumerate(rules):
        t, d, e, w = (F.col(f"_{x}{i}") for x in "tdew")
        stored = w.rlike("(?iU)" + fixed.STORAGE_ONLY) & d.isNull() & e.isNull()
        advised = w.rlike("(?iU)" + fixed.RECOMMENDATION_ONLY) & ~w.rlike(any_of(r.effective))
        gone = F.lower(d["words"]).contains("removed") | F.lower(d["words"]).contains("missing")
        near_bad = F.abs(t["at"] - d["at"]) <= F.abs(t["at"] - e["at"])
        both = d.isNotNull() & e.isNotNull()
        state = (
            F.when(both, F.when(near_bad, F.when(gone, "ABSENT").otherwise("FAILED")).otherwise("EFFECTIVE"))
            .when(d.isNotNull(), _state_of(d["words"]))
            .when(e.isNotNull(), "EFFECTIVE")
            .otherwise(F.coalesce(known, F.lit(r.default_state)))
        )
        chosen = F.when(both, F.when(near_bad, d).otherwise(e)).otherwise(F.coalesce(d, e))
        evidence = F.when(chosen.isNotNull(), _window(body, chosen, 120)).otherwise(w)
        rows.append(F.when(t.isNotNull() & ~stored & ~advised, F.struct(
            F.lit(r.category).alias("category"), F.lit(r.label).alias("barrier"), F.lit(r.role).alias("role"),
            state.alias("state"), evidence.alias("evidence"), t["words"].alias("words"),
        )))
    fallback_state = F.when(F.col("_broken"), "FAILED").otherwise(by_condition)
    fallback = F.when(
        ~F.lower("_kind").isin("", "none", "unknown", "n/a", "na") & fallback_state.isNotNull(),
        F.array(F.struct(
            F.col("_kind").alias("category"), F.col("_kind").alias("barrier"), F.lit("PREVENTIVE").alias("role"),
            fallback_state.alias("state"), F.col("_text").alias("evidence"), F.col("_kind").alias("words"),
        )),
    )
    df = once(df, _rows=F.array_compact(F.array(*rows)), _fallback=fallback)
    out = df.select(id_col, *keep, F.inline(F.when(F.size("_rows") > 0, F.col("_rows")).otherwise(F.col("_fallback"))))
    return out.withColumns({
        "is_effective": F.col("state").isin(*EFFECTIVE_STATES), "is_deficient": F.col("state").isin(*DEFICIENT_STATES),
    })
