"""Rule tags with contexts, against a brute-force reading of each occurrence."""

import random
import re

from wardline.operators import tagging as g
from wardline.rules import tagging as fixed


def run(spark, text, field="description", rules=None):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return {x["rule"]: x for x in g.tag_rules(df, "id", {field: "t"}, rules or fixed.LIFE_SAVING_KEYWORDS).collect()}


def test_direct_mentions(spark):
    got = run(spark, "Worker entered the confined space. A permit to enter was issued.")
    tag = got["Confined Space"]
    assert tag["keywords"] == ["confined space", "permit to enter"] and tag["match_type"] == "direct_event" and tag["strength"] == 1.0


def test_negated_mentions_do_not_count(spark):
    assert run(spark, "There was no welding on site.") == {}
    assert run(spark, "The lifting operation was not performed.") == {}
    assert run(spark, "Done without entering confined space.") == {}
    assert run(spark, "Crew used cold cutting only.") == {}


def test_without_a_control_is_a_breach(spark):
    assert "Working at Height" in run(spark, "He worked without harness on the roof edge.")
    assert "Hot Work" not in run(spark, "Repair done without hot work.")


def test_incidental_and_corrective(spark):
    assert run(spark, "Walked past the parked crane.")["Safe Mechanical Lifting"]["match_type"] == "incidental"
    tag = run(spark, "The toolbox talk was revised after the incident.")["Work Authorization"]
    assert (tag["match_type"], tag["strength"]) == ("corrective_action", 0.5)
    assert run(spark, "Install harness.", "corrective_actions")["Working at Height"]["match_type"] == "corrective_action"
    both = run(spark, "The parked crane stood there. Later the crane hoisted a pipe.")["Safe Mechanical Lifting"]
    assert both["match_type"] == "direct_event"


def test_negation_stops_at_the_clause(spark):
    assert "Hot Work" in run(spark, "No one was hurt. Welding went on.")


def test_words_are_whole(spark):
    assert run(spark, "The roadmap and the crossroads") == {}


def brute(text, rules):
    """Every occurrence with up to 60 characters of its clause on both sides."""
    out = {}
    for rule, keywords in rules.items():
        for kw in keywords:
            for m in re.finditer(rf"\b(?:{kw})\b", text, re.I):
                before = re.split(r"[.?!;\n]", text[max(0, m.start() - 60):m.start()])[-1]
                after = re.split(r"[.?!;\n]", text[m.end():m.end() + 60])[0]
                if re.search(r"\b(?:no|not|never)\b(?:\s+\w+){0,3}\s*$", before, re.I):
                    continue
                if re.search(r"\bwithout\s+(?:any\s+)?$", before, re.I) and kw not in fixed.CONTROL_TERMS:
                    continue
                kind = 1 if re.search(r"\b(?:parked|stored)\b", before, re.I) else 3
                assert len(before) <= 60 and len(after) <= 60
                words, best = out.get(rule, (set(), 0))
                out[rule] = (words | {m.group(0).lower()}, max(best, kind))
    return {r: (sorted(w), b) for r, (w, b) in out.items()}


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(11)
    words = "no not crane parked stored without harness welding the a b. c; long-clause-filler-text lifting fall\n never Crane".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(150)]
    rules = {"L": ("crane", r"lift[a-z]*"), "H": ("harness", "fall"), "W": ("welding",)}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rank = {"direct_event": 3, "incidental": 1}
    got = {}
    for x in g.tag_rules(df, "id", {"description": "t"}, rules).collect():
        got.setdefault(x["id"], {})[x["rule"]] = (x["keywords"], rank[x["match_type"]])
    for i, t in enumerate(texts):
        assert got.get(i, {}) == brute(t, rules), t


def test_best_class_prefers_the_first_on_a_tie(spark):
    df = spark.createDataFrame([(1, "crane and valve"), (2, "nothing")], "id int, t string")
    got = {x["id"]: (x["class"], x["score"]) for x in g.best_class(df, "id", "t").collect()}
    assert got == {1: ("Energy Isolation", 1), 2: ("Unclassified", 0)}


def test_precursors_concepts_temporal_and_failures(spark):
    text = "Hot work without gas testing. The guard will be fitted. Welding sparks flew"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    tags = {x["class"]: x["keywords"] for x in g.keyword_tags(df, "id", "t").collect()}
    assert tags["Hot Work"] == ["hot work", "welding", "weld", "spark"] and tags["Missing Gas Testing"] == ["gas testing", "gas test"]
    assert [x["cue"] for x in g.find_concepts(df, "id", "t").collect()] == ["hot work"]
    assert [(x["role"], x["contemporaneous"]) for x in g.find_temporal(df, "id", "t").collect()] == [("PLANNED", False)]
    assert g.failure_phrases(df, "id", "t").first()["phrases"] == ["Gas testing not performed", "Hot work without gas testing"]
    none = g.failure_phrases(spark.createDataFrame([(1, "fine")], "id int, t string"), "id", "t").first()["phrases"]
    assert none == ["None detected"]


def test_contexts_come_from_one_search_and_marks_in_a_text_do_no_harm(spark):
    told = ["No crane was used", "The crane was parked nearby", "a\u0001b no crane\u0002", "a\u0001 the crane\u0002 swung"]
    df = spark.createDataFrame(list(enumerate(told)), "id int, t string")
    out = g.tag_rules(df, "id", {"description": "t"}, {"Lifting": ("crane",)})
    assert sorted((r.id, r.match_type) for r in out.collect()) == [(1, "incidental"), (3, "direct_event")]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert f"{g.MARKS[0]}$1{g.MARKS[1]}$2{g.MARKS[1]}$3{g.MARKS[0]}" in plan
