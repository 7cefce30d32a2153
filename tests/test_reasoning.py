"""Decisions on short safety narratives, one per case, and minimal pairs."""

import pytest

from wardline.operators import reasoning as r

COLS = r.ReasoningColumns("t", "energy", "task", "injury", None, "kind", "cond", "failed")
SCHEMA = "t string, energy string, task string, injury string, kind string, cond string, failed boolean"


def assess(spark, text, energy=None, task=None, injury=None, kind=None, cond=None, failed=None):
    df = spark.createDataFrame([(text, energy, task, injury, kind, cond, failed)], SCHEMA)
    return r.assess(df, COLS).first()


CASES = [
    ("The electrician opened the energized switchgear while the lockout was not applied and was exposed to the live busbar",
     "PSIF_PATHWAY_OPEN", "PSIF", "PSIF-R-04"),
    ("During the crane lift the rigger remained outside the exclusion zone and the load path was clear all day",
     "HIGH_ENERGY_CONTROLLED", "NOT_PSIF", "PSIF-R-08"),
    ("The clerk noticed a loose paper tray on the desk and told the office manager about it today",
     "LOW_ENERGY", "NOT_PSIF", "PSIF-R-10"),
    ("Crane used", "INSUFFICIENT_INFORMATION", "INSUFFICIENT_INFORMATION", None),
    ("Isolation was verified before the job but residual pressure escaped when the flange was opened and sprayed the fitter",
     "CONFLICTING_EVIDENCE", "INSUFFICIENT_INFORMATION", None),
    ("The scaffolder found the missing guard and work was halted by the crew in good time before climbing again",
     "HIGH_ENERGY_CONTROLLED", "NOT_PSIF", "PSIF-R-09"),
]


@pytest.mark.parametrize("text,state,decision,rule", CASES)
def test_cases(spark, text, state, decision, rule):
    row = assess(spark, text)
    assert (row["internal_state"], row["decision"], row["matched_rule"]) == (state, decision, rule)


def test_minimal_pair_bypassed_or_verified(spark):
    base = "The fitter unbolted the pressurized line and stood in the line of fire, the isolation {} for the whole task"
    assert assess(spark, base.format("was bypassed"))["decision"] == "PSIF"
    assert assess(spark, base.format("held throughout the shift and zero energy verified"))["decision"] == "NOT_PSIF"


def test_structured_values_come_first(spark):
    row = assess(spark, "Something happened at the work place and nobody wrote down any details of it", energy="gravity", cond="bypassed", injury="fracture")
    assert (row["hazard"], row["control_state"], row["exposure_state"]) == ("gravity", "BYPASSED", "DIRECT_EXPOSURE")
    assert row["decision"] == "PSIF" and row["hazard_source"] == "energy_type"


def test_all_hazards_are_kept_in_order(spark):
    row = assess(spark, "A dropped object hit the pump below the scaffold and the crew walked away from the area")
    assert row["hazard"] == "dropped_objects"
    assert row["all_hazards"] == ["dropped_objects", "working_at_height", "rotating_equipment"]


def test_protective_equipment_is_no_barrier(spark):
    row = assess(spark, "The operator wore a hard hat next to the rotating equipment during the night shift today")
    assert (row["control_state"], row["control_tier"], row["is_direct_control"]) == ("ABSENT", "PPE", False)


def test_evidence_strength(spark):
    strong = assess(spark, CASES[0][0], energy="electrical", kind="lockout")
    assert strong["evidence_strength"] == "STRONG" and strong["facts"] == 6
    assert assess(spark, "Crane used")["evidence_strength"] == "WEAK"


def test_reconciliation(spark):
    rows = [("PSIF", True, None), ("PSIF", False, None), ("NOT_PSIF", True, None), ("INSUFFICIENT_INFORMATION", True, None),
            ("PSIF", None, None), ("PSIF", True, "CRITICAL")]
    df = spark.createDataFrame(rows, "decision string, predicted boolean, q string")
    got = [(x["agreement_state"], x["disagreement_type"], x["final_decision"]) for x in r.reconcile(df, quality="q").collect()]
    assert got == [
        ("MODEL_AND_RULE_AGREE", None, "PSIF"), ("RULE_EVIDENCE_STRONGER_THAN_MODEL", "POTENTIAL_FALSE_NEGATIVE", "PSIF"),
        ("MODEL_STRONGER_THAN_RULE_EVIDENCE", "POTENTIAL_FALSE_POSITIVE", "NOT_PSIF"),
        ("INSUFFICIENT_EVIDENCE", None, "INSUFFICIENT_INFORMATION"), ("MODEL_AND_RULE_AGREE", None, "PSIF"),
        ("DATA_QUALITY_BLOCKED", None, "INSUFFICIENT_INFORMATION"),
    ]


def test_evidence_chain_links_and_breaks(spark):
    from pyspark.sql import functions as F

    from wardline.operators import evidence as ev

    rows = [("The rigger stood underneath the suspended load and the sling failed while the crane moved it",),
            ("The crane held the suspended load, the area was evacuated and the trip activated as it should",), ("Crane",)]
    df = r.prepare(spark.createDataFrame(rows, "t string"), r.ReasoningColumns("t"))
    none = F.lit(None).cast("string")
    out = ev.evidence_chain(df, ev.CHAIN, none, none, none, none, F.lit(False), none, F.lit(True)).collect()
    states = [[x[f"{link}_link"] for link in ev.LINKS] for x in out]
    assert states[0] == ["SUPPORTED"] * 5 and out[0]["breaks"] == ["none_supported_psif"]
    assert states[1][1:3] == ["MISSING", "MISSING"] and out[1]["breaks"] == ["exposure_missing", "control_intact"]
    assert out[2]["is_sparse"] and "sparse_narrative" in out[2]["breaks"]


def test_every_taxonomy_resolves_its_own_names(spark):
    from wardline.operators import entities as e

    for name, tax in e.TAXONOMIES.items():
        df = spark.createDataFrame([(c,) for c in tax.canonical if c != "Unknown"], "raw string")
        got = e.resolve_entity(df, "raw", tax).collect()
        assert all(x["raw_entity"]["canonical"] == x["raw"] for x in got), name
