"""Barriers, activities, places and entities from short safety sentences."""

from wardline.operators import entities as e
from wardline.operators import extraction as x
from wardline.rules.entities import TAXONOMIES, Taxonomy


def barriers(spark, text, cond=None, kind=None, failed=None):
    df = spark.createDataFrame([(1, text, cond, kind, failed)], "id int, t string, cond string, kind string, failed boolean")
    return {b["category"]: b["state"] for b in x.extract_barriers(df, "id", ["t"], "cond", "kind", "failed").collect()}


def test_several_barriers_with_their_states(spark):
    got = barriers(spark, "The machine guard had been removed but the worker hit the e-stop in time.")
    assert got == {"MACHINE_GUARD": "ABSENT", "EMERGENCY_STOP": "EFFECTIVE"}


def test_storage_and_recommendations_do_not_count(spark):
    assert barriers(spark, "The harness was stored in the truck all day.") == {}
    assert barriers(spark, "The report recommends to install a guardrail.") == {}


def test_the_wording_nearer_to_the_trigger_wins(spark):
    text = "The harness arrested the fall of the tool bag. " + "x " * 60 + "the second lanyard snapped"
    assert barriers(spark, text)["FALL_ARREST_SYSTEM"] == "EFFECTIVE"


def test_structured_condition_then_default(spark):
    assert barriers(spark, "A guardrail stood there.", "bypassed") == {"GUARDRAIL": "BYPASSED"}
    assert barriers(spark, "A guardrail stood there.") == {"GUARDRAIL": "ABSENT"}
    assert barriers(spark, "Nothing said.", "failed", "relief valve") == {"relief valve": "FAILED"}
    assert barriers(spark, "Nothing said.", None, "relief valve", True) == {"relief valve": "FAILED"}
    assert barriers(spark, "Nothing said.", None, "relief valve") == {}


def activity(spark, raw, text):
    row = x.extract_activity(spark.createDataFrame([(raw, text)], "raw string, t string"), "raw", "t").first()
    return row["activity"], row["activity_method"]


def test_activity_hierarchy(spark):
    assert activity(spark, "Welding", "x") == ("Welding, Cutting & Hot Work", "exact_alias")
    assert activity(spark, "deck painting job", "x") == ("Painting & Surface Coating", "substring_alias")
    assert activity(spark, "Hot Work", "After completing welding, workers began cleaning the deck") == (
        "Cleaning & Housekeeping", "temporal_narrative_subphrase")
    assert activity(spark, "", "He was near the trench excavation") == ("Digging / Excavation", "narrative_keyword_digging_excavation")
    assert activity(spark, "Driving", "nothing else") == ("Vehicle / Parking Operations", "operational_remapping")
    assert activity(spark, "barge mooring", "nothing else") == ("Barge Mooring", "structured_identity")
    assert activity(spark, None, "nothing else")[0] == "UNKNOWN ACTIVITY"


def place(spark, loc, text, dep=None):
    df = spark.createDataFrame([(loc, text, dep)], "loc string, t string, dep string")
    row = x.extract_location(df, "loc", "t", "dep", site_names=["North Complex"]).first()
    return row["place"], row["place_field"], row["place_method"]


def test_place_hierarchy(spark):
    assert place(spark, "old tank farm east", "x") == ("Tank Farm", "location", "exact_alias")
    assert place(spark, "jetty 4", "x") == ("Jetty 4", "location", "structured_identity")
    assert place(spark, "North Complex", "leak at the rig floor, fixed") == (
        "Drilling Area / Rig Floor", "narrative", "narrative_extraction")
    assert place(spark, None, "He stood in Cargo Bay, alone") == ("Cargo Bay", "narrative", "narrative_extraction")
    assert place(spark, None, "He was hit in Left Hand, badly", "Drilling") == (
        "Drilling Area / Rig Floor", "department", "inferred")
    assert place(spark, None, "nowhere") == ("UNKNOWN LOCATION", "none", "unknown")


def resolve(spark, raw, tax):
    row = e.resolve_entity(spark.createDataFrame([(raw,)], "raw string"), "raw", tax).first()["raw_entity"]
    return row["canonical"], row["status"], row["confidence"]


def test_entity_cascade(spark):
    tax = Taxonomy("site", ("North Platform", "South Platform", "Platform AAAAAAAA", "Platform AAAAAAAB"), {"np": "North Platform"}, unknown="UNKNOWN")
    assert resolve(spark, " north-platform ", tax) == ("North Platform", "CANONICAL", 1.0)
    assert resolve(spark, "NP", tax) == ("North Platform", "MAPPED", 1.0)
    assert resolve(spark, "N/A", tax) == ("UNKNOWN", "UNKNOWN", 0.0)
    assert resolve(spark, "north platfrom x", tax)[1] == "UNCERTAIN"
    assert resolve(spark, "north platforn", tax) == ("North Platform", "SUGGESTED", 0.93)
    assert resolve(spark, "platform aaaaaaac", tax)[:2] == ("platform aaaaaaac", "UNCERTAIN")
    assert resolve(spark, "Boom  Lift BL-40", TAXONOMIES["equipment"]) == ("Boom Lift / MEWP", "MAPPED", 0.98)
    assert resolve(spark, None, tax)[1] == "UNKNOWN"


def test_barriers_of_the_default_table(spark):
    texts = [
        ("LOTO not applied to the pump.", "LOCKOUT_TAGOUT"), ("The gas detector failed during entry.", "GAS_DETECTION"),
        ("His seat belt not worn at the time.", "SEAT_BELT"), ("The wheel chocks missing, the van rolled.", "WHEEL_CHOCK"),
        ("Pedestrian segregation was maintained.", "VEHICLE_PEDESTRIAN_SEGREGATION"), ("The safety net caught the tool.", "SAFETY_NET"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id int, text string")
    rows = {(r.id, r.category): r for r in x.extract_barriers(df, "id", ["text"]).collect()}
    for i, (_, category) in enumerate(texts):
        assert rows[i, category].is_effective == (i > 3) and rows[i, category].is_deficient == (i < 4)


def test_every_default_barrier_is_complete():
    from wardline.rules.barriers import BARRIER_RULES

    assert len({r.category for r in BARRIER_RULES}) == len(BARRIER_RULES) == 26
    assert all(r.triggers and r.effective and r.deficient and r.label and r.role for r in BARRIER_RULES)


def test_costly_phrases_are_made_once(spark):
    """Neither the narrative's words nor the phrase after a preposition is made again for each name or step that reads it."""
    df = spark.createDataFrame([("", "He stood in Cargo Hold Two, alone."), ("x", "At the old  WELLHEAD area")], "l string, t string")
    out = x.extract_location(df, "l", "t", aliases={"wellhead area": "Wellhead Area", "rig": "Rig"})
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("inside)\\s+") == 1 and plan.count(r"(?U)[^\w]+") == 1
    assert [tuple(r)[2:] for r in out.collect()] == [
        ("Cargo Hold Two", "narrative", "narrative_extraction"), ("X", "location", "structured_identity")]
