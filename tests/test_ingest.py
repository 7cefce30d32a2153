"""Mapping, gate, readers and writers on small fixtures."""

import uuid

from pyspark.sql import functions as F

from wardline.operators import mapping as m
from wardline.operators import quality as q
from wardline.plans.pipeline import ingest
from wardline.sources import readers as r
from wardline.sources import writers as w


def test_keys_map_exactly_then_by_the_longest_alias_once_per_source(spark):
    rows = [("s", 1, {"Incident-Date": "2024-01-01", "What Happened": "x", "Narrative": "y", "Dept": "d", "zzz9": "?"})]
    df = spark.createDataFrame(rows, "source string, row int, vals map<string,string>")
    got = {x["canonical"]: x["key"] for x in m.key_mapping(df, "source", "vals").collect()}
    assert got["incident_date"] == "Incident-Date" and got["department"] == "Dept"
    # two keys ask for the narrative; only one of them gets it
    assert len({"What Happened", "Narrative"} & set(got.values())) == 1 and "zzz9" not in got.values()
    wide = m.pivot_fields(m.harmonise_keys(df, "source", "row", "vals"), "source", "row").first()
    assert wide["department"] == "d" and wide["location"] is None


def test_uuid5_equals_the_standard_one(spark):
    names = ["d1:ext:42", "d1:row:7", "süß:ext:é"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [x[0] for x in df.select(m.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_derived_flags(spark):
    rows = [("failed", None, "near_miss", None, None), ("effective", True, "incident", None, "lost_time"),
            ("unknown", None, "incident", None, "none"), (None, True, None, False, None)]
    df = spark.createDataFrame(rows, "control_condition string, control_failed_bypassed boolean, report_type string, near_miss boolean, severity_actual string")
    got = [(x[1], x[3]) for x in m.derive_flags(df).collect()]
    assert got == [(True, True), (False, False), (None, None), (True, False)]


def test_scoring_never_sees_outcomes(spark):
    df = spark.createDataFrame([("a", "fatality", True)], "description string, severity_actual string, human_label boolean")
    assert m.prediction_record(df).columns == ["description"]


NARRATIVES = {
    None: "MISSING_NARRATIVE", "  ": "MISSING_NARRATIVE", "bad � text": "UNSUPPORTED_ENCODING", "?!": "MEANINGLESS_NARRATIVE",
    "N/A": "PLACEHOLDER_NARRATIVE", "Incident 12": "PLACEHOLDER_NARRATIVE", "test, none. 5": "PLACEHOLDER_NARRATIVE",
    "aaaa AAA": "CORRUPTED_NARRATIVE", "bcdfg hjk": "CORRUPTED_NARRATIVE", "see asdfghjkl now": "MEANINGLESS_NARRATIVE",
    "slipped": "INSUFFICIENT_NARRATIVE", "worker slipped on deck": "SHORT_NARRATIVE",
    "The worker slipped on the wet deck near the main pump today": None,
}


def test_narrative_cascade(spark):
    df = spark.createDataFrame([(k,) for k in NARRATIVES], "t string")
    assert [x["narrative_check"] for x in q.check_narrative(df, "t").collect()] == list(NARRATIVES.values())


def gate(spark, **fields):
    base = {"t": "The worker slipped on the wet deck near the main pump today", "a": "walking", "l": "deck", "part": None,
            "inj": None, "sev": None, "miss": None, "day": "2024-01-05", "rep": None}
    base.update(fields)
    schema = "t string, a string, l string, part string, inj string, sev string, miss boolean, day string, rep string"
    df = spark.createDataFrame([tuple(base.values())], schema).withColumns({"day": F.to_date("day"), "rep": F.to_date("rep")})
    cols = q.ReportColumns("t", None, "a", "l", "part", "inj", "sev", "miss", "day", "rep")
    row = q.quality_gate(df, cols, F.to_date(F.lit("2024-06-01"))).first()
    return row["quality_status"], [f["check_id"] for f in row["findings"]], row["quality_score"]


def test_gate_verdicts(spark):
    assert gate(spark) == ("VALID", [], 1.0)
    assert gate(spark, a="")[1] == ["OPTIONAL_ACTIVITY_MISSING"]
    assert gate(spark, l="Unknown") == ("WARNING", ["INVALID_LOCATION"], 0.75)
    assert gate(spark, t="", a="")[1] == ["MISSING_NARRATIVE", "MISSING_ACTIVITY"]
    assert gate(spark, inj="eye strain", part="left leg")[1] == ["INJURY_BODY_PART_CONFLICT"]
    text = "Worker had a knee injury and a fracture after the fall from the deck today"
    assert gate(spark, t=text, part="hand", inj="burn")[1] == ["INJURY_BODY_PART_CONFLICT", "INJURY_TYPE_CONFLICT"]
    assert gate(spark, t=text, sev="none", miss=True)[1] == ["NEAR_MISS_INJURY_CONFLICT"]
    assert gate(spark, miss=True, sev="lost_time")[:2] == ("CRITICAL", ["NEAR_MISS_SEVERITY_CONFLICT"])
    assert gate(spark, day="2025-01-01")[1] == ["FUTURE_DATE"]
    assert gate(spark, day="1960-01-01")[1] == ["IMPOSSIBLE_DATE"]
    assert gate(spark, rep="2024-01-01")[1] == ["CONTRADICTORY_DATE"]
    assert gate(spark, day=None)[1] == ["MISSING_DATE"]


def test_fingerprint_ignores_case_and_punctuation(spark):
    df = spark.createDataFrame([(1, "A valve, failed!"), (2, "a VALVE failed"), (3, "other"), (4, "")], "i int, t string")
    groups = q.duplicate_groups(df, "t", "i").collect()
    assert [(g["copies"], g["first_id"]) for g in groups] == [(2, 1)]


def test_csv_keeps_short_rows_and_drops_long_ones(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(b'\xef\xbb\xbfcol1,col2\n1,2\n3\n4,5,6\n"a, b",7\n\n')
    rows = r.read_reports(spark, str(path), "csv", ["col1", "col2"])
    assert sorted(tuple(x) for x in r.good_rows(rows).collect()) == [("1", "2"), ("3", None), ("a, b", "7")]
    assert tuple(r.bad_count(rows).first()) == (4, 1, 0)
    assert [names for names, _ in r.csv_headers(spark, str(path))] == [("col1", "col2")]


def test_csv_latin_1(spark, tmp_path):
    path = tmp_path / "l1.csv"
    path.write_bytes("name\nsüß\n".encode("latin-1"))
    assert r.good_rows(r.read_csv(spark, str(path), encoding="ISO-8859-1")).first()[0] == "süß"


def test_json_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"}, 5, {"a": null, "c": true}]')
    rows = r.read_reports(spark, str(tmp_path / "a.json"), "json")
    assert sorted(map(tuple, r.good_rows(rows).select("a", "b", "c").collect()), key=str) == [("1", "x", None), (None, None, "true")]
    assert r.bad_count(rows).first()["bad"] == 1
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{broken\n\n[1]\n{"a": 2}\n')
    lines = r.read_reports(spark, str(tmp_path / "a.jsonl"), "jsonl", ["a"])
    assert sorted(x[0] for x in r.good_rows(lines).collect()) == ["1", "2"]
    assert r.bad_count(lines).first()["bad"] == 2


def test_append_upsert_backfill(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "C2")], "k int, v string")
    assert [x["k"] for x in w.append_new(old, new, ["k"]).collect()] == [3]
    merged = sorted(map(tuple, w.upsert(old, new.filter("v <> 'C2'"), ["k"]).collect()))
    assert merged == [(1, "a"), (2, "B"), (3, "C")]
    assert [x["k"] for x in w.backfill(new, old, ["k"]).select("k").distinct().collect()] == [3]


def test_ingest_end_to_end(spark):
    rows = [("1", "Crane dropped the load while the crew worked below the suspended load today", "Crane lift", "2024-01-02", "LTI"),
            ("2", "test", "", "2024-01-02", None)]
    df = spark.createDataFrame(rows, "id string, story string, task string, day string, sev string")
    mapping = {"external_id": "id", "description": "story", "job_task": "task", "incident_date": "day", "severity_actual": "sev"}
    out = ingest(df, F.lit("ds"), mapping, as_of=F.to_date(F.lit("2024-06-01")))
    assert [x["severity_actual"] for x in out.accepted.collect()] == ["lost_time"]
    assert out.rejected.first()["blocking_checks"] == ["PLACEHOLDER_NARRATIVE"]
    tags = {x["rule"]: x["keywords"] for x in out.tags.collect()}
    assert tags["Safe Mechanical Lifting"] == ["crane", "dropped", "lift", "suspended load"]


def test_csv_files_of_other_column_order_and_quoted_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Narrative,Task\n2024-01-05,"one\ntwo, ""three""",weld\n\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("\ufeffTask,Date\ncut,2024-01-06\n", encoding="utf-8")
    rows = r.good_rows(r.read_csv(spark, f"{tmp_path}/*.csv"))
    got = sorted((x.Date, x.Narrative, x.Task) for x in rows.collect())
    assert got == [("2024-01-05", 'one\ntwo, "three"', "weld"), ("2024-01-06", None, "cut")]
