"""The default rule tables over the documents, each with a sentence put before its text; the SQL holds its own values."""

from pyspark.sql import functions as F

from wardline.operators import extraction as x
from wardline.operators import reasoning
from wardline.operators import tagging as g
from wardline.queries.registry import query


def told(t, cases, **columns):
    """Documents with the sentence of case ``doc_id % len(cases)`` before the text, and other columns of that case."""
    pick = lambda i: F.get(F.array(*[F.lit(c[i]).cast("string") for c in cases]), (F.col("doc_id") % len(cases)).cast("int"))
    told = F.concat(pick(0), F.lit(" "), F.coalesce("text", F.lit(""))).alias("narrative")
    return t.documents.select("doc_id", told, *[pick(i).alias(name) for name, i in columns.items()])


# sentence, structured value
ACTIVITIES = (
    ("", "Scaffold  Dismantling"),
    ("", "Hot Work in Classified Area"),
    ("", "night crew crane lifting job"),
    ("After completing welding, workers began loading cargo in the yard.", "Gas Detector"),
    ("Before starting the pump, operators were pressure testing, as planned.", None),
    ("The breaker repair went on.", "n/a"),
    ("He slipped while performing ndt inspection near the door.", "H2S"),
    ("It broke during the annual chemical transfer, unseen.", ""),
    ("Nothing more is known.", "Energy Isolation"),
    ("Nothing more is known.", "barge mooring"),
    ("Nothing more is known.", "a job that has no name at all"),
)


@query(
    "e10_default_activity",
    """select doc_id, a as activity, c as activity_category, m as activity_method from documents join (values
      (0, 'Work at Height / Scaffolding', 'ELEVATED_WORK_SCAFFOLDING', 'exact_alias'),
      (1, 'Hot Work in Classified Area', 'WELDING_HOT_WORK', 'exact_alias'),
      (2, 'Lifting Operation / Crane Work', 'LIFTING_OPERATION', 'substring_alias'),
      (3, 'Material Handling & Staging', 'MATERIAL_HANDLING', 'temporal_narrative_subphrase'),
      (4, 'Sampling & Hydrotesting', 'SAMPLING_TESTING', 'temporal_narrative_alias'),
      (5, 'Electrical Maintenance & Troubleshooting', 'ELECTRICAL_MAINTENANCE', 'narrative_keyword_electrical_maintenance'),
      (6, 'Inspection & Quality Auditing', 'INSPECTION_AUDITING', 'active_pattern_alias'),
      (7, 'Chemical Handling & Transfer', 'CHEMICAL_HANDLING', 'active_pattern_substring'),
      (8, 'Equipment Maintenance & Servicing', 'EQUIPMENT_MAINTENANCE', 'operational_remapping'),
      (9, 'Barge Mooring', 'OTHER_KNOWN_ACTIVITY', 'structured_identity'),
      (10, 'UNKNOWN ACTIVITY', 'UNKNOWN_ACTIVITY', 'unknown_indeterminate')) v(i, a, c, m) on doc_id % 11 = i""",
)
def _(t):
    out = x.extract_activity(told(t, ACTIVITIES, raw=1), "raw", "narrative")
    return out.select("doc_id", "activity", "activity_category", "activity_method")


# sentence, location, department
PLACES = (
    ("", "Derrick", None),
    ("", "north of the flare stack", None),
    ("", "jetty 4", None),
    ("Leak beside the christmas tree.", "North Complex", None),
    ("He stood in Cargo Hold Two, alone.", None, None),
    ("Hit in Left Hand.", None, "Drilling"),
)


@query(
    "e11_default_location",
    """select doc_id, p as place, f as place_field, m as place_method from documents join (values
      (0, 'Drilling Area / Rig Floor', 'location', 'exact_alias'), (1, 'Flare Area', 'location', 'exact_alias'),
      (2, 'Jetty 4', 'location', 'structured_identity'), (3, 'Wellhead Area', 'narrative', 'narrative_extraction'),
      (4, 'Cargo Hold Two', 'narrative', 'narrative_extraction'), (5, 'Drilling Area / Rig Floor', 'department', 'inferred')) v(i, p, f, m)
      on doc_id % 6 = i""",
)
def _(t):
    out = x.extract_location(told(t, PLACES, location=1, department=2), "location", "narrative", "department", site_names=["North Complex"])
    return out.select("doc_id", "place", "place_field", "place_method")


# sentences on life-saving rules: direct, negated, without a control, incidental, corrective, negated
MENTIONS = (
    ("The crane lifted it.",), ("No hot work was performed.",), ("Entry was made without ptw.",), ("It was parked near a vehicle.",),
    ("The toolbox talk was reviewed after the incident.",), ("Cold cutting only.",),
)


@query(
    "e8_default_contexts",
    """select doc_id, r as rule, k as keywords, m as match_type, s::double as strength from documents join (values
      (0, 'Safe Mechanical Lifting', 'crane,lifted', 'direct_event', 1.0), (2, 'Work Authorization', 'ptw', 'direct_event', 1.0),
      (3, 'Driving', 'vehicle', 'incidental', 0.3), (4, 'Work Authorization', 'toolbox', 'corrective_action', 0.5)) v(i, r, k, m, s)
      on doc_id % 6 = i
    union all select doc_id, 'Energy Isolation', 'bleed', 'direct_event', 1.0 from documents
      where regexp_matches(lower(text), '(?:^|[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}])bleed(?:[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]|$)')""",  # a keyword that the invented texts hold
)
def _(t):
    out = g.tag_rules(told(t, MENTIONS), "doc_id", {"description": "narrative"})
    return out.select("doc_id", "rule", F.array_join("keywords", ",").alias("keywords"), "match_type", "strength")


# hazard, state
HAZARDS = (
    ("pressure_stored", "INSUFFICIENT_INFORMATION"), ("pressure_stored", "PSIF_PATHWAY_OPEN"), ("low_energy_general", "LOW_ENERGY"),
    ("line_of_fire", "HIGH_ENERGY_CONTROLLED"), (None, "LOW_ENERGY"), ("rotating_equipment", "HIGH_ENERGY_CONTROLLED"),
)


@query(
    "f7_applicable_rules",
    """select doc_id, a as applicable, s as for_state from documents join (values
      (0, 'PSIF-R-03,PSIF-R-08,PSIF-R-09,PSIF-R-11,PSIF-R-16', 'PSIF-R-11'), (1, 'PSIF-R-03,PSIF-R-08,PSIF-R-09,PSIF-R-11,PSIF-R-16', 'PSIF-R-03,PSIF-R-16'),
      (2, 'PSIF-R-10', 'PSIF-R-10'), (3, 'PSIF-R-02,PSIF-R-07', ''), (4, '', ''), (5, 'PSIF-R-08,PSIF-R-09,PSIF-R-12', 'PSIF-R-08,PSIF-R-09')) v(i, a, s)
      on doc_id % 6 = i""",
)
def _(t):
    pick = lambda i: F.get(F.array(*[F.lit(c[i]).cast("string") for c in HAZARDS]), (F.col("doc_id") % len(HAZARDS)).cast("int"))
    df = t.documents.select("doc_id", pick(0).alias("hazard"), pick(1).alias("state"))
    both = reasoning.applicable_rules(df, "hazard").withColumnRenamed("applicable_rules", "all_rules")
    both = reasoning.applicable_rules(both, "hazard", state="state")
    return both.select("doc_id", F.array_join("all_rules", ",").alias("applicable"), F.array_join("applicable_rules", ",").alias("for_state"))
