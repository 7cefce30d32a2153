"""Canonical report fields, column aliases, code dictionaries and enumerations."""

CANONICAL_FIELDS = (
    "external_id", "incident_date", "department", "location", "job_task", "equipment_involved",
    "injury_type", "body_part", "immediate_cause", "root_cause_category", "severity_actual",
    "severity_potential", "near_miss", "description", "corrective_actions", "witness_statement",
)
LONG_TEXT_FIELDS = ("description", "corrective_actions", "witness_statement")

FIELD_ALIASES = {
    "description": (
        "incident description", "incident detail", "incident narrative", "description", "narrative", "details",
        "summary", "what happened", "event description", "report details", "report_text", "report text",
        "report_narrative",
    ),
    "incident_date": (
        "incident date", "date of incident", "date of occurrence", "occurrence date", "event date", "accident date",
        "date occurred", "reported date", "report date", "incident_date", "occurrence",
    ),
    "department": ("department name", "department", "dept name", "dept", "division", "business unit", "section"),
    "location": (
        "incident location", "work location", "work area", "location", "site name", "site", "facility", "area", "place",
    ),
    "job_task": (
        "job task", "work task", "activity performed", "task description", "job/task", "work activity", "task", "job",
        "activity",
    ),
    "equipment_involved": (
        "equipment involved", "equipment name", "machinery", "equipment", "machine", "vehicle", "tool", "asset",
    ),
    "injury_type": (
        "nature of injury", "injury classification", "injury category", "type of injury", "injury type", "harm type",
        "injury",
    ),
    "body_part": (
        "body part injured", "affected body part", "injured body part", "part of body", "body part", "body area", "body",
    ),
    "immediate_cause": (
        "immediate cause of incident", "proximate cause", "direct cause", "primary cause", "immediate cause",
    ),
    "root_cause_category": (
        "root cause category", "causal factor", "contributing factor", "underlying cause", "root cause type",
        "root cause", "cause category",
    ),
    "severity_actual": (
        "actual injury severity", "outcome severity", "recorded severity", "actual outcome", "actual severity",
        "severity actual", "severity of injury", "severity", "actual",
    ),
    "severity_potential": (
        "maximum potential severity", "potential consequence", "worst case severity", "potential outcome",
        "potential severity", "severity potential", "potential",
    ),
    "near_miss": (
        "near miss event", "near-miss", "close call", "near hit", "near miss", "nearmiss", "near_miss",
    ),
    "corrective_actions": (
        "corrective measures", "preventive actions", "action taken", "actions taken", "corrective action",
        "corrective actions", "remediation", "controls",
    ),
    "witness_statement": ("witness account", "witness testimony", "witness statement", "witnesses", "witness"),
    "external_id": (
        "incident number", "incident ref", "report number", "case number", "record id", "case id", "report id",
        "incident id", "reference", "incident_id", "ref", "id",
    ),
}

SEVERITY_ACTUAL = {
    "none": "none", "no injury": "none", "no-injury": "none", "no injury / near miss": "none", "near miss": "none",
    "near-miss": "none", "property damage only": "none", "0": "none",
    "first aid": "first_aid", "first-aid": "first_aid", "firstaid": "first_aid", "fa": "first_aid",
    "1 - first aid": "first_aid", "1": "first_aid",
    "medical treatment": "medical_treatment", "medical treatment injury": "medical_treatment",
    "medical": "medical_treatment", "mti": "medical_treatment", "recordable": "medical_treatment",
    "2 - medical treatment": "medical_treatment", "2": "medical_treatment",
    "lost time": "lost_time", "lost time injury": "lost_time", "lost-time": "lost_time", "lti": "lost_time",
    "restricted duty": "lost_time", "restricted work": "lost_time", "3 - restricted work": "lost_time",
    "3": "lost_time", "4 - lost time": "lost_time", "4": "lost_time",
    "fatality": "fatality", "fatal": "fatality", "death": "fatality", "5 - fatality": "fatality", "5": "fatality",
}
SEVERITY_POTENTIAL = {
    "low": "low", "minor": "low", "negligible": "low", "1": "low",
    "moderate": "moderate", "medium": "moderate", "significant": "moderate", "2": "moderate",
    "serious": "serious", "high": "serious", "major": "serious", "severe": "serious", "critical": "serious",
    "3": "serious",
    "fatality": "fatality", "fatal": "fatality", "catastrophic": "fatality", "life threatening": "fatality",
    "life-threatening": "fatality", "4": "fatality",
}

# Inputs a score may use; outcome severities, labels and review fields are left out on purpose.
SCORING_FIELDS = (
    "description", "corrective_actions", "witness_statement", "department", "location", "job_task",
    "equipment_involved", "injury_type", "body_part", "immediate_cause", "root_cause_category", "near_miss",
    "report_type", "high_energy_present", "energy_type", "worker_exposed", "direct_control_present", "control_type",
    "control_condition", "control_failed_bypassed",
)

# Label source by dataset provenance; anything else has no label source.
LABEL_SOURCES = {"REAL_EXTERNAL": "real_external", "REAL_HUMAN": "real_human", "SYNTHETIC": "synthetic"}

UUID_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
