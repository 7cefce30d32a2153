"""Fixed values for tagging narratives: life-saving-rule keywords, contexts, cues and keyword classes."""

# Rule -> keyword patterns, each matched as whole words ignoring case.
LIFE_SAVING_KEYWORDS = {
    "Bypassing Safety Controls": (
        r"bypass(?:ing|ed)?", r"override", r"disabl[a-z]*", r"interlock", r"jumper[a-z]*", r"defeat[a-z]*",
        r"safety control", r"alarm silenc[a-z]*", r"guard removed", r"safety device removed",
    ),
    "Confined Space": (
        r"confined space", r"vessel entry", r"tank entry", r"manhole", r"permit to enter", r"atmospheric test",
        r"gas test[a-z]*", r"oxygen level", r"o2 level", r"ventilation", r"enclosed space", r"entry permit",
    ),
    "Driving": (
        r"vehicle", r"driving", r"drove", r"driver", r"seatbelt", r"seat belt", r"road", r"collision", r"speeding",
        r"mobile phone while driving", r"fatigue driving", r"rollover", r"skid",
    ),
    "Energy Isolation": (
        r"loto", r"lockout", r"tag out", r"tagout", r"isolat[a-z]*", r"de-energ[a-z]*", r"lock and tag",
        r"test for dead", r"zero energy", r"breaker", r"bleed", r"depressurize",
    ),
    "Hot Work": (
        r"hot work", r"welding", r"cutting", r"grinding", r"sparks", r"ignition source", r"burn[a-z]*", r"torch",
        r"hot permit", r"fire watch", r"combustible", r"flammable",
    ),
    "Line of Fire": (
        r"line of fire", r"struck by", r"falling object", r"dropped object", r"pinch point", r"crushed",
        r"caught between", r"tension", r"pressure release", r"swing radius", r"barricade", r"exclusion zone",
    ),
    "Safe Mechanical Lifting": (
        r"lift[a-z]*", r"crane", r"hoist", r"rigging", r"sling", r"suspended load", r"tag line", r"rigger", r"swl",
        r"safe working load", r"drop[a-z]*", r"overhead load",
    ),
    "Work Authorization": (
        r"permit to work", r"ptw", r"jsa", r"jha", r"job safety analysis", r"risk assessment", r"clearance",
        r"authorization", r"safety briefing", r"tool box talk", r"toolbox",
    ),
    "Working at Height": (
        r"height", r"fall", r"harness", r"lanyard", r"tie-off", r"scaffolding", r"scaffold", r"edge protection",
        r"lifeline", r"mewp", r"cherry picker", r"dropped from height",
    ),
}

# "without <control>" is a breach, not a negation.
CONTROL_TERMS = (
    "permit", "ptw", "authorization", "authorisation", "clearance", "jsa", "jha", "permit to work", "permit to enter",
    "entry permit", "hot permit", "harness", "lanyard", "tie-off", "lifeline", "scaffolding", "scaffold",
    "edge protection", "loto", "lockout", "tagout", "tag out", "isolation", "breaker", "gas test", "atmospheric test",
    "ventilation", "fire watch", "guard", "safety device", "interlock", "seatbelt", "seat belt", "barricade",
    "exclusion zone", "swl", "safe working load",
)

# Context patterns around one occurrence: text before it and after it inside the same clause.
NEGATION_BEFORE = r"\b(?:no|not|never|neither|nor)\b(?:\s+\w+){0,3}\s*$"
WITHOUT_ACTIVITY_BEFORE = (
    r"\bwithout\s+(?:any\s+)?(?:actual\s+)?(?:entering|performing|doing|undertaking|conducting|operating|using|"
    r"involving|carrying\s+out)\s*$"
)
WITHOUT_BEFORE = r"\bwithout\s+(?:any\s+)?$"
NEGATION_AFTER = (
    r"^\s*(?:operation|activity|work|entry|event)?\s*(?:was|were|is|are|been|being|did)?\s*(?:not|never)\s+"
    r"(?:performed|conducted|undertaken|carried\s+out|involved|permitted|occurred|done|observed|take\s+place)\b"
)
COLD_BEFORE = r"\bcold\s*$"
COLD_KEYWORD = "cutting"
INCIDENTAL_BEFORE = (
    r"\b(?:stored|parked|kept|idle|inactive|unrelated|passed\s+by|adjacent\s+to|located\s+near|stationed\s+near|"
    r"lying\s+on\s+the\s+ground|in\s+storage)\b"
)
INCIDENTAL_AFTER = (
    r"^\s*(?:machine|equipment|vehicle|crane|material|tools?)?\s*(?:was|were|is|are)?\s*"
    r"(?:stored|parked|kept|idle|inactive|located|stationed)\s+"
    r"(?:nearby|in\s+the\s+area|in\s+storage|adjacent|away\s+from|on\s+site)\b"
)
CORRECTIVE_AROUND = (
    r"\b(?:revised|updated|conducted|reviewed|organized|briefed|retrained|discussed|re-issued)\s+"
    r"(?:after|post|following)\s+(?:the\s+)?(?:incident|event|accident)\b"
    r"|\b(?:after|post|following)\s+(?:the\s+)?(?:incident|event|accident)[,\s]+(?:a\s+)?"
    r"(?:revised|updated|conducted|reviewed|new|briefing)\b"
    r"|\b(?:as\s+a\s+corrective\s+action|corrective\s+action|action\s+item|lesson\s+learned)\b"
)
# A text without any of these words can only hold direct mentions.
CONTEXT_WORDS = (
    r"\b(?:no|not|never|neither|nor|without|cold|stored|parked|kept|idle|inactive|unrelated|passed|adjacent|located|"
    r"stationed|lying|in\s+storage|after|post|following|corrective|action\s+item|lesson)\b"
)
CORRECTIVE_FIELDS = ("corrective_actions", "remedial_actions")
STRENGTHS = {"direct_event": 1.0, "corrective_action": 0.5, "incidental": 0.3}
TAG_VERSION = "rules_v2"

# Phase, role, contemporaneous, cues.
TEMPORAL_CUES = (
    ("BEFORE_EXPOSURE", "RESTORED_BEFORE_EXPOSURE", True,
     ("restored before", "fixed prior to", "replaced before starting", "installed prior to entry",
      "isolated before entry")),
    ("AFTER_EXPOSURE", "RESTORED_AFTER_EXPOSURE", False,
     ("restored after", "repaired subsequently", "fixed following", "reinstalled after incident",
      "replaced post-incident")),
    ("POST_INCIDENT", "RECOMMENDED", False,
     ("should be", "recommended to", "advise that", "suggest that", "action recommended")),
    ("POST_INCIDENT", "PLANNED", False,
     ("will be", "planned to", "to be replaced", "scheduled for next", "to be rectified", "target completion")),
    ("BEFORE_WORK", "VERIFIED_STATE", True,
     ("verified zero", "tested before touch", "confirmed isolated", "measured 0v", "zero pressure confirmed",
      "lock applied and verified")),
    ("BEFORE_WORK", "HISTORICAL_STATE", False,
     ("previously observed", "past history", "prior shift report", "historically known")),
    ("POST_INCIDENT", "DISCOVERED_SUBSEQUENTLY", False,
     ("investigation revealed", "later found", "subsequently discovered", "post-incident audit noted")),
)

# Concept, cue class, cues in order; the first cue found stands for its class.
CONCEPT_CUES = (
    ("energy_isolation", "SYNONYM",
     ("loto", "lockout/tagout", "lockout", "tagout", "positive isolation", "double block and bleed", "blinding", "blind flange",
      "spade", "de-energized", "zero energy", "depressurized", "isolated")),
    ("energy_isolation", "EFFECTIVE_CUE",
     ("isolation verified", "valves held absolute isolation", "verified zero pressure", "depressurized to zero",
      "verified zero voltage", "held throughout")),
    ("energy_isolation", "COMPROMISED_CUE",
     ("isolation failed", "valve passing", "omitted opening bleeder", "lockout not applied", "not verified",
      "wrong isolation point", "residual pressure released")),
    ("energy_isolation", "EXPOSURE_CUE",
     ("line breaking", "breaking flange", "unbolting live", "tightening under pressure", "in release path")),
    ("working_at_height", "SYNONYM",
     ("scaffold", "scaffolding", "scaffolder", "ladder", "mewp", "manlift", "elevated platform", "pipe rack", "derrick mast",
      "fall arrest", "harness", "srl", "self-retracting lifeline", "lanyard", "anchor", "tie-off", "guardrail")),
    ("working_at_height", "EFFECTIVE_CUE",
     ("fall arrest installed and verified", "100% tie-off maintained", "guardrail held", "harness arrested", "netting caught",
      "tied off")),
    ("working_at_height", "COMPROMISED_CUE",
     ("lanyards unhitched", "lanyard unclipped", "detached harness", "guardrail missing", "not anchored", "frayed lanyard")),
    ("working_at_height", "EXPOSURE_CUE",
     ("worked at height", "working at 8 metres", "worked at 7 meters elevation", "at unprotected edge", "fell from")),
    ("lifting_rigging", "SYNONYM",
     ("crane", "mobile crane", "hoist", "winch", "rigging", "sling", "synthetic sling", "wire rope", "shackle", "spreader bar",
      "tag line", "banksman", "rigger", "suspended load", "lift radius", "drop zone")),
    ("lifting_rigging", "EFFECTIVE_CUE",
     ("remained outside exclusion zone", "behind designated safety barrier", "remote console operation", "slings held firm",
      "exclusion zone maintained")),
    ("lifting_rigging", "COMPROMISED_CUE",
     ("stood beneath suspended load", "entered exclusion zone", "sling parted", "dropped assembly", "rigging failed",
      "crossed inside barrier")),
    ("lifting_rigging", "EXPOSURE_CUE",
     ("underneath load", "under suspended load", "in crane radius", "beneath hoisted package")),
    ("confined_space", "SYNONYM",
     ("confined space", "tank entry", "vessel entry", "manhole", "sewer", "manway", "scrubber", "column", "nitrogen purge",
      "atmospheric testing", "gas monitoring", "oxygen deficiency", "h2s")),
    ("confined_space", "EFFECTIVE_CUE",
     ("continuous gas testing confirmed", "safe atmosphere verified", "alarm sounded and crew cleared",
      "positive mechanical blinds installed")),
    ("confined_space", "COMPROMISED_CUE",
     ("entered without continuous monitoring", "gas testing was bypassed", "entered without permit", "nitrogen pocket",
      "lost consciousness")),
    ("confined_space", "EXPOSURE_CUE",
     ("entered vessel", "inside tank", "inside confined space", "leaned through manway", "entrant")),
    ("electrical_systems", "SYNONYM",
     ("switchgear", "cubicle", "breaker", "racking", "busbar", "copper busbar", "11kv", "33kv", "440v", "transformer",
      "arc flash", "live wire", "conductor", "electrocution")),
    ("electrical_systems", "EFFECTIVE_CUE",
     ("verified zero hazardous voltage", "remained fully locked out", "dead-front interlock engaged",
      "tested safe before touch")),
    ("electrical_systems", "COMPROMISED_CUE",
     ("absence of voltage not maintained", "lockout verification degraded", "energized-panel not closed off", "worked live",
      "arc flash occurred")),
    ("electrical_systems", "EXPOSURE_CUE",
     ("direct contact trajectory", "contact with live", "opened energized switchgear", "inside flash boundary")),
    ("vehicle_logistics", "SYNONYM",
     ("forklift", "truck", "delivery truck", "heavy vehicle", "tractor-trailer", "loading bay", "pedestrian walkway",
      "segregation barrier", "bollard", "reverse alarm", "spotter")),
    ("vehicle_logistics", "EFFECTIVE_CUE",
     ("stayed outside reversing zone", "behind segregation walkway barriers", "reversing alarm held throughout",
      "bolted steel barrier prevented vehicle encroaching")),
    ("vehicle_logistics", "COMPROMISED_CUE",
     ("reverse alarm disabled", "backup alarm broken", "severed wiring harness", "entered vehicle path", "rolled over foot")),
    ("vehicle_logistics", "EXPOSURE_CUE",
     ("in vehicle path", "in front of moving", "behind reversing truck", "in travel path")),
    ("hot_work", "SYNONYM",
     ("hot work", "welding", "torch cutting", "oxy-acetylene", "cutting torch", "grinding", "welding sparks", "hot slag",
      "fire blanket", "fire watch")),
    ("hot_work", "EFFECTIVE_CUE",
     ("dedicated fire watch immediately doused", "fire blanket completely sealed deck", "continuous gas test zero lel")),
    ("hot_work", "COMPROMISED_CUE",
     ("slag rolled past fire blanket", "hot work started without gas test", "sparks contacted combustible")),
    ("hot_work", "EXPOSURE_CUE", ("in hot slag path", "welding spatter trajectory", "flash fire enveloped")),
    ("excavation_ground", "SYNONYM",
     ("excavation", "trench", "trenching", "shoring box", "trench shield", "vertical cut", "soil collapse", "cave-in",
      "bell hole", "spoil pile")),
    ("excavation_ground", "EFFECTIVE_CUE",
     ("certified steel shoring box deployed", "workers shielded inside trench box", "soil sloped at 45 degrees",
      "trench shield held firm")),
    ("excavation_ground", "COMPROMISED_CUE",
     ("entered un-shored trench", "bypassed trench shoring boxes", "wall collapsed engulfing worker")),
    ("excavation_ground", "EXPOSURE_CUE", ("inside trench bed", "below vertical soil face", "in excavation")),
    ("dropped_objects", "SYNONYM",
     ("dropped object", "falling object", "fallen tool", "dropped clamp", "dropped pipe", "tool lanyard", "drop netting",
      "toe board", "red zone")),
    ("dropped_objects", "EFFECTIVE_CUE",
     ("tool lanyard arrested dynamic fall", "drop netting caught clamp", "toe boards installed and held")),
    ("dropped_objects", "COMPROMISED_CUE",
     ("drop netting absent", "tool untethered and fell", "object fell through grating")),
    ("dropped_objects", "EXPOSURE_CUE", ("working below scaffold", "under elevated platform", "in drop zone")),
)

# Precursor -> (severity, keywords).
PRECURSORS = {
    "Confined Space": ("CRITICAL", (
        "confined space", "tank entry", "vessel entry", "manhole entry", "entered the tank", "confined")),
    "Failure of Energy Isolation": ("CRITICAL", (
        "isolation not verified", "without isolation", "lockout", "lock out", "loto", "energy isolation",
        "equipment was not isolated", "electrical isolation", "confirming isolation", "isolation", "isolated")),
    "Missing Gas Testing": ("HIGH", (
        "gas testing", "gas test", "atmospheric testing", "gas detection", "oxygen testing", "gas monitoring",
        "gas monitor")),
    "Working at Height": ("HIGH", (
        "working at height", "fall from height", "scaffold", "scaffolding", "ladder", "elevated platform", "harness",
        "fall protection")),
    "Line of Fire": ("HIGH", (
        "line of fire", "struck by", "caught between", "pinch point", "moving equipment", "suspended load",
        "dropped object")),
    "Lifting Operation": ("HIGH", ("lifting", "crane", "suspended load", "lifting operation", "rigging", "rigger")),
    "Hot Work": ("HIGH", ("hot work", "welding", "weld", "cutting", "spark", "grinding", "torch")),
    "Driving & Transport": ("HIGH", (
        "driving", "driver", "vehicle", "speeding", "seatbelt", "truck", "collision")),
    "Bypassing Safety Controls": ("CRITICAL", (
        "bypassed", "bypassing", "override", "disabled alarm", "interlock bypassed", "safety device disabled")),
}

FAILURE_PHRASES = (
    (r"without\s+(?:gas\s+test(?:ing)?|gas monitor|atmospheric testing)", "Gas testing not performed"),
    (r"(?:isolation\s+not\s+verified|without\s+isolation|isolation\s+failed|not\s+isolated)", "Isolation not verified"),
    (r"(?:without\s+fall\s+protection|without\s+(?:harness|lanyard)|no\s+fall\s+protection)", "Fall protection missing"),
    (r"(?:without\s+permit|no\s+(?:work\s+)?permit|permit\s+not\s+issued)", "Work permit not obtained"),
    (r"(?:without\s+(?:required\s+)?hot\s+work\s+controls|hot\s+work\s+permit\s+missing)", "Hot work controls missing"),
    (r"(?:without\s+seatbelt|speeding|reckless\s+driving)", "Driving safety controls violated"),
    (r"(?:bypassed|override|disabled)\s+(?:safety\s+controls?|alarm|interlock|guard)", "Safety control bypassed"),
)
FAILURE_CUES = ("without ", "not performed", "not verified", "lacking ")
NONE_DETECTED = "None detected"

BEST_RULE_KEYWORDS = {
    "Energy Isolation": ("isolation", "isolated", "loto", "lockout", "lock out", "energy", "valve", "electrical"),
    "Confined Space": ("confined", "tank", "vessel", "enclosed", "gas monitor", "entry permit"),
    "Hot Work": ("hot work", "welding", "weld", "cutting", "spark", "flame", "grinding"),
    "Line of Fire": ("line of fire", "suspended load", "struck by", "dropped object", "overhead"),
    "Working at Height": ("height", "scaffold", "fall", "harness", "ladder", "elevated"),
    "Lifting Operations": ("crane", "lifting", "load", "sling", "rigger", "hoist"),
    "Driving": ("vehicle", "driving", "speed", "seatbelt", "road", "truck"),
    "Bypassing Safety Controls": ("bypass", "override", "disabled alarm", "defeat", "by-passed"),
}
BEST_ACTIVITY_KEYWORDS = {
    "Confined Space Entry": ("confined space", "tank", "vessel"),
    "Hot Work": ("welding", "weld", "grinding", "hot work"),
    "Lifting Operation": ("crane", "lifting", "sling", "hoist"),
    "Working at Height": ("scaffold", "ladder", "height", "harness"),
    "Vehicle Movement": ("vehicle", "truck", "driving", "forklift"),
    "Energy Isolation": ("isolation", "loto", "lockout"),
}
