"""Wording of the evidence chain and of the guards against inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from wardline.rules.wording import HAZARDS

# Fixed values.
VIOLATION_WORDS = ("violation", "breach", "bypassed", "failed")
CONTROL_WORDS = ("control", "barrier", "guard", "scaffold", "lanyard", "loto")
PLAN_WORDS = ("will be", "should be", "planned to", "to be installed", "proposed to", "recommended to")
PPE_MENTIONS = ("ppe", "helmet", "gloves", "safety shoes", "goggles", "hard hat")
POSITION_TERMS = ("position", "proximity", "entry", "under", "exposure")
CONTROL_TERMS = ("isolation", "barrier", "guard", "loto", "gas", "tethering")
LINKS = ("hazard", "exposure", "control", "consequence", "escalation")


@dataclass(frozen=True)
class ChainPatterns:
    energy: Mapping[str, Sequence[str]]
    exposure: Sequence[str]
    no_exposure: Sequence[str]
    failure: Sequence[str]
    effective: Sequence[str]
    mechanisms: Mapping[str, Sequence[str]]


# General wording of the chain.
CHAIN = ChainPatterns(
    energy=HAZARDS,
    exposure=(
        r"\b(?:worker|scaffolder|operator|technician|helper|roustabout|rig\s+crew|electrician|welder|driver|employee|personnel|"
        r"crew|line\s+of\s+fire|in\s+the\s+path|worker\s+exposed|personnel\s+present|underneath|standing\s+near|struck\s+by|"
        r"caught\s+between|pinch\s+point|crush(?:ed)?|fell|falling)\b",),
    no_exposure=(
        r"\b(?:no\s+personnel\s+present|unmanned|remote\s+location|cleared\s+area|barricaded|safe\s+distance|"
        r"exclusion\s+zone\s+maintained|nobody\s+exposed|no\s+injury|evacuated)\b",),
    failure=(
        r"\b(?:bypassed|interlock\s+bypassed|missing\s+guard|guard\s+removed|without\s+permit|no\s+loto|lockout\s+not\s+applied|"
        r"isolation\s+failed|failed\s+to\s+hold|defective|corroded|deteriorated|inadequate|breach(?:ed)?|not\s+isolated|"
        r"unsecured|unauthorized|failed|not\s+hooked|not\s+tied\s+off|not\s+anchored|unanchored|no\s+harness|not\s+worn)\b",),
    effective=(
        r"\b(?:interlock\s+engaged|auto(?:matic)?-shutdown|trip\s+activated|relief\s+valve\s+lifted\s+safely|ppe\s+prevented|"
        r"safely\s+contained|isolated\s+properly|barricade\s+prevented|alarm\s+sounded\s+and\s+crew\s+cleared)\b",),
    mechanisms={
        "pressure": (r"\b(?:high\s+pressure|pressurized|rupture|projectile|injection|blowout)\b",),
        "fall": (r"\b(?:fall(?:ing)?|working\s+at\s+height|dropped\s+from\s+height|mast\s+fall)\b",),
        "crush": (r"\b(?:suspended\s+load|dropped\s+load|crush(?:ed)?|rigging\s+failed|crane\s+toppled)\b",),
        "fire": (r"\b(?:gas\s+leak|hydrocarbon|flash\s+fire|explosion|ignition|fire)\b",),
        "electrocution": (r"\b(?:electrocution|electric\s+shock|live\s+wire|arc\s+flash|high\s+voltage)\b",),
        "toxic": (r"\b(?:h2s|hydrogen\s+sulfide|confined\s+space|asphyxiat(?:ion|ed)|oxygen\s+depletion)\b",),
        "vehicle": (r"\b(?:vehicle\s+collision|runaway|struck\s+by\s+vehicle|rollover|forklift\s+impact)\b",),
    },
)
