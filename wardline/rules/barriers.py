"""Barrier categories and their wording.

Fixed values: categories in order of precedence, display names, roles, and the patterns that name a barrier, show that it
worked and show that it did not, with the state of a barrier that is only named.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class BarrierRule:
    category: str
    label: str
    role: str
    triggers: Sequence[str]
    effective: Sequence[str]
    deficient: Sequence[str]
    default_state: str


BARRIER_RULES = (
    BarrierRule(
        "FALL_ARREST_SYSTEM", "Safety Harness / Fall-Arrest System", "RECOVERY_RESCUE",
        (
            r"\b(?:safety\s+)?harness\b",
            r"\bfall[- ]arrest(?:\s+system)?\b",
            r"\b(?:self[- ]retracting\s+)?lifeline\b",
            r"\blanyard\b",
            r"\bSRL\b",
            r"\bfall\s+protection\s+system\b",
            r"\bdual[- ]tie[- ]off\b",
        ),
        (
            r"\b(?:harness\s+(?:caught|arrested|held|stopped|saved|supported)\s+(?:him|her|the\s+worker|them|person))\b",
            r"\b(?:helped\s+(?:him|her|them)\s+regain\s+balance)\b",
            r"\b(?:arrested\s+the\s+fall)\b",
            r"\b(?:fall\s+arrest\s+(?:system\s+)?(?:stopped|arrested|prevented|caught))\b",
            r"\b(?:lifeline\s+(?:engaged|arrested|stopped|held))\b",
            r"\b(?:tied\s+off\s+and\s+(?:prevented|stopped|held))\b",
        ),
        (
            r"\b(?:was\s+not\s+(?:connected|tied\s+off|clipped|anchored|worn|attached))\b",
            r"\b(?:not\s+tied[- ]off|unclipped|unattached|detached)\b",
            r"\b(?:no\s+harness|without\s+(?:a\s+)?harness)\b",
            r"\b(?:harness\s+(?:\w+\s+)?(?:failed|snapped|broke|slipped|tore))\b",
            r"\b(?:lifeline\s+(?:failed|severed|broke|cut|snapped))\b",
            r"\b(?:lanyard\s+(?:severed|broke|unhooked|snapped|parted|failed))\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "GUARDRAIL", "Guardrail / Edge Protection", "PREVENTIVE",
        (
            r"\bguardrail\b",
            r"\bhandrail\b",
            r"\btoe\s*board\b",
            r"\bedge\s+protection\b",
            r"\bsafety\s+railing\b",
            r"\bscaffold\s+railing\b",
        ),
        (
            r"\b(?:guardrail\s+prevented\s+(?:the\s+worker\s+from\s+falling|fall|entry))\b",
            r"\b(?:handrail\s+(?:prevented|held|supported|stopped))\b",
            r"\b(?:edge\s+protection\s+(?:in\s+place|prevented))\b",
            r"\b(?:guardrail\s+(?:held|intact))\b",
        ),
        (
            r"\b(?:no\s+guardrail(?:\s+was\s+installed)?)\b",
            r"\b(?:guardrail\s+(?:was\s+)?(?:missing|removed|damaged|broken|absent|collapsed))\b",
            r"\b(?:handrail\s+(?:missing|removed|broken|absent))\b",
            r"\b(?:without\s+(?:a\s+)?(?:guardrail|handrail|edge\s+protection))\b",
            r"\b(?:toe\s*board\s+(?:missing|absent))\b",
        ),
        "ABSENT",
    ),
    BarrierRule(
        "SAFETY_NET", "Safety Net / Catch Platform", "RECOVERY_RESCUE",
        (r"\bsafety\s+net\b", r"\bdebris\s+netting\b", r"\bcatch\s+platform\b"),
        (r"\b(?:safety\s+net\s+(?:caught|arrested|stopped))\b", r"\b(?:fell\s+into\s+the\s+safety\s+net)\b"),
        (r"\b(?:safety\s+net\s+(?:failed|tore|missing|not\s+installed))\b",),
        "EFFECTIVE",
    ),
    BarrierRule(
        "EXCLUSION_BARRIER", "Physical Exclusion Barricade", "PREVENTIVE",
        (
            r"\bexclusion\s+barrier\b",
            r"\bexclusion\s+zone\b",
            r"\bbarricad(?:e|ed|ing)\b",
            r"\bphysical\s+barrier\b",
            r"\bhard\s+barricading\b",
            r"\bdanger\s+zone\s+barrier\b",
            r"\bdrop\s+zone\s+barrier\b",
        ),
        (
            r"\b(?:controlled\s+within\s+the\s+barricaded\s+exclusion\s+zone)\b",
            r"\b(?:exclusion\s+zone\s+was\s+maintained)\b",
            r"\b(?:barricaded?\s+exclusion\s+zone)\b",
            r"\b(?:barrier\s+prevented\s+entry)\b",
            r"\b(?:area\s+was\s+barricaded)\b",
            r"\b(?:remained\s+outside\s+the\s+exclusion\s+zone)\b",
        ),
        (
            r"\b(?:exclusion\s+zone\s+was\s+not\s+maintained)\b",
            r"\b(?:exclusion\s+barrier\s+was\s+not\s+maintained)\b",
            r"\b(?:barricad(?:e|ing)?\s+(?:was\s+)?(?:not\s+in\s+place|missing|absent|removed|inadequate|breached))\b",
            r"\b(?:entered\s+(?:the\s+)?(?:exclusion\s+zone|drop\s+zone|danger\s+area)\s+while)\b",
            r"\b(?:without\s+(?:an?\s+)?(?:exclusion\s+barrier|barricade))\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "MACHINE_GUARD", "Machine Guard / Equipment Shield", "PREVENTIVE",
        (
            r"\bmachine\s+guard\b",
            r"\bequipment\s+guard\b",
            r"\bsafety\s+guard\b",
            r"\bprotective\s+guard\b",
            r"\bguard\s+casing\b",
            r"\bcoupling\s+guard\b",
            r"\bbelt\s+guard\b",
            r"\bshaft\s+guard\b",
            r"\bphysical\s+guard\b",
            r"\boperating\s+machine\s+after\s+the\s+guard\b",
            r"\bguard\s+had\s+been\s+removed\b",
        ),
        (
            r"\b(?:guard\s+(?:prevented\s+contact|shielded|protected|in\s+place|intact))\b",
            r"\b(?:physical\s+guarding\s+prevented)\b",
        ),
        (
            r"\b(?:guard\s+had\s+been\s+removed)\b",
            r"\b(?:guard\s+(?:was\s+)?(?:removed|missing|absent|detached|unbolted|open|damaged|defeated))\b",
            r"\b(?:unguarded\s+(?:shaft|machine|belt|equipment|rotating))\b",
            r"\b(?:without\s+(?:a\s+)?guard)\b",
            r"\b(?:guard\s+bypassed)\b",
        ),
        "ABSENT",
    ),
    BarrierRule(
        "INTERLOCK", "Safety Interlock / Light Curtain", "PREVENTIVE",
        (r"\binterlock(?:ed)?\b", r"\blight\s+curtain\b", r"\bsafety\s+switch\b", r"\bdoor\s+interlock\b"),
        (r"\b(?:interlock\s+(?:stopped|tripped|prevented|activated))\b", r"\b(?:interlocked\s+door\s+prevented)\b"),
        (r"\b(?:interlock\s+(?:bypassed|defeated|failed|overridden|faulty|jumpered))\b", r"\b(?:without\s+interlock)\b"),
        "EFFECTIVE",
    ),
    BarrierRule(
        "EMERGENCY_STOP", "Emergency Stop / Trip Wire", "MITIGATIVE",
        (r"\bemergency\s+stop\b", r"\be[- ]stop\b", r"\btrip[- ]wire\b", r"\bsafety\s+trip\b", r"\bkill[- ]switch\b"),
        (
            r"\b(?:emergency\s+stop\s+(?:was\s+)?activated\s+before)\b",
            r"\b(?:activated\s+(?:the\s+)?emergency\s+stop)\b",
            r"\b(?:hit\s+(?:the\s+)?e[- ]stop)\b",
            r"\b(?:stopped\s+(?:the\s+machine|the\s+conveyor|motion)\s+before\s+contact)\b",
            r"\b(?:emergency\s+stop\s+(?:halted|tripped|stopped))\b",
        ),
        (r"\b(?:emergency\s+stop\s+(?:failed|did\s+not\s+stop|unreachable|defective))\b", r"\b(?:e[- ]stop\s+(?:failed|inoperable))\b"),
        "EFFECTIVE",
    ),
    BarrierRule(
        "EMERGENCY_SHUTDOWN", "Emergency Shutdown System (ESD/ESDV)", "MITIGATIVE",
        (r"\bemergency\s+shutdown\b", r"\bESDV\b", r"\bESD\b", r"\bauto[- ]shutdown\b", r"\bautomatic\s+trip\b"),
        (
            r"\b(?:emergency\s+shutdown\s+(?:activated|closed|isolated|stopped\s+the\s+release))\b",
            r"\b(?:ESDV\s+(?:closed|tripped|isolated))\b",
            r"\b(?:emergency\s+isolation\s+valve\s+was\s+activated\s+and\s+stopped\s+the\s+flow)\b",
            r"\b(?:shutdown\s+system\s+(?:tripped|prevented|stopped))\b",
        ),
        (r"\b(?:ESDV\s+(?:failed|leaked|did\s+not\s+close))\b", r"\b(?:emergency\s+shutdown\s+(?:bypassed|failed|overridden))\b"),
        "EFFECTIVE",
    ),
    BarrierRule(
        "ISOLATION_VALVE", "Isolation Valve / Positive Mechanical Blind", "PREVENTIVE",
        (
            r"\bisolation\s+valve\b",
            r"\bpositively\s+isolated\b",
            r"\bpositive\s+isolation\b",
            r"\bdouble\s+block\s+and\s+bleed\b",
            r"\bblind(?:ed|ing)?\b",
            r"\bspade\s+insertion\b",
            r"\bblock\s+valve\b",
            r"\bupstream\s+isolation\s+valve\b",
        ),
        (
            r"\b(?:process\s+line\s+was\s+positively\s+isolated)\b",
            r"\b(?:isolation\s+valve\s+(?:closed|held|isolated|shut))\b",
            r"\b(?:shutting\s+the\s+upstream\s+isolation\s+valve)\b",
            r"\b(?:positive\s+isolation\s+(?:in\s+place|confirmed|verified))\b",
            r"\b(?:double\s+block\s+and\s+bleed\s+(?:confirmed|verified|effective))\b",
        ),
        (
            r"\b(?:isolation\s+valve\s+(?:had\s+not\s+been\s+locked|leaked|passing|failed|open))\b",
            r"\b(?:had\s+not\s+been\s+locked)\b",
            r"\b(?:without\s+(?:positive\s+)?isolation)\b",
            r"\b(?:valve\s+passing)\b",
            r"\b(?:isolation\s+(?:incomplete|inadequate|compromised))\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "ZERO_ENERGY_VERIFICATION", "Zero-Energy Verification (Test-Before-Touch)", "DETECTIVE",
        (
            r"\bzero[- ]energy(?:\s+verification)?\b",
            r"\btest[- ]before[- ]touch\b",
            r"\bverified\s+zero\b",
            r"\bverif(?:y|ied)\s+absence\s+of\s+voltage\b",
            r"\bzero\s+energy\s+was\s+verified\b",
        ),
        (
            r"\b(?:zero\s+energy\s+was\s+verified\s+before\s+work\s+began)\b",
            r"\b(?:zero[- ]energy\s+verification\s+(?:completed|confirmed|verified))\b",
            r"\b(?:absence\s+of\s+voltage\s+verified)\b",
            r"\b(?:residual\s+pressure\s+safely\s+relieved,\s+and\s+isolation\s+confirmed)\b",
        ),
        (
            r"\b(?:zero[- ]energy\s+verification\s+had\s+not\s+been\s+completed)\b",
            r"\b(?:energy\s+isolation\s+was\s+not\s+verified)\b",
            r"\b(?:zero\s+energy\s+(?:not\s+verified|not\s+checked|omitted))\b",
            r"\b(?:without\s+zero[- ]energy\s+verification)\b",
            r"\b(?:failure\s+to\s+complete\s+and\s+independently\s+confirm\s+zero[- ]energy)\b",
        ),
        "NOT_VERIFIED",
    ),
    BarrierRule(
        "LOCKOUT_TAGOUT", "Lockout / Tagout (LOTO)", "PREVENTIVE",
        (r"\blockout[ /]tagout\b", r"\bLOTO\b", r"\block\s*out\b", r"\btag\s*out\b", r"\bpadlock\b", r"\blockout\s+hasp\b"),
        (
            r"\b(?:LOTO\s+(?:applied|implemented|confirmed|in\s+place))\b",
            r"\b(?:locked\s+out\s+and\s+tagged\s+out)\b",
            r"\b(?:padlock\s+applied)\b",
        ),
        (
            r"\b(?:no\s+LOTO\b|LOTO\s+not\s+applied|without\s+LOTO)\b",
            r"\b(?:lock\s+(?:not\s+installed|not\s+applied|removed\s+prematurely))\b",
            r"\b(?:not\s+locked\s+out)\b",
        ),
        "ABSENT",
    ),
    BarrierRule(
        "GAS_DETECTION", "Gas Detection / Atmospheric Monitoring", "DETECTIVE",
        (
            r"\bgas\s+test(?:ing)?\b",
            r"\bgas\s+detector\b",
            r"\batmospheric\s+test(?:ing)?\b",
            r"\batmospheric\s+monitor(?:ing)?\b",
            r"\bLEL\s+monitor(?:ing)?\b",
            r"\b4[- ]gas\s+monitor\b",
            r"\bmulti[- ]gas\b",
            r"\bH2S\s+detector\b",
        ),
        (
            r"\b(?:gas\s+testing\s+confirmed\s+safe\s+atmospheric\s+conditions)\b",
            r"\b(?:gas\s+detector\s+alarmed\s+when)\b",
            r"\b(?:atmospheric\s+testing\s+(?:confirmed\s+safe|completed|verified))\b",
            r"\b(?:gas\s+detector\s+alerted)\b",
            r"\b(?:gas\s+test\s+(?:clear|safe|completed))\b",
        ),
        (
            r"\b(?:atmospheric\s+testing\s+was\s+not\s+verified)\b",
            r"\b(?:gas\s+test(?:ing)?\s+(?:not\s+done|omitted|not\s+performed|failed|unverified))\b",
            r"\b(?:gas\s+detector\s+(?:failed|faulty|not\s+calibrated|did\s+not\s+alarm))\b",
            r"\b(?:without\s+atmospheric\s+testing)\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "VENTILATION", "Mechanical Forced Air Ventilation", "MITIGATIVE",
        (r"\bventilation\b", r"\bforced\s+air\s+ventilation\b", r"\bair\s+mover\b", r"\bexhaust\s+fan\b", r"\bblower\b"),
        (
            r"\b(?:ventilation\s+(?:maintained|running|operational|effective|adequate))\b",
            r"\b(?:forced\s+air\s+ventilation\s+in\s+place)\b",
        ),
        (
            r"\b(?:ventilation\s+was\s+inadequate)\b",
            r"\b(?:ventilation\s+(?:failed|stopped|absent|insufficient|inadequate|lacking))\b",
            r"\b(?:without\s+(?:adequate\s+)?ventilation)\b",
        ),
        "UNKNOWN",
    ),
    BarrierRule(
        "FIRE_WATCH", "Dedicated Fire Watch & Extinguisher", "DETECTIVE",
        (r"\bfire\s+watch\b", r"\bfire\s+extinguisher\b", r"\bfire\s+blanket\b", r"\bstandby\s+fire\s+watch\b"),
        (
            r"\b(?:fire\s+watch\s+was\s+in\s+place)\b",
            r"\b(?:fire\s+watch\s+(?:extinguished|present|alert|intervened))\b",
            r"\b(?:fire\s+blanket\s+(?:contained|shielded|enclosed))\b",
            r"\b(?:extinguisher\s+on\s+hand)\b",
        ),
        (
            r"\b(?:fire\s+watch\s+(?:absent|missing|not\s+assigned|left\s+area|inattentive))\b",
            r"\b(?:no\s+fire\s+watch)\b",
            r"\b(?:fire\s+extinguisher\s+(?:depleted|missing|inoperable))\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "FIRE_SUPPRESSION", "Fire Suppression System / Auto-Deluge", "MITIGATIVE",
        (r"\bfire\s+suppression\b", r"\bdeluge\s+system\b", r"\bsprinkler\s+system\b", r"\bfoam\s+system\b"),
        (r"\b(?:fire\s+suppression\s+(?:activated|extinguished|discharged|controlled))\b", r"\b(?:deluge\s+(?:activated|extinguished))\b"),
        (r"\b(?:fire\s+suppression\s+(?:failed|did\s+not\s+activate|isolated))\b", r"\b(?:deluge\s+isolated)\b"),
        "EFFECTIVE",
    ),
    BarrierRule(
        "CONTAINMENT", "Spill Containment / Bund / Drip Pan", "MITIGATIVE",
        (r"\bspill\s+containment\b", r"\bbund(?:ed|ing)?\b", r"\bdrip\s+pan\b", r"\bcatchment\b", r"\bsecondary\s+containment\b"),
        (
            r"\b(?:containment\s+(?:captured|held|contained))\b",
            r"\b(?:bund\s+contained\s+the\s+release)\b",
            r"\b(?:drip\s+pan\s+captured)\b",
        ),
        (
            r"\b(?:containment\s+(?:overflowed|breached|leaked|failed|absent))\b",
            r"\b(?:bund\s+valve\s+open)\b",
            r"\b(?:no\s+secondary\s+containment)\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "VEHICLE_PEDESTRIAN_SEGREGATION", "Vehicle / Pedestrian Segregation Barrier", "PREVENTIVE",
        (
            r"\bpedestrian\s+segregation\b",
            r"\bsegregation\s+barrier\b",
            r"\bpedestrian\s+barrier\b",
            r"\bvehicle\s+barrier\b",
            r"\bcrash\s+bollard\b",
            r"\bwalkway\s+barrier\b",
            r"\bseparating\s+the\s+vehicle\s+lane\s+from\s+the\s+walkway\b",
        ),
        (
            r"\b(?:pedestrian\s+segregation\s+was\s+maintained)\b",
            r"\b(?:worker\s+remained\s+outside\s+the\s+vehicle\s+operating\s+zone)\b",
            r"\b(?:segregation\s+barrier\s+prevented\s+entry)\b",
            r"\b(?:barrier\s+separating\s+the\s+vehicle\s+lane\s+from\s+the\s+walkway\s+stopped\s+the\s+forklift)\b",
            r"\b(?:physical\s+barrier\s+stopped\s+the\s+vehicle)\b",
            r"\b(?:bollard\s+prevented\s+intrusion)\b",
        ),
        (
            r"\b(?:pedestrian\s+segregation\s+not\s+maintained)\b",
            r"\b(?:no\s+pedestrian\s+segregation)\b",
            r"\b(?:vehicle\s+barrier\s+(?:damaged|absent|missing|breached))\b",
            r"\b(?:entered\s+vehicle\s+lane\s+without\s+barrier)\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "SEAT_BELT", "Seat Belt / Restraint Harness", "MITIGATIVE",
        (r"\bseat[- ]belt\b", r"\bsafety\s+belt\b", r"\brestraint\s+harness\b"),
        (r"\b(?:seat[- ]belt\s+(?:restrained|held|protected|worn))\b", r"\b(?:wearing\s+seat[- ]belt\s+prevented)\b"),
        (r"\b(?:seat[- ]belt\s+(?:not\s+worn|not\s+fastened|unbuckled|failed))\b", r"\b(?:without\s+seat[- ]belt)\b"),
        "EFFECTIVE",
    ),
    BarrierRule(
        "WHEEL_CHOCK", "Wheel Chocks / Parking Brake", "PREVENTIVE",
        (r"\bwheel\s+chock(?:s)?\b", r"\bchock(?:ed|ing)?\b", r"\bparking\s+brake\b"),
        (r"\b(?:wheel\s+chocks\s+(?:in\s+place|prevented\s+roll|held))\b", r"\b(?:chocked\s+and\s+secured)\b"),
        (
            r"\b(?:wheel\s+chocks\s+(?:not\s+applied|missing|absent|slipped))\b",
            r"\b(?:without\s+wheel\s+chocks)\b",
            r"\b(?:parking\s+brake\s+not\s+set)\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "PRESSURE_RELIEF", "Pressure Relief Valve (PRV) / Rupture Disk", "MITIGATIVE",
        (r"\bpressure\s+relief\s+valve\b", r"\bPRV\b", r"\bPSV\b", r"\brupture\s+dis[ck]\b", r"\bsafety\s+relief\s+valve\b"),
        (
            r"\b(?:PRV\s+(?:lifted|relieved|vented|opened\s+safely))\b",
            r"\b(?:rupture\s+disk\s+burst\s+safely)\b",
            r"\b(?:relief\s+valve\s+(?:operated|functioned))\b",
        ),
        (r"\b(?:PRV\s+(?:failed\s+to\s+lift|stuck|gagged|passing|isolated))\b", r"\b(?:relief\s+valve\s+(?:isolated|blocked|failed))\b"),
        "EFFECTIVE",
    ),
    BarrierRule(
        "STOP_WORK_INTERVENTION", "Stop-Work Authority Intervention", "ADMINISTRATIVE_STOP_WORK",
        (
            r"\bstop[- ]work\b",
            r"\bcrew\s+stopped\b",
            r"\bwork\s+was\s+stopped\b",
            r"\bwork\s+stopped\s+immediately\b",
            r"\bintervened\s+and\s+stopped\b",
        ),
        (
            r"\b(?:crew\s+stopped\s+when\s+conditions\s+changed\s+and\s+resumed\s+only\s+after\s+controls\s+were\s+confirmed)\b",
            r"\b(?:work\s+was\s+stopped\s+and\s+the\s+platform\s+was\s+taken\s+out\s+of\s+service)\b",
            r"\b(?:work\s+stopped\s+immediately\s+upon\s+release)\b",
            r"\b(?:stop[- ]work\s+authority\s+(?:exercised|used|initiated))\b",
            r"\b(?:stopped\s+the\s+work\s+before\s+exposure)\b",
        ),
        (r"\b(?:failed\s+to\s+stop\s+work)\b", r"\b(?:stop[- ]work\s+not\s+heeded)\b"),
        "EFFECTIVE",
    ),
    BarrierRule(
        "RIGGING_CONTROL", "Certified Rigging / Whip Check Safety Cable", "PREVENTIVE",
        (r"\brigging\b", r"\bsling\b", r"\bshackle\b", r"\btag[- ]line\b", r"\bwhip[- ]check\b", r"\bsafety\s+cable\b"),
        (
            r"\b(?:rigging\s+remained\s+within\s+its\s+rated\s+capacity)\b",
            r"\b(?:whip[- ]check\s+(?:restrained|held))\b",
            r"\b(?:tag[- ]line\s+controlled\s+the\s+load)\b",
            r"\b(?:rigging\s+inspected\s+and\s+certified)\b",
        ),
        (
            r"\b(?:rigging\s+(?:snapped|failed|overloaded|damaged|severed))\b",
            r"\b(?:whip[- ]check\s+(?:not\s+installed|missing|failed))\b",
            r"\b(?:sling\s+(?:parted|snapped|cut))\b",
            r"\b(?:without\s+tag[- ]line)\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "LIFTING_EXCLUSION_ZONE", "Lifting Radius Exclusion Zone", "PREVENTIVE",
        (
            r"\blifting\s+radius(?:\s+exclusion\s+zone)?\b",
            r"\blift\s+path\b",
            r"\bsuspended[- ]load\s+(?:exclusion\s+)?zone\b",
            r"\bcrane\s+(?:swing\s+path|exclusion\s+zone)\b",
        ),
        (
            r"\b(?:no\s+worker\s+entered\s+the\s+lift\s+path)\b",
            r"\b(?:lift\s+path\s+cleared)\b",
            r"\b(?:worker\s+remained\s+outside\s+lift\s+radius)\b",
        ),
        (
            r"\b(?:worker\s+entered\s+the\s+suspended[- ]load\s+exclusion\s+zone)\b",
            r"\b(?:entered\s+the\s+lift\s+path)\b",
            r"\b(?:positioned\s+under\s+(?:the\s+)?suspended\s+load)\b",
        ),
        "EFFECTIVE",
    ),
    BarrierRule(
        "PROTECTIVE_SHIELD", "Protective Splash / Blast Shield", "MITIGATIVE",
        (
            r"\bdeflector\s+shield\b",
            r"\bblast\s+(?:shield|curtain|panel)\b",
            r"\bspray\s+shield\b",
            r"\bflange\s+shield\b",
            r"\bprotective\s+screen\b",
        ),
        (r"\b(?:shield\s+(?:deflected|stopped|protected|contained))\b", r"\b(?:spray\s+shield\s+prevented)\b"),
        (r"\b(?:shield\s+(?:missing|damaged|absent|omitted))\b", r"\b(?:without\s+(?:a\s+)?shield)\b"),
        "EFFECTIVE",
    ),
    BarrierRule(
        "RESCUE_SYSTEM", "Standby Rescue System / Retrieval Lifeline", "RECOVERY_RESCUE",
        (r"\brescue\s+system\b", r"\bretrieval\s+winch\b", r"\bstandby\s+rescuer\b", r"\btripod\s+retrieval\b"),
        (r"\b(?:retrieval\s+system\s+(?:extracted|rescued|recovered))\b", r"\b(?:standby\s+rescue\s+deployed)\b"),
        (r"\b(?:rescue\s+system\s+(?:not\s+ready|failed|missing))\b", r"\b(?:no\s+standby\s+rescue)\b"),
        "EFFECTIVE",
    ),
    BarrierRule(
        "PPE_PROTECTIVE_BARRIER", "Task-Critical Protective Barrier PPE", "MITIGATIVE",
        (r"\bSCBA\b", r"\bbreathing\s+apparatus\b", r"\barc[- ]flash\s+(?:suit|shield|hood)\b", r"\bchemical\s+suit\b", r"\bblast\s+suit\b"),
        (
            r"\b(?:SCBA\s+(?:prevented\s+inhalation|protected\s+breathing))\b",
            r"\b(?:arc[- ]flash\s+suit\s+prevented\s+burns)\b",
            r"\b(?:chemical\s+suit\s+prevented\s+contact)\b",
        ),
        (r"\b(?:SCBA\s+(?:depleted|failed|not\s+worn))\b", r"\b(?:arc[- ]flash\s+suit\s+(?:not\s+worn|failed))\b"),
        "EFFECTIVE",
    ),
)
