"""Wording of the deterministic reasoning, one alternative a line.

Fixed values: all of them decide a result, so they are kept whole, unmerged and in order.
"""

from __future__ import annotations


def whole(alternatives: str) -> tuple[str, ...]:
    """One pattern that matches any of the lines between word bounds."""
    return (r"\b(?:" + "|".join(alternatives.strip().split("\n")) + r")\b",)


HAZARDS = {
    "dropped_objects": whole(r"""
dropped\s+object
falling\s+object
object\s+fell
dropped\s+from
fallen\s+tool
dropped\s+tool
dropped\s+clamp
dropped\s+tubular
overhead\s+drop
drop\s+zone
clamp\s+and\s+pipe\s+dropped
tool\s+dropped
"""),
    "excavation_ground_collapse": whole(r"""
trench(?:ing)?
excavat(?:ion|ing)
un-shored
trench\s+box
shoring\s+box
soil\s+collapse
cave-in
vertical\s+cut
trench\s+wall
"""),
    "toxic_asphyxiant_atmosphere": whole(r"""
h2s
hydrogen\s+sulfide
toxic\s+gas
toxic\s+vapor
nitrogen\s+pocket
asphyxia(?:nt|tion)?
oxygen\s+deficien(?:cy|t)
anoxia
hypoxia
ppm\s+h2s
"""),
    "vehicle_mobile_equipment": whole(r"""
forklift
truck
heavy\s+vehicle
semi-trailer
tractor-trailer
crane\s+movement
excavator
collision
runaway\s+vehicle
speeding
rollover
backing\s+up
"""),
    "working_at_height": whole(r"""
work(?:ing)?\s+at\s+height
fall\s+from\s+height
scaffold(?:er|ing|s)?
ladder
derrick\s+mast
drilling\s+mast
mast\s+climbing
fall\s+from\s+mast
elevated\s+(?:pipe\s+rack|structure|platform|level|walkway)
elevated\s+platform
manlift
fall\s+arrest
roof
pipe\s+rack
safety\s+harness
fall\s+harness
body\s+harness
harness\s+lanyards?
harness\s+straps
harness\s+attachment
worked\s+at\s+\d+\s+met(?:er|re)s
working\s+at\s+\d+\s+met(?:er|re)s
\d+\s+met(?:er|re)s\s+(?:height|elevation|above)
"""),
    "pressure_stored": whole(r"""
high\s+pressure
pressur(?:e|ized)
psi
bar
blowout
relief\s+valve
pipe\s+burst
flange\s+leak
air\s+receiver
hydraulic
pneumatic
bleed(?:ing)?
depressuriz
hydrotest
line\s+breaking
stored\s+energy
"""),
    "electrical": whole(r"""
high\s+voltage
electrical
electrocution
arc\s+flash
flashover
live\s+wire
generator
substation
transformer
440v
11kv
33kv
breaker
switchgear
energized\s+switchgear
live\s+(?:\d+.*?[vV]|busbar|copper\s+busbar)
"""),
    "suspended_loads": whole(r"""
crane
hoist
rigging
suspended\s+load
load\s+was\s+suspended
sling
winch
derrick
lifting\s+operation
shackle
spreader\s+bar
overhead\s+load
hydraulic\s+jack
raised\s+on\s+jacks
elevated\s+a\s+\d+.*?\bjack
"""),
    "hydrocarbon_flammable_release": whole(r"""
hydrocarbon
gas\s+leak
crude
methane
flammable
ignition
explosion
fire
h2s
hydrogen\s+sulfide
condensate
blowout
toxic\s+vapor
torch-cutting
torch\s+cutting
oxy-acetylene
hot\s+work
hot\s+slag
caustic(?:\s+soda)?
"""),
    "confined_space": whole(r"""
confined\s+space
tank\s+entry
vessel\s+entry
manhole
sewer
oxygen\s+deficien(?:cy|t)
toxic\s+atmosphere
manway
scrubber
vessel\s+inspection
nitrogen\s+pocket
"""),
    "rotating_equipment": whole(r"""
rotating\s+equipment
coupling
shaft
nip\s+point
pinch\s+point
conveyor
drive\s+belt
lathe
spindle
flywheel
rotational\s+load
pump
pumps
pump\s+guard
drive-train
"""),
    "hot_work_ignition": whole(r"""
hot\s+work
structural\s+welding
torch-cutting
torch\s+cutting
welding\s+sparks
open\s+flame
hot\s+slag
oxy-acetylene
"""),
    "line_of_fire": whole(r"""
line\s+of\s+fire
trajectory
recoil\s+path
whip\s+path
discharge\s+path
danger\s+zone\s+vector
"""),
    "thermal_energy": whole(r"""
superheated\s+steam
steam\s+leak
cryogenic
thermal\s+oil
molten\s+slag
extreme\s+heat
deep\s+freeze
"""),
    "stored_mechanical_energy": whole(r"""
tensioned\s+cable
winch\s+line
counterweight
spring\s+loaded
hydraulic\s+accumulator
whip\s+check
"""),
}

EXPOSURE_INTERRUPTED = whole(r"""
stop\s+work
stopped\s+work
work\s+stopped
work\s+halted
work\s+was\s+halted
aborted
retreated
stepped\s+back
pre-job\s+check
identified\s+before
identified\s+prior
refused\s+to\s+work
noticed\s+prior
restored\s+before
restored\s+prior
restored\s+properly
repaired\s+before
stopped\s+before
corrected\s+before\s+any\s+credible\s+exposure
stopped\s+at\s+.*?\s+before\s+a\s+person\s+occupied
activity\s+remained\s+controlled\s+at\s+.*?\s+before\s+anyone\s+crossed
""")

EXPOSURE_SAFE = whole(r"""
no\s+personnel\s+present
unmanned
remote\s+location
cleared\s+area
barricaded
safe\s+distance
safe\s+standoff\s+distance
standoff\s+distance
exclusion\s+zone\s+maintained
remained\s+outside\s+exclusion\s+zone
outside\s+(?:the\s+)?exclusion\s+zone
outside\s+(?:the\s+)?drop\s+zone
staged\s+safely\s+outside
staged\s+outside
remained\s+behind\s+segregation
behind\s+segregation
behind\s+designated\s+safety\s+barrier
remained\s+behind\s+(?:the\s+)?(?:designated\s+safety\s+|safety\s+|physical\s+)?barrier(?:s)?
did\s+not\s+enter\s+(?:the\s+)?(?:vehicle\s+)?path
behind\s+(?:an\s+|the\s+)?instrumented\s+console
monitoring\s+from\s+behind
(?:staged|remained)\s+.*?inside\s+(?:the\s+)?monitoring\s+trailer
remained\s+inside\s+(?:the\s+)?monitoring\s+trailer
ensured\s+no\s+personnel\s+were\s+stationed
keeping\s+all\s+.*?staged\s+safely\s+outside
nobody\s+exposed
no\s+injury
evacuated
protected\s+by\s+barrier
outside\s+danger\s+zone
remained\s+behind\s+(?:the\s+)?rail
behind\s+(?:the\s+)?rail
shielded\s+from\s+contact
pipelayers\s+working\s+inside\s+the\s+trench\s+box\s+.*?shielded
positioned\s+inside\s+(?:the\s+)?(?:shoring\s+|trench\s+)?box
inside\s+(?:the\s+)?(?:shoring\s+|trench\s+)?box
outside\s+(?:the\s+)?red\s+zone(?:\s+boundary)?
outside\s+the\s+red\s+zone
behind\s+(?:the\s+)?(?:driller(?:'s)?\s+)?(?:clear\s+)?(?:polycarbonate\s+)?(?:protective\s+)?shield
operating\s+(?:the\s+.*?sequence\s+)?via\s+remote
remote\s+joystick(?:\s+controls)?
from\s+behind\s+(?:a\s+)?polycarbonate\s+control\s+console
alarm\s+activated\s+before\s+any\s+crew\s+member\s+attempted\s+to\s+enter
no\s+entry\s+permits\s+had\s+been\s+requested\s+or\s+granted
no\s+spatter\s+risk\s+materialised
traffic\s+was\s+light\s+and\s+no\s+near\s+miss\s+resulted
by\s+chance\s+no\s+one\s+was\s+in\s+the\s+immediate\s+impact\s+zone
kept\s+all\s+foot\s+traffic\s+isolated
all\s+foot\s+traffic\s+isolated
no\s+personnel\s+were\s+under\s+(?:the\s+)?load
elevated\s+glass-enclosed\s+console
glass-enclosed\s+console\s+station
stayed\s+outside\s+(?:the\s+)?reversing\s+zone
stayed\s+outside\s+(?:the\s+)?(?:drive-train\s+)?envelope
prevented\s+personnel\s+from\s+entering(?:\s+the\s+movement\s+or\s+energy\s+path)?
corrected\s+before\s+any\s+credible\s+exposure\s+developed
replaced\s+before\s+(?:work\s+began|further\s+use|crew\s+approach|entry|use)
no\s+further\s+work\s+was\s+permitted\s+until
work\s+was\s+secured\s+at\s+.*?\s+after\s+(?:the\s+)?field\s+arrangement\s+had\s+been\s+rechecked
""")

EXPOSURE_DIRECT = whole(r"""
worker\s+struck
struck\s+by
caught\s+between
caught\s+in
pinch\s+point
crush(?:ed)?
fell
falling
fell\s+from
splashed
sprayed
sprayed\s+directly
exposed
worker\s+exposed
workers\s+exposed
exposed\s+directly
exposure\s+occurred
worker\s+exposure
exposure\s+beneath
in\s+(?:the\s+)?line\s+of\s+fire
struck\s+(?:a\s+|the\s+)?worker
struck\s+worker
pipe\s+whip\s+struck
hit\s+(?:a\s+|the\s+)?worker
in\s+the\s+path
in\s+path
in\s+vehicle\s+path
entered\s+vehicle\s+path
directly\s+in\s+front
in\s+front\s+of\s+moving
underneath
under\s+suspended
beneath\s+(?:the\s+)?suspended
stood\s+beneath
working\s+beneath
entered\s+(?:a\s+|the\s+)?(?:vessel|tank|confined\s+space|column|manway|compartment)
inside\s+(?:a\s+|the\s+)?(?:vessel|tank|confined\s+space|manhole|trench)
inside\s+vessel
inside\s+danger\s+zone
in\s+danger\s+zone
inside\s+exclusion\s+zone
entered\s+(?:the\s+)?exclusion\s+zone
inside\s+(?:the\s+)?lift\s+radius
under\s+lift\s+radius
stepped\s+past\s+(?:the\s+)?(?:plastic\s+tape|warning\s+tape|barrier)
crossed\s+inside\s+(?:the\s+)?(?:plastic\s+chain\s+)?barrier
hand\s+inside
inside\s+trench
entered\s+(?:an?\s+)?(?:un-shored\s+)?(?:vertical\s+cut|trench)
working\s+live
contact\s+with\s+energized
opened\s+energized
arc\s+flash
flashover
shock
electrocution
entangle(?:d|ment)
line\s+breaking
breaking\s+flange
unbolting\s+live
tighten(?:ing)?\s+(?:the\s+joint\s+|the\s+union\s+)?under\s+(?:live|active|pressure)
pulling\s+.*?into\s+pinch\s+point
released\s+toward\s+worker(?:s)?
released\s+toward\s+personnel
blew\s+past
narrowly\s+dodging
dodging\s+the\s+.*?trajectory
dodging\s+the\s+pressurized\s+mist
throwing\s+the\s+.*?into
projecting\s+the\s+.*?into
causing\s+injury
eye\s+injury
injury
injured
burn(?:ed)?
hospitalized
amputat(?:ion|ed)
worker\s+face
hit\s+worker
engulf(?:ed|ing)
tearing\s+muscle
severing\s+muscle
arterial\s+bleeding
fractur(?:ing|e)
laceration
tendon\s+damage
lost\s+consciousness
hypoxia
leaned\s+.*?through\s+the\s+manway
leaned\s+torso\s+through\s+the\s+hatch
into\s+(?:the\s+)?nitrogen\s+pocket
anoxia
threads\s+stripped\s+off
projecting\s+the\s+steel\s+nipple
tire\s+rolled\s+over
pinning\s+the\s+foot
bone\s+contusions
deep\s+lacerations\s+and\s+multiple\s+tendon\s+tears
first-degree\s+burns
struck\s+a\s+nearby\s+handrail
damaged/frayed\s+after\s+the\s+person\s+had\s+already\s+begun\s+work
frayed\s+after\s+the\s+person\s+had\s+already\s+begun\s+work
worked\s+at\s+(?:\d+.*?\b)?height
working\s+at\s+(?:\d+.*?\b)?height
worked\s+at\s+elevated
working\s+at\s+elevated
worked\s+on\s+elevated
working\s+on\s+elevated
(?:head|chest|body|torso)\s+beneath
missing\s+.*?head\s+by
in\s+front\s+of\s+(?:a\s+|the\s+)?(?:[a-z]+\s+)?(?:worker|engineer|personnel|technician|operator|helper|them)
where\s+(?:the\s+)?(?:worker|welder|operator|technician|personnel)\s+was\s+(?:actively\s+)?standing
(?:panel\s+operator|entrant|technician|worker|personnel|crew|supervisor|mechanic|electrician|welder|fitter|helper)\s+entered
entered\s+without\s+(?:continuous\s+)?(?:atmospheric\s+|gas\s+)?monitoring
(?:energized-panel\s+interface\s+)?was\s+not\s+closed\s+off\s+from
could\s+not\s+avoid\s+contact(?:\s+with\s+live\s+parts)?
remained\s+within\s+reach\s+of\s+(?:an\s+)?uncontrolled\s+release
trajectory\s+pointed\s+toward
(?:direct\s+)?contact\s+trajectory
exposure\s+pathway\s+affecting\s+(?:the\s+)?(?:field\s+operator|worker|technician|personnel|crew|scaffolder|fitter|welder)
(?:worked|working)\s+(?:at|on)\s+\d+\s+met(?:er|re)s(?:\s+elevation)?
mechanic\s+on\s+duty\s+was\s+working\s+at
(?:leak|leaked|leaking|spray|sprayed)\s+onto\s+(?:the\s+)?(?:technician|worker|personnel|crew|operator|individual|person)
maintenance\s+on\s+.*?(?:switchgear|cubicle|breaker|transformer|substation)
operator\s+reached
reached\s+into
within\s+reach\s+of\s+moving
within\s+reach\s+of\s+rotating
within\s+reach\s+of\s+pinch
""")

CONTROL_COMPROMISED = whole(r"""
bypassed
interlock\s+bypassed
missing\s+guard
guard\s+removed
guard\s+was\s+removed
coupling\s+guard\s+was\s+removed
unguarded
had\s+been\s+removed
had\s+been\s+left\s+off
left\s+off
without\s+reinstalling
started\s+without\s+reinstalling
without\s+permit
without\s+obtaining\s+(?:an?\s+)?(?:entry\s+)?permit
no\s+loto
without\s+(?:lockout|loto)(?:\s+applied)?
lockout\s+not\s+applied
lockout\s+was\s+not\s+applied
isolation\s+failed
failed\s+to\s+hold
defective
corroded
inadequate
breach(?:ed)?
not\s+isolated
unsecured
unauthorized
failed
not\s+hooked
not\s+tied\s+off
not\s+anchored
unanchored
unhitched\s+(?:both\s+)?(?:harness\s+)?lanyards
(?:harness\s+)?lanyards?\s+(?:were|was)?\s*(?:unhitched|unclipped|detached)
unhitched
unclipped
detached\s+harness
no\s+harness
not\s+worn
isolation\s+not\s+verified
not\s+verified\s+before
not\s+verified
omitted\s+opening\s+(?:the\s+)?(?:casing\s+)?bleeder\s+port
omitted\s+opening\s+(?:the\s+)?(?:casing\s+)?bleed
omitted\s+to\s+prove\s+zero\s+energy
positive\s+isolation\s+blinds\s+pending
blind\s+flanges\s+pending\s+installation
no\s+atmospheric\s+testing\s+had\s+been\s+completed
was\s+absent
were\s+absent
no\s+drop\s+zone\s+netting
had\s+not\s+been\s+installed
no\s+mechanical\s+jack\s+stands
jack\s+seal\s+ruptured
seal\s+ruptured
rolled\s+past\s+(?:a\s+)?fire\s+blanket
bypassed\s+trench\s+shoring(?:\s+boxes)?
un-shored
never\s+rodded\s+out
plugged\s+with\s+scale
tighten\s+under\s+live\s+pressure
tighten\s+under\s+active\s+load
tighten\s+(?:the\s+)?union\s+under\s+(?:active\s+)?(?:hydraulic\s+)?load
threads\s+stripped\s+off
threads\s+stripped
blew\s+past\s+the\s+gasket
stem\s+packing\s+failed
residual\s+pressure\s+was\s+released
(?:pressurized\s+mist|pressurized\s+fluid|pressurized\s+spray|hydrocarbon\s+leak|fluid|gas)\s+(?:was\s+)?released\s+toward
sling\s+unseated
sling\s+parted
rigging\s+sling\s+unseated
rigging\s+failed
dropped\s+the\s+assembly
dropping\s+the\s+assembly
valve\s+passing
passing\s+valve
reverse\s+alarm\s+was\s+disabled
alarm\s+was\s+disabled
severed\s+wiring\s+harness
broken\s+backup\s+alarm
damaged/frayed
found\s+damaged(?:/frayed)?
frayed\s+lanyard
disconnected
lifeline\s+disconnected
without\s+shoring
wall\s+collapsed
entered\s+(?:the\s+)?exclusion\s+zone
entered\s+vehicle\s+path
stepped\s+past\s+(?:the\s+)?(?:plastic\s+tape\s+|warning\s+tape\s+)?barrier
crossed\s+inside\s+(?:the\s+)?(?:plastic\s+chain\s+)?barrier
beneath\s+suspended
stood\s+beneath
under\s+suspended
working\s+beneath
rule\s+violated\s+during\s+event
violated\s+during\s+event
isolation\s+point\s+was\s+found\s+defective
isolation\s+point\s+found\s+defective
lost\s+consciousness\s+instantly\s+from\s+severe\s+anoxia
nitrogen\s+pocket
(?:was\s+)?incorrectly\s+applied(?:\s+to\s+(?:the\s+)?wrong(?:\s+isolation)?\s+point)?
wrong\s+isolation\s+point
(?:lockout\s+|isolation\s+)?verification\s+(?:at\s+.*?\s+)?had\s+degraded
(?:was\s+)?not\s+maintained(?:\s+for\s+the\s+duration)?
(?:was\s+)?assumed\s+to\s+be\s+in\s+place\s+but\s+(?:was\s+)?never(?:\s+independently)?\s+verified
relied\s+upon\s+without\s+(?:the\s+)?required\s+(?:independent\s+)?check
without\s+(?:continuous\s+)?(?:atmospheric\s+|gas\s+)?monitoring
guardrail\s+.*?was\s+missing
missing\s+on\s+one\s+side
zero-energy\s+verification\s+was\s+skipped
movement\s+control\s+was\s+inadequate
contrary\s+to\s+procedure
""")

CONTROL_EFFECTIVE = whole(r"""
interlock\s+engaged
auto(?:matic)?-shutdown
trip\s+activated
trip\s+valve
relief\s+valve\s+lifted\s+safely
ppe\s+prevented
safely\s+contained
isolated\s+properly
barricade\s+prevented
alarm\s+sounded\s+and\s+crew\s+cleared
harness\s+arrested
fall\s+arrested
arresting\s+the\s+fall
shock\s+pack\s+deployed
guardrail\s+held
zero\s+energy\s+verified
zero\s+process\s+pressure
zero\s+gauge\s+pressure
isolation\s+verified
isolation\s+valves\s+held
held\s+absolute\s+isolation
valves\s+held\s+absolute\s+isolation
fully\s+depressurized
depressurized\s+to\s+zero
fall\s+arrest\s+(?:system\s+)?(?:was\s+)?installed\s+and\s+verified
installed\s+and\s+verified
verified\s+prior\s+to\s+ascending
segregation\s+walkway\s+barriers
behind\s+segregation
designated\s+safety\s+barrier
cordoned\s+drop\s+zone
perimeter\s+fences\s+were\s+fully\s+active
rigid\s+(?:interlocking\s+|timber\s+)?barricades
blast\s+(?:containment\s+)?barricade(?:s)?
mesh\s+guard
safety\s+shields\s+in\s+place
hit\s+the\s+interior\s+(?:wall|plate)\s+of
arrested\s+the\s+dynamic\s+weight
restored\s+properly
restored\s+before
safety\s+netting\s+caught
netting\s+caught
caught\s+by\s+netting
positive\s+mechanical\s+blinds
positive\s+blinds
continuous\s+gas\s+testing\s+confirmed
wearing\s+seatbelt
crash\s+bollard\s+arrested
crash\s+bollard
bolted\s+(?:galvanized\s+)?steel\s+barrier(?:s)?
continuous\s+bolted\s+(?:galvanized\s+)?steel\s+barriers
certified\s+steel\s+shoring\s+box
steel\s+shoring\s+box\s+deployed
trench\s+box\s+deployed
trench\s+shield\s+held\s+firm
rock\s+stopped\s+against\s+(?:the\s+)?outer\s+spreader\s+bar
coupling\s+guard\s+contained
contained\s+(?:the\s+)?sheared\s+hardware
heavy\s+steel\s+mesh\s+locked\s+cover\s+was\s+securely\s+bolted
locked\s+cover\s+was\s+securely\s+bolted
(?:coupling\s+guard|guard|cover)\s+was\s+securely\s+bolted
securely\s+bolted
dedicated\s+fire\s+watch\s+.*?immediately\s+doused
fire\s+watch\s+.*?immediately\s+doused
polycarbonate\s+control\s+console
polycarbonate\s+protective\s+shield
verified\s+zero\s+hazardous\s+voltage
remained\s+fully\s+locked\s+out
retaining\s+all\s+soil\s+mass\s+outside
shielded\s+from\s+contact
sustained\s+zero\s+deflection
sustained\s+no\s+deflection
safety\s+cribbing(?:\s+blocks)?
solid\s+oak\s+safety\s+cribbing
timber\s+packing
spring-loaded\s+breakaway\s+valve
breakaway\s+valve\s+slammed\s+shut
curbed\s+(?:acid-brick\s+)?containment\s+tray
fire\s+watch\s+.*?smothered\s+(?:the\s+)?flame
dry\s+chemical\s+extinguisher\s+within
fail-closed\s+seat
traveled\s+to\s+(?:its\s+)?designed\s+fail-closed
isolation\s+(?:was\s+)?(?:independently\s+)?verified
control\s+(?:was\s+)?effective(?:\s+before)?
(?:mechanical\s+|energy\s+)?isolation\s+(?:at\s+.*?\s+)?held\s+throughout
(?:isolation\s+and\s+)?(?:physical\s+)?guarding\s+(?:were|was)\s+established(?:\s+before\s+access)?
direct\s+control\s+(?:and\s+isolation\s+)?prevented(?:\s+personnel)?
tested\s+and\s+demonstrated\s+to\s+be\s+functioning(?:\s+as\s+intended)?
reversing\s+alarm\s+(?:check\s+)?(?:at\s+.*?\s+)?held\s+throughout
lifting\s+path\s+was\s+controlled
replaced\s+before\s+(?:work\s+began|further\s+use|crew\s+approach|entry|use)
re-confirmed\s+after\s+a\s+shift\s+change\s+with\s+no\s+gap\s+in\s+coverage
verified\s+cooling\s+and\s+venting\s+sequence
verified\s+impairment\s+permit
""")

MECHANISMS = {
    "fall": (r"\b(?:fall(?:en|ing)?|fell\s+from|plummet(?:ed)?|dropped\s+from\s+height)\b",),
    "struck_by": (r"\b(?:struck\s+by|hit\s+by|impacted\s+by|struck\s+(?:a\s+|the\s+)?worker|struck\s+worker|blow\s+from)\b",),
    "caught_between": (r"\b(?:caught\s+between|pinch(?:ed)?|pinned\s+between|trapped\s+between)\b",),
    "entanglement": (
        r"\b(?:entangle(?:d|ment)?|drawn\s+into|pulled\s+into\s+shaft|caught\s+in\s+rotating|nip\s+point|rotating\s+nip\s+point)\b",),
    "crushing": (r"\b(?:crush(?:ed|ing)?|pinned\s+under|runover|compressed\s+under)\b",),
    "amputation": (r"\b(?:amputat(?:ed|ion)?|sever(?:ed|ing)?\s+limb|severing\s+muscle|severing\s+finger)\b",),
    "electrical_contact": (r"\b(?:electrocution|electric\s+shock|contact\s+with\s+live|contact\s+with\s+energized)\b",),
    "arc_flash": (r"\b(?:arc\s+flash|flashover|electrical\s+blast|arc\s+blast)\b",),
    "pressure_release": (r"\b(?:pressure\s+release|depressuriz(?:ed|ation)|pressurized\s+spray|blown\s+out|pipe\s+burst)\b",),
    "fluid_injection": (r"\b(?:fluid\s+injection|hydraulic\s+injection|penetrat(?:ed|ion)\s+under\s+pressure)\b",),
    "projectile": (r"\b(?:projectile|flying\s+fragment|shrapnel|ejected\s+fitting|whipping\s+hose)\b",),
    "fire": (r"\b(?:fire|flame|ignit(?:ed|ion)|burning|combustion)\b",),
    "flash_fire": (r"\b(?:flash\s+fire|vapor\s+fire|fireball)\b",),
    "explosion": (r"\b(?:explosion|blast|detonation|overpressure\s+wave)\b",),
    "toxic_exposure": (r"\b(?:toxic\s+exposure|chemical\s+exposure|poisoning|toxic\s+vapor|inhalation\s+of\s+toxic)\b",),
    "asphyxiation": (r"\b(?:asphyxiat(?:ed|ion)?|hypoxia|anoxia|oxygen\s+starvation|suffocat(?:ed|ion)?)\b",),
    "engulfment": (r"\b(?:engulf(?:ed|ment)?|soil\s+engulfment|sand\s+collapse|liquid\s+submersion)\b",),
    "dropped_object": whole(r"""
dropped\s+object
falling\s+object
object\s+fell
dropped\s+from
fallen\s+tool
dropped\s+tool
dropped\s+clamp
dropped\s+pipe
dropped\s+tubular
struck\s+by\s+falling
impact\s+from\s+dropped
tool\s+fell
"""),
}
