"""Canonical names of every entity type and their spellings, complete and in order. Site names are a parameter."""

# Fixed values.
LOCATIONS = (
    "Loading Rack", "Workshop/Maintenance Bay", "Tank Farm", "Produced Water Treatment", "Jetty/Marine Terminal",
    "Cooling Tower Area", "Compressor Station", "Wellhead Platform", "Pipeline ROW", "Mud Pit Area", "Sand Trap Area",
    "Drill Floor", "Electrical Substation", "Flare Area", "Warehouse / Storage Yard", "Control Room",
    "Offsite / Public Road",
)
LOCATION_NAMES = {
    "jetty": "Jetty/Marine Terminal",
    "marine terminal": "Jetty/Marine Terminal",
    "marine jetty": "Jetty/Marine Terminal",
    "dock": "Jetty/Marine Terminal",
    "wharf": "Jetty/Marine Terminal",
    "berth": "Jetty/Marine Terminal",
    "tank farm": "Tank Farm",
    "tankfarm": "Tank Farm",
    "tanks": "Tank Farm",
    "storage tank area": "Tank Farm",
    "tank battery": "Tank Farm",
    "drill floor": "Drill Floor",
    "rig floor": "Drill Floor",
    "derrick": "Drill Floor",
    "derrick floor": "Drill Floor",
    "rotary table area": "Drill Floor",
    "wellhead": "Wellhead Platform",
    "well head": "Wellhead Platform",
    "wellhead platform": "Wellhead Platform",
    "whp": "Wellhead Platform",
    "christmas tree area": "Wellhead Platform",
    "compressor station": "Compressor Station",
    "compressor": "Compressor Station",
    "comp station": "Compressor Station",
    "gas compression": "Compressor Station",
    "cooling tower": "Cooling Tower Area",
    "cooling tower area": "Cooling Tower Area",
    "workshop": "Workshop/Maintenance Bay",
    "maintenance bay": "Workshop/Maintenance Bay",
    "maint bay": "Workshop/Maintenance Bay",
    "mech shop": "Workshop/Maintenance Bay",
    "fab shop": "Workshop/Maintenance Bay",
    "loading rack": "Loading Rack",
    "truck loading rack": "Loading Rack",
    "loading bay": "Loading Rack",
    "gantry": "Loading Rack",
    "pipeline row": "Pipeline ROW",
    "pipeline": "Pipeline ROW",
    "right of way": "Pipeline ROW",
    "flowline": "Pipeline ROW",
    "manifold area": "Pipeline ROW",
    "produced water treatment": "Produced Water Treatment",
    "water treatment": "Produced Water Treatment",
    "pwt": "Produced Water Treatment",
    "effluent treatment": "Produced Water Treatment",
    "mud pit": "Mud Pit Area",
    "mud pit area": "Mud Pit Area",
    "mud pits": "Mud Pit Area",
    "sand trap": "Sand Trap Area",
    "sand trap area": "Sand Trap Area",
    "substation": "Electrical Substation",
    "switchgear room": "Electrical Substation",
    "transformer yard": "Electrical Substation",
    "flare": "Flare Area",
    "flare pit": "Flare Area",
    "flare stack": "Flare Area",
    "warehouse": "Warehouse / Storage Yard",
    "storage yard": "Warehouse / Storage Yard",
    "pipe yard": "Warehouse / Storage Yard",
    "stores": "Warehouse / Storage Yard",
    "control room": "Control Room",
    "ccr": "Control Room",
}

# Fixed values.
DEPARTMENTS = (
    "Drilling", "Workover", "Refinery Operations", "Mechanical Maintenance", "Electrical Maintenance",
    "Instrumentation", "Civil", "Logistics & Stores", "Security", "HSE / Safety", "Production Operations",
    "Pipeline Operations",
)
DEPARTMENT_ALIASES = {
    "drilling": "Drilling",
    "drill ops": "Drilling",
    "drilling operations": "Drilling",
    "rig operations": "Drilling",
    "workover": "Workover",
    "well intervention": "Workover",
    "snubbing": "Workover",
    "wireline": "Workover",
    "refinery": "Refinery Operations",
    "refinery operations": "Refinery Operations",
    "refinery ops": "Refinery Operations",
    "refining": "Refinery Operations",
    "process operations": "Refinery Operations",
    "mechanical": "Mechanical Maintenance",
    "mechanical maintenance": "Mechanical Maintenance",
    "mech": "Mechanical Maintenance",
    "mech maint": "Mechanical Maintenance",
    "electrical": "Electrical Maintenance",
    "electrical maintenance": "Electrical Maintenance",
    "elec": "Electrical Maintenance",
    "elec maint": "Electrical Maintenance",
    "instrumentation": "Instrumentation",
    "i c": "Instrumentation",
    "instrumentation and control": "Instrumentation",
    "inst": "Instrumentation",
    "civil": "Civil",
    "civil engineering": "Civil",
    "construction": "Civil",
    "logistics": "Logistics & Stores",
    "logistics stores": "Logistics & Stores",
    "stores": "Logistics & Stores",
    "supply chain": "Logistics & Stores",
    "materials": "Logistics & Stores",
    "security": "Security",
    "hse": "HSE / Safety",
    "safety": "HSE / Safety",
    "ehs": "HSE / Safety",
    "occupational health": "HSE / Safety",
    "production": "Production Operations",
    "production operations": "Production Operations",
    "operations": "Production Operations",
    "pipeline": "Pipeline Operations",
    "pipeline operations": "Pipeline Operations",
}

# Fixed values.
JOB_TASKS = (
    "Hot Work in Classified Area", "Confined Space Vessel Entry", "Work at Height / Scaffold Work",
    "Lifting Operations / Rigging", "Safe Mechanical Lifting", "Energy Isolation / LOTO",
    "Wellhead Pressure Control Intervention", "Pipeline Tie-In / Hot Tap", "Marine Hydrocarbon Transfer",
    "Internal Pressure Vessel Cleaning", "Excavation / Trenching", "Vehicle Operation / Road Transport",
    "Vehicle Maintenance / Servicing", "Electrical Maintenance / Switching", "Chemical Handling / Sampling",
    "Permit to Work / Work Authorization", "Routine Maintenance / Inspection",
)
JOB_TASK_ALIASES = {
    "hot work in a hydrocarbon classified area": "Hot Work in Classified Area",
    "hot work in classified area": "Hot Work in Classified Area",
    "hot work": "Hot Work in Classified Area",
    "welding": "Hot Work in Classified Area",
    "cutting and welding": "Hot Work in Classified Area",
    "torch cutting": "Hot Work in Classified Area",
    "confined space vessel entry": "Confined Space Vessel Entry",
    "confined space entry": "Confined Space Vessel Entry",
    "tank entry": "Confined Space Vessel Entry",
    "vessel entry": "Confined Space Vessel Entry",
    "manhole entry": "Confined Space Vessel Entry",
    "work at height scaffold work": "Work at Height / Scaffold Work",
    "work at height": "Work at Height / Scaffold Work",
    "working at height": "Work at Height / Scaffold Work",
    "scaffolding": "Work at Height / Scaffold Work",
    "scaffold erection": "Work at Height / Scaffold Work",
    "work on a floating or fixed tank roof": "Work at Height / Scaffold Work",
    "tank roof work": "Work at Height / Scaffold Work",
    "lifting operations rigging": "Lifting Operations / Rigging",
    "lifting operations": "Lifting Operations / Rigging",
    "lifting operation": "Safe Mechanical Lifting",
    "material lifting": "Safe Mechanical Lifting",
    "lifting materials": "Safe Mechanical Lifting",
    "safe mechanical lifting": "Safe Mechanical Lifting",
    "mechanical lifting": "Safe Mechanical Lifting",
    "lifting": "Safe Mechanical Lifting",
    "safe lifting": "Safe Mechanical Lifting",
    "crane lift": "Lifting Operations / Rigging",
    "crane operation": "Lifting Operations / Rigging",
    "rigging": "Lifting Operations / Rigging",
    "heavy lift": "Lifting Operations / Rigging",
    "energy isolation loto": "Energy Isolation / LOTO",
    "energy isolation": "Energy Isolation / LOTO",
    "loto": "Energy Isolation / LOTO",
    "lockout tagout": "Energy Isolation / LOTO",
    "isolation and de energization": "Energy Isolation / LOTO",
    "wellhead pressure control intervention": "Wellhead Pressure Control Intervention",
    "wellhead intervention": "Wellhead Pressure Control Intervention",
    "pressure control": "Wellhead Pressure Control Intervention",
    "bop testing": "Wellhead Pressure Control Intervention",
    "pipeline tie in hot tap operation": "Pipeline Tie-In / Hot Tap",
    "pipeline tie in hot tap": "Pipeline Tie-In / Hot Tap",
    "hot tap": "Pipeline Tie-In / Hot Tap",
    "pipeline tie in": "Pipeline Tie-In / Hot Tap",
    "marine hydrocarbon transfer at the jetty": "Marine Hydrocarbon Transfer",
    "marine hydrocarbon transfer": "Marine Hydrocarbon Transfer",
    "jetty loading": "Marine Hydrocarbon Transfer",
    "bunkering": "Marine Hydrocarbon Transfer",
    "ship to shore transfer": "Marine Hydrocarbon Transfer",
    "internal cleaning of a pressure vessel": "Internal Pressure Vessel Cleaning",
    "internal pressure vessel cleaning": "Internal Pressure Vessel Cleaning",
    "vessel descaling": "Internal Pressure Vessel Cleaning",
    "tank cleaning": "Internal Pressure Vessel Cleaning",
    "excavation trenching": "Excavation / Trenching",
    "excavation": "Excavation / Trenching",
    "trenching": "Excavation / Trenching",
    "digging": "Excavation / Trenching",
    "vehicle operation road transport": "Vehicle Operation / Road Transport",
    "driving": "Vehicle Operation / Road Transport",
    "vehicle transport": "Vehicle Operation / Road Transport",
    "road haulage": "Vehicle Operation / Road Transport",
    "vehicle maintenance": "Vehicle Maintenance / Servicing",
    "truck maintenance": "Vehicle Maintenance / Servicing",
    "fleet maintenance": "Vehicle Maintenance / Servicing",
    "fleet servicing": "Vehicle Maintenance / Servicing",
    "vehicle servicing": "Vehicle Maintenance / Servicing",
    "electrical maintenance switching": "Electrical Maintenance / Switching",
    "electrical switching": "Electrical Maintenance / Switching",
    "breaker servicing": "Electrical Maintenance / Switching",
    "chemical handling sampling": "Chemical Handling / Sampling",
    "chemical sampling": "Chemical Handling / Sampling",
    "permit to work": "Permit to Work / Work Authorization",
    "work permit": "Permit to Work / Work Authorization",
    "ptw": "Permit to Work / Work Authorization",
    "work authorization": "Permit to Work / Work Authorization",
    "work authorisation": "Permit to Work / Work Authorization",
    "permit": "Permit to Work / Work Authorization",
    "authorization": "Permit to Work / Work Authorization",
    "routine maintenance inspection": "Routine Maintenance / Inspection",
    "inspection": "Routine Maintenance / Inspection",
}

# Fixed values.
EQUIPMENT = (
    "Chemical Pump", "Hydraulic Press", "Electrical Panel", "Portable Generator", "Step Ladder", "Extension Ladder",
    "Hand Truck", "Angle Grinder", "Pressure Washer", "Compressed Air Line", "Boom Lift / MEWP", "Crane / Hoist",
    "Storage Tank", "Pressure Vessel", "Compressor", "Forklift", "Scaffolding", "Welding Machine", "Heat Exchanger",
    "Centrifugal Separator",
)
EQUIPMENT_ALIASES = {
    "chemical pump": "Chemical Pump",
    "pump": "Chemical Pump",
    "dosing pump": "Chemical Pump",
    "hydraulic press": "Hydraulic Press",
    "press": "Hydraulic Press",
    "electrical panel": "Electrical Panel",
    "panel": "Electrical Panel",
    "switchboard": "Electrical Panel",
    "mcc": "Electrical Panel",
    "portable generator": "Portable Generator",
    "generator": "Portable Generator",
    "genset": "Portable Generator",
    "step ladder": "Step Ladder",
    "ladder": "Step Ladder",
    "extension ladder": "Extension Ladder",
    "hand truck": "Hand Truck",
    "dolly": "Hand Truck",
    "trolley": "Hand Truck",
    "angle grinder": "Angle Grinder",
    "grinder": "Angle Grinder",
    "disc cutter": "Angle Grinder",
    "pressure washer": "Pressure Washer",
    "hydrojet": "Pressure Washer",
    "power washer": "Pressure Washer",
    "compressed air line": "Compressed Air Line",
    "air line": "Compressed Air Line",
    "pneumatic hose": "Compressed Air Line",
    "boom lift mewp": "Boom Lift / MEWP",
    "boom lift": "Boom Lift / MEWP",
    "mewp": "Boom Lift / MEWP",
    "cherry picker": "Boom Lift / MEWP",
    "manlift": "Boom Lift / MEWP",
    "scissor lift": "Boom Lift / MEWP",
    "crane hoist": "Crane / Hoist",
    "crane": "Crane / Hoist",
    "overhead crane": "Crane / Hoist",
    "hoist": "Crane / Hoist",
    "winch": "Crane / Hoist",
    "storage tank": "Storage Tank",
    "tank": "Storage Tank",
    "pressure vessel": "Pressure Vessel",
    "vessel": "Pressure Vessel",
    "separator": "Centrifugal Separator",
    "centrifugal separator": "Centrifugal Separator",
    "compressor": "Compressor",
    "forklift": "Forklift",
    "fork lift": "Forklift",
    "scaffolding": "Scaffolding",
    "scaffold": "Scaffolding",
    "welding machine": "Welding Machine",
    "welder": "Welding Machine",
    "heat exchanger": "Heat Exchanger",
}

# Fixed values.
ENERGY_SOURCES = (
    "Gravity / Working at Height", "Electrical", "Mechanical Motion / Rotating Equipment", "Pressure / Stored Energy",
    "Chemical / Toxic / Flammable", "Thermal (Extreme Heat/Cold)", "Radiation", "Sound / Noise",
    "Motor Vehicle / Driving", "Other", "Unknown / Not Determined",
)
ENERGY_ALIASES = {
    "gravity_height": "Gravity / Working at Height",
    "gravity height": "Gravity / Working at Height",
    "gravity": "Gravity / Working at Height",
    "height": "Gravity / Working at Height",
    "fall": "Gravity / Working at Height",
    "electrical": "Electrical",
    "electric": "Electrical",
    "high voltage": "Electrical",
    "arc flash": "Electrical",
    "mechanical_motion": "Mechanical Motion / Rotating Equipment",
    "mechanical motion": "Mechanical Motion / Rotating Equipment",
    "mechanical": "Mechanical Motion / Rotating Equipment",
    "rotating equipment": "Mechanical Motion / Rotating Equipment",
    "pinch point": "Mechanical Motion / Rotating Equipment",
    "pressure": "Pressure / Stored Energy",
    "stored energy": "Pressure / Stored Energy",
    "high pressure": "Pressure / Stored Energy",
    "hydraulic": "Pressure / Stored Energy",
    "pneumatic": "Pressure / Stored Energy",
    "chemical": "Chemical / Toxic / Flammable",
    "toxic": "Chemical / Toxic / Flammable",
    "flammable": "Chemical / Toxic / Flammable",
    "hydrocarbon": "Chemical / Toxic / Flammable",
    "h2s": "Chemical / Toxic / Flammable",
    "thermal": "Thermal (Extreme Heat/Cold)",
    "heat": "Thermal (Extreme Heat/Cold)",
    "cold": "Thermal (Extreme Heat/Cold)",
    "hot surface": "Thermal (Extreme Heat/Cold)",
    "radiation": "Radiation",
    "sound": "Sound / Noise",
    "noise": "Sound / Noise",
    "motor_vehicle": "Motor Vehicle / Driving",
    "motor vehicle": "Motor Vehicle / Driving",
    "driving": "Motor Vehicle / Driving",
    "vehicle": "Motor Vehicle / Driving",
    "other": "Other",
    "unknown": "Unknown / Not Determined",
}

# Fixed values.
CONTROL_TYPES = (
    "LOTO / Energy Isolation (Direct)", "Machine Guarding / Interlocks (Direct)",
    "Physical Barrier / Exclusion Zone (Direct)", "Fall Protection / Harness / Railing (Direct)",
    "Permit-Based Isolation / Hot Work Control (Direct)", "Ventilation / Atmospheric Monitoring (Direct)",
    "Training / Competency (Indirect)", "Signage / Warnings (Indirect)", "Personal Protective Equipment (Indirect)",
    "Rules / Safe Working Procedures (Indirect)", "Supervision / Experience (Indirect)", "Other Control",
    "Unknown / Not Determined",
)
CONTROL_TYPE_ALIASES = {
    "loto_isolation": "LOTO / Energy Isolation (Direct)",
    "loto isolation": "LOTO / Energy Isolation (Direct)",
    "loto": "LOTO / Energy Isolation (Direct)",
    "lockout tagout": "LOTO / Energy Isolation (Direct)",
    "isolation": "LOTO / Energy Isolation (Direct)",
    "machine_guarding": "Machine Guarding / Interlocks (Direct)",
    "machine guarding": "Machine Guarding / Interlocks (Direct)",
    "guard": "Machine Guarding / Interlocks (Direct)",
    "guarding": "Machine Guarding / Interlocks (Direct)",
    "interlock": "Machine Guarding / Interlocks (Direct)",
    "physical_barrier": "Physical Barrier / Exclusion Zone (Direct)",
    "physical barrier": "Physical Barrier / Exclusion Zone (Direct)",
    "barrier": "Physical Barrier / Exclusion Zone (Direct)",
    "barricade": "Physical Barrier / Exclusion Zone (Direct)",
    "exclusion zone": "Physical Barrier / Exclusion Zone (Direct)",
    "fall_protection": "Fall Protection / Harness / Railing (Direct)",
    "fall protection": "Fall Protection / Harness / Railing (Direct)",
    "harness": "Fall Protection / Harness / Railing (Direct)",
    "lifeline": "Fall Protection / Harness / Railing (Direct)",
    "railing": "Fall Protection / Harness / Railing (Direct)",
    "permit_isolation": "Permit-Based Isolation / Hot Work Control (Direct)",
    "permit isolation": "Permit-Based Isolation / Hot Work Control (Direct)",
    "permit to work": "Permit-Based Isolation / Hot Work Control (Direct)",
    "ptw": "Permit-Based Isolation / Hot Work Control (Direct)",
    "ventilation_monitoring": "Ventilation / Atmospheric Monitoring (Direct)",
    "ventilation monitoring": "Ventilation / Atmospheric Monitoring (Direct)",
    "gas testing": "Ventilation / Atmospheric Monitoring (Direct)",
    "gas detection": "Ventilation / Atmospheric Monitoring (Direct)",
    "training": "Training / Competency (Indirect)",
    "competency": "Training / Competency (Indirect)",
    "signage": "Signage / Warnings (Indirect)",
    "warning sign": "Signage / Warnings (Indirect)",
    "ppe": "Personal Protective Equipment (Indirect)",
    "personal protective equipment": "Personal Protective Equipment (Indirect)",
    "safety glasses": "Personal Protective Equipment (Indirect)",
    "rules_procedures": "Rules / Safe Working Procedures (Indirect)",
    "rules procedures": "Rules / Safe Working Procedures (Indirect)",
    "sop": "Rules / Safe Working Procedures (Indirect)",
    "supervision": "Supervision / Experience (Indirect)",
    "other": "Other Control",
    "unknown": "Unknown / Not Determined",
}

# Fixed values.
CONTROL_CONDITIONS = (
    "Effective / Held", "Failed", "Absent / Not Implemented", "Bypassed / Defeated", "Unknown / Not Determined",
)
CONTROL_CONDITION_ALIASES = {
    "effective": "Effective / Held",
    "held": "Effective / Held",
    "prevented": "Effective / Held",
    "intact": "Effective / Held",
    "failed": "Failed",
    "failure": "Failed",
    "broke": "Failed",
    "malfunctioned": "Failed",
    "inadequate": "Failed",
    "absent": "Absent / Not Implemented",
    "missing": "Absent / Not Implemented",
    "not implemented": "Absent / Not Implemented",
    "none": "Absent / Not Implemented",
    "bypassed": "Bypassed / Defeated",
    "defeated": "Bypassed / Defeated",
    "overridden": "Bypassed / Defeated",
    "disabled": "Bypassed / Defeated",
    "unknown": "Unknown / Not Determined",
}

# Fixed values.
LIFE_SAVING_RULES = (
    "Bypassing Safety Controls", "Confined Space", "Driving", "Energy Isolation", "Hot Work", "Line of Fire",
    "Safe Mechanical Lifting", "Work Authorization", "Working at Height",
)
RULE_ALIASES = {
    "bypassing safety controls": "Bypassing Safety Controls",
    "bypassing controls": "Bypassing Safety Controls",
    "bypass controls": "Bypassing Safety Controls",
    "bypassing": "Bypassing Safety Controls",
    "confined space": "Confined Space",
    "confined spaces": "Confined Space",
    "confined space entry": "Confined Space",
    "driving": "Driving",
    "safe driving": "Driving",
    "energy isolation": "Energy Isolation",
    "isolation": "Energy Isolation",
    "loto": "Energy Isolation",
    "lockout tagout": "Energy Isolation",
    "hot work": "Hot Work",
    "hotwork": "Hot Work",
    "line of fire": "Line of Fire",
    "line-of-fire": "Line of Fire",
    "struck by": "Line of Fire",
    "safe mechanical lifting": "Safe Mechanical Lifting",
    "mechanical lifting": "Safe Mechanical Lifting",
    "lifting": "Safe Mechanical Lifting",
    "safe lifting": "Safe Mechanical Lifting",
    "work authorization": "Work Authorization",
    "work permit": "Work Authorization",
    "permit to work": "Work Authorization",
    "ptw": "Work Authorization",
    "working at height": "Working at Height",
    "work at height": "Working at Height",
    "height": "Working at Height",
    "fall protection": "Working at Height",
}

# Fixed values.
HAZARD_FAMILIES = (
    "Working at Height", "Suspended Loads / Mechanical Lifting", "Line of Fire", "Pressure / Stored Energy Release",
    "Electrical Energy / Arc Flash", "Vehicle & Mobile Equipment", "Rotating Equipment / Mechanical In-Running Nips",
    "Hot Work & Ignition Sources", "Confined Space / Engulfment", "Hydrocarbon & Flammable Chemical Release",
    "Toxic & Asphyxiant Atmosphere", "Thermal Energy (Extreme Heat / Cryogenic)",
    "Stored Mechanical Energy (Springs / Tension)", "Excavation & Ground Collapse",
    "Dropped Objects (Dynamic Gravity Impact)",
)
HAZARD_ALIASES = {
    "working at height": "Working at Height",
    "work at height": "Working at Height",
    "fall from height": "Working at Height",
    "fall from elevation": "Working at Height",
    "gravity": "Working at Height",
    "suspended loads": "Suspended Loads / Mechanical Lifting",
    "crane lift hazard": "Suspended Loads / Mechanical Lifting",
    "rigging failure": "Suspended Loads / Mechanical Lifting",
    "suspended load": "Suspended Loads / Mechanical Lifting",
    "line of fire": "Line of Fire",
    "line-of-fire": "Line of Fire",
    "struck by moving object": "Line of Fire",
    "struck by": "Line of Fire",
    "pressure release": "Pressure / Stored Energy Release",
    "pressurized line": "Pressure / Stored Energy Release",
    "high pressure release": "Pressure / Stored Energy Release",
    "overpressurization": "Pressure / Stored Energy Release",
    "uncontrolled pressure release": "Pressure / Stored Energy Release",
    "pressure stored": "Pressure / Stored Energy Release",
    "electrical hazard": "Electrical Energy / Arc Flash",
    "arc flash": "Electrical Energy / Arc Flash",
    "high voltage": "Electrical Energy / Arc Flash",
    "electrocution hazard": "Electrical Energy / Arc Flash",
    "electrical": "Electrical Energy / Arc Flash",
    "vehicle hazard": "Vehicle & Mobile Equipment",
    "mobile equipment": "Vehicle & Mobile Equipment",
    "vehicle impact": "Vehicle & Mobile Equipment",
    "forklift hazard": "Vehicle & Mobile Equipment",
    "motor vehicle": "Vehicle & Mobile Equipment",
    "rotating equipment": "Rotating Equipment / Mechanical In-Running Nips",
    "in running nips": "Rotating Equipment / Mechanical In-Running Nips",
    "nip point": "Rotating Equipment / Mechanical In-Running Nips",
    "entanglement": "Rotating Equipment / Mechanical In-Running Nips",
    "mechanical motion": "Rotating Equipment / Mechanical In-Running Nips",
    "hot work hazard": "Hot Work & Ignition Sources",
    "ignition source": "Hot Work & Ignition Sources",
    "sparks near flammable": "Hot Work & Ignition Sources",
    "hot work ignition": "Hot Work & Ignition Sources",
    "confined space": "Confined Space / Engulfment",
    "confined space hazard": "Confined Space / Engulfment",
    "engulfment": "Confined Space / Engulfment",
    "hydrocarbon release": "Hydrocarbon & Flammable Chemical Release",
    "gas leak": "Hydrocarbon & Flammable Chemical Release",
    "fuel spill": "Hydrocarbon & Flammable Chemical Release",
    "flammable release": "Hydrocarbon & Flammable Chemical Release",
    "chemical flammable": "Hydrocarbon & Flammable Chemical Release",
    "toxic atmosphere": "Toxic & Asphyxiant Atmosphere",
    "h2s exposure": "Toxic & Asphyxiant Atmosphere",
    "h2s gas": "Toxic & Asphyxiant Atmosphere",
    "asphyxiation": "Toxic & Asphyxiant Atmosphere",
    "thermal energy": "Thermal Energy (Extreme Heat / Cryogenic)",
    "extreme heat": "Thermal Energy (Extreme Heat / Cryogenic)",
    "steam leak": "Thermal Energy (Extreme Heat / Cryogenic)",
    "cryogenic exposure": "Thermal Energy (Extreme Heat / Cryogenic)",
    "stored mechanical energy": "Stored Mechanical Energy (Springs / Tension)",
    "spring tension": "Stored Mechanical Energy (Springs / Tension)",
    "hydraulic recoil": "Stored Mechanical Energy (Springs / Tension)",
    "excavation collapse": "Excavation & Ground Collapse",
    "trench collapse": "Excavation & Ground Collapse",
    "cave in": "Excavation & Ground Collapse",
    "dropped object": "Dropped Objects (Dynamic Gravity Impact)",
    "dropped objects": "Dropped Objects (Dynamic Gravity Impact)",
    "falling object": "Dropped Objects (Dynamic Gravity Impact)",
    "gravity dropped object": "Dropped Objects (Dynamic Gravity Impact)",
    "kinetic vehicle": "Vehicle & Mobile Equipment",
    "kinetic moving object vehicle": "Vehicle & Mobile Equipment",
    "kinetic": "Vehicle & Mobile Equipment",
    "mechanical rotating equipment": "Rotating Equipment / Mechanical In-Running Nips",
    "mechanical": "Rotating Equipment / Mechanical In-Running Nips",
    "pressure": "Pressure / Stored Energy Release",
    "hydrocarbon": "Hydrocarbon & Flammable Chemical Release",
    "hydrocarbon flammable atmosphere": "Hydrocarbon & Flammable Chemical Release",
    "chemical toxic h2s": "Toxic & Asphyxiant Atmosphere",
    "atmospheric oxygen deficiency": "Confined Space / Engulfment",
    "thermal": "Thermal Energy (Extreme Heat / Cryogenic)",
}

# Fixed values.
OPERATIONS = (
    "Drilling Operations", "Workover & Well Servicing", "Production Operations", "Refinery Process Operations",
    "Pipeline Transportation", "Maintenance & Overhaul", "Construction & Commissioning", "Logistics & Marine Transfer",
    "Facility Shutdown / Turnaround",
)
OPERATION_ALIASES = {
    "drilling": "Drilling Operations",
    "drilling ops": "Drilling Operations",
    "drilling operations": "Drilling Operations",
    "workover": "Workover & Well Servicing",
    "well servicing": "Workover & Well Servicing",
    "well intervention": "Workover & Well Servicing",
    "production": "Production Operations",
    "production operations": "Production Operations",
    "oil production": "Production Operations",
    "gas production": "Production Operations",
    "refining": "Refinery Process Operations",
    "refinery": "Refinery Process Operations",
    "refinery operations": "Refinery Process Operations",
    "pipeline": "Pipeline Transportation",
    "pipeline operations": "Pipeline Transportation",
    "pipeline transportation": "Pipeline Transportation",
    "maintenance": "Maintenance & Overhaul",
    "mechanical maintenance": "Maintenance & Overhaul",
    "overhaul": "Maintenance & Overhaul",
    "construction": "Construction & Commissioning",
    "commissioning": "Construction & Commissioning",
    "marine transfer": "Logistics & Marine Transfer",
    "logistics": "Logistics & Marine Transfer",
    "shutdown": "Facility Shutdown / Turnaround",
    "turnaround": "Facility Shutdown / Turnaround",
}
