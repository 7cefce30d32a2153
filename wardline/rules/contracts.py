"""What a report must tell about each hazard.

Fixed values: hazards, the number of facts required of each, and the keys of the questions. The questions are own wording.
"""

from __future__ import annotations

CONTRACTS: dict[str, tuple[int, dict[str, str]]] = {
    "pressure_stored": (3, {
        "worker_position": "Did anyone stand where the release went when the system was opened?",
        "isolation_verification": "Was a bleed point used to prove zero pressure before fittings were loosened?",
    }),
    "working_at_height": (3, {
        "elevation": "How high was the work above grade?",
        "tie_off_status": "Were lanyards anchored throughout the task?",
    }),
    "suspended_loads": (3, {
        "personnel_position": "Was anyone beneath or inside the swing of the load?",
        "barricade_status": "Was the exclusion zone kept around the whole lift?",
    }),
    "electrical": (3, {
        "voltage_verification": "Was a proven meter used to show the parts dead before they were touched?",
        "isolation_state": "Was every feed, backfeeds included, locked and tagged?",
    }),
    "confined_space": (3, {
        "gas_testing": "Was the air tested at every level of the space for as long as work went on?",
        "entry_extent": "Did anyone put head, torso or body through the opening?",
    }),
    "vehicle_mobile_equipment": (3, {
        "worker_position": "Was anyone on foot in the route, the blind spot or the reversing area?",
        "barrier_state": "Did a physical barrier keep people on foot away from the vehicle?",
    }),
    "rotating_equipment": (3, {
        "guard_status": "Was the guard fitted, fastened and whole while parts turned?",
        "worker_reach": "Could anyone reach parts that turned without a guard?",
    }),
    "hot_work_ignition": (3, {
        "combustible_proximity": "Was anything that burns within ten metres of the work?",
        "fire_watch": "Did a fire watch with a charged extinguisher stay the whole time?",
    }),
    "excavation_ground_collapse": (3, {
        "trench_depth": "How deep was the excavation?",
        "shoring_status": "Did shoring or a trench box protect the place of work?",
    }),
    "dropped_objects": (3, {
        "drop_height": "How far did the object fall?",
        "tethering_status": "Were tools tied on, and was there netting below?",
    }),
    "line_of_fire": (3, {
        "worker_position": "Did anyone stand in the path of a recoil, a whip or a release?",
        "containment_state": "Were restraints, whip checks or shields in use?",
    }),
    "hydrocarbon_flammable_release": (3, {
        "lel_concentration": "What did the gas meter read in the work area?",
        "isolation_status": "Were blinds or double valves with a bleed in place and secured?",
    }),
    "toxic_asphyxiant_atmosphere": (3, {
        "ppm_level": "How many parts per million of the gas were measured?",
        "respiratory_ppe": "Was supplied-air breathing apparatus worn?",
    }),
    "thermal_energy": (3, {
        "fluid_temperature": "How hot was the fluid, and under which pressure?",
        "cooling_verification": "Was the line shown to be cool and vented before it was opened?",
    }),
    "stored_mechanical_energy": (3, {
        "stored_mechanism": "Which spring, weight or accumulator held energy?",
        "de_energization": "Were stop pins in or the accumulator drained?",
    }),
}
CONTRACTS["chemical_flammable"] = CONTRACTS["hydrocarbon_flammable_release"]
