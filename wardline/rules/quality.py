"""Fixed values of the data-quality gate."""

PLACEHOLDERS = (
    "test", "dummy", "asdf", "sample", "n/a", "na", "-", "--", "none", "null", "nil", "tbd", "xxx", "xyz",
    "placeholder", "testing", "nothing", "no description", "na na", "n/a n/a",
)
PLACEHOLDER_STEMS = ("desc", "test", "sample", "incident", "dummy", "asdf")
BAD_LOCATIONS = PLACEHOLDERS + ("unknown",)
KEYBOARD_ROWS = ("asdfghjkl", "qwertyuiop", "zxcvbnm")
WORD_EDGES = ",.!?\"';:()"

BODY_PARTS = ("eye", "knee", "head", "hand", "arm", "leg", "foot")
BODY_PART_PATTERN = r"\b({part} injury|injured (?:his|her|their)?\s*{part}|injury to (?:the\s+)?{part})\b"
INJURY_TYPE_PATTERNS = {
    "fracture": r"\b(fracture|fractured|broken bone)\b",
    "laceration": r"\b(laceration|deep cut|sliced)\b",
    "burn": r"\b(burn|burned|chemical burn)\b",
}
EYE_CONFLICT_PARTS = ("leg", "foot", "arm", "hand", "back", "knee")
SEVERE_WORDS = r"\b(serious fracture|hospitalized|hospitalization|fatality|serious injury)\b"
SEVERE_OUTCOMES = ("lost_time", "fatality", "death")
INJURY_WORDS = r"\b(sustained (?:a|an)? serious injury|fracture|laceration|hospitalized)\b"
HAZARD_CUES = (
    "drill", "pipe", "pressure", "crane", "fall", "height", "gas", "h2s", "fire", "electric", "leak", "tank", "valve",
)
