"""Order of corrective actions and the words that tell their intent."""

# Types and urgencies in order, intents with their words.
TYPE_ORDER = ("IMMEDIATE", "ESCALATION", "CORRECTIVE", "PREVENTIVE", "VERIFICATION", "POSITIVE_LEARNING")
URGENCY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
INTENTS = (
    ("STOP_WORK", ("halt", "cease", "stop", "evacuate", "remove personnel", "extinguish", "clear personnel")),
    ("RESTORE_BARRIER", ("re-establish", "restore", "install", "fit")),
    ("VERIFY_ENERGY", ("verify", "survey", "test", "check")),
    ("ESCALATE_SIF", ("escalat", "investigat")),
    ("POSITIVE_LEARNING", ("learning", "document & share")),
)
