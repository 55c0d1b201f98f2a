"""Output texts, thresholds and dimension members that results depend on."""

# Corpus gate.
MIN_TEXT_CHARS = 500
MAX_TEXT_CHARS = 30000
DROPPED_HTML_TAGS = ["script", "style", "nav", "footer", "aside"]
MIN_SENTENCE_CHARS = 20

# External entities.
ENTITY_MIN_SCORE = 0.65
ENTITY_MIN_CHARS = 3

# Evidence confidence: least(top, base + step * number of terms).
CONFIDENCE_TOP = 0.99
CONFIDENCE_BASE = 0.55
CONFIDENCE_STEP = 0.08
CONFIDENCE_MISSING = 0.6

# Topic profile.
TOP_TERMS = 6
DEFAULT_CLASS = "tridosha"
DEFAULT_TERMS = ["guduchi", "triphala"]
DEFAULT_SOURCE = "N/A"
FORMULATION_CUTS = [(5, "kwatha"), (3, "churna")]
FORMULATION_ELSE = "vati"

# Patient dimensions, in order.
AGES = ["young", "middle", "elder"]
GENDERS = ["male", "female"]
SEVERITIES = ["low", "medium", "high"]

# Knowledge-base dosage and contraindication texts.
DOSAGE_HIGH = "Intensive protocol - physician supervision required"
DOSAGE_LOW = "Low intensity protocol - once or twice daily"
DOSAGE_STANDARD = "Standard protocol - twice daily after meals"
DOSAGE_YOUNG_PREFIX = "Half adult dose. "
DOSAGE_ELDER_PREFIX = "Start with reduced dose. "
CONTRAINDICATION_CHILD = "Not recommended for children under 12"
CONTRAINDICATION_ELDER = "Use with caution in elderly"
CONTRAINDICATION_PREGNANT = "Avoid in pregnancy"
QUALITY_EXAMPLES = 50

# Intake scoring.
CONTROL_MARKER = "skip_followup."
FUZZY_WORD_CUTOFF = 85
FUZZY_WORD_MIN_CHARS = 4
TYPO_WORD_MIN_CHARS = 5
LOOKUP_CUTOFF = 70
RULE_CONFIDENCE = 0.98
CRITICAL_CONFIDENCE = 0.40
MIN_FEATURES = 3
RULE_SLACK = 1
HIGH_SEVERITY_WORDS = ["severe", "terrible", "blinding", "unbearable", "extreme", "bad", "worst", "killing", "intense"]
LOW_SEVERITY_WORDS = ["mild", "slight", "little", "minor", "bearable"]
CRITICAL_FOLLOW_UPS = ["dizziness", "blurred_vision", "unsteadiness", "stiff_neck"]
FOLLOW_UP = (". I also have ", ".")

# Reply texts.
REPLY_ERROR = (
    "Without any recognized symptoms, I cannot safely provide a diagnosis. "
    "Please try describing your condition using specific medical terms."
)
REPLY_NOTHING_FOUND = (
    "I didn't quite catch any specific medical symptoms from your description. "
    "To help me diagnose you, are you experiencing any of these common issues?"
)
REPLY_CRITICAL_FEW = (
    "A ",
    " can be caused by many things. To ensure your safety, are you also feeling any dizziness, "
    "blurred vision, or sudden weakness?",
)
REPLY_FEW = (
    "You mentioned ",
    ". That is a good start, but many conditions share these early signs. "
    "To help me narrow down the diagnosis, are you also feeling any of these?",
)
REPLY_EMERGENCY = ("EMERGENCY: Symptoms indicate ", ". Seek immediate hospital care.")

# Sentence evidence: severity words and proximity patterns (a flag is true when its pattern does not match).
SENTENCE_HIGH_WORDS = ["severe", "acute", "critical", "intense", "advanced"]
SENTENCE_LOW_WORDS = ["mild", "slight", "early"]
CONSTRAINT_PATTERNS = {
    "child_safe": "(not|avoid|contraindicated).{0,20}(child|children|infant)",
    "elderly_safe": "(avoid|caution).{0,20}(elder|elderly)",
    "pregnant_safe": "(avoid|not|contraindicated).{0,20}(pregnan)",
}

# Recommendation texts.
GENERIC_NAME_MARK = "Protocol"
GENERIC_NAME = "Ayurvedic Herb"
DEFAULT_REMEDY_NAME = "Ayurvedic Protocol"
DEFAULT_REMEDY_DOSAGE = "Standard Dose"
DEFAULT_REMEDIES = [
    ("Divya Ashwagandha Vati", "1 tablet twice daily"),
    ("Triphala Churna", "1 teaspoon at bedtime"),
]
SCALED_AGES = ["children", "elderly", "child", "elder"]
SCALED_MARK = "Half Dose"
SCALED_PREFIX = "Pediatric/Geriatric Scale (Half Dose): "
INTENSIVE_MARK = "INTENSIVE"
INTENSIVE_PREFIX = "INTENSIVE: "
INTENSIVE_SUFFIX = " (Requires Physician Monitoring)"
PREGNANCY_MALE = "Not applicable for male patients."
PREGNANCY_YES = "Contraindicated during pregnancy. Consult a physician immediately."
PREGNANCY_NO = "Safe for general use."

# Catalog.
IMAGE_ELSE = "other"

# Training.
SPLIT_TEST_FRACTION = 0.2
SPLIT_SEED = 42
