"""Fixed values. They must equal the source system's for right results."""

# Camera views, in the order the file name is searched.
VIEWS = [
    "EXTERIOR_FRONT_STRAIGHT", "EXTERIOR_REAR_STRAIGHT",
    "DIAGONAL_FRONT_LEFT", "DIAGONAL_FRONT_RIGHT",
    "DIAGONAL_REAR_LEFT", "DIAGONAL_REAR_RIGHT",
    "TYRE_RIM_FRONT_LEFT", "TYRE_RIM_FRONT_RIGHT",
    "TYRE_RIM_REAR_LEFT", "TYRE_RIM_REAR_RIGHT",
]
LEGACY_VIEW = "exterior_legacy"
UNKNOWN_VIEW = "UNKNOWN"
LEGACY_NAME = r"^[a-f0-9-]+_\d+\.jpg$"
LEGACY_PHOTO_TYPE = "exterior"
EXTERIOR_TYPES = [LEGACY_PHOTO_TYPE, *VIEWS]

# Damage classes in category-id order, and the register type of each.
DAMAGE_CLASSES = ["scratch", "stone_chip", "dent", "crack", "missing", "major", "other"]
CLASS_OF_TYPE = {
    "TYPE_SCRATCH": "scratch",
    "TYPE_STONE_CHIP": "stone_chip",
    "TYPE_STONE_CHIP_WITH_CRACK": "stone_chip",
    "TYPE_DENT": "dent",
    "TYPE_DENTED": "dent",
    "TYPE_CRACK": "crack",
    "TYPE_HOLE": "crack",
    "TYPE_BROKEN": "crack",
    "TYPE_MISSING": "missing",
    "TYPE_LOOSE": "missing",
    "TYPE_CRASH": "major",
    "TYPE_HAIL_DAMAGE": "major",
}
EXCLUDED_GROUPS = ["WINDOWS", "TYRES"]

# Image limits (all strict), score weights, selection targets.
MIN_SIDE = 800
MIN_SHARPNESS = 30
BRIGHTNESS_RANGE = (40, 220)
MAX_OVEREXPOSED = 10
MAX_UNDEREXPOSED = 30
MIN_SATURATION = 10
HASH_DISTANCE = 6
KEEP_TOP_SHARE = 0.35
STRATA_TARGETS = {
    "scratch": 150, "stone_chip": 100, "dent": 75, "crack": 50,
    "missing": 50, "major": 25, "other": 50,
}
SHOWCASE_TARGETS = [
    ("major", 1), ("crack", 1), ("missing", 1), ("dent", 2),
    ("stone_chip", 2), ("scratch", 2), ("other", 1),
]

# US dollars per million prompt / completion tokens, by model key.
PRICES = {"pro": (1.25, 5.00), "flash": (0.075, 0.30)}

# Phrases that mark a network failure as worth another try.
NETWORK_PHRASES = [
    "unable to resolve host", "no address associated with hostname", "timeout", "timed out",
    "failed to connect", "connection reset", "network is unreachable", "socket",
]

# Display texts.
LABEL_TEXT = {
    "scratch": "Kratzer", "stone_chip": "Steinschlag", "dent": "Delle", "crack": "Riss",
    "missing": "Fehlendes Teil", "major": "Schwerer Schaden", "other": "Sonstiges",
}
SEVERITY_TEXT = {"light": "leicht", "medium": "mittel", "severe": "schwer"}
ROW_TEXT = ("oben", "mittig", "unten")
COLUMN_TEXT = ("links", "Mitte", "rechts")
UNKNOWN_POSITION = "unbekannte Position"
MODEL_TEXT = {"gemini": "Pro", "flash": "Flash", "": "Model?"}
