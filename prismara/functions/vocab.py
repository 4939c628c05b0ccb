"""Closed vocabularies. The order of each list is the order of matching."""

GENDERS = ["female", "male"]
AGE_GROUPS = ["childhood", "youth", "adulthood", "old age"]
BEHAVIOURS = ["demand/affiliation", "demand/seduction", "demand/submission", "offer/ideal"]
BEHAVIOUR_SUFFIXES = {"affiliation": "demand/affiliation", "seduction": "demand/seduction", "submission": "demand/submission", "ideal": "offer/ideal"}
BEHAVIOUR_RENAMED = {"demand/submission": "demand/power"}
BODY_DISPLAYS = ["normal clothes", "revealing clothes", "partially naked", "no clothes at all"]
BODY_WEIGHTS = ["overweight", "obese", "median", "thin", "not visible"]
BODY_WEIGHT_SYNONYMS = {"underweight": "thin", "skinny": "thin", "lean": "thin", "slim": "thin", "light": "thin", "normal": "median", "average": "median", "healthy": "median"}
ADIPOSITY = {"thin": "low", "median": "medium", "overweight": "high", "obese": "high"}
MUSCLE_NEGATIVE = ["not visible", "no visible", "none", "absent", "soft", "na", "n/a", "0"]
MUSCLE_POSITIVE = ["visible", "muscular", "defined", "toned", "athletic", "1"]
ATTIRES = ["not visible", "underwear/swimwear", "sportswear", "uniform", "formal", "casual"]
ATTIRE_SYNONYMS = {
    "swimsuit": "underwear/swimwear", "swimwear": "underwear/swimwear", "bikini": "underwear/swimwear", "swim trunks": "underwear/swimwear",
    "trunks": "underwear/swimwear", "lingerie": "underwear/swimwear", "underwear": "underwear/swimwear", "bra": "underwear/swimwear",
    "briefs": "underwear/swimwear", "boxers": "underwear/swimwear", "athletic": "sportswear", "gym": "sportswear", "tracksuit": "sportswear",
    "jersey": "sportswear", "activewear": "sportswear", "sports": "sportswear", "military": "uniform", "police": "uniform", "army": "uniform",
    "firefighter": "uniform", "medical": "uniform", "scrubs": "uniform", "suit": "formal", "tuxedo": "formal", "gown": "formal", "tie": "formal",
    "blazer": "formal", "traditional": "formal", "tunic": "formal", "kimono": "formal", "sari": "formal", "kilt": "formal", "thobe": "formal",
    "everyday": "casual", "streetwear": "casual", "street": "casual", "jeans": "casual", "t-shirt": "casual", "hoodie": "casual", "normal": "casual",
}
ACTIVITIES = ["sports", "romance", "posing", "other"]
ACTIVITY_ALIASES = ["entertaining", "everyday doings", "no activities", "na", "n/a"]
LOCATIONS = ["indoors", "wilderness", "city", "no background"]
LOCATION_FALLBACK = "no background"
SOCIAL_DISTANCES = ["intimate distance", "close personal distance", "far personal distance", "close social distance", "far social distance", "public distance"]
ACCESSORIES = ["makeup", "tattoos", "bags", "belts", "jewelry", "headwear", "eyewear"]
JSON_LABELS = {
    "gender": "Gender", "age": "Age", "behaviour": "Behaviour", "bodydisplay": "BodyDisplay", "bodyweight": "BodyWeight", "muscle": "Musculature",
    "attire": "Attire", "makeup": "makeup", "tattoos": "tattoos", "bags": "bags", "belts": "belts", "jewelry": "jewelry", "headwear": "headwear",
    "eyewear": "eyewear", "activity": "Activity", "location": "location", "socialdistance": "social distance",
}
BLANKS = ["", "no visible", "not visible", "na", "n/a", "unknown", "none"]
STATUS = {"ok": "completado", "partial": "parcial", "failed": "vlm_failed"}
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp"]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "webm"]

#: Display labels.
LABELS = {
    "behaviour": {"demand/affiliation": "Affiliation", "demand/seduction": "Seduction", "demand/power": "Power", "demand/submission": "Power", "offer/ideal": "Ideal"},
    "activity": {"sports": "Sports", "romance": "Romance", "posing": "Posing", "other": "Other"},
    "location": {"indoors": "Indoors", "wilderness": "Wilderness", "city": "City", "no background": "No background"},
    "body_weight": {"low": "Low", "medium": "Medium", "high": "High", "thin": "Low", "median": "Medium", "overweight": "High"},
    "attire": {"underwear/swimwear": "Underwear/Swim", "sportswear": "Sportswear", "uniform": "Uniform", "formal": "Formal", "casual": "Casual"},
}
ACCESSORY_LETTERS = {"makeup": "M", "tattoos": "T", "bags": "B", "belts": "Cn", "jewelry": "J", "headwear": "S", "eyewear": "G"}

#: Keyword heuristics of the older single-task answers, tried in order: (any of these words, label).
LEGACY_AGE = [(["child", "baby", "toddler", "kid"], "childhood"), (["teenager", "adolescent", "young adult", "young"], "youth"), (["adult", "middle"], "adulthood"), (["senior", "elderly", "old"], "old age")]
LEGACY_BODY_DISPLAY = [
    (["revealing", "straps", "bikini", "swimwear"], "revealing clothes"),
    (["no shirt", "no top", "no pants", "shirtless", "bare chest"], "partially naked"),
    (["normal", "regular", "covered", "everyday"], "normal clothes"),
]
LEGACY_LOCATION = [
    (["no background", "solid color", "plain", "studio", "gradient"], "no background"),
    (["indoor", "inside", "building", "apartment", "bedroom"], "indoors"),
    (["wilderness", "natural", "park", "garden", "woods", "lake", "sea", "river"], "wilderness"),
    (["city", "urban", "street", "buildings", "landmark"], "city"),
]

#: Phrases that say a score cannot be given, and the patterns of a score in the order they are tried.
SCORE_NA = [
    r"^n\s*/\s*a$", r"^na$", r"eyes\s+(are\s+)?(completely|fully|not|cannot)\s+(hidden|visible|seen)", r"cannot\s+see\s+(the\s+)?eyes", r"eyes\s+not\s+visible",
    r"heavily\s+pixelated", r"fully\s+covered", r"completely\s+(obscured|covered)", r"cannot\s+rate", r"unable\s+to\s+rate",
]
SCORE_PATTERNS = [r"^\s*(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s*/\s*{hi}", r"score.*?(\d+(?:\.\d+)?)", r"rating.*?(\d+(?:\.\d+)?)", r"\b(\d{1,2}(?:\.\d+)?)\b"]

#: What may stand around a label at a line's start, and the patterns that recover JSON values from cut answers.
LABEL_START = r"^[\s>*\-\d.]*\**\s*"
LABEL_END = r"\**\s*:\s*\**\s*"
NESTED_VALUE = r'"(\w+)"(?=\s*:\s*\{\s*"class"\s*:\s*"([^"]*)")'
FLAT_VALUE = r'"(\w+)"(?=\s*:\s*"([^"]*)")'
PARTS_KEYS = ['"shoulders"', '"frame_filled"']

#: Names under which older results list an accessory.
ACCESSORY_NAMES = {
    "makeup": ["makeup", "maquillaje"], "tattoos": ["tattoos", "tatuajes"], "bags": ["bags", "bolsos"], "belts": ["belts", "cinturones"],
    "jewelry": ["jewelry", "jewellery", "joyas"], "headwear": ["headwear", "hat", "sombrero"], "eyewear": ["eyewear", "glasses", "gafas"],
}
