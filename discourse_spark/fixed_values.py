"""Fixed values.

Everything in this file is data, not design: word lists, rule patterns, column
aliases and thresholds that must have exactly these values for results to be
comparable with other implementations of the same analysis.
"""

# --- fixed values: divisive-language rules, family -> label -> pattern ---
RULES: dict[str, dict[str, str]] = {
    "dehumanizing": {
        "invasion": r"\b(invasion|invade|invading)\b",
        "flood": r"\b(flood(ing)?|flooded)\b",
        "swarm": r"\b(swarm(ing)?|swarmed)\b",
        "infestation": r"\b(infest(ation|ed|ing)?)\b",
        "plague": r"\b(plague[ds]?|plaguing)\b",
        "vermin": r"\b(vermin|cockroach(es)?|rat[s]?)\b",
        "animals": r"\b(animals?|beast[s]?|savages?|barbarian[s]?)\b",
        "parasite": r"\b(parasite[s]?|parasitic)\b",
    },
    "moral_exclusion": {
        "dont_belong": r"\bdon'?t\s+belong\b",
        "go_back": r"\bgo\s+back\s+(to\s+)?(where|your)\b",
        "not_like_us": r"\bnot\s+like\s+us\b",
        "their_kind": r"\btheir\s+kind\b",
        "not_welcome": r"\bnot\s+welcome\s+here\b",
        "get_out": r"\b(get\s+out|leave\s+our\s+(country|land|nation))\b",
        "no_place_here": r"\bno\s+place\s+(here|in\s+this\s+country)\b",
        "send_them_back": r"\bsend\s+them\s+back\b",
    },
    "generalization": {
        "all_of_them": r"\ball\s+of\s+them\b",
        "these_ppl_always": r"\bthese\s+people\s+always\b",
        "they_never": r"\bthey\s+never\b",
        "they_all": r"\bthey'?re?\s+all\b",
        "all_they_do": r"\ball\s+they\s+(do|want|care)\b",
        "every_single_one": r"\bevery\s+single\s+one\s+of\s+them\b",
        "those_people": r"\bthose\s+(kind\s+of\s+)?people\b",
        "none_of_them": r"\bnone\s+of\s+them\b",
    },
    "threat_framing": {
        "taking_over": r"\btaking\s+over\b",
        "replacing_us": r"\breplacing\s+us\b",
        "replacement": r"\b(great\s+)?replacement\b",
        "destroying_our": r"\bdestroying\s+our\b",
        "under_attack": r"\b(under\s+attack|being\s+attacked)\b",
        "erase_us": r"\beras(e|ing|ed)\s+us\b",
        "our_culture": (
            r"\b(destroy|destroy(ing)?|threaten(ing)?|eradicate)"
            r"\s+our\s+(culture|way\s+of\s+life|values|heritage)\b"
        ),
        "white_genocide": r"\b(white\s+genocide|demographic\s+replacement)\b",
    },
}

# --- fixed values: pronoun markers ---
WE_WORDS = ["we", "us", "our", "ours", "ourselves"]
THEM_WORDS = ["they", "them", "their", "theirs"]
THEM_PHRASES = ["those people", "these people", "people like them"]

# --- fixed values: 28 emotion labels and their valence ---
EMOTION_VALENCE = {
    "admiration": "positive", "amusement": "positive", "approval": "positive",
    "caring": "positive", "desire": "positive", "excitement": "positive",
    "gratitude": "positive", "joy": "positive", "love": "positive",
    "optimism": "positive", "pride": "positive", "relief": "positive",
    "anger": "negative", "annoyance": "negative", "confusion": "negative",
    "disappointment": "negative", "disapproval": "negative", "disgust": "negative",
    "embarrassment": "negative", "fear": "negative", "grief": "negative",
    "nervousness": "negative", "remorse": "negative", "sadness": "negative",
    "curiosity": "neutral", "realization": "neutral", "surprise": "neutral",
    "neutral": "neutral",
}

# --- fixed values: score columns and the raw model labels behind them ---
TOXICITY_COLUMNS = ["toxicity", "severe_toxicity", "identity_attack", "insult", "threat"]
TOXICITY_LABEL_MAP = {
    "toxic": "toxicity",
    "severe_toxic": "severe_toxicity",
    "identity_hate": "identity_attack",
    "insult": "insult",
    "threat": "threat",
}

# --- fixed values: column names that may hold the post text, in priority order ---
TEXT_ALIASES = [
    "text", "Text", "TEXT", "caption", "Caption",
    "tweet", "Tweet", "tweet_text", "comment", "Comment", "comment_text",
    "body", "Body", "content", "Content", "message", "Message", "description",
    "transcription", "video_transcription_text",
    "parentText", "childCommentText", "post", "post_text", "selftext", "title",
]

# --- fixed values: column names that may hold the post date, in priority order ---
DATE_COLUMNS = [
    "createTimeISO", "createdAt", "Timestamp", "timestamp", "created_at",
    "date", "Date", "datetime", "childCommentDate", "date Parent", "posted_at",
]

# --- fixed values: forum boards kept at ingest, and those sampled around events ---
INGEST_SUBREDDITS = ["politics", "immigration", "europe", "worldnews", "conspiracy"]
EVENT_SUBREDDITS = ["immigration", "europe", "worldnews", "UKpolitics", "politics"]

# --- fixed values: thresholds and sizes ---
DATASET_SEPARATOR = "  ·  "
MIN_TEXT_LENGTH = 20
SPIKE_SIGMAS = 1.5
HIGH_TOXICITY = 0.5
TOXICITY_BANDS = (0.7, 0.4)
NEAREST_EVENT_DAYS = 45
EVENT_WINDOW_DAYS = 14
EVENT_MIN_POSTS = 5
