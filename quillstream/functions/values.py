"""Word lists, patterns and constants that define the results."""

# Fixed values of the English profile.
SPEAKER_VERBS = (
    "said", "asked", "replied", "answered", "whispered", "shouted", "muttered", "exclaimed", "cried", "called", "yelled", "screamed",
    "murmured", "demanded", "pleaded", "begged", "suggested", "agreed", "added", "continued", "explained", "insisted", "admitted",
    "confessed", "announced", "declared", "stated", "mentioned", "noted", "observed", "remarked", "commented", "groaned", "sighed",
    "laughed", "chuckled", "giggled", "sobbed",
)
EMOTION_HINTS = {
    "whispered": "whisper", "shouted": "angry", "yelled": "angry", "screamed": "fearful", "muttered": "grumpy", "exclaimed": "excited",
    "cried": "sad", "sobbed": "sad", "laughed": "happy", "chuckled": "happy", "giggled": "happy", "sighed": "sad", "groaned": "grumpy",
    "demanded": "angry", "pleaded": "sad", "begged": "sad",
}
SPEAKER_BLACKLIST = (
    "he", "she", "it", "they", "we", "i", "you", "him", "her", "them", "us", "me", "his", "hers", "its", "theirs", "ours", "mine", "yours",
    "softly", "loudly", "quietly", "gruffly", "sharply", "gently", "slowly", "quickly", "rapidly", "carefully", "angrily", "sadly",
    "happily", "nervously", "anxiously", "fearfully", "excitedly", "calmly", "coldly", "warmly", "coolly", "hotly", "flatly",
    "dryly", "wryly", "sweetly", "bitterly", "harshly", "roughly", "smoothly", "evenly", "unevenly", "breathlessly", "hoarsely",
    "huskily", "shrilly", "deeply", "lightly", "heavily", "urgently", "desperately", "frantically", "hysterically", "sarcastically",
    "mockingly", "teasingly", "playfully", "seriously", "solemnly", "thoughtfully", "absently", "distractedly", "sleepily", "wearily",
    "tiredly", "briskly", "curtly", "abruptly", "suddenly", "finally", "immediately", "eventually", "meanwhile", "instead", "however",
    "therefore", "moreover", "furthermore", "nevertheless", "wonderfully", "terribly", "horribly", "awfully", "incredibly",
)
# Who speaks: VERBS stands for the speech verbs, any of them; a verb before the name, or after it.
SAID_PATTERNS = (r"(?:VERBS)\s+([A-Z][a-z]+)(?:\s|[,.!?]|$)", r"([A-Z][a-z]+)\s+(?:VERBS)")
NAME_PATTERN = r"^[A-Z][a-z]{1,14}$"
CHAPTER_PATTERNS = (
    r"^(?:Chapter|CHAPTER)\s+(\d+|[IVXLCDM]+|[A-Za-z]+)(?:\s*[:\-\.]\s*(.*))?$",
    r"^(?:Part|PART)\s+(\d+|[IVXLCDM]+)(?:\s*[:\-\.]\s*(.*))?$",
    r"^(\d+)\s*[\.\:\-]\s+(.+)$",
    r"^#\s+(.+)$",
    r"^##\s+(.+)$",
)
SCENE_BREAK_PATTERNS = (r"^\*\s*\*\s*\*\s*$", r"^-\s*-\s*-\s*$", r"^~\s*~\s*~\s*$", r"^###\s*$")
DOUBLE_QUOTES = (('"', '"'),)
CURLY_QUOTES = (("“", "”"),)
SINGLE_QUOTES = (("‘", "’"), ("'", "'"))

# Fixed values of emotion inference: label, words or phrases, confidence, in order of precedence between equals.
EMOTION_LEXICON = (
    ("angry", ("furious", "enraged", "livid", "seething", "infuriated"), 0.9),
    ("angry", ("angry", "mad", "outraged", "irate", "incensed"), 0.85),
    ("angry", ("annoyed", "irritated", "frustrated"), 0.7),
    ("sad", ("sobbing", "weeping", "grieving", "mourning", "heartbroken"), 0.9),
    ("sad", ("crying", "tears", "sorrowful", "miserable", "devastated"), 0.85),
    ("sad", ("sad", "unhappy", "gloomy", "melancholy"), 0.75),
    ("happy", ("ecstatic", "overjoyed", "elated", "jubilant", "thrilled"), 0.9),
    ("happy", ("delighted", "joyful", "excited", "gleeful", "beaming"), 0.85),
    ("happy", ("happy", "pleased", "cheerful", "glad", "smiling"), 0.75),
    ("fearful", ("terrified", "petrified", "horrified", "panic"), 0.9),
    ("fearful", ("frightened", "scared", "afraid", "alarmed", "trembling"), 0.85),
    ("fearful", ("nervous", "anxious", "worried", "uneasy"), 0.7),
    ("whisper", ("whispered", "hissed", "murmured", "breathed"), 0.9),
    ("whisper", ("softly", "quietly", "hushed", r"under\s+(?:his|her|their)\s+breath"), 0.8),
    ("excited", (r"can't\s+wait", "incredible", "amazing", "fantastic", "wonderful"), 0.8),
    ("excited", ("eager", "enthusiastic", "pumped", "exhilarated"), 0.85),
)
VERB_CONFIDENCE, EXCLAIM_CONFIDENCE, CAPITALS_CONFIDENCE, ELLIPSIS_CONFIDENCE, CAPITAL_WORDS, EMOTION_THRESHOLD = 0.85, 0.6, 0.6, 0.4, 4, 0.75

# Fixed values of casting: prefix, gender, accent; voice, style, tags; words that tell a speaker's gender.
VOICE_PREFIXES = (("af_", "female", "american"), ("am_", "male", "american"), ("bf_", "female", "british"), ("bm_", "male", "british"))
VOICE_NOTES = (
    ("af_heart", "calm", ("narrator", "warm", "default")),
    ("af_aoede", "expressive", ("narrator", "elegant")),
    ("af_jessica", "neutral", ("dialogue", "clear")),
    ("af_sky", "expressive", ("young", "energetic")),
    ("am_eric", "neutral", ("dialogue", "clear")),
    ("am_fenrir", "powerful", ("narrator", "deep", "commanding")),
    ("am_liam", "neutral", ("dialogue", "young")),
    ("am_onyx", "calm", ("narrator", "deep")),
    ("bf_alice", "neutral", ("dialogue", "refined")),
    ("bf_emma", "expressive", ("dialogue", "warm")),
    ("bf_isabella", "calm", ("narrator", "gentle")),
    ("bm_george", "calm", ("narrator", "authoritative")),
    ("bm_lewis", "neutral", ("dialogue", "clear")),
)
FEMALE_CUES = ("she", "her", "hers", "herself", "woman", "girl", "mother", "sister", "daughter", "wife", "queen", "princess", "lady", "madam", "miss", "mrs", "ms")
MALE_CUES = ("he", "him", "his", "himself", "man", "boy", "father", "brother", "son", "husband", "king", "prince", "lord", "sir", "mr")
GENDER_MATCH, GENDER_MISMATCH, NARRATOR_VOICE, DIALOGUE_VOICE, CLEAR_STYLE, REUSE, CURATED = 0.3, -0.5, 0.4, 0.2, 0.1, -0.6, 0.05
NARRATOR_NAMES = ("narrator", "narration")
FALLBACK_VOICE, NARRATOR, UNKNOWN = "af_heart", "narrator", "unknown"

# Fixed values of HTML extraction, rendering and project files.
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote", "pre", "br", "hr")
SKIPPED_TAGS = ("script", "style", "head", "meta", "link", "nav", "footer")
VOID_TAGS = ("meta", "link")
WORDS_PER_MINUTE = 150
HEADING_LINES, TITLE_CHARS, TITLE_LIMIT, CONTEXT_CHARS, QUOTE_KEY_CHARS, NLP_CONFIDENCE = 200, 2000, 200, 100, 80, 0.3
SCHEMA_VERSION, MANIFEST_VERSION = 1, 1
CONFIG_DEFAULTS = {
    "chapter_pause_ms": 2000, "narrator_pause_ms": 600, "dialogue_pause_ms": 400, "sample_rate": 24000, "output_format": "m4b",
    "fallback_voice_id": "af_heart", "validate_voices_on_render": True, "estimated_wpm": 150, "min_chapter_words": 50,
    "keep_titled_short_chapters": True, "language_code": "en", "booknlp_mode": "auto", "emotion_mode": "rule", "emotion_confidence_threshold": 0.75,
}
