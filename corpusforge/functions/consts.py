"""Shared constants of the corpus pipeline.

Everything here is data, not logic: character classes as regex text that
both Java regex (Spark) and RE2 (DuckDB oracle) accept, the two romanized
vocabularies, label code tables and default thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScriptBlock:
    """A contiguous Unicode block treated as the 'native' script."""

    name: str
    lo: int
    hi: int

    @property
    def char_class(self) -> str:
        return f"[\\x{{{self.lo:04X}}}-\\x{{{self.hi:04X}}}]"


# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the behaviour being reproduced; do not edit.
# ---------------------------------------------------------------------------

# Native script block: Telugu, U+0C00..U+0C7F.
TELUGU = ScriptBlock("telugu", 0x0C00, 0x0C7F)

# Pictograph ranges removed by the emoji stripper (union of the listed rows:
# U+1F300-1FAFF, U+2600-27BF, U+1F1E0-1F1FF, U+2300-23FF, U+FE0F).
EMOJI_CLASS = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E0}-\\x{1F1FF}\\x{2300}-\\x{23FF}\\x{FE0F}]"

# Characters Python's str.strip()/str.split()/\s treat as whitespace, as
# code-point ranges (inclusive).
WS_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
             (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
             (0x3000, 0x3000))

# Characters JavaScript's String.prototype.trim() removes.
JS_WS_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
                (0xFEFF, 0xFEFF))


def ranges_class(ranges) -> str:
    """Regex character class (Java and RE2 syntax) for code-point ranges."""
    parts = [f"\\x{{{lo:04X}}}" if lo == hi else f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in ranges]
    return "[" + "".join(parts) + "]"


def ranges_chars(ranges) -> str:
    """All characters of the code-point ranges, as one string."""
    return "".join(chr(c) for lo, hi in ranges for c in range(lo, hi + 1))


WS_CLASS = ranges_class(WS_RANGES)
WS_CHARS = ranges_chars(WS_RANGES)
JS_WS_CLASS = ranges_class(JS_WS_RANGES)
JS_WS_CHARS = ranges_chars(JS_WS_RANGES)

# Separator between word tokens: anything that is not a letter, number or '_'.
NON_WORD_CLASS = "[^\\p{L}\\p{N}_]"

# Cells that pandas.read_csv turns into NaN by default.
NA_SENTINELS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Romanized vocabulary used by the comment scorer (distinct words, in the
# order they are first listed).
LEXICON_COMMENTS = (
    "nenu", "meeru", "memu", "mee", "nee", "vallaki", "vadiki", "akka", "anna",
    "bro", "andi", "garu",
    "undi", "undhi", "ledu", "ledhu", "oka", "okka", "okate", "cheyandi",
    "cheppandi", "chustunnaru", "antunnaru", "chestunnaru", "vastundi",
    "vastundhi", "poindi", "poindhi", "padthundi", "ayindi", "ayindhi",
    "avutundi", "avutundhi", "ivvandi", "cheyaledu", "cheyaledhu", "telusu",
    "telusindi",
    "ikkade", "akkade", "enti", "emiti", "ela", "elanti", "enduku", "chala",
    "chaala", "chaalaa", "anni", "inkaa", "inka", "kuda", "kooda", "kaadu",
    "kadu", "kadhu", "ante", "ayite", "appudu", "ippudu", "epudu", "kani",
    "kaani",
    "bagundi", "bagundhi", "baagundi", "super", "worst", "correct",
    "incorrect", "nijam", "nijame", "abadham", "fake", "asalu", "manchidi",
    "pedda", "chinna",
    "news", "vishayam", "government", "sarkar", "raajyam", "janalu", "praja",
    "desam", "ooru", "uur",
    "ayyo", "arey", "arrey", "haha", "lol", "ra", "raa", "le", "em", "emo",
    "emoo", "avunu", "avunuu",
)

# Smaller romanized vocabulary used by the post flagger.
LEXICON_POSTS = (
    "meeru", "nenu", "mee", "memu", "anni", "undi", "ayindi", "cheppandi",
    "cheyandi", "antunnaru", "chestunnaru", "ledu", "ikkade", "akkade", "ela",
    "ento", "emiti", "bagunna", "padthundi", "vastundi", "poindi", "okka",
    "okate", "oka",
)

LEXICONS = {"comments": LEXICON_COMMENTS, "posts": LEXICON_POSTS}

# Label code -> name, per annotation task.
SENTIMENT_NAMES = {0: "positive", 1: "negative", 2: "neutral"}
TOXICITY_NAMES = {0: "not_toxic", 1: "toxic", 2: "ambiguous"}
STANCE_NAMES = {0: "support", 1: "oppose", 2: "neutral"}
TASKS = (("sentiment", "sent", SENTIMENT_NAMES),
         ("toxicity", "tox", TOXICITY_NAMES),
         ("stance", "sta", STANCE_NAMES))

# Drop reasons, in the order the rules are checked.
DROP_REASONS = ("empty_or_nan", "emoji_or_symbol_only", "too_short_no_telugu", "exact_duplicate")

# Default thresholds.
MIN_WORDS = 3
MIN_POST_CHARS = 10
MIX_RATIO = 0.05
VIDEOS_PER_CHANNEL = 50
ROWS_PER_VIDEO = 200
PAGE_SIZE = 100
TOTAL_TARGET = 5000
POSTS_PER_ACCOUNT = 300
MILESTONE = 100
KAPPA_TARGET = 0.7
TRUE_FLAGS = ("True", "true", "1")
