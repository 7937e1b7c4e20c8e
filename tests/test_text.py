"""Column functions: hand-written edge rows and property tests against plain Python."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge.functions import consts as K
from corpusforge.functions import text as T

# Plain-Python statements of the semantics being reproduced.
PY_EMOJI = re.compile("[\U0001F300-\U0001FAFF☀-➿\U0001F1E0-\U0001F1FF⌀-⏿️]+")
PY_NATIVE = re.compile("[ఀ-౿]")
PY_WORDS = re.compile(r"\b(" + "|".join(map(re.escape, K.LEXICON_COMMENTS)) + r")\b", re.IGNORECASE)


def py_strip(s):
    return PY_EMOJI.sub("", s).strip()


def py_key(s):
    return re.sub(r"\s+", " ", s.lower())


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


EDGE = [
    ("good👍bad idea", "goodbad idea", 2),
    ("👨‍👩‍👧 ok fine now", "‍‍ ok fine now", 4),
    ("⭐", "⭐", 1),
    ("१२ हिन्दी", "१२ हिन्दी", 2),
    ("చాలా", "చాలా", 1),
]


def test_strip_and_words_edge_rows(spark):
    for text, stripped, words in EDGE:
        assert one(spark, text, T.strip_emoji) == stripped
        assert one(spark, stripped, T.word_count) == words


def test_alpha_and_native_edge_rows(spark):
    assert one(spark, "⭐", T.has_alpha_content) is False
    assert one(spark, "१२ हिन्दी", T.has_alpha_content) is False
    assert one(spark, "చాలా", T.has_alpha_content) is True
    assert one(spark, "చాలా", T.has_native_script) is True
    assert one(spark, "12345 !!! ???", T.has_alpha_content) is False


def test_lexicon_boundaries(spark):
    assert one(spark, "కాra ledu", T.lexicon_hits) == 2     # vowel sign is not a word character
    assert one(spark, "ఆra ledu", T.lexicon_hits) == 1      # a letter is
    assert one(spark, "LEDU_ ledu", T.lexicon_hits) == 1    # underscore is a word character
    assert one(spark, "Raa RA ra-le", T.lexicon_hits) == 4


def test_ratio_rounding_tie(spark):
    text = "క" + "a" * 31                                   # 1 native char in 32 non-space chars
    sc = one(spark, text, T.code_mix_score)
    assert sc["script_mix_ratio"] == 0.0313 and sc["has_telugu_script"] and sc["is_tenglish"]


def test_dedup_key_collapses_case_and_space(spark):
    a = one(spark, py_strip("A  B c"), T.dedup_key)
    b = one(spark, py_strip("a b C 👍"), T.dedup_key)
    assert a == b == "a b c"


def test_permalink_and_defaults(spark):
    assert one(spark, "https://x/a/status/1/photo/1", T.permalink_id) == "1/photo/1"
    assert one(spark, "https://x/a/status/77?s=20", T.permalink_id) == "77"
    assert one(spark, "https://x/a", T.permalink_id) == "https://x/a"
    assert one(spark, None, T.default_stat) == "0"
    assert one(spark, "1,204 Likes", T.stat_number) == 1204
    assert one(spark, "true", T.parse_flag) is True
    assert one(spark, "yes", T.parse_flag) is False
    assert one(spark, None, T.parse_flag) is False


ALPHABET = st.sampled_from(list("ab cZ_\t\n\x1c\x85  　‍1.!") +
                           ["👍", "❤", "️", "⭐", "క", "ా", "ఆ", "é", "ß", "ledu", "RA", "bro"])
TEXTS = st.lists(ALPHABET, max_size=25).map("".join)


@settings(max_examples=30, deadline=None)
@given(texts=st.lists(TEXTS, min_size=1, max_size=20))
def test_properties_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i",
        T.unicode_trim("t").alias("trim"),
        T.strip_emoji("t").alias("strip"),
        T.word_count(T.strip_emoji("t")).alias("wc"),
        T.has_min_words(T.strip_emoji("t"), 3).alias("min3"),
        T.dedup_key(T.strip_emoji("t")).alias("key"),
        T.native_char_count("t").alias("native"),
        T.non_space_length("t").alias("nonspace"),
        T.lexicon_hits("t").alias("hits"),
        T.has_alpha_content(T.strip_emoji("t")).alias("alpha"),
    ).collect()
    for r in rows:
        s = texts[r["i"]]
        stripped = py_strip(s.strip())
        assert r["trim"] == s.strip()
        assert r["strip"] == py_strip(s)
        assert r["wc"] == len(stripped.split())
        assert r["min3"] == (len(stripped.split()) >= 3)
        assert r["key"] == py_key(stripped)
        assert r["native"] == len(PY_NATIVE.findall(s))
        assert r["nonspace"] == max(len(s.replace(" ", "")), 1)
        assert r["hits"] == len(PY_WORDS.findall(s))
        assert r["alpha"] == bool(re.search("[A-Za-zఀ-౿]", stripped))
