"""Column functions for text scoring and cleaning.

Every function takes and returns ``pyspark.sql.Column`` and is built only
from native Spark expressions, so it stays inside whole-stage codegen and
needs no Python worker.  Character classes come from ``consts`` and are
spelled out explicitly because Java's ``\\s``/``\\b`` and Python's differ.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import consts as K

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P1 / P2 / P3 / P4 / P5 -------------------------------------------------

def unicode_trim(c: ColumnOrName, chars: str = K.WS_CHARS) -> Column:
    """Strip Unicode whitespace at both ends.

    ``trim(BOTH chars FROM c)`` with the explicit character set (plain
    ``F.trim`` strips only U+0020); a set scan from both ends, no regex.
    """
    return F.trim(_c(c), F.lit(chars))


def js_trim(c: ColumnOrName) -> Column:
    """Whitespace trim with JavaScript ``String.trim`` semantics."""
    return unicode_trim(c, K.JS_WS_CHARS)


def ws_to_space(c: ColumnOrName) -> Column:
    """Every Unicode whitespace character mapped to U+0020 (a code-point map, no regex)."""
    return F.translate(_c(c), K.WS_CHARS, " " * len(K.WS_CHARS))


def strip_emoji(c: ColumnOrName) -> Column:
    """Delete pictographs without a replacement space, then trim."""
    return unicode_trim(F.regexp_replace(_c(c), K.EMOJI_CLASS + "+", ""))


def has_alpha_content(c: ColumnOrName, block: K.ScriptBlock = K.TELUGU) -> Column:
    """Any ASCII letter or any character of the native block."""
    return _c(c).rlike(f"[A-Za-z\\x{{{block.lo:04X}}}-\\x{{{block.hi:04X}}}]")


def word_count(c: ColumnOrName) -> Column:
    """Number of whitespace-separated tokens (maximal non-space runs).

    Trim, then split on whitespace runs; blank text has 0 tokens.
    """
    trimmed = unicode_trim(c)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, K.WS_CLASS + "+")))


def has_min_words(c: ColumnOrName, n: int) -> Column:
    """At least ``n`` whitespace-separated tokens.

    The anchored regex stops at the start of the n-th token, so its cost
    does not depend on the text length (no full-text pass or copy).
    """
    if n <= 0:
        return F.lit(True)
    ws, nws = K.WS_CLASS, "[^" + K.WS_CLASS[1:-1] + "]"
    return _c(c).rlike(f"^{ws}*(?:{nws}+{ws}+){{{n - 1}}}{nws}")


def has_native_script(c: ColumnOrName, block: K.ScriptBlock = K.TELUGU) -> Column:
    """P5: any character in the native block."""
    return _c(c).rlike(block.char_class)


# --- P6 / P7 / P8 / P9 / P10 / P11 ------------------------------------------

def dedup_key(stripped: ColumnOrName) -> Column:
    """Lower case + whitespace runs collapsed to one space.

    Whitespace is first mapped to U+0020 by ``translate``; the regex then
    only touches runs of two or more spaces, which are rare.
    """
    return F.regexp_replace(ws_to_space(F.lower(_c(stripped))), "  +", " ")


def native_char_count(c: ColumnOrName, block: K.ScriptBlock = K.TELUGU) -> Column:
    """Number of native-block code points."""
    return F.regexp_count(_c(c), F.lit(block.char_class))


def non_space_length(c: ColumnOrName) -> Column:
    """``max(len(text.replace(' ', '')), 1)`` — removes U+0020 only."""
    return F.greatest(F.length(F.replace(_c(c), F.lit(" "), F.lit(""))), F.lit(1))


def word_tokens(c: ColumnOrName) -> Column:
    """Lower-cased word tokens: maximal runs of letters, numbers and '_'."""
    return F.filter(F.split(F.lower(_c(c)), K.NON_WORD_CLASS + "+"), lambda x: x != "")


def lexicon_hits(c: ColumnOrName, words: Iterable[str] = K.LEXICON_COMMENTS) -> Column:
    """Whole-word, case-insensitive vocabulary matches.

    Counting tokens that are in the vocabulary equals counting
    ``\\b(w1|w2|...)\\b`` matches with Unicode word boundaries; the
    ``isin`` list becomes a hash-set lookup (InSet) in the optimizer.
    """
    vocab = list(dict.fromkeys(words))
    return F.size(F.filter(word_tokens(c), lambda x: x.isin(vocab)))


def ratio_round(num: ColumnOrName, den: ColumnOrName, digits: int = 4) -> Column:
    """``round(num / den, digits)`` with half-up rounding."""
    return F.round(_c(num).cast("double") / _c(den).cast("double"), digits)


def code_mix_score(c: ColumnOrName, block: K.ScriptBlock = K.TELUGU,
                   words: Iterable[str] = K.LEXICON_COMMENTS,
                   min_ratio: float = K.MIX_RATIO) -> Column:
    """P10: struct(has_telugu_script, script_mix_ratio, roman_telugu_hits, is_tenglish)."""
    native = native_char_count(c, block)
    ratio = ratio_round(native, non_space_length(c))
    hits = lexicon_hits(c, words)
    return F.struct(
        (native > 0).alias("has_telugu_script"),
        ratio.alias("script_mix_ratio"),
        hits.alias("roman_telugu_hits"),
        ((native > 0) | (ratio >= F.lit(min_ratio)) | (hits >= 1)).alias("is_tenglish"),
    )


def is_code_mixed(c: ColumnOrName, block: K.ScriptBlock = K.TELUGU,
                  words: Iterable[str] = K.LEXICON_POSTS) -> Column:
    """Native script present OR any vocabulary word."""
    return has_native_script(c, block) | (lexicon_hits(c, words) > 0)


# --- P12 .. P17 -------------------------------------------------------------

def permalink_id(href: ColumnOrName) -> Column:
    """``href.split('/status/')[-1].split('?')[0]``."""
    return F.substring_index(F.substring_index(_c(href), "/status/", -1), "?", 1)


def fallback_id(permalink: ColumnOrName, text: ColumnOrName) -> Column:
    """Permalink id, else a deterministic digest of the text."""
    return F.coalesce(_c(permalink), F.sha2(_c(text), 256))


def title_preview(c: ColumnOrName, n: int = 80) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(c), 1, n)


def _blank_to_null(c: ColumnOrName) -> Column:
    return F.nullif(_c(c), F.lit(""))


def date_part(primary: ColumnOrName, fallback: ColumnOrName) -> Column:
    """First 10 characters of the first non-empty timestamp string."""
    return F.substring(F.coalesce(_blank_to_null(primary), _blank_to_null(fallback), F.lit("")), 1, 10)


def coalesce_source(primary: ColumnOrName, fallback: ColumnOrName, missing: str = "—") -> Column:
    """First non-empty of two source names, else a dash."""
    return F.coalesce(_blank_to_null(primary), _blank_to_null(fallback), F.lit(missing))


def parse_flag(c: ColumnOrName) -> Column:
    """P17: 'True' | 'true' | '1' -> true, anything else (incl. null) -> false."""
    return F.coalesce(_c(c).isin(*K.TRUE_FLAGS), F.lit(False))


# --- P19 .. P21, P26 --------------------------------------------------------

def pct_one_dp(x: ColumnOrName, n: ColumnOrName) -> Column:
    """``100 * x / max(n, 1)`` rounded to one decimal."""
    return F.round(F.lit(100.0) * _c(x) / F.greatest(_c(n), F.lit(1)), 1)


def pct_int(n: ColumnOrName, done: ColumnOrName) -> Column:
    """P20: ``Math.round(n / done * 100)``, 0 when nothing is done."""
    return F.when(_c(done) > 0, F.round(_c(n).cast("double") / _c(done) * 100, 0)) \
        .otherwise(F.lit(0.0)).cast("bigint")


def decode_label(code: ColumnOrName, names: Mapping[int, str]) -> Column:
    """Numeric code -> label name; unset -> ''."""
    pairs = []
    for k, v in names.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[_c(code)], F.lit(""))


def default_stat(c: ColumnOrName, default: str = "0") -> Column:
    """Display string of an engagement stat, '0' when missing."""
    return F.coalesce(_blank_to_null(c), F.lit(default))


def stat_number(c: ColumnOrName) -> Column:
    """Numeric part of an engagement display string such as '1,204 Likes'."""
    digits = F.regexp_replace(F.regexp_extract(_c(c), "([0-9][0-9,]*)", 1), ",", "")
    return F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
