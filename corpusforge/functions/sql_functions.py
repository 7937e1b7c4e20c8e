"""SQL names for the text functions: ``CREATE TEMPORARY FUNCTION``.

``register_sql_functions(spark)`` makes the cleaning and scoring rules
callable from ``spark.sql``.  Each body is a plain SQL expression built
from the same constants as ``text.py``; Spark inlines SQL-function bodies,
so calls stay inside whole-stage codegen (no Python).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import consts as K


def _raw(s: str) -> str:
    """A Spark SQL raw string literal (no backslash processing)."""
    assert "'" not in s
    return f"r'{s}'"


def _bodies(block: K.ScriptBlock = K.TELUGU) -> dict[str, tuple[str, str]]:
    ws, nat = _raw(K.WS_CHARS), _raw(block.char_class)
    alpha = _raw(f"[A-Za-z\\x{{{block.lo:04X}}}-\\x{{{block.hi:04X}}}]")
    trim = f"trim(BOTH {ws} FROM x)"
    strip = f"trim(BOTH {ws} FROM regexp_replace(x, {_raw(K.EMOJI_CLASS + '+')}, ''))"
    words = lambda lex: ", ".join(f"'{w}'" for w in dict.fromkeys(lex))
    hits = lambda lex: (f"size(filter(split(lower(x), {_raw(K.NON_WORD_CLASS + '+')}), "  # noqa: E731
                        f"t -> t IN ({words(lex)})))")
    native_n = f"regexp_count(x, {nat})"
    nonspace = "greatest(length(replace(x, ' ', '')), 1)"
    ratio = f"round(CAST({native_n} AS DOUBLE) / {nonspace}, 4)"
    nws = "[^" + K.WS_CLASS[1:-1] + "]"
    min_pat = _raw(f"^{K.WS_CLASS}*(?:{nws}+{K.WS_CLASS}+){{{K.MIN_WORDS - 1}}}{nws}")
    min_words = f"regexp_like(x, {min_pat})"
    return {
        "unicode_trim": ("STRING", trim),
        "strip_emoji": ("STRING", strip),
        "has_alpha_content": ("BOOLEAN", f"regexp_like(x, {alpha})"),
        "word_count": ("INT", f"CASE WHEN {trim} = '' THEN 0 ELSE size(split({trim}, {_raw(K.WS_CLASS + '+')})) END"),
        "has_native_script": ("BOOLEAN", f"regexp_like(x, {nat})"),
        "dedup_key": ("STRING", f"regexp_replace(lower(x), {_raw(K.WS_CLASS + '+')}, ' ')"),
        "native_char_count": ("INT", native_n),
        "non_space_length": ("INT", nonspace),
        "lexicon_hits": ("INT", hits(K.LEXICON_COMMENTS)),
        "script_mix_ratio": ("DOUBLE", ratio),
        "is_tenglish": ("BOOLEAN", f"({native_n} > 0 OR {ratio} >= {K.MIX_RATIO} OR {hits(K.LEXICON_COMMENTS)} >= 1)"),
        "is_code_mixed": ("BOOLEAN", f"(regexp_like(x, {nat}) OR {hits(K.LEXICON_POSTS)} > 0)"),
        "permalink_id": ("STRING", "substring_index(substring_index(x, '/status/', -1), '?', 1)"),
        "has_min_words": ("BOOLEAN", min_words),
        # rules 1-3 of the cleaning chain on one text (null = survives to the duplicate check)
        "rule_verdict": ("STRING", (
            f"CASE WHEN x IS NULL OR {trim} = '' THEN 'empty_or_nan' "
            f"WHEN NOT regexp_like({strip}, {alpha}) THEN 'emoji_or_symbol_only' "
            f"WHEN NOT regexp_like({strip}, {min_pat}) "
            f"AND NOT regexp_like({trim}, {nat}) THEN 'too_short_no_telugu' END")),
    }


def register_sql_functions(spark: SparkSession, block: K.ScriptBlock = K.TELUGU) -> list[str]:
    """Register the functions as session-scoped SQL functions; returns their names."""
    names = []
    for name, (rtype, body) in _bodies(block).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {rtype} RETURN {body}")
        names.append(name)
    return names
