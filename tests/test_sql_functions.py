"""SQL-named functions agree with the Column functions on the whole smoke corpus."""

from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.functions.sql_functions import register_sql_functions
from corpusforge.operators import clean as C
from corpusforge.plans import views as V


def test_sql_functions_match_columns(spark, sf_dir):
    names = register_sql_functions(spark)
    assert "strip_emoji" in names and "rule_verdict" in names
    V.register(spark, sf_dir)
    sql = spark.sql("""
        SELECT comment_id, unicode_trim(text) AS a, strip_emoji(text) AS b, has_alpha_content(strip_emoji(text)) AS c,
               word_count(strip_emoji(text)) AS d, dedup_key(strip_emoji(text)) AS e, lexicon_hits(text) AS f,
               script_mix_ratio(coalesce(text, '')) AS g, is_tenglish(coalesce(text, '')) AS h,
               is_code_mixed(text) AS i, rule_verdict(text) AS j
        FROM corpus_fx""")
    df = V.view(spark, sf_dir, "corpus_fx")
    x, s = F.col("text"), T.strip_emoji("text")
    sc = T.code_mix_score(F.coalesce(x, F.lit("")))
    ruled = C.with_rule_columns(df).select("comment_id", F.col("drop_reason").alias("j"))
    col = df.select("comment_id", T.unicode_trim(x).alias("a"), s.alias("b"), T.has_alpha_content(s).alias("c"),
                    T.word_count(s).alias("d"), T.dedup_key(s).alias("e"), T.lexicon_hits(x).alias("f"),
                    sc["script_mix_ratio"].alias("g"), sc["is_tenglish"].alias("h"),
                    T.is_code_mixed(x).alias("i")).join(ruled, "comment_id")
    a = sorted(tuple(r) for r in sql.collect())
    b = sorted(tuple(r[k] for k in sql.columns) for r in col.collect())
    assert a == b
