"""Release: names under a secret key."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import release as R


@pytest.mark.parametrize("key", ["k", "a longer secret key", "é" * 32, "x" * 64, "y" * 200])
def test_author_hash_is_hmac(spark, key):
    names = ["", "name", "పేరు", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(R.anonymize_author(F.col("n"), key).alias("h")).collect()
    assert [r.h for r in got] == [hmac.new(key.encode(), (n or "").encode(), hashlib.sha256).hexdigest() for n in names]


def test_no_release_without_a_key(spark):
    spark.conf.unset(R.RELEASE_KEY_CONF)
    with pytest.raises(ValueError):
        R.release_key(spark)
    with pytest.raises(ValueError):
        R.anonymize_author(F.col("n"), "")
    spark.conf.set(R.RELEASE_KEY_CONF, "secret")
    try:
        assert R.release_key(spark) == "secret"
    finally:
        spark.conf.unset(R.RELEASE_KEY_CONF)
