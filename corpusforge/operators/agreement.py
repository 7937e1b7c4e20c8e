"""Inter-annotator agreement.

Pairs come from one conditional aggregate per item (no self-join, tasks are
spread out only afterwards).  Kappa comes from one contingency table (task,
a, b, n) over the pairs: p_o is its diagonal share, p_e the sum over classes
of the two marginal shares multiplied, both read off the table's few cells
per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import consts as K
from .annotate import CODES


def paired_ratings(labels: DataFrame, annotator_a: int = 0, annotator_b: int = 1) -> DataFrame:
    """Items labeled by both annotators, one row per (item, task) with both codes.

    ``labels`` holds one row per annotator and item (see ``latest_labels``).
    """
    def code(annotator: int, name: str) -> Column:
        return F.max(F.when(F.col("annotator") == annotator, F.col(name))).cast("int")

    per_item = labels.where(F.col("annotator").isin(annotator_a, annotator_b)).groupBy("item").agg(
        *[code(x, c).alias(f"_{side}_{c}") for c in CODES for side, x in (("a", annotator_a), ("b", annotator_b))])
    both = [F.struct(F.lit(task).alias("task"), F.col(f"_a_{c}").alias("a"), F.col(f"_b_{c}").alias("b")) for task, c, _ in K.TASKS]
    rated = F.filter(F.array(*both), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    return per_item.select("item", F.inline(rated))


def contingency(pairs: DataFrame, group_cols: Sequence[str] = ("task",)) -> DataFrame:
    """Per group the cells (a, b, n) of its contingency table as one array; pairs without a rating are left out."""
    cells = (pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull())
             .groupBy(*group_cols, "a", "b").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    return cells.groupBy(*group_cols).agg(F.collect_list(F.struct("a", "b", "n")).alias("cells"))


def cohens_kappa(pairs: DataFrame, group_cols: Sequence[str] = ("task",),
                 target: float = K.KAPPA_TARGET) -> DataFrame:
    """Kappa per group; null when chance agreement is 1 (one class only)."""
    g = list(group_cols)

    def total(of=lambda c: F.lit(True)) -> Column:
        return F.aggregate(F.filter("cells", of), F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])

    classes = F.array_distinct(F.transform("cells", lambda c: c["a"]))
    chance = F.aggregate(F.transform(classes, lambda k: total(lambda c: c["a"] == k).cast("double") * total(lambda c: c["b"] == k)),
                         F.lit(0.0), lambda acc, x: acc + x)
    t = contingency(pairs, g).select(*g, total().alias("n"), total(lambda c: c["a"] == c["b"]).alias("_agree"), chance.alias("_chance"))
    po = F.col("_agree") / F.col("n")
    pe = F.col("_chance") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(pe < 1.0, (po - pe) / (F.lit(1.0) - pe))
    return t.select(*g, "n", F.round(po, 6).alias("p_o"), F.round(pe, 6).alias("p_e"),
                    F.round(kappa, 6).alias("kappa"),
                    F.coalesce(F.round(kappa, 6) >= target, F.lit(False)).alias("meets_target"))


def agreement_matrix(pairs: DataFrame, classes: Sequence[int] = (0, 1, 2),
                     group_cols: Sequence[str] = ("task",)) -> DataFrame:
    """A10: confusion counts, rater a down, rater b across (columns ``b_<class>``)."""
    return pairs.groupBy(*group_cols, "a").agg(
        *[F.count(F.when(F.col("b") == c, 1)).cast("bigint").alias(f"b_{c}") for c in classes])
