"""How well each field separates the classes of a label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlode.functions import information as info
from pathlode.operators.drift import ordered_comparison
from pathlode.operators.ordered import running


class SeparationError(ValueError):
    """No labelled record, a missing label field, one class only, or a base rate outside 0 to 1."""


def feature_counts(table: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, value, label, n; a missing value is the bucket ``(absent)``."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("(absent)")).alias("value")) for f in features])
    rows = table.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{label}`").cast("string").alias("label"), F.explode(cells).alias("c"))
    return rows.groupBy("c.feature", "c.value", "label").agg(F.count("*").alias("n"))


def separation(table: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, coverage, distinct_values, mutual_information, conditional_entropy, relationship_strength."""
    if label not in table.columns:
        raise SeparationError(f"no label field {label}")
    joint = feature_counts(table, label, features)
    by_value = joint.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    by_label = joint.groupBy("feature", "label").agg(F.sum("n").alias("n"))
    hv = by_value.groupBy("feature").agg(
        info.entropy(F.col("n")).alias("hv"), F.sum("n").alias("total"), F.sum(F.when(F.col("value") != "(absent)", F.col("n")).otherwise(0)).alias("present"), F.count_if(F.col("value") != "(absent)").alias("distinct_values")
    )
    hl = by_label.groupBy("feature").agg(info.entropy(F.col("n")).alias("hl"))
    hj = joint.groupBy("feature").agg(info.entropy(F.col("n")).alias("hj"))
    given = F.greatest(F.lit(0.0), F.col("hj") - F.col("hv"))
    return hv.join(hl, "feature").join(hj, "feature").select(
        "feature",
        F.col("total").alias("count"),
        (F.col("present") / F.col("total")).alias("coverage"),
        "distinct_values",
        F.greatest(F.lit(0.0), F.col("hl") + F.col("hv") - F.col("hj")).alias("mutual_information"),
        given.alias("conditional_entropy"),
        F.when(F.col("hl") > 1e-12, 1 - given / F.col("hl")).otherwise(F.lit(1.0)).alias("relationship_strength"),
    )


def numeric_pairs(table: DataFrame, label: str, positive: str, features: list[str]) -> DataFrame:
    """feature, num, a (positives), b (negatives): counts of each number by class."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("num")) for f in features])
    rows = table.where(F.col(f"`{label}`").isNotNull()).select((F.col(f"`{label}`").cast("string") == positive).alias("pos"), F.explode(cells).alias("c")).where("c.num is not null")
    return rows.groupBy("c.feature", "c.num").agg(F.count_if("pos").alias("a"), F.count_if(~F.col("pos")).alias("b"))


def auc(table: DataFrame, label: str, positive: str, features: list[str]) -> DataFrame:
    """feature, auc (midranks) and separation, its distance from chance on a scale of 0 to 1."""
    out = ordered_comparison(numeric_pairs(table, label, positive, features), ("feature",), "num")
    return out.select("feature", "auc", F.abs(2 * F.col("auc") - 1).alias("separation"))


def operating_point(table: DataFrame, label: str, positive: str, features: list[str], base_rate: float | None = None) -> DataFrame:
    """The threshold of each feature with the largest |J|: rule ``>=`` or ``<``, threshold, tpr, fpr, youden_j, precision.

    A rule whose J is negative is reported as its complement. Ties keep the smallest threshold. Precision
    is that at ``base_rate``, or at the rate seen.
    """
    if base_rate is not None and not 0 < base_rate < 1:
        raise SeparationError("the base rate lies between 0 and 1")
    counted = numeric_pairs(table, label, positive, features)
    run = running(counted, ("feature",), "num", ("a", "b")).select(
        "feature", "num", F.col("total_a").alias("na"), F.col("total_b").alias("nb"), F.col("before_a").alias("ca"), F.col("before_b").alias("cb")
    ).where("na > 0 and nb > 0")
    at = run.select("feature", "num", "na", "nb", (1 - F.col("ca") / F.col("na")).alias("t"), (1 - F.col("cb") / F.col("nb")).alias("f"))
    best = at.groupBy("feature").agg(F.max(F.struct(F.abs(F.col("t") - F.col("f")).alias("j"), (-F.col("num")).alias("first"), "num", "t", "f", "na", "nb")).alias("m"))
    up = F.col("m.t") >= F.col("m.f")
    tpr, fpr = F.when(up, F.col("m.t")).otherwise(1 - F.col("m.t")), F.when(up, F.col("m.f")).otherwise(1 - F.col("m.f"))
    rate = F.lit(base_rate) if base_rate is not None else F.col("m.na") / (F.col("m.na") + F.col("m.nb"))
    hit = tpr * rate
    return best.select(
        "feature",
        F.when(up, ">=").otherwise("<").alias("rule"),
        F.col("m.num").alias("threshold"),
        tpr.alias("tpr"),
        fpr.alias("fpr"),
        F.col("m.j").alias("youden_j"),
        F.when(hit + fpr * (1 - rate) > 0, hit / (hit + fpr * (1 - rate))).alias("precision_at_base_rate"),
    )


def operating_category(table: DataFrame, label: str, positive: str, features: list[str], base_rate: float | None = None) -> DataFrame:
    """The value of each feature that, as an indicator, has the largest |J|: rule ``==`` or ``!=``, value, tpr, fpr, youden_j, precision.

    A missing value is the value ``(absent)``. Ties keep the first value in text order; a feature without both
    classes has no row. Precision as in :func:`operating_point`.
    """
    if base_rate is not None and not 0 < base_rate < 1:
        raise SeparationError("the base rate lies between 0 and 1")
    hit, miss = F.col("label") == positive, F.col("label") != positive
    counted = feature_counts(table, label, features).groupBy("feature", "value").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(miss, F.col("n")).otherwise(0)).alias("b"))
    totals = counted.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).where("na > 0 and nb > 0")
    at = counted.join(totals, "feature").select("feature", "value", "na", "nb", (F.col("a") / F.col("na")).alias("t"), (F.col("b") / F.col("nb")).alias("f"))
    best = at.groupBy("feature").agg(F.min(F.struct((-F.abs(F.col("t") - F.col("f"))).alias("j"), "value", "t", "f", "na", "nb")).alias("m"))
    same = F.col("m.t") >= F.col("m.f")
    tpr, fpr = F.when(same, F.col("m.t")).otherwise(1 - F.col("m.t")), F.when(same, F.col("m.f")).otherwise(1 - F.col("m.f"))
    rate = F.lit(base_rate) if base_rate is not None else F.col("m.na") / (F.col("m.na") + F.col("m.nb"))
    right, wrong = tpr * rate, fpr * (1 - rate)
    return best.select(
        "feature",
        F.when(same, "==").otherwise("!=").alias("rule"),
        F.col("m.value").alias("value"),
        tpr.alias("tpr"),
        fpr.alias("fpr"),
        (-F.col("m.j")).alias("youden_j"),
        F.when(right + wrong > 0, right / (right + wrong)).otherwise(F.lit(0.0)).alias("precision_at_base_rate"),
    )
