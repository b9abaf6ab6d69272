"""Differences between two node tables, or between the groups of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.operators.ordered import running
from pathlode.operators.profile import path_inventory
from pathlode.sources.tables import scalars

JSD_CUT, W_CUT, JSD_MAJOR, W_MAJOR = 0.05, 0.1, 0.3, 1.0


def path_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, status (added, removed or shared) of the paths of two node tables."""
    a = left.select("path").distinct().withColumn("l", F.lit(True))
    b = right.select("path").distinct().withColumn("r", F.lit(True))
    status = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").otherwise("shared")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def jaccard_of_paths(diff: DataFrame) -> DataFrame:
    """One row: shared, total, jaccard; 1 when neither side has a path."""
    counts = diff.agg(F.count_if(F.col("status") == "shared").alias("shared"), F.count("*").alias("total"))
    return counts.withColumn("jaccard", F.when(F.col("total") > 0, F.col("shared") / F.col("total")).otherwise(F.lit(1.0)))


def type_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared paths whose dominant type differs: path, from_type, to_type."""
    a = path_inventory(left).select("path", F.col("dominant_type").alias("from_type"))
    b = path_inventory(right).select("path", F.col("dominant_type").alias("to_type"))
    return a.join(b, "path").where("from_type <> to_type")


def paired_counts(values: DataFrame, group: str, item: str, pairs: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Counts of each item in both groups of each pair: group_a, group_b, keys, item, a, b.

    Values are counted by group once; the pairs meet the counts, not the rows.
    """
    counts = values.groupBy(group, *keys, item).agg(F.count("*").alias("n"))
    side_a = counts.join(pairs, F.col(group) == F.col("group_a")).select("group_a", "group_b", *keys, item, F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    side_b = counts.join(pairs, F.col(group) == F.col("group_b")).select("group_a", "group_b", *keys, item, F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    return side_a.union(side_b).groupBy("group_a", "group_b", *keys, item).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def group_pairs(values: DataFrame, group: str) -> DataFrame:
    """All pairs of groups (group_a < group_b); the number of groups is small by nature."""
    names = values.select(F.col(group).alias("g")).where("g is not null").distinct()
    return names.select(F.col("g").alias("group_a")).join(names.select(F.col("g").alias("group_b")), F.col("group_a") < F.col("group_b"))


def jensen_shannon(paired: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, jsd (base 2) and jsd_metric (its root), from counts a and b of each value.

    sum p log2 p needs the totals only at the end: with counts, sum a log2(a / m) splits into sums that
    one aggregation gives, because m is a weighted sum of a and b; the totals come from a first one.
    """
    totals = paired.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).where("na > 0 and nb > 0")
    p, q = F.col("a") / F.col("na"), F.col("b") / F.col("nb")
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    out = paired.join(totals, list(keys)).groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum(term) / 2).alias("jsd"))
    return out.withColumn("jsd_metric", F.sqrt("jsd"))


def ordered_comparison(paired: DataFrame, keys: tuple[str, ...], item: str = "num") -> DataFrame:
    """keys, wasserstein, cliffs_delta and auc of two numeric samples given by counts a and b of each number.

    Running sums in the order of the numbers give the distance between the two cumulative distributions
    and the rank comparison. Null numbers are left out.
    """
    run = running(paired, keys, item, ("a", "b")).select(
        *keys, item, "a", "b",
        (F.col("before_a") + F.col("a")).alias("ca"), (F.col("before_b") + F.col("b")).alias("cb"),
        F.col("total_a").alias("na"), F.col("total_b").alias("nb"),
        (F.col(f"next_{item}") - F.col(item)).alias("step"),
    ).where("na > 0 and nb > 0")
    gap = F.coalesce(F.col("step") * F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb")), F.lit(0.0))
    # b's below this number minus b's above it
    balance = (F.col("cb") - F.col("b")) - (F.col("nb") - F.col("cb"))
    out = run.groupBy(*keys).agg(F.sum(gap).alias("wasserstein"), (F.sum(F.col("a") * balance).cast("double") / (F.first("na") * F.first("nb"))).alias("cliffs_delta"))
    return out.withColumn("auc", (F.col("cliffs_delta") + 1) / 2)


def severity(removed: Column, changed: Column, added: Column, jsd: Column, wasserstein: Column) -> Column:
    """critical, high, medium, low or none, from counts of path differences and the largest drifts."""
    return (
        F.when(removed > 0, "critical")
        .when((changed > 0) | (jsd > JSD_MAJOR) | (wasserstein > W_MAJOR), "high")
        .when(added > 0, "medium")
        .when((jsd > JSD_CUT) | (wasserstein > W_CUT), "low")
        .otherwise("none")
    )


def population_drift(nodes: DataFrame, group: str) -> DataFrame:
    """For each pair of groups and each path: metric (wasserstein or jsd), value and effect_size of what drifts.

    ``nodes`` carries the column ``group``. Paths that are numeric in both groups are compared as numbers,
    others as sets of values.
    """
    values = scalars(nodes).where(F.col(group).isNotNull())
    pairs = group_pairs(values, group)
    kinds = path_inventory(values, keys=(group,)).select(F.col(group).alias("g"), F.col("path").alias("p"), F.col("dominant_type").isin("integer", "float").alias("numeric"))
    both = (
        pairs.join(kinds.select(F.col("g").alias("group_a"), "p", F.col("numeric").alias("na")), "group_a")
        .join(kinds.select(F.col("g").alias("group_b"), "p", F.col("numeric").alias("nb")), ["group_b", "p"])
        .select("group_a", "group_b", F.col("p").alias("path"), (F.col("na") & F.col("nb")).alias("numeric"))
    )
    keys = ("group_a", "group_b", "path")
    numbers = values.withColumn("number", F.coalesce("num", F.expr("try_cast(value AS double)"))).where("number is not null")
    by_number = paired_counts(numbers, group, "number", pairs).join(both.where("numeric").drop("numeric"), list(keys), "left_semi")
    by_value = paired_counts(values, group, "value", pairs).join(both.where("not numeric").drop("numeric"), list(keys), "left_semi")
    w = ordered_comparison(by_number, keys, "number").select(*keys, F.lit("wasserstein").alias("metric"), F.col("wasserstein").alias("value"), F.abs("cliffs_delta").alias("effect_size"))
    j = jensen_shannon(by_value, keys).select(*keys, F.lit("jsd").alias("metric"), F.col("jsd").alias("value"), F.col("jsd").alias("effect_size"))
    return w.where(F.col("value") > W_CUT).union(j.where(F.col("value") > JSD_CUT))


def full_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: added, removed, shared and changed paths, similarity, largest drifts and severity."""
    diff = path_diff(left, right)
    counts = diff.agg(
        F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "removed").alias("removed"), F.count_if(F.col("status") == "shared").alias("shared"), F.count("*").alias("total")
    )
    changed = type_changes(left, right).agg(F.count("*").alias("changed")).scalar()
    both = left.withColumn("side", F.lit("a")).unionByName(right.withColumn("side", F.lit("b")), allowMissingColumns=True)
    found = population_drift(both, "side").agg(
        F.max(F.when(F.col("metric") == "jsd", F.col("value"))).alias("max_jsd"), F.max(F.when(F.col("metric") == "wasserstein", F.col("value"))).alias("max_wasserstein")
    )
    jsd, w = F.coalesce(found.select("max_jsd").scalar(), F.lit(0.0)), F.coalesce(found.select("max_wasserstein").scalar(), F.lit(0.0))
    row = counts.select("added", "removed", "shared", changed.alias("changed"), F.when(F.col("total") > 0, F.col("shared") / F.col("total")).otherwise(F.lit(1.0)).alias("structural_similarity"), jsd.alias("max_jsd"), w.alias("max_wasserstein"))
    return row.withColumn("severity", severity(F.col("removed"), F.col("changed"), F.col("added"), F.col("max_jsd"), F.col("max_wasserstein")))
