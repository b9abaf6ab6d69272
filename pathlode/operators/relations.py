"""Relationships between fields: conditional entropy, PMI, mutual information, total correlation, transfer entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlode.functions import information as info
from pathlode.operators.ordered import running


def binned(table: DataFrame, column: str, bins: int = 5, strategy: str = "quantile") -> DataFrame:
    """``table`` with ``column`` replaced by the text of its bin.

    Only numeric columns of more than ``bins`` distinct values are binned; others stay as they are.
    Quantile cuts are the values at positions i * n / bins of the sorted column; a value's bin is the
    number of cuts below it. Equal-width bins split the range evenly.
    """
    x = F.col(f"`{column}`")
    if strategy == "none" or dict(table.dtypes)[column] in ("string", "boolean", "date", "timestamp"):
        return table
    counts = table.where(x.isNotNull()).groupBy(x.cast("double").alias("x")).agg(F.count("*").alias("c"))
    if strategy == "equal-width":
        r = counts.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("d")).first()
        if not r.d or r.d <= bins or r.hi == r.lo:
            return table
        width = (r.hi - r.lo) / bins
        cell = F.least(F.lit(bins - 1), F.floor((x.cast("double") - r.lo) / width))
        return table.withColumn(column, F.when(x.isNotNull(), cell.cast("int").cast("string")))
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("d")).first()
    if not size.n or size.d <= bins:
        return table
    at = F.array(*[F.lit(i * size.n // bins) for i in range(1, bins)])
    before = F.col("before_c")
    hits = running(counts, (), "x", ("c",)).select("x", F.explode(F.filter(at, lambda k: (k >= before) & (k < before + F.col("c")))).alias("k"))
    cuts = [r.x for r in hits.orderBy("k").collect()]  # bins - 1 numbers
    cell = sum(((F.lit(c) < x.cast("double")).cast("int") for c in cuts), F.lit(0))
    return table.withColumn(column, F.when(x.isNotNull(), cell.cast("string")))


def pair_counts(table: DataFrame, columns: list[str], record: Column | None = None) -> DataFrame:
    """Joint counts of all ordered pairs of columns in one pass: field_x, field_y, x, y, n.

    Each row becomes one array of pairs in place, so no column meets another through a join.
    """
    text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns}
    pairs = F.array(*[F.struct(F.lit(a).alias("field_x"), F.lit(b).alias("field_y"), text[a].alias("x"), text[b].alias("y")) for a in columns for b in columns if a != b])
    return table.select(F.explode(pairs).alias("p")).groupBy("p.field_x", "p.field_y", "p.x", "p.y").agg(F.count("*").alias("n"))


def relationships(joint: DataFrame) -> DataFrame:
    """For each ordered pair of fields: conditional_entropy H(Y|X), mean_pmi, mutual_information, relationship_strength.

    Mutual information is averaged over both directions and never negative; strength is
    1 - H(Y|X) / H(Y), and 1 where Y does not vary; PMI is the plain mean over distinct pairs.
    """
    keys = ("field_x", "field_y")
    x = joint.groupBy(*keys, "x").agg(F.sum("n").alias("nx"))
    y = joint.groupBy(*keys, "y").agg(F.sum("n").alias("ny"))
    hx = x.groupBy(*keys).agg(info.entropy(F.col("nx")).alias("hx"), F.sum("nx").alias("total"))
    hy = y.groupBy(*keys).agg(info.entropy(F.col("ny")).alias("hy"))
    hxy = joint.groupBy(*keys).agg(info.entropy(F.col("n")).alias("hxy"))
    pmi = joint.join(x, [*keys, "x"]).join(y, [*keys, "y"]).join(hx.select(*keys, "total"), list(keys))
    pmi = pmi.groupBy(*keys).agg(F.avg(F.log2(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mean_pmi"))
    every = hx.join(hy, list(keys)).join(hxy, list(keys)).join(pmi, list(keys))
    given = F.greatest(F.lit(0.0), F.col("hxy") - F.col("hx"))
    return every.select(
        *keys,
        given.alias("conditional_entropy"),
        "mean_pmi",
        F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy")).alias("mutual_information"),
        F.when(F.col("hy") > 1e-12, 1 - given / F.col("hy")).otherwise(F.lit(1.0)).alias("relationship_strength"),
    )


def discover(table: DataFrame, columns: list[str] | None = None, top_k: int = 50, bins: int | None = None) -> DataFrame:
    """Relationships among the first ``top_k`` columns, both directions, strongest first."""
    chosen = (columns or table.columns)[:top_k]
    slim = table.select(*[F.col(f"`{c}`") for c in chosen])
    if bins:
        for c in chosen:
            slim = binned(slim, c, bins)
    return relationships(pair_counts(slim, chosen))


def total_correlation(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row: sum of the columns' entropies, their joint entropy, total_correlation, over records that have all."""
    full = table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).dropna()
    joint = full.groupBy(*columns).agg(F.count("*").alias("n"))
    each = joint.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("v")) for c in columns])).alias("e"), "n").groupBy("e.field", "e.v").agg(F.sum("n").alias("n"))
    sums = each.groupBy("field").agg(info.entropy(F.col("n")).alias("h")).agg(F.sum("h").alias("sum_entropy"))
    whole = joint.agg(info.entropy(F.col("n")).alias("joint_entropy"))
    return sums.select("sum_entropy", whole.scalar().alias("joint_entropy")).withColumn("total_correlation", F.greatest(F.lit(0.0), F.col("sum_entropy") - F.col("joint_entropy")))


def transfer_entropy(series: DataFrame, entity: str, order: list[str], source: str, target: str, history: int = 1) -> DataFrame:
    """One row: transfer_entropy from ``source`` to ``target`` in bits, over all entities' sequences.

    H(Y_t | Y past) - H(Y_t | Y past, X past), with ``history`` steps of past; 0 at least.
    """
    w = Window.partitionBy(entity).orderBy(*order)

    def past(c: str) -> Column:
        steps = [F.lag(F.col(c).cast("string"), k).over(w) for k in range(1, history + 1)]
        return F.when(steps[-1].isNotNull(), F.concat_ws("\x01", *steps))

    rows = series.select(F.col(target).cast("string").alias("y"), past(target).alias("yp"), past(source).alias("xp")).where("y is not null and yp is not null and xp is not null")
    joint = rows.groupBy("y", "yp", "xp").agg(F.count("*").alias("n"))

    def h(*by: str) -> Column:
        return joint.groupBy(*by).agg(F.sum("n").alias("n")).agg(info.entropy(F.col("n")).alias("h")).scalar()

    te = (h("y", "yp") - h("yp")) - (h("y", "yp", "xp") - h("yp", "xp"))
    return joint.agg(F.sum("n").alias("transitions")).select("transitions", F.greatest(F.lit(0.0), te).alias("transfer_entropy"))
