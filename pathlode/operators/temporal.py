"""Dates, windows, trends, gaps and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlode.functions import information as info
from pathlode.operators.ordered import percentiles

#: Numbers in this range are read as seconds since 1970 (years 2000 to 2050).
EPOCH_RANGE = (946684800, 2524607999)
#: Keys that name the author of a record.
AUTHOR_KEYS = ("author", "committer", "user", "name")


def window_label(ts: Column, window: str) -> Column:
    """``YYYY-MM``, ``YYYY-Www`` (ISO week) or ``YYYY-MM-DD`` for month, week or day."""
    if window == "month":
        return F.date_format(ts, "yyyy-MM")
    if window == "week":
        return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    if window == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    raise ValueError(f"unknown window {window}")


def parse_time(text: Column) -> Column:
    """A timestamp from a string: ISO date-time (with an offset where there is no fraction), ISO date, US date, EU date, epoch seconds.

    A fraction of a second ends what is read, and with it the offset; years
    outside 1970 to 2100 give null.
    """
    date = r"(\d{4})-(\d{2})-(\d{2})"
    stamp = F.regexp_extract(text, rf"^({date}T\d{{2}}:\d{{2}}:\d{{2}})", 1)
    offset = F.regexp_extract(text, rf"^{date}T\d{{2}}:\d{{2}}:\d{{2}}([+-]\d{{2}}:?\d{{2}})", 4)
    minutes = F.when(offset != "", F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1) * (F.substring(offset, 2, 2).cast("int") * 60 + F.right(offset, F.lit(2)).cast("int"))).otherwise(0)
    iso = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss")) - F.make_interval(mins=minutes)
    day = F.try_to_timestamp(F.regexp_extract(text, rf"^({date})$", 1), F.lit("yyyy-MM-dd"))
    us = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/\d{4})$", 1), F.lit("M/d/yyyy"))
    eu = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{1,2}[.]\d{1,2}[.]\d{4})$", 1), F.lit("d.M.yyyy"))
    number = F.when(text.rlike(r"^\d{9,10}$"), text.cast("long"))
    epoch = F.when(number.between(*EPOCH_RANGE), F.timestamp_seconds(number))
    found = F.coalesce(iso, day, us, eu, epoch)
    return F.when(F.year(found).between(1970, 2100), found)


def date_kind(text: Column) -> Column:
    """iso_datetime, iso_date, us_date, eu_date, epoch or null, in that order."""
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}") & parse_time(text).isNotNull(), "iso_datetime")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & parse_time(text).isNotNull(), "iso_date")
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$") & parse_time(text).isNotNull(), "us_date")
        .when(text.rlike(r"^\d{1,2}[.]\d{1,2}[.]\d{4}$") & parse_time(text).isNotNull(), "eu_date")
        .when(text.rlike(r"^\d{9,10}$") & parse_time(text).isNotNull(), "epoch")
    )


def windowed(table: DataFrame, ts: str, window: str, fields: list[str]) -> DataFrame:
    """window, field, record_count, entropy, cardinality of each field in each window; null is a value."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("null")).alias("value")) for f in fields])
    rows = table.where(F.col(ts).isNotNull()).select(window_label(F.col(ts), window).alias("window"), F.explode(cells).alias("c"))
    counts = rows.groupBy("window", "c.field", "c.value").agg(F.count("*").alias("n"))
    return counts.groupBy("window", "field").agg(F.sum("n").alias("record_count"), info.entropy(F.col("n")).alias("entropy"), F.count("*").alias("cardinality"))


def trend(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, slope, r_squared, direction over the observed windows, numbered from 0 in order.

    A constant series fits perfectly and, not rising, is ``decreasing``; r² of 0.3 at most is ``stable``.
    """
    x = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    fitted = points.where(F.col(value).isNotNull()).select(*keys, x.cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    sums = fitted.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.regr_r2("y", "x").alias("r2"), F.var_pop("y").alias("v"))
    r2 = F.when(F.col("n") < 2, F.lit(0.0)).when(F.col("v") < 1e-12, F.lit(1.0)).otherwise(F.coalesce("r2", F.lit(0.0)))
    named = F.when(F.col("r_squared") <= 0.3, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return sums.withColumn("r_squared", r2).select(*keys, "slope", "r_squared", named.alias("direction"))


def gaps(table: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """For each key: events, duplicates (equal times in a row), median_gap, mad_gap, n_gaps beyond median + 3 MAD."""
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    steps = table.where(F.col(ts).isNotNull()).select(*keys, (t - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))).alias("gap"))
    counted = steps.where("gap is not null").groupBy(*keys, "gap").agg(F.count("*").alias("w"))
    mid = percentiles(counted, tuple(keys), "gap", "w", (0.5,)).select(*keys, F.col("p")[0].alias("median_gap"))
    both = counted.join(mid, keys)
    apart = both.select(*keys, F.abs(F.col("gap") - F.col("median_gap")).alias("apart"), "w")
    mad = percentiles(apart, tuple(keys), "apart", "w", (0.5,)).select(*keys, F.col("p")[0].alias("mad_gap"))
    limit = F.col("median_gap") + 3 * F.col("mad_gap")
    return both.join(mad, keys).groupBy(*keys, "median_gap", "mad_gap").agg(
        (F.sum("w") + 1).alias("events"), F.sum(F.when(F.col("gap") == 0, F.col("w")).otherwise(0)).alias("duplicates"), F.sum(F.when((limit > 0) & (F.col("gap") > limit), F.col("w")).otherwise(0)).alias("n_gaps")
    )


def is_response(event: Column, responses: list[str]) -> Column:
    """Whether an event's text contains one of the response words."""
    found = F.lit(False)
    for word in responses:
        found = found | F.contains(event, F.lit(word))
    return found


def cascades(table: DataFrame, entity: str, order: list[str], event: str, responses: list[str], keep: list[str] | None = None) -> DataFrame:
    """Triggers that a response to the same entity follows at once: entity, trigger, response and ``keep`` of both (``next_`` for the response's).

    One window per entity: the step after a response can never start with it, so looking one ahead is enough.
    """
    w = Window.partitionBy(entity).orderBy(*order)
    columns = [c for c in keep or [] if c != entity]
    ahead = table.where(F.col(entity).isNotNull() & F.col(event).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(event).alias("trigger"), F.lead(event).over(w).alias("response"), *columns, *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]
    )
    return ahead.where(~is_response(F.col("trigger"), responses) & is_response(F.col("response"), responses))


def hot_entities(table: DataFrame, found: DataFrame, entity: str, event: str) -> DataFrame:
    """entity, total, cascades, cascade_ratio and the lower end of its Wilson interval."""
    totals = table.where(F.col(entity).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("total"))
    hits = found.groupBy("entity").agg(F.count("*").alias("cascades"))
    both = totals.join(hits, "entity")
    return both.select("entity", "total", "cascades", (F.col("cascades") / F.col("total")).alias("cascade_ratio"), info.wilson_lower(F.col("cascades"), F.col("total")).alias("cascade_ratio_lower_bound"))


def monotonic(table: DataFrame, keys: list[str], order: list[str], ts: str) -> DataFrame:
    """For each key: events and whether each time, in the order of the records, is later than the one before."""
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    steps = table.where(F.col(ts).isNotNull()).select(*keys, (t - F.lag(t).over(Window.partitionBy(*keys).orderBy(*order))).alias("step"))
    return steps.groupBy(*keys).agg(F.count("*").alias("events"), F.coalesce(F.every(F.col("step") > 0), F.lit(True)).alias("is_monotonic"))


def cascade_summary(table: DataFrame, found: DataFrame, entity: str, author: str) -> DataFrame:
    """One row: total_events, cascades, cascade_rate, self_fix_rate of cascades that keep ``author``.

    The self-fix rate is the share of cascades whose trigger and response have the same author, 0 without
    cascades. Where the entity is the author it would always be 1 and is null instead.
    """
    same = F.count_if((F.col(author) == F.col(f"next_{author}")) & (F.col(author).cast("string") != ""))
    hits = found.agg(F.count("*").alias("cascades"), same.alias("same"))
    tautology = entity == author or entity.rsplit(".", 1)[-1].removesuffix("[*]") in AUTHOR_KEYS
    rate = F.lit(None).cast("double") if tautology else F.when(F.col("cascades") > 0, F.col("same") / F.col("cascades")).otherwise(F.lit(0.0))
    both = table.agg(F.count("*").alias("total_events")).crossJoin(hits)  # one row each
    return both.select("total_events", "cascades", F.when(F.col("total_events") > 0, F.col("cascades") / F.col("total_events")).otherwise(F.lit(0.0)).alias("cascade_rate"), rate.alias("self_fix_rate"))
