"""Who contributes how much: concentration, churn, tenure, identities, core team, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlode.functions import information as info
from pathlode.operators.fingerprints import connected


class MissingField(ValueError):
    """A field that the analysis needs is not there; the message lists those that are."""


def need(table: DataFrame, *fields: str) -> None:
    for f in fields:
        if f not in table.columns:
            raise MissingField(f"no field {f}; there are: {', '.join(sorted(table.columns))}")


def author_counts(table: DataFrame, author: str) -> DataFrame:
    """author, n."""
    need(table, author)
    return table.where(F.col(author).isNotNull()).groupBy(F.col(author).alias("author")).agg(F.count("*").alias("n"))


def concentration(counts: DataFrame) -> DataFrame:
    """One row: total_items, unique_authors, bus_factor_50/80, author_entropy, gini_coefficient, top1/3/5_share, one_commit_rate.

    Authors with equal counts are one row of the running sums, so the windows are over distinct counts,
    of which there are at most about the square root of twice the total.
    """
    tiers = counts.groupBy("n").agg(F.count("*").alias("authors"))
    desc = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    asc = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    run = tiers.select(
        "n",
        "authors",
        F.coalesce(F.sum(F.col("n") * F.col("authors")).over(desc), F.lit(0)).alias("items_above"),
        F.coalesce(F.sum("authors").over(desc), F.lit(0)).alias("authors_above"),
        F.coalesce(F.sum("authors").over(asc), F.lit(0)).alias("authors_below"),
        F.sum(F.col("n") * F.col("authors")).over(every).alias("total"),
        F.sum("authors").over(every).alias("people"),
    )

    def bus(share: float) -> Column:
        goal = F.ceil(F.col("total") * share)
        reached = (F.col("items_above") < goal) & (F.col("items_above") + F.col("n") * F.col("authors") >= goal)
        return F.max(F.when(reached, F.col("authors_above") + F.ceil((goal - F.col("items_above")) / F.col("n"))))

    def top(k: int) -> Column:
        return F.sum(F.col("n") * F.least(F.col("authors"), F.greatest(F.lit(0), k - F.col("authors_above")))) / F.max("total")

    # ranks in ascending order within a tier are authors_below + 1 .. authors_below + authors
    ranked = F.sum(F.col("n") * (F.col("authors") * F.col("authors_below") + F.col("authors") * (F.col("authors") + 1) / 2))
    entropy = F.log2(F.max("total")) - F.sum(F.col("authors") * F.col("n") * F.log2("n")) / F.max("total")
    n = F.max("people")
    return run.agg(
        F.max("total").alias("total_items"),
        n.alias("unique_authors"),
        bus(0.5).cast("long").alias("bus_factor_50"),
        bus(0.8).cast("long").alias("bus_factor_80"),
        F.greatest(F.lit(0.0), entropy).alias("author_entropy"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * ranked / (n * F.max("total")) - (n + 1) / n)).alias("gini_coefficient"),
        top(1).alias("top1_share"),
        top(3).alias("top3_share"),
        top(5).alias("top5_share"),
        (F.sum(F.when(F.col("n") == 1, F.col("authors")).otherwise(0)) / n).alias("one_commit_rate"),
    )


def churn(table: DataFrame, author: str, ts: str) -> DataFrame:
    """month, new, returning, churned, active, net by observed month.

    New authors are there for the first time; returning ones were there before; churned ones were active in
    the observed month before and are not in this one.
    """
    need(table, author, ts)
    rows = table.where(F.col(author).isNotNull() & F.col(ts).isNotNull()).select(F.col(author).alias("author"), F.date_format(ts, "yyyy-MM").alias("month")).distinct()
    months = rows.select("month").distinct().withColumn("m", F.row_number().over(Window.orderBy("month")))
    numbered = rows.join(months, "month")
    w = Window.partitionBy("author").orderBy("m")
    seen = numbered.withColumn("first", F.min("m").over(Window.partitionBy("author")) == F.col("m")).withColumn("following", F.lead("m").over(w))
    active = seen.groupBy("month", "m").agg(F.count_if("first").alias("new"), F.count_if(~F.col("first")).alias("returning"), F.count("*").alias("active"))
    lost = seen.where("following is null or following > m + 1").groupBy((F.col("m") + 1).alias("lost_m")).agg(F.count("*").alias("churned"))
    out = active.join(lost, F.col("m") == F.col("lost_m"), "left").withColumn("churned", F.coalesce("churned", F.lit(0)))
    return out.select("month", "new", "returning", "churned", "active", (F.col("new") - F.col("churned")).alias("net"))


def half_life(table: DataFrame, author: str, ts: str) -> DataFrame:
    """One row: contributor_half_life_days, the median of (last - first) over authors."""
    spans = table.where(F.col(author).isNotNull() & F.col(ts).isNotNull()).groupBy(author).agg((F.unix_seconds(F.max(ts).cast("timestamp")) - F.unix_seconds(F.min(ts).cast("timestamp"))).alias("s"))
    return spans.groupBy("s").agg(F.count("*").alias("w")).agg((F.percentile("s", 0.5, F.col("w")) / 86400).alias("contributor_half_life_days"))


# Mail providers whose domain says nothing about an employer.
GENERIC_DOMAINS = (
    "gmail.com",
    "yahoo.com",
    "hotmail.com",
    "outlook.com",
    "live.com",
    "icloud.com",
    "me.com",
    "mac.com",
    "aol.com",
    "protonmail.com",
    "proton.me",
    "users.noreply.github.com",
    "mail.com",
    "gmx.com",
    "gmx.net",
    "yandex.com",
    "fastmail.com",
    "hey.com",
    "pm.me",
    "qq.com",
    "163.com",
    "126.com",
    "foxmail.com",
)
#: Shares of all months over which an author is there often, and under which seldom.
OFTEN, SELDOM = 0.5, 0.2


def normalise_email(email: Column) -> Column:
    """Lower case, without the number that some hosts put before the name."""
    return F.regexp_replace(F.lower(F.trim(email)), r"^[0-9]+\+", "")


def email_domain(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), F.lower(F.substring_index(email, "@", -1)))


def is_generic_domain(domain: Column) -> Column:
    return domain.isin(*GENERIC_DOMAINS)


def bot_reason(name: Column, email: Column) -> Column:
    """Why an author is a bot, or null. Addresses count by marker or whole token, names by marker only."""
    local = F.regexp_replace(F.substring_index(F.lower(F.coalesce(email, F.lit(""))), "@", 1), r"^[0-9]+\+", "")
    return (
        F.when(name.endswith("[bot]"), "bot_suffix")
        .when(name.startswith("app/"), "bot_app_prefix")
        .when(F.contains(local, F.lit("[bot]")), "bot_email_marker")
        .when(local.rlike(r"^bot$|[-_.]bot$|^bot[-_.]"), "bot_email_local_part")
    )


def identities(table: DataFrame, name: str, email: str) -> DataFrame:
    """name, email, identity, canonical: people joined by shared names or addresses.

    Names and addresses are the nodes of a graph; its components are the identities, named by their
    smallest name. ``canonical`` is the most frequent name of the component (ties: the smallest). An empty
    address joins nobody.
    """
    pairs = table.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name"), F.coalesce(normalise_email(F.col(email)), F.lit("")).alias("email")).agg(F.count("*").alias("n"))
    # the marks put every name before every address, so a component's smallest node is its smallest name
    node = F.concat(F.lit("n"), F.col("name"))
    found = connected(pairs.select(node.alias("a"), F.when(F.col("email") != "", F.concat(F.lit("o"), F.col("email"))).otherwise(node).alias("b")))
    labels = pairs.join(found.select(F.col("node").alias("x"), F.substring("component", 2, 1 << 30).alias("identity")), node == F.col("x")).drop("x")
    totals = labels.groupBy("identity", "name").agg(F.sum("n").alias("n"))
    best = totals.groupBy("identity").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("canonical"))
    return labels.join(best, "identity").select("name", "email", "identity", "canonical")


def core_team(table: DataFrame, author: str, ts: str, email: str | None = None) -> DataFrame:
    """author, email, n, months, role (bot, core, community), confidence (definite, dominant, heuristic), reason.

    Three signals make an author core, beside the markers of bots: the address is of the domain (no mail
    provider) that more than half of the work comes from; the author is among those who make up the first
    80 % of the work (ties by name and address); the latter does not hold for authors seen in less than a
    fifth of the months, and weighs more for those seen in more than half of them.
    """
    need(table, author, ts, *([email] if email else []))
    mail = F.coalesce(F.col(email).cast("string"), F.lit("")) if email else F.lit("")
    who = F.coalesce(F.col(author).cast("string"), F.lit(""))
    rows = table.select(who.alias("author"), mail.alias("email"), F.date_format(ts, "yyyy-MM").alias("month")).where("author <> '' or email <> ''")
    counts = rows.groupBy("author", "email").agg(F.count("*").alias("n"), F.count_distinct("month").alias("months"))
    counts = counts.withColumn("bot", bot_reason(F.col("author"), F.col("email"))).withColumn("domain", email_domain(F.col("email")))
    people = counts.where("bot is null")
    # the largest domain; of equal ones the last by name
    domains = people.where(F.col("domain").isNotNull() & ~is_generic_domain(F.col("domain"))).groupBy("domain").agg(F.sum("n").alias("c"))
    leading = domains.agg(F.max(F.struct("c", "domain")).alias("top"))
    # running sums over distinct counts; only the tier in which the share is reached is put in order
    tiers = people.groupBy("n").agg(F.count("*").alias("authors"))
    above = F.coalesce(F.sum(F.col("n") * F.col("authors")).over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goal = F.ceil(F.sum(F.col("n") * F.col("authors")).over(Window.partitionBy()) * 4 / 5)
    edge = tiers.select("n", (goal - above).alias("missing")).where("missing > 0").agg(F.min(F.struct("n", "missing")).alias("edge"))
    months = rows.agg(F.count_distinct("month").alias("all_months"))
    total = people.agg(F.sum("n").alias("total"))
    facts = leading.crossJoin(edge).crossJoin(months).crossJoin(total)  # one row
    told = counts.crossJoin(F.broadcast(facts))
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.concat("author", F.lit(" <"), "email", F.lit(">"))))
    on_edge = told.where("bot is null and n = edge.n").select(F.col("author").alias("a"), F.col("email").alias("e"), ((place - 1) * F.col("n") < F.col("edge.missing")).alias("first"))
    told = told.join(on_edge, (F.col("author") == F.col("a")) & (F.col("email") == F.col("e")), "left")
    by_domain = F.coalesce((F.col("domain") == F.col("top.domain")) & (F.col("top.c") * 2 > F.col("total")), F.lit(False))
    by_volume = F.coalesce((F.col("n") > F.col("edge.n")) | F.col("first"), F.lit(False))
    often = F.col("months") > F.col("all_months") * OFTEN
    seldom = F.col("months") < F.col("all_months") * SELDOM
    by_mail = F.concat(F.lit("email_domain:"), F.col("domain"))
    bot = F.col("bot").isNotNull()
    role = F.when(bot, "bot").when(by_domain | (by_volume & ~seldom), "core").otherwise("community")
    confidence = F.when(bot, F.when(F.col("bot") == "bot_email_local_part", "dominant").otherwise("definite")).when(by_domain | (by_volume & often), "dominant").otherwise("heuristic")
    reason = (
        F.when(bot, F.col("bot"))
        .when(by_domain & by_volume, F.concat(by_mail, F.lit("+pareto_80pct")))
        .when(by_domain, by_mail)
        .when(by_volume & seldom, "pareto_80pct+temporal_sporadic")
        .when(by_volume & often, "pareto_80pct+temporal_consistent")
        .when(by_volume, "pareto_80pct")
        .otherwise("community_default")
    )
    return told.select("author", "email", "n", "months", role.alias("role"), confidence.alias("confidence"), reason.alias("reason"))


# Grade ladders. (limit, grade) pairs are tried in order; the last grade is for the rest.
LADDERS = {
    "commit_entropy": (">", ((5, "A"), (4.5, "A-"), (4, "B+"), (3.5, "B"), (3, "C"), (2.5, "D"))),
    "top1_share": ("<", ((0.15, "A"), (0.20, "A-"), (0.25, "B+"), (0.30, "B"), (0.35, "B-"), (0.40, "C"), (0.50, "D"))),
    "fix_ratio": ("<", ((0.05, "A"), (0.10, "B"), (0.15, "C"), (0.20, "D"))),
    "one_commit_rate": ("<", ((0.20, "A"), (0.35, "B"), (0.50, "C"), (0.65, "D"))),
    "velocity_slope": (">", ((2, "A"), (1, "B+"), (0, "B"), (-0.5, "C"), (-1, "D"))),
    "zero_comment_rate": ("<", ((0.10, "A"), (0.20, "B"), (0.35, "C"), (0.50, "D"))),
}
POINTS = {"A": 4.0, "A-": 3.7, "B+": 3.3, "B": 3.0, "B-": 2.7, "C+": 2.3, "C": 2.0, "C-": 1.7, "D+": 1.3, "D": 1.0, "F": 0.0}
LETTERS = ((3.85, "A"), (3.5, "A-"), (3.15, "B+"), (2.85, "B"), (2.5, "B-"), (2.15, "C+"), (1.85, "C"), (1.5, "C-"), (1.15, "D+"), (0.5, "D"))
#: Weight of each dimension and the metric that grades it.
DIMENSIONS = {
    "bus_factor": (0.15, "top1_share"),
    "contribution_diversity": (0.10, "commit_entropy"),
    "code_stability": (0.20, "fix_ratio"),
    "contributor_retention": (0.20, "one_commit_rate"),
    "velocity_trend": (0.15, "velocity_slope"),
    "issue_response": (0.20, "zero_comment_rate"),
}


def grade(metric: str, value: Column) -> Column:
    """Letter grade of a metric; null for a missing value."""
    direction, steps = LADDERS[metric]
    out = F.when(value.isNull(), F.lit(None))
    for limit, letter in steps:
        out = out.when(value > limit if direction == ">" else value < limit, F.lit(letter))
    return out.otherwise("F")


def points(letter: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in POINTS.items() for x in p])[letter]


def letter_of(number: Column) -> Column:
    out = F.when(number.isNull(), F.lit(None))
    for limit, letter in LETTERS:
        out = out.when(number >= limit, F.lit(letter))
    return out.otherwise("F")


def fix_share(message: Column) -> Column:
    """Share of messages that speak of a repair, as an aggregate."""
    return F.avg(F.lower(message).rlike("fix|bug|hotfix|patch|revert").cast("int"))


def health(metrics: DataFrame) -> DataFrame:
    """One row of metrics in, the same row with a grade for each dimension, score and overall_grade out.

    Dimensions without a value are left out and the other weights are scaled up.
    """
    graded = metrics
    for name, (_, metric) in DIMENSIONS.items():
        graded = graded.withColumn(f"grade_{name}", grade(metric, F.col(metric)) if metric in metrics.columns else F.lit(None).cast("string"))
    parts = [(w, points(F.col(f"grade_{n}"))) for n, (w, _) in DIMENSIONS.items()]
    weight = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for w, p in parts), F.lit(0.0))
    total = sum((F.coalesce(p * w, F.lit(0.0)) for w, p in parts), F.lit(0.0))
    return graded.withColumn("score", F.when(weight > 0, total / weight)).withColumn("overall_grade", letter_of(F.col("score")))


def author_entropy(counts: DataFrame) -> DataFrame:
    return counts.agg(info.entropy(F.col("n")).alias("author_entropy"))
