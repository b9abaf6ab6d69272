"""Scored observations under a profile: what is worth knowing about a dataset."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = ("rarity", "instability", "entropy", "coverage", "anomaly", "concern")
# Weights of the signals, in the order of SIGNALS.
PROFILES = {
    "engineer": (0.15, 0.25, 0.15, 0.15, 0.15, 0.15),
    "staff": (0.10, 0.05, 0.10, 0.25, 0.30, 0.20),
    "auditor": (0.10, 0.20, 0.10, 0.10, 0.20, 0.30),
    "ai": (0.15, 0.10, 0.20, 0.20, 0.20, 0.15),
    "fraud": (0.25, 0.10, 0.10, 0.05, 0.35, 0.15),
    "health": (0.15, 0.10, 0.25, 0.05, 0.20, 0.25),
}


@dataclass(frozen=True)
class Profile:
    name: str
    weights: tuple[float, ...]


def load_profiles(text: str) -> dict[str, Profile]:
    """Profiles of a TOML text: tables ``[profiles.NAME.weights]`` with a number for each signal (0 if absent)."""
    found = tomllib.loads(text).get("profiles", {})
    return {n: Profile(n, tuple(float(p.get("weights", {}).get(s, 0.0)) for s in SIGNALS)) for n, p in found.items()}


def profile(name: str) -> Profile:
    return Profile(name, PROFILES[name])


def _observe(rows: DataFrame, kind: str, **signals) -> DataFrame:
    cells = [(signals[s] if s in signals else F.lit(0.0)).cast("double").alias(s) for s in SIGNALS]
    return rows.select("path", F.lit(kind).alias("kind"), *cells)


def from_statistics(stats: DataFrame) -> DataFrame:
    """Informative paths (normalised entropy over 0.8) and paths like enumerations (up to 10 values, twice seen)."""
    informative = _observe(stats.where("normalized_entropy > 0.8"), "high_entropy", entropy=F.col("normalized_entropy"), concern=F.lit(0.3))
    enum_like = _observe(stats.where("cardinality between 1 and 10 and total_count >= 2"), "enum_like", rarity=1 - F.col("cardinality") / 10, coverage=F.lit(1.0))
    return informative.union(enum_like)


def from_anomalies(outliers: DataFrame, rare: DataFrame, unstable: DataFrame) -> DataFrame:
    z = F.least(F.abs("z_mad") / 10, F.lit(1.0))
    o = _observe(outliers.groupBy("path").agg(F.max(F.abs("z_mad")).alias("z_mad")), "numeric_outlier", anomaly=z, concern=z)
    bits = F.least(F.col("rarity_bits") / 20, F.lit(1.0))
    r = _observe(rare.groupBy("path").agg(F.max("rarity_bits").alias("rarity_bits")), "rare_value", rarity=bits, anomaly=bits)
    u = _observe(unstable, "type_instability", instability=F.col("instability"), anomaly=F.col("instability"))
    return o.union(r).union(u)


def from_inventory(paths: DataFrame) -> DataFrame:
    nulls = _observe(paths.where("null_rate > 0.5"), "mostly_null", coverage=1 - F.col("null_rate"), concern=F.col("null_rate"))
    mixed = _observe(paths.where("type_instability > 0"), "mixed_types", instability=F.col("type_instability"))
    return nulls.union(mixed)


def from_motifs(motifs: DataFrame) -> DataFrame:
    rows = motifs.where("count > 1").select(F.concat(F.lit("motif:"), "hash").alias("path"), "count")
    return _observe(rows, "motif", coverage=F.least(F.col("count") / 100, F.lit(1.0)))


def score(observations: DataFrame, chosen: Profile) -> DataFrame:
    """rank, path, kind, score and the signals: best first, then shallower, then by path and kind."""
    total = sum((F.col(s) * w for s, w in zip(SIGNALS, chosen.weights, strict=True)), F.lit(0.0))
    depth = F.size(F.regexp_extract_all("path", F.lit(r"(\.[^.\[]+|\[\*\])"), F.lit(1)))
    scored = observations.withColumn("score", F.round(total, 12)).withColumn("depth", depth)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "depth", "path", "kind"))
    return scored.select(rank.alias("rank"), "path", "kind", "score", *SIGNALS)


def estimate_tokens(text: str) -> int:
    """About four characters a token."""
    return -(-len(text) // 4)


def apply_budget(rows: list[dict], budget: int) -> list[dict]:
    """Observations by score for each token, skipping what no longer fits; the result keeps the rank order."""
    cost = {id(r): max(1, estimate_tokens(f"{r['path']} {r['kind']} {r['score']:.3f}")) for r in rows}
    chosen, left = set(), budget
    for r in sorted(rows, key=lambda r: (-r["score"] / cost[id(r)], r["rank"])):
        if cost[id(r)] <= left:
            chosen.add(id(r))
            left -= cost[id(r)]
    return [r for r in rows if id(r) in chosen]


def chunk(rows: list[dict], budget: int) -> list[dict]:
    """Chunks of one kind each, within the budget: kind, part, rows."""
    out: list[dict] = []
    for kind in sorted({r["kind"] for r in rows}):
        part, size = [], 0
        for r in (r for r in rows if r["kind"] == kind):
            cost = estimate_tokens(f"{r['path']} {r['score']:.3f}")
            if part and size + cost > budget:
                out.append({"kind": kind, "part": sum(c["kind"] == kind for c in out) + 1, "rows": part})
                part, size = [], 0
            part.append(r)
            size += cost
        if part:
            out.append({"kind": kind, "part": sum(c["kind"] == kind for c in out) + 1, "rows": part})
    return out


def render_text(rows: list[dict]) -> str:
    return "\n".join(f"{r['rank']:>3}. [{r['kind']}] {r['path']} ({r['score']:.3f})" for r in rows)


def render_markdown(rows: list[dict], title: str = "Essence") -> str:
    body = "\n".join(f"| {r['rank']} | {r['kind']} | `{r['path']}` | {r['score']:.3f} |" for r in rows)
    return f"# {title}\n\n| # | Kind | Path | Score |\n|---|---|---|---|\n{body}\n"


def render_compact(rows: list[dict]) -> dict:
    """Short keys for language models: anomalies apart from what is notable, and paths to look into."""
    odd = {"numeric_outlier", "rare_value", "type_instability", "mixed_types"}
    item = lambda r: {"p": r["path"], "k": r["kind"], "s": round(r["score"], 3)}
    return {
        "a": [item(r) for r in rows if r["kind"] in odd],
        "n": [item(r) for r in rows if r["kind"] not in odd and r["kind"] != "motif"],
        "m": sum(r["kind"] == "motif" for r in rows),
        "d": list(dict.fromkeys(r["path"] for r in rows[:5])),
    }
