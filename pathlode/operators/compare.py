"""Comparing datasets and folders, expected relationships, and findings in package manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.operators import drift, fingerprints, governance


def dataset_metrics(datasets: dict[str, DataFrame], author: str, ts: str) -> DataFrame:
    """dataset and its concentration metrics, one row each."""
    out = None
    for name, table in sorted(datasets.items()):
        row = governance.concentration(governance.author_counts(table, author)).select(F.lit(name).alias("dataset"), "*")
        months = table.agg(F.count_distinct(F.date_format(ts, "yyyy-MM")).alias("months"))
        row = row.withColumn("months", months.scalar())
        out = row if out is None else out.unionByName(row)
    if out is None or len(datasets) < 2:
        raise ValueError("a comparison needs two datasets at least")
    return out


def pairwise_drift(datasets: dict[str, DataFrame]) -> DataFrame:
    """left, right and the columns of :func:`drift.full_drift` for each pair of node tables."""
    names, out = sorted(datasets), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            row = drift.full_drift(datasets[a], datasets[b]).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "*")
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("a comparison needs two datasets at least")
    return out


def tree_diff(spark: SparkSession, left: str, right: str) -> DataFrame:
    """path, status (added, removed, changed or same) of the files of two folders, by relative path and content."""

    def files(root: str) -> DataFrame:
        base = root.rstrip("/")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        relative = F.regexp_replace("path", "^(?:[a-z]+:/*)?/?" + "\\Q" + base.split("://")[-1].lstrip("/") + "\\E/", "")
        return found.select(relative.alias("path"), F.sha2("content", 256).alias("digest"))

    a, b = files(left).withColumnRenamed("digest", "l"), files(right).withColumnRenamed("digest", "r")
    status = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.col("l") != F.col("r"), "changed").otherwise("same")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def group_key(path: str, depth: int = 1) -> Column:
    """The first ``depth`` parts of a relative path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def corpus_clusters(shapes: DataFrame, group: str) -> DataFrame:
    """Groups linked by shapes that they share: group, cluster, size; ``shapes`` has a group and a shape column.

    Each shape links its groups to the smallest of them, so a shape that all groups have costs one link each.
    """
    pairs = shapes.where("shape is not null").select(F.col(group).alias("g"), "shape").distinct()
    first = pairs.groupBy("shape").agg(F.min("g").alias("a"), F.count("*").alias("c")).where("c > 1")
    edges = pairs.join(first, "shape").where("g <> a").select("a", F.col("g").alias("b")).distinct()
    return fingerprints.clusters(pairs, "g", edges)


@dataclass(frozen=True)
class Hint:
    """Fields (patterns like ``**/name``, or names) that are expected to depend on each other."""

    name: str
    fields: tuple[str, ...]
    relationship: str
    weight: float


def trailing_key(pattern: str) -> str:
    """What has to equal the last key of a path; a star in it is an ordinary character."""
    return pattern.rsplit("/", 1)[-1]


# The expected relationships of each domain. Patterns are matched by their last key.
HINTS = {
    "medical": (
        Hint("claim_service_line", ("**/procedure_code", "**/service_date", "**/charge_amount"), "co_occurrence", 0.9),
        Hint("diagnosis_code_description", ("**/diagnosis_code", "**/diagnosis_description"), "code_description_pair", 0.85),
        Hint("patient_subscriber", ("**/patient_*", "**/subscriber_*"), "co_occurrence", 0.8),
        Hint("provider_npi_name", ("**/provider_npi", "**/provider_name"), "functional_dependency", 0.9),
        Hint("adjudication", ("**/allowed_amount", "**/paid_amount", "**/adjustment_amount"), "co_occurrence", 0.85),
        Hint("denial_reason", ("**/claim_status", "**/denial_reason"), "conditional_presence", 0.75),
    ),
    "security": (
        Hint("network_flow", ("**/src_ip", "**/dst_ip", "**/src_port", "**/dst_port", "**/protocol"), "co_occurrence", 0.95),
        Hint("alert_classification", ("**/tactic", "**/technique", "**/severity"), "co_occurrence", 0.9),
        Hint("vulnerability_assessment", ("**/cve*", "**/cvss*", "**/affected_*"), "co_occurrence", 0.9),
        Hint("authentication_event", ("**/user*", "**/source_ip", "**/auth_result"), "co_occurrence", 0.85),
        Hint("process_execution", ("**/process_name", "**/pid", "**/command_line", "**/parent_pid"), "co_occurrence", 0.8),
        Hint("dns_query", ("**/query_name", "**/query_type", "**/answer*"), "co_occurrence", 0.75),
    ),
    "devops": (
        Hint("k8s_pod_spec", ("**/containers/*/image", "**/containers/*/resources", "**/containers/*/ports"), "co_occurrence", 0.95),
        Hint("deployment_metadata", ("**/metadata/name", "**/metadata/namespace", "**/metadata/labels"), "co_occurrence", 0.9),
        Hint("service_endpoint", ("**/spec/ports/*/port", "**/spec/ports/*/targetPort", "**/spec/ports/*/protocol"), "co_occurrence", 0.85),
        Hint("terraform_resource_block", ("**/type", "**/provider", "**/instances/*/attributes"), "co_occurrence", 0.85),
        Hint("ci_pipeline_stage", ("**/stages/*/name", "**/stages/*/status", "**/stages/*/duration"), "co_occurrence", 0.8),
        Hint("container_spec", ("**/image", "**/command", "**/env", "**/volumeMounts"), "co_occurrence", 0.8),
    ),
    "github": (
        Hint("review_network", ("**/reviewer", "**/pr_author", "**/review_state"), "co_occurrence", 0.9),
        Hint("merge_gate", ("**/author", "**/state", "**/merged", "**/additions"), "co_occurrence", 0.85),
        Hint("issue_triage", ("**/author", "**/labels", "**/state", "**/comment_count"), "co_occurrence", 0.85),
        Hint("contributor_lifecycle", ("**/author", "**/created", "**/commits"), "functional_dependency", 0.8),
        Hint("release_cadence", ("**/tag", "**/created", "**/isPrerelease"), "co_occurrence", 0.75),
        Hint("pr_review_assignment", ("**/pr_author", "**/reviewer", "**/approval_rate"), "functional_dependency", 0.85),
        Hint("commit_cascade", ("**/trigger_author", "**/response_author", "**/same_author", "**/file"), "co_occurrence", 0.8),
    ),
    "source": (
        Hint("function_definition", ("**/function_definition/*/field", "**/function_item/*/field", "**/method_definition/*/field"), "co_occurrence", 0.95),
        Hint("class_definition", ("**/class_definition/*/field", "**/struct_item/*/field", "**/class_declaration/*/field"), "co_occurrence", 0.9),
        Hint("import_statement", ("**/import_statement/*/kind", "**/use_declaration/*/kind"), "co_occurrence", 0.85),
        Hint("parameter_list", ("**/parameters/*/kind", "**/formal_parameters/*/kind"), "co_occurrence", 0.8),
        Hint("conditional_block", ("**/if_expression/*/field", "**/if_statement/*/field"), "co_occurrence", 0.75),
        Hint("loop_block", ("**/for_statement/*/field", "**/while_statement/*/field", "**/for_expression/*/field"), "co_occurrence", 0.75),
    ),
    "encoding": (
        Hint("content_with_encoding", ("**/content_type", "**/content", "**/body"), "conditional_presence", 0.8),
        Hint("transfer_encoding", ("**/transfer_encoding", "**/encoding", "**/data", "**/payload"), "co_occurrence", 0.75),
        Hint("encoded_decoded_pair", ("**/*_encoded", "**/*_decoded", "**/*_base64", "**/*_raw"), "code_description_pair", 0.7),
    ),
}


def evaluate_hints(hints: list[Hint], paths: DataFrame, relationships: DataFrame, least: float = 0.25) -> DataFrame:
    """name, relationship, weight, matched_fields, observed, max_strength of the hints that the data can test.

    A hint can be tested when two of its fields are there; it is observed when a relationship between two
    different ones of them is at least ``least`` strong.
    """
    spark = paths.sparkSession
    rows = [(h.name, h.relationship, h.weight, f, trailing_key(f)) for h in hints for f in h.fields]
    asked = spark.createDataFrame(rows, "name string, relationship string, weight double, pattern string, field string")
    last = lambda c: F.element_at(F.split(c, "\\."), -1)
    present = asked.join(paths.select("path", last("path").alias("field")).distinct(), "field")
    testable = present.groupBy("name", "relationship", "weight").agg(F.count_distinct("pattern").alias("k"), F.array_sort(F.collect_set("path")).alias("matched_fields")).where("k >= 2")
    here = present.select("name", "pattern", "field").distinct()
    strong = relationships.select(last("field_x").alias("x"), last("field_y").alias("y"), "relationship_strength")
    other = here.select(F.col("name").alias("n"), F.col("field").alias("f"), F.col("pattern").alias("p"))
    spans = here.join(strong, F.col("field") == F.col("x")).join(other, (F.col("name") == F.col("n")) & (F.col("y") == F.col("f")) & (F.col("pattern") != F.col("p")))
    best = spans.groupBy("name").agg(F.max("relationship_strength").alias("s"))
    found = testable.join(best, "name", "left").withColumn("max_strength", F.coalesce("s", F.lit(0.0)))
    return found.select("name", "relationship", "weight", "matched_fields", (F.col("max_strength") >= least).alias("observed"), "max_strength")


@dataclass(frozen=True)
class Finding:
    """A finding of manifests: a path pattern (a regular expression) that is there, or that is missing."""

    manifest: str
    name: str
    pattern: str
    severity: str
    missing: bool = False


# A manifest is one that has all paths of the first list and any of the second; a tuple there has to be there as a whole.
MANIFESTS = {
    "npm": ((r"^\$\.name$",), (r"^\$\.(version|dependencies|devDependencies|scripts|main)$",)),
    "python": ((), (r"^\$\.(project|build-system|tool\.poetry)$", (r"^\$\.metadata$", r"^\$\.options$"))),
    "cargo": ((r"^\$\.package$",), (r"^\$\.package\.(name|version)$",)),
}
FINDINGS = (
    Finding("npm", "npm_install_hook", r"^\$\.scripts\.(preinstall|install|postinstall|prepare)$", "concern"),
    Finding("npm", "npm_script_count", r"^\$\.scripts\.[^.]+$", "info"),
    Finding("npm", "npm_dependency_count", r"^\$\.(dependencies|devDependencies|optionalDependencies|peerDependencies)\.[^.]+$", "info"),
    Finding("npm", "npm_bundled_dependencies", r"^\$\.(bundledDependencies|bundleDependencies)$", "notable"),
    Finding("npm", "npm_bin_entry", r"^\$\.bin$", "notable"),
    Finding("npm", "npm_missing_provenance", r"^\$\.repository$", "notable", missing=True),
    Finding("python", "python_console_script", r"^\$\.project\.scripts\.[^.]+$", "notable"),
    Finding("python", "python_entry_points", r"^\$\.project\.entry-points\.", "notable"),
    Finding("python", "python_dependency_list", r"^\$\.project\.dependencies\[\*\]$", "info"),
    Finding("python", "python_build_backend", r"^\$\.build-system\.build-backend$", "info"),
    Finding("python", "python_in_tree_backend", r"^\$\.build-system\.backend-path", "concern"),
    Finding("python", "python_cmdclass_override", r"^\$\.options\.cmdclass$", "concern"),
    Finding("cargo", "cargo_build_script", r"^\$\.package\.build$", "concern"),
    Finding("cargo", "cargo_dependency_count", r"^\$\.(dependencies|dev-dependencies|build-dependencies)\.[^.]+$", "info"),
    Finding("cargo", "cargo_missing_provenance", r"^\$\.package\.repository$", "notable", missing=True),
)


def structural_findings(nodes: DataFrame, document: str = "record_id") -> DataFrame:
    """document, manifest, finding, severity, count of what package manifests among the documents show."""
    paths = nodes.select(document, "path")
    tests = []
    for manifest, (every, some) in MANIFESTS.items():
        holds = F.lit(True)
        for pattern in every:
            holds = holds & (F.count_if(F.col("path").rlike(pattern)) > 0)
        any_of = F.lit(False)
        for pattern in some:
            whole = F.lit(True)
            for part in (pattern,) if isinstance(pattern, str) else pattern:
                whole = whole & (F.count_if(F.col("path").rlike(part)) > 0)
            any_of = any_of | whole
        tests.append((holds & any_of).alias(f"is_{manifest}"))
    counts = [F.count_if(F.col("path").rlike(f.pattern)).alias(f"n_{k}") for k, f in enumerate(FINDINGS)]
    wide = paths.groupBy(document).agg(*tests, *counts)
    cells = [
        F.when(F.col(f"is_{f.manifest}") & ((F.col(f"n_{k}") == 0) if f.missing else (F.col(f"n_{k}") > 0)), F.struct(F.lit(f.manifest).alias("manifest"), F.lit(f.name).alias("finding"), F.lit(f.severity).alias("severity"), F.col(f"n_{k}").alias("count")))
        for k, f in enumerate(FINDINGS)
    ]
    return wide.select(document, F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("f")).select(document, "f.*")
