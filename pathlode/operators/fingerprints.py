"""Structural fingerprints, motifs, similarity and clusters of documents."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pathlode.operators import set_parts
from pathlode.operators.profile import path_inventory

#: Hash functions of a signature, bands of the index, similarity that links (strictly more).
HASHES, BANDS, THRESHOLD = 128, 16, 0.5
#: Sets of fewer items are compared by single items, larger ones in parts of about so many items of all sets.
LONG, PART_ITEMS = 64, 1_000_000


def document_paths(nodes: DataFrame, document: str = "record_id") -> DataFrame:
    """document, path, type: the distinct typed paths of each document."""
    return nodes.select(document, "path", "type").distinct()


def shape_fingerprints(nodes: DataFrame, document: str = "record_id", min_nodes: int = 0) -> DataFrame:
    """document, nodes, path_set and typed_path hashes (each path with its dominant type); withheld under ``min_nodes``."""
    return hashed_shapes(path_inventory(nodes, (document,)), document, min_nodes)


def hashed_shapes(paths: DataFrame, document: str, min_nodes: int = 0) -> DataFrame:
    """The hashes of :func:`shape_fingerprints` from document, path, count, dominant_type."""
    rows = paths.groupBy(document).agg(
        F.sum("count").alias("nodes"),
        F.array_join(F.array_sort(F.collect_list("path")), "\x01").alias("p"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "dominant_type"))), lambda e: F.concat(e["path"], F.lit(":"), e["dominant_type"])), "\x01").alias("t"),
    )
    enough = F.col("nodes") >= min_nodes
    return rows.select(document, "nodes", F.when(enough, F.sha2("p", 256)).alias("path_set"), F.when(enough, F.sha2("t", 256)).alias("typed_path"), (~enough).alias("suppressed"))


def merkle(value: object) -> tuple[str, Counter]:
    """Hash of a JSON value's shape (types and keys, not scalars) and the count of each subtree's hash."""
    motifs: Counter = Counter()

    def digest(text: str) -> str:
        out = hashlib.sha256(text.encode()).hexdigest()
        motifs[out] += 1
        return out

    def kind(v: object) -> str:
        return "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "float" if isinstance(v, float) else "string"

    stack: list[tuple[object, list[str], list | None, list]] = []
    result: list[str] = []

    def push(v: object, into: list[str]) -> None:
        if isinstance(v, dict):
            stack.append((v, into, sorted(v), []))
        elif isinstance(v, list):
            stack.append((v, into, list(range(len(v))), []))
        else:
            into.append(digest(kind(v)))

    push(value, result)
    while stack:
        v, into, keys, got = stack[-1]
        if len(got) < len(keys):
            push(v[keys[len(got)]], got)
            continue
        stack.pop()
        inner = "".join(f"{k}={h};" for k, h in zip(keys, got, strict=True)) if isinstance(v, dict) else "".join(got)
        into.append(digest(("object:" if isinstance(v, dict) else "array:") + inner))
    return result[0], motifs


def merkle_shapes(texts: DataFrame, document: str, body: str) -> DataFrame:
    """document, shape, motifs array<struct<hash, count>> of JSON texts; null where the text is not JSON."""
    schema = f"{document} {dict(texts.dtypes)[document]}, shape string, motifs array<struct<hash:string,count:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.string()), ("count", pa.int64())]))
        for batch in batches:
            shapes, motifs = [], []
            for text in batch.column(1).to_pylist():
                try:
                    shape, found = merkle(json.loads(text))
                    shapes.append(shape)
                    motifs.append([{"hash": h, "count": n} for h, n in sorted(found.items())])
                except (TypeError, ValueError):
                    shapes.append(None)
                    motifs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string()), pa.array(motifs, kind)], names=[document, "shape", "motifs"])

    return texts.select(document, body).mapInArrow(run, schema)


def repeated_motifs(shapes: DataFrame) -> DataFrame:
    """hash, count of subtrees that occur more than once in all documents."""
    return shapes.select(F.explode("motifs").alias("m")).groupBy("m.hash").agg(F.sum("m.count").alias("count")).where("count > 1")


def corpus_reuse(shapes: DataFrame, document: str, group: str) -> DataFrame:
    """shape, documents, groups of shapes that more than one document has; ``group`` is a column of ``shapes``."""
    found = shapes.where("shape is not null").groupBy("shape").agg(F.count_distinct(document).alias("documents"), F.count_distinct(group).alias("groups"))
    return found.where("documents > 1")


def jaccard_pairs(items: DataFrame, document: str, item: str, least: float = THRESHOLD) -> DataFrame:
    """a, b, jaccard of all pairs of documents over ``least``, exactly.

    Prefix filter: two sets can only be so similar if they share one of the first few of their items in
    an order that puts rare items first, so only those meet in the join. A pair that met goes on only if
    the items it has in common there, plus all that follow the last of them, could be enough.
    """
    slim = items.select(F.col(document).alias("d"), F.col(item).alias("i")).distinct()
    rare = slim.groupBy("i").agg(F.count("*").alias("df"))
    sets = slim.join(rare, "i").groupBy("d").agg(F.sort_array(F.collect_list(F.struct("df", "i"))).alias("s"))
    sets = sets.select("d", F.transform("s", lambda x: x["i"]).alias("s"))
    prefix = F.slice("s", F.lit(1), F.size("s") - F.ceil(least * F.size("s")).cast("int") + 1)
    keys = sets.select("d", F.size("s").alias("n"), F.posexplode(prefix).alias("at", "k"))
    left, right = (keys.select("k", F.col("d").alias(x), F.col("n").alias("n" + x), F.col("at").alias("at" + x)) for x in "ab")
    met = left.join(right, "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"), *[F.max(f + x).alias(f + x) for f in ("n", "at") for x in "ab"])
    most = F.col("c") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) - 1
    return _confirmed(met.where(most > least * (F.col("na") + F.col("nb") - most)).select("a", "b"), sets, least)


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b, jaccard of the pairs (a, b) whose whole sets (d, s) are similar."""
    both = pairs.join(sets.select(F.col("d").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("d").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard")).where(F.col("jaccard") > least)


def similar_links(items: DataFrame, document: str, item: str, least: float = THRESHOLD) -> DataFrame:
    """Edges (a, b) that connect just the documents which links over ``least`` connect, exactly.

    Documents of equal sets are linked to the smallest of them, and only that one is compared with others:
    sets under LONG items by :func:`jaccard_pairs`, larger ones in parts of the items (see ``set_parts``).
    """
    slim = items.select(F.col(document).alias("d"), F.col(item).alias("i")).where("d is not null and i is not null")
    sets = slim.groupBy("d").agg(F.sort_array(F.collect_set("i")).alias("s")).select("d", "s", F.sha2(F.to_json("s"), 256).alias("k"))
    firsts = sets.groupBy("k").agg(F.min("d").alias("a")).select("a")
    marked = _cut(sets.join(firsts, F.col("d") == F.col("a"), "left").select("d", "k", F.when(F.col("a").isNotNull(), F.col("s")).alias("s")))
    unlike = marked.where("s is not null").select("d", "s", F.size("s").alias("n"))
    named = marked.where("s is not null").select("k", F.col("d").alias("a"))
    links = named.join(marked.where("s is null").select("k", F.col("d").alias("b")), "k").select("a", "b")
    # items by the power of two that a set's size reaches
    sizes = {r.c: r.n for r in unlike.groupBy((F.length(F.bin("n")) - 1).alias("c")).agg(F.sum("n").alias("n")).collect()}
    if any(1 << c < LONG for c in sizes):
        short = unlike.where(F.col("n") * least < LONG).select("d", F.explode("s").alias("i"))
        links = links.union(jaccard_pairs(short, "d", "i", least).select("a", "b"))
    met = [_met_in_parts(unlike, 1 << c, sum(n for k, n in sizes.items() if k >= c and (1 << k) * least < 2 << c), least) for c in sizes if 1 << c >= LONG]
    if met:
        pairs = functools.reduce(DataFrame.union, met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = links.union(_connecting(_cut(pairs), unlike, least))
    return links


def _connecting(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Similar ones of the pairs (a, b), a < b, that connect all that the similar ones connect.

    In a large group of near copies most pairs need not be confirmed: each set is confirmed with the
    smallest that it met first, and then only the pairs that this has not connected.
    """
    if pairs.count() <= sets.count():
        return _confirmed(pairs, sets, least).select("a", "b")
    stars = _cut(_confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, least).select("a", "b"))
    labels = connected(stars)
    for x in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("component").alias("c" + x)), x, "left")
    apart = pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    return stars.union(_confirmed(apart, sets, least).select("a", "b"))


def _met_in_parts(sets: DataFrame, size: int, items: int, least: float) -> DataFrame:
    """Candidate pairs (a, b) of the sets (d, s, n) whose smaller one has ``size`` to twice as many items; none is lost.

    ``items`` tells the number of parts; they keep at least four items of a set on average, since smaller ones
    would let too many pairs through.
    """
    parts = max(1, min(size // 4, -(-items // PART_ITEMS)))
    rows = sets.where((F.col("n") >= size) & (F.col("n") * least < 2 * size)).select("d", F.transform("s", lambda x: F.xxhash64(x)).alias("h"))
    kind, arrow = dict(rows.dtypes)["d"], to_arrow_type(rows.schema["d"].dataType)
    split = rows.mapInArrow(set_parts.splitter(parts, 2 * size, arrow), f"p int, d {kind}, own boolean, h array<long>")
    return split.groupBy("p").applyInArrow(set_parts.finder(least, arrow), f"a {kind}, b {kind}")


def minhash_signatures(items: DataFrame, document: str, item: str, hashes: int = HASHES) -> DataFrame:
    """document, signature array<bigint>: the smallest of each hash function over the document's items."""
    low = [F.min(F.xxhash64(F.col(item), F.lit(k))).alias(f"h{k}") for k in range(hashes)]
    return items.groupBy(document).agg(*low).select(document, F.array(*[f"h{k}" for k in range(hashes)]).alias("signature"))


def minhash_similarity(a, b):
    """Share of equal places of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return same / F.size(a)


def lsh_pairs(signatures: DataFrame, document: str, bands: int = BANDS, hashes: int = HASHES) -> DataFrame:
    """Candidate pairs (a, b), a < b: all documents that agree in all rows of a band, to be confirmed on their sets.

    A pair of similarity J is met with chance 1 - (1 - J^rows)^bands, so some are missed; ``similar_links`` misses none.
    """
    rows = hashes // bands
    keys = F.array(*[F.xxhash64(F.lit(k), F.slice("signature", k * rows + 1, rows)) for k in range(bands)])
    banded = signatures.select(F.col(document).alias("b"), F.explode(keys).alias("band"))
    return banded.withColumnRenamed("b", "a").join(banded, "band").where("a < b").select("a", "b").distinct()


def _cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: checkpointed in the shared folder that the session names.

    Only a local session without one gets a temporary folder; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pathlode-"))
    return df.checkpoint()


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (its smallest member) of all nodes of edges (a, b), by spreading the smallest label.

    Labels also jump to the label of their label, so the rounds are about the logarithm of the longest way;
    each is checkpointed. Labels that have not settled after ``rounds`` are an error.
    """
    both = _cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", "m").alias("now"))
        # pointer jumping: take the label of the label
        far = new.select(F.col("node").alias("n2"), F.col("now").alias("jump"))
        new = _cut(new.join(far, F.col("now") == F.col("n2"), "left").select("node", "component", F.coalesce("jump", "now").alias("now")))
        moved = new.where("now <> component").limit(1).count()
        labels = new.select("node", F.col("now").alias("component"))
        if not moved:
            return labels
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def clusters(documents: DataFrame, document: str, edges: DataFrame) -> DataFrame:
    """document, cluster (its smallest member), size: every document, linked or not."""
    found = connected(edges)
    every = documents.select(document).distinct().join(found, F.col(document) == F.col("node"), "left")
    named = every.select(document, F.coalesce("component", document).alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.count("*").alias("size"))
    return named.join(sizes, "cluster").select(document, "cluster", "size")
