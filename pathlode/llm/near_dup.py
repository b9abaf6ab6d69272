"""MinHash near-deduplication with HyperMinHash registers.

1. Each text's set of shingles is put into REGISTERS buckets; a bucket keeps the smallest hash as the count
   of its leading zeros plus MANTISSA bits after them (16 bits in all). Sets too small to fill the buckets
   get one true minimum for each register instead, kept in the same form; sets of a size near the border
   get both, so that no pair of similar size is left without a common form.
2. Texts with the same set are one class, found by a 128-bit digest of the set; only classes go on.
3. Bands of ROWS registers are grouped. Members of a group are compared with one representative, never
   all with each other. Links that this leaves out are found from the members' differences to their
   representative: copies of one text differ from each other by their own changes, so an index of
   these few changes (prefix filter, exact) gives the pairs that are still worth a look.
4. A candidate pair's registers give an estimate of its similarity, corrected for chance collisions of the
   compressed registers. Only pairs whose estimate lies DEVIATIONS standard deviations below the threshold,
   for the number of registers that sets of this size fill, are dropped on it (a chance of 1e-11 a pair);
   all others are confirmed on the full sets: 100 * |intersection| >= 75 * |union|.
5. Links become components by alternating large-star and small-star steps.

At the threshold itself a pair of full registers meets in no band with chance (1 - 0.75**ROWS)**BANDS,
about 1e-6; sets of 90 to 400 shingles borrow some registers, which raises it (measured: see the README).
Bands, tokens and components that very many members have are joined apart
(:func:`pathlode.llm.common.spread_join`).

Defined cases: a text without words (null, empty, white space) has an empty set and is linked with
nothing; repeated rows belong to one component and each row is returned; a component's id is null only
if all of its rows have none, and then all of them count as kept; rows that tie in the smallest id are all
kept by :func:`near_duplicates`, :func:`deduplicate` keeps the first of them in the table; a text is
sketched whole by one task, in time that follows its length; an empty table gives no rows; other columns
are ignored by :func:`near_duplicates` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlode.llm.common import materialize, spread_join
from pathlode.llm.shingles import mix, shingle_set

REGISTERS, ROWS, BANDS, MANTISSA = 256, 5, 51, 10
#: Sets of at most SMALL shingles have true minima; sets from LARGE shingles on fill buckets.
SMALL, LARGE = 86, 48
PERCENT = 75
#: Pairs whose estimate lies so many standard deviations below PERCENT are not confirmed.
DEVIATIONS = 7.0
#: Members of one representative that are confirmed by one task.
STAR_SHARE = 256
_U = np.uint64
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))
_BITS = 56  # of a hash below its 8-bit bucket number


def _registers(minima: np.ndarray) -> np.ndarray:
    """Compressed form of minima below 2**56: leading zeros, then MANTISSA bits after the first one."""
    top = np.frexp(np.maximum(minima, _U(1)).astype(np.float64))[1].astype(np.int64)  # bit length
    zeros = np.minimum(_BITS - top, 62)
    shift = top - 1 - MANTISSA
    cut = np.where(shift >= 0, minima >> np.maximum(shift, 0).astype(_U), minima << np.maximum(-shift, 0).astype(_U))
    return (zeros * (1 << MANTISSA) + (cut.astype(np.int64) & ((1 << MANTISSA) - 1))).astype(np.uint16)


_PROBES = (mix((np.arange(64 * REGISTERS, dtype=_U) + _U(77)) * _U(0x9FB21C651E98DF25)) % _U(REGISTERS)).astype(np.int64).reshape(64, REGISTERS)


def bucket_registers(shingles: np.ndarray) -> np.ndarray:
    """One register for each bucket; an empty bucket borrows from a fixed order of others."""
    h = np.sort(mix(shingles ^ _U(0x5851F42D4C957F2D)))
    bucket = (h >> _U(_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    full = np.full(REGISTERS, -1, dtype=np.int64)
    full[bucket[first]] = _registers(h[first] & _U((1 << _BITS) - 1))
    out, open_ = full.copy(), np.flatnonzero(full < 0)
    for probe in _PROBES:
        if not len(open_):
            break
        out[open_] = full[probe[open_]]
        open_ = open_[out[open_] < 0]
    if len(open_):  # the next full bucket
        have = np.flatnonzero(full >= 0)
        out[open_] = full[have[np.searchsorted(have, open_) % len(have)]]
    return out.astype(np.uint16)


def minimum_registers(shingles: np.ndarray) -> np.ndarray:
    """One true minimum for each register, each under a hash function of its own."""
    with np.errstate(over="ignore"):
        return _registers(mix(shingles[None, :] ^ _SEEDS[:, None]).min(axis=1) >> _U(64 - _BITS))


def sketch(shingles: np.ndarray) -> bytes:
    """b'', or a tag and REGISTERS registers for each form that the set's size asks for."""
    n = len(shingles)
    out = b""
    if 0 < n <= SMALL:
        out += b"S" + minimum_registers(shingles).tobytes()
    if n >= LARGE:
        out += b"L" + bucket_registers(shingles).tobytes()
    return out


_FORM = 1 + 2 * REGISTERS


def forms(sketched: bytes) -> dict[int, np.ndarray]:
    return {sketched[i]: np.frombuffer(sketched, dtype=np.uint16, count=REGISTERS, offset=i + 1) for i in range(0, len(sketched), _FORM)}


def collision_rate() -> float:
    """Chance that the registers of two different minima are equal.

    Zeros agree with the sum of their squared chances (1/3), mantissas with 2**-MANTISSA.
    """
    return (1 / 3) * 2.0**-MANTISSA


def estimate(a: bytes, b: bytes) -> float:
    """Similarity from the share of equal registers, corrected for chance collisions."""
    x, y = forms(a), forms(b)
    both = [k for k in x if k in y]
    if not both:
        return 0.0
    equal = float((x[both[0]] == y[both[0]]).mean())
    c = collision_rate()
    return max(0.0, (equal - c) / (1 - c))


def least_estimate(n: int) -> float:
    """What the estimate of a similar pair of bucket forms does not fall below, for sets of ``n`` shingles.

    Empty buckets borrow, so only the expected number of full ones counts as independent registers.
    """
    full = REGISTERS * -math.expm1(-n / REGISTERS)
    p = PERCENT / 100
    return p - DEVIATIONS * math.sqrt(p * (1 - p) / full)


def band_hashes(sketched: bytes) -> np.ndarray:
    """A 64-bit number for each band of each form."""
    out = []
    for tag, regs in forms(sketched).items():
        rows = regs[: ROWS * BANDS].reshape(BANDS, ROWS).astype(_U)
        with np.errstate(over="ignore"):
            key = mix(np.arange(BANDS, dtype=_U) + _U(tag) * _U(1 << 20))
            for k in range(ROWS):
                key = mix(key * _U(0x9E3779B97F4A7C15) + rows[:, k])
        out.append(key)
    return np.concatenate(out).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on sets given as sorted arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text, or doc_id, text and what else is to be carried along."""
    for batch in batches:
        sizes, firsts, seconds, sketches = [], [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            with np.errstate(over="ignore"):
                firsts.append(int(mix(s).sum(dtype=_U).astype(np.int64)) if len(s) else 0)
                seconds.append(int(mix(s ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U).astype(np.int64)) if len(s) else 0)
            sizes.append(len(s))
            sketches.append(sketch(s))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sketches, pa.binary())],
            names=[*batch.schema.names, "n_shingles", "k1", "k2", "sketch"],
        )


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            keys = [band_hashes(s.as_py()) for s in part.column("sketch")]
            if not keys:
                continue
            long = np.array([len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column("cid").to_numpy(), long)), pa.array(np.concatenate(keys))],
                names=["cid", "band"],
            )


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, share, b is set): the representative first, then its members."""
    center, own, own_sketch = None, None, b""
    for batch in batches:
        left, right = [], []
        for a, share, b, text, sketched in zip(*(batch.column(c).to_pylist() for c in ("a", "share", "b", "text", "sketch")), strict=True):
            if b is None:
                center, own, own_sketch = (a, share), shingle_set(text), sketched
                continue
            assert center == (a, share), "a member came before its representative"
            if len(own) > SMALL and estimate(own_sketch, sketched) < least_estimate(len(own) * PERCENT // 100):
                continue
            if similar(own, shingle_set(text)):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _difference_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symmetric difference of each member's set from its representative's."""
    center, own = None, None
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for a, share, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "share", "b", "text")), strict=True):
            if b is None:
                center, own = (a, share), shingle_set(text)
                if share:
                    continue
                mine = own  # the representative is a member without differences
                b = a
            else:
                assert center == (a, share), "a member came before its representative"
                mine = shingle_set(text)
            tokens = np.setxor1d(mine, own, assume_unique=True).view(np.int64)
            cols[0].append(a)
            cols[1].append(b)
            cols[2].append(len(mine))
            cols[3].append(len(tokens))
            cols[4].append(tokens.tolist())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.int64()))], names=["a", "b", "n", "size", "tokens"])


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Written table: rid (a number of its own for each row), doc_id, text, n_shingles, digest, sketch.

    ``carry``: names of further columns, kept in a struct ``carried``.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    added = [T.StructField(c, T.LongType()) for c in ("n_shingles", "k1", "k2")] + [T.StructField("sketch", T.BinaryType())]
    schema = T.StructType(slim.schema.fields + added)
    return materialize(slim.mapInArrow(_sketch_batches, schema).withColumn("rid", F.monotonically_increasing_id()), "sketches")


def deal_stars(pairs: DataFrame, payload: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, share, b, columns of the payload), sorted so that a representative (b null) comes before its members.

    A representative's text travels once for every STAR_SHARE of its members, so that a hot one is
    dealt to many tasks.
    """
    shares = F.ceil(F.col("members") / STAR_SHARE).cast("int")
    sizes = materialize(pairs.groupBy("a").agg(F.count("*").alias("members")).select("a", "members", shares.alias("shares")), "stars")
    centers = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"))
    members = spread_join(pairs, sizes, ["a"], "members").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b")
    rows = centers.unionByName(members).withColumn("cid", F.coalesce("b", "a"))
    full = rows.join(payload.select("cid", *columns), "cid").select("a", "share", "b", *columns)
    return full.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())


def confirm(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar on their full sets; payload: cid, text, sketch."""
    return deal_stars(pairs, payload, ["text", "sketch"]).mapInArrow(_confirm_batches, "a long, b long")


def across(stars: DataFrame, label: DataFrame, payload: DataFrame) -> DataFrame:
    """Pairs of members of one star that can be similar although they are not yet of one component.

    With A and B the differences of two members from their representative, the members' own symmetric
    difference is |A| + |B| - 2 |A and B|. They are similar only if it is at most a seventh of the sum of
    their sizes (at 75 %), so A and B have to have ``need`` elements in common. Most copies of one text have
    not: their changes are their own. In an order that puts rare differences first, similar members share
    one of the first ``size - need + 1`` of each (prefix filter); only such pairs are returned. Differences
    that one member alone has come first and match nothing, so they are counted and not listed.
    """
    named = stars.join(label.select(F.col("node").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    heads = stars.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").join(label.select(F.col("node").alias("a"), F.col("label").alias("own")), "a", "left").withColumn("own", F.coalesce("own", "a"))
    named = materialize(spread_join(named, materialize(heads, "heads"), ["a"], "c"), "named")
    apart = named.groupBy("a").agg(F.count_if(F.col("label") != F.col("own")).alias("out"), F.count("*").alias("c")).where("out > 0").select("a", "c")
    active = materialize(spread_join(named.drop("own", "c"), materialize(apart, "unsettled"), ["a"], "c").drop("c"), "apart")
    told = deal_stars(active.select("a", "b"), payload, ["text"]).mapInArrow(_difference_batches, "a long, b long, n long, size long, tokens array<long>")
    told = materialize(told.join(active, ["a", "b"]), "differences")
    each = told.select("a", "b", F.explode("tokens").alias("token"))
    often = materialize(each.groupBy("a", "token").agg(F.count("*").alias("c")).where("c > 1"), "often")
    listed = spread_join(each, often, ["a", "token"], "c").groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("t"))
    share = (100 - PERCENT) / (100 + PERCENT)
    # the partner's differences are at least 0, and its set is at most 4/3 as large
    longest = F.col("size") - F.greatest(F.lit(0.0), (F.col("size") - share * (1 + 100 / PERCENT) * F.col("n")) / 2) + 1
    alone = F.col("size") - F.size("t")
    rows = listed.join(told.drop("tokens"), ["a", "b"]).select("a", "b", "n", "size", "label", alone.alias("alone"), F.slice("t", F.lit(1), F.greatest(F.lit(0), F.floor(longest - alone).cast("int"))).alias("t"))
    index = materialize(rows.select("a", "b", "n", "size", "label", "alone", F.posexplode("t").alias("k", "x")).select("a", "b", "n", "size", "label", (F.col("alone") + F.col("k")).alias("pos"), "x.token"), "index")
    # only changes that members of two components share matter; each pair of components has one that is not the largest
    parts = index.groupBy("a", "token", "label").agg(F.count("*").alias("c"))
    apart = parts.groupBy("a", "token").agg(F.max(F.struct("c", "label")).alias("big"), F.count("*").alias("labels"), F.sum("c").alias("c")).where("labels > 1")
    apart = materialize(apart.select("a", "token", "c", F.col("big.label").alias("big")), "shared")
    told = materialize(spread_join(index, apart, ["a", "token"], "c"), "told")
    other = told.where("label <> big").select(*[F.col(c).alias(f"s_{c}") for c in ("a", "b", "n", "size", "label", "pos", "token", "big")])
    need = f"((size + s_size - {share} * (n + s_n)) / 2)"
    # in a pair, the smaller set of differences needs few: its partner's is no smaller
    few = f"if(size < s_size or (size = s_size and b < s_b), pos <= {share} * (1 + 100 / {PERCENT}) * n / 2 + 1, s_pos <= {share} * (1 + 100 / {PERCENT}) * s_n / 2 + 1)"
    met = told.join(other, (F.col("a") == F.col("s_a")) & (F.col("token") == F.col("s_token"))).where(
        f"label <> s_label and (label = big or b > s_b) and {_near('n', 's_n')} and {few} and pos + {need} <= size + 0.001 and s_pos + {need} <= s_size + 0.001"
    )
    return met.select(F.least("b", "s_b").alias("a"), F.greatest("b", "s_b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (a, b); label is the smallest node reachable.

    Large-star and small-star steps in turn; each step's table is written, and the loop ends when the
    links are stars around the smallest nodes.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = materialize(small, "links")
        mixed = new.select(F.col("u").alias("x")).intersect(new.select(F.col("v").alias("x"))).limit(1).count()
        twice = new.groupBy("u").count().where("count > 1").limit(1).count()
        links = new
        if not mixed and not twice:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _near(n: str, m: str) -> str:
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def links_of(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to give every component."""
    own = sketched.join(classes.select("cid"), sketched.rid == F.col("cid")).select("cid", "n_shingles", "sketch")
    bands = materialize(own.mapInArrow(_band_batches, "cid long, band long"), "bands")
    shared = materialize(bands.groupBy("band").agg(F.count("*").alias("c"), F.min("cid").alias("a")).where("c > 1"), "shared")
    member = materialize(spread_join(bands, shared, ["band"], "c"), "members")
    stars = member.where("cid <> a").select("a", F.col("cid").alias("b")).distinct()
    # texts of candidates only; merged, not broadcast, so that the plan is the same at every size
    some = member.select("cid").distinct()
    payload = materialize(sketched.select(F.col("rid").alias("cid"), "n_shingles", "text", "sketch").join(some.hint("merge"), "cid", "left_semi"), "payload")
    size = payload.select("cid", F.col("n_shingles").alias("n"))

    def test(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        heads = pairs.groupBy("a").agg(F.count("*").alias("c")).join(size.select(F.col("cid").alias("a"), F.col("n").alias("na")), "a")
        sized = spread_join(pairs, materialize(heads, "heads"), ["a"], "c").join(size.select(F.col("cid").alias("b"), F.col("n").alias("nb")), "b")
        return materialize(confirm(sized.where(_near("na", "nb")).select("a", "b"), payload), "confirmed")

    # first the smallest member of each band, whoever that is
    links = test(stars)
    label = materialize(components(links), "labels")
    # then, in bands that are still apart, a member of the largest component, so that differences from it are small
    weight = label.groupBy("label").agg(F.count("*").alias("w"))
    weighed = materialize(spread_join(label, materialize(weight, "weights"), ["label"], "w"), "weighed")
    named = member.join(weighed.withColumnRenamed("node", "cid"), "cid", "left").select("band", "cid", "c", F.coalesce("label", "cid").alias("label"), F.coalesce("w", F.lit(1)).alias("w"))
    apart = named.where("c > 2").groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("w", (-F.col("cid")).alias("last"))).alias("h"), F.count("*").alias("c")).where("lo <> hi")
    apart = materialize(apart.select("band", "c", (-F.col("h.last")).alias("a")), "apart")
    tight = materialize(spread_join(member.select("band", F.col("cid").alias("b")), apart, ["band"], "c").where("a <> b").select("a", "b").distinct(), "stars")
    links = links.union(test(tight.join(stars, ["a", "b"], "left_anti")))
    label = materialize(components(links), "labels")
    return links.union(test(across(tight, label, payload)))


def resolve(sketched: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, class_id, component (a rid) and component_id (a doc_id) of each row."""
    classes = sketched.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("low_id"), F.count("*").alias("c"))
    classes = materialize(classes, "classes")
    links = links_of(sketched, classes)
    label = components(links)
    joined = classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("label", "cid"))
    lows = joined.where("label is not null").groupBy("component").agg(F.min("low_id").alias("low"))
    named = joined.join(lows, "component", "left").withColumn("component_id", F.coalesce("low", "low_id"))
    named = materialize(named.select("k1", "k2", "n_shingles", "cid", "component", "component_id", "c"), "named")
    rows = sketched.select("rid", "doc_id", "n_shingles", "k1", "k2")
    out = spread_join(rows, named, ["k1", "k2", "n_shingles"], "c", "left")
    return out.select("rid", "doc_id", "n_shingles", F.col("cid").alias("class_id"), F.coalesce("component", "rid").alias("component"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, and rid, class_id, component.

    ``component_id`` is the smallest id of the row's component; the row that has it is kept.
    """
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return resolve(sketch_documents(docs, id_col, text)).select("doc_id", "n_shingles", "component_id", same.alias("kept"), "rid", "class_id", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id (then the first), with the columns of ``docs``.

    Rows without words are in no component with others and all stay.
    """
    others = [c for c in docs.columns if c not in (id_col, text)]
    sketched = sketch_documents(docs, id_col, text, others)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    stay = resolve(sketched).groupBy("component").agg(F.min(first).alias("s")).select(F.col("s.rid").alias("stay"))
    kept = sketched.join(stay, sketched.rid == F.col("stay"), "left_semi")
    source = {id_col: F.col("doc_id"), text: F.col("text")} | {c: F.col("carried").getField(c) for c in others}
    return kept.select(*[source[c].alias(c) for c in docs.columns])
