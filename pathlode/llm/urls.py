"""URL filters: a blocked Bloom filter before an exact hash join.

Listed entries are canonical URL expressions ``host/path``: an entry fits its host and every subdomain
of it, if the URL's path starts with the entry's path. The longest entry that fits decides.

The key of an entry is its host and its path up to the last ``/``. An entry that fits a URL has a key
made of one of the URL's host suffixes and one of its path prefixes that end in ``/`` (or the empty
one), so these are the URL's candidate keys, as deep as the list goes. They are looked up in a blocked
Bloom filter of the listed keys, a table with one row of 512 bits for each block: a key is sent to its
block and tests its bits there. The filter has a fixed largest size, whatever the list's length, so it
is safe to send to every task; a long list only raises its rate of false hits. Possible hits, and only
those, go to an exact join with the list, which also compares the rest of the path.

Equal URLs are counted first and judged once. Keys and URLs that very many rows have are joined apart
(:func:`pathlode.llm.common.spread_join`), so that none of them fills a task.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits nothing; an empty
table gives no rows; repeated rows are all judged; an empty list allows every URL; entries with an empty
host fit nothing; two entries of equal length are decided in favour of the longer host; the same entry
listed twice with different verdicts blocks; very long URLs are judged whole, with keys only as deep as
the list's; columns named like an added one are replaced by it, all others pass through whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.llm.common import ascii_lower, materialize, spread_join

#: 64-bit words of a block, and the largest number of blocks (2**17 blocks of 512 bits are 8 MB).
BLOCK_WORDS, MAX_BLOCKS = 8, 1 << 17
#: Bits set for each key, each in a word of its block.
KEY_BITS = 4
ADDED = ("host", "path", "maybe", "entry", "verdict", "entry_kind")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def folder_of(path: Column) -> Column:
    """A path up to its last ``/``; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def candidate_keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Array of struct(h, p): each suffix of ``labels`` host labels at most, with each prefix of ``depth`` folders at most."""

    def many(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.translate(text, mark, ""))

    hosts = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), many(host, ".") + 1)), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    folders = F.when(F.least(F.lit(depth), many(path, "/")) > 0, F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), many(path, "/"))), lambda k: F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))))
    prefixes = F.concat(F.array(F.lit("")), F.coalesce(folders, F.array().cast("array<string>")))
    return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))


def _placed(h: Column, p: Column, blocks: int) -> tuple[Column, Column]:
    """Number of a key's block, and the number whose 9-bit pieces say which bits the key sets there."""
    key = F.xxhash64(h, p)
    return F.pmod(key, F.lit(blocks).cast("long")).cast("int"), F.xxhash64(key, F.lit(1))


def _mask(picks: Column, k: int) -> tuple[Column, Column]:
    """The k-th bit of a key: the word within its block, and a word with only that bit."""
    piece = F.shiftrightunsigned(picks, 9 * k)
    bit = F.shiftrightunsigned(piece, 3).bitwiseAND(F.lit(63)).cast("int")
    return piece.bitwiseAND(F.lit(7)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_filter(keys: DataFrame, bits_per_key: int = 24, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """(block, words) of each block that is not empty, and the number of blocks: the filter of distinct keys (h, p).

    The number of blocks follows the list's length up to ``max_blocks``.
    """
    blocks = min(max_blocks, max(1, -(-keys.count() * bits_per_key // (64 * BLOCK_WORDS))))
    block, picks = _placed(F.col("h"), F.col("p"), blocks)
    masks = [_mask(F.col("picks"), k) for k in range(KEY_BITS)]
    zero = F.lit(0).cast("long")

    def word(at: int) -> Column:
        bits = zero
        for place, bit in masks:
            bits = bits.bitwiseOR(F.when(place == at, bit).otherwise(zero))
        return F.bit_or(bits).alias(f"w{at}")

    filled = keys.select(block.alias("block"), picks.alias("picks")).groupBy("block").agg(*[word(at) for at in range(BLOCK_WORDS)])
    return filled.select("block", F.array(*[f"w{at}" for at in range(BLOCK_WORDS)]).alias("words")), blocks


def possible_hits(probes: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``probes`` (with h and p) whose key may be listed; each row meets one block of 64 bytes."""
    block, picks = _placed(F.col("h"), F.col("p"), blocks)
    met = probes.withColumn("block", block).withColumn("picks", picks).join(F.broadcast(bloom), "block")
    hit = F.lit(True)
    for k in range(KEY_BITS):
        word, bit = _mask(F.col("picks"), k)
        hit = hit & (F.get("words", word).bitwiseAND(bit) != 0)
    return met.where(hit).drop("block", "picks", "words")


def filter_urls(pages: DataFrame, entries: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` by ``entries`` (host, path, verdict, kind, rank).

    Among the entries that fit, those of the highest rank decide, and among them the longest.

    Adds host, path, maybe (the filter's answer), and entry, verdict and entry_kind of the longest
    entry that fits; without one, entry is null and verdict is ``default``.
    """
    address = F.struct(host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    split = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), address.alias("a"))
    split = split.select("row", "a", F.xxhash64("a.host", "a.path").alias("k1"), F.xxhash64(F.lit(1), "a.path", "a.host").alias("k2"))
    listed = entries.where("host <> ''").groupBy("host", "path").agg(F.max(F.struct("rank", (F.col("verdict") == "block").alias("b"), "verdict", "kind")).alias("e"))
    listed = listed.select(F.col("host").alias("h"), folder_of(F.col("path")).alias("p"), F.col("path").alias("whole"), "e")
    # how deep the list goes: two numbers
    slashes, dots = F.length("p") - F.length(F.translate("p", "/", "")), F.length("h") - F.length(F.translate("h", ".", ""))
    depth = listed.agg(F.coalesce(F.max(slashes), F.lit(0)).alias("folders"), F.coalesce(F.max(dots), F.lit(-1)).alias("dots")).first()
    bloom, blocks = bloom_filter(listed.select("h", "p").distinct())

    # each distinct URL once, with the number of its rows
    distinct = materialize(split.where("a.host <> ''").groupBy("k1", "k2").agg(F.first("a").alias("a"), F.count("*").alias("n")), "urls")
    probes = distinct.select("k1", "k2", F.col("a.path").alias("path"), F.explode(candidate_keys(F.col("a.host"), F.col("a.path"), depth.dots + 1, depth.folders)).alias("k")).select("k1", "k2", "path", "k.*")
    hits = materialize(possible_hits(probes, bloom, blocks), "hits")
    # the exact join, from the list's side: the keys of hits are counted, so a key of many URLs is one row
    keys = hits.groupBy("h", "p").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("e.rank").alias("rank"), (F.length("h") + F.length("whole")).alias("long"), F.length("h").alias("host_long"), F.concat("h", "whole").alias("entry"), "whole", "e")
    found = materialize(listed.join(keys, ["h", "p"]).groupBy("h", "p").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(rank), False).alias("fits")), "entries")
    # the entries of one key are in order of rank and length: the first whose path fits is the key's answer
    told = spread_join(hits, found, ["h", "p"], "n").select("k1", "k2", F.get(F.filter("fits", lambda f: F.col("path").startswith(f["whole"])), F.lit(0)).alias("best"))
    best = told.groupBy("k1", "k2").agg(F.max("best").alias("best"))
    maybe = hits.select("k1", "k2").distinct().join(best, ["k1", "k2"], "left")
    judged = materialize(distinct.select("k1", "k2", "n").join(maybe.withColumn("maybe", F.lit(True)), ["k1", "k2"], "left"), "judged")
    out = spread_join(split, judged, ["k1", "k2"], "n", "left")
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in ADDED],
        F.col("a.host").alias("host"),
        F.col("a.path").alias("path"),
        F.coalesce("maybe", F.lit(False)).alias("maybe"),
        F.col("best.entry").alias("entry"),
        F.coalesce(F.col("best.e.verdict"), F.lit(default)).alias("verdict"),
        F.col("best.e.kind").alias("entry_kind"),
    )
