"""Benchmark decontamination: size-partitioned MinHash containment search with exact confirmation.

A test item is found in a document when at least PERCENT of the item's distinct shingles occur in the
document, wherever they stand. For a short item in a long document the Jaccard similarity is close to
zero, so banded signatures of documents cannot find it (see the README). The chance that the item's
minimum under a hash function occurs in the document, however, is the containment itself. Items are
therefore partitioned by size (powers of two), and each keeps the minima that its partition asks for:
the ``m`` smallest hashes of its set, ``m = floor((1 - PERCENT/100) * n) + 1`` for the largest ``n`` of
the partition. An item contained to PERCENT misses at most ``(1 - PERCENT/100) * n`` shingles, so at
least one kept minimum occurs in the document: nothing is missed. Hits are confirmed on the full sets.

Each partition has an index of its own, searched with all shingles of the document.

Documents are never shuffled. Items are held by every task, so they are taken in blocks of at most
BLOCK_ITEMS and BLOCK_BYTES, which pass through the driver one after the other; more items mean more
passes over the documents, not more memory. A worker process makes the index of a block once.

Defined cases: null or empty texts (documents or items) contain nothing and are contained in nothing;
items with equal texts are each reported; repeated documents are each reported; ids of items may be of any
simple type, also null; a containment of exactly PERCENT counts; documents of any length are searched
whole, by one task each; empty tables give no rows; other columns are ignored, and kept by
:func:`decontaminate`, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pathlode.llm.shingles import WIDTH, mix, shingle_hashes, words_of

PERCENT = 75
#: Items of one pass over the documents, and bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 64 << 20
_U = np.uint64


def minima_kept(n: int, percent: int = PERCENT) -> int:
    """Minima of an item of ``n`` shingles: as many as the largest size of its partition asks for."""
    largest = (1 << n.bit_length()) - 1
    return min(n, (100 - percent) * largest // 100 + 1)


def exact_shingles(words: list[bytes], width: int = WIDTH) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


@dataclass
class SizePartition:
    """The items of between 2**(k - 1) and 2**k - 1 shingles: their kept minima, sorted, and whose they are."""

    keys: np.ndarray
    owners: np.ndarray

    def owners_in(self, hashes: np.ndarray) -> set[int]:
        """Items of which one kept minimum is among ``hashes``."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.unique(hashes[self.keys[at] == hashes])
        lo, hi = np.searchsorted(self.keys, hit, "left"), np.searchsorted(self.keys, hit, "right")
        return {int(o) for a, b in zip(lo, hi, strict=True) for o in self.owners[a:b]}


class ItemIndex:
    """Items by size partition, each with an index and a number of minima of its own."""

    def __init__(self, items: list[tuple[object, str]], percent: int = PERCENT) -> None:
        self.percent, self.ids, self.sets = percent, [], []
        kept: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            hashes = np.unique(shingle_hashes(words))
            if not len(hashes):
                continue
            order = np.argsort(mix(hashes), kind="stable")
            kept.setdefault(len(hashes).bit_length(), []).append((hashes[order[: minima_kept(len(hashes), percent)]], len(self.ids)))
            self.ids.append(item_id)
            self.sets.append(exact_shingles(words))
        self.partitions = []
        for _, own in sorted(kept.items()):
            keys = np.concatenate([k for k, _ in own])
            owners = np.repeat([o for _, o in own], [len(k) for k, _ in own])
            order = np.argsort(keys, kind="stable")
            self.partitions.append(SizePartition(keys[order], owners[order]))

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(position of the item, shingles found, shingles of the item) of every item in the text."""
        words = words_of(text)
        if not self.partitions or not words:
            return []
        hashes = shingle_hashes(words)
        possible = sorted(set().union(*[p.owners_in(hashes) for p in self.partitions]))
        if not possible:
            return []
        own = exact_shingles(words)
        found = []
        for k in possible:
            both = len(self.sets[k] & own)
            if 100 * both >= self.percent * len(self.sets[k]):
                found.append((k, both, len(self.sets[k])))
        return found


#: The index that this process made last: tasks that come after one another share it.
_last: list = [None, None]


def _index_of(key: str, shared, percent: int) -> ItemIndex:
    if _last[0] != (key, percent):
        _last[:] = [(key, percent), ItemIndex(shared.value, percent)]
    return _last[1]


def item_blocks(items: DataFrame, id_col: str = "item_id", text: str = "text") -> Iterator[list[tuple[object, str]]]:
    """The stated test items, in blocks of bounded size."""
    block, size = [], 0
    for row in items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row.t) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    if block:
        yield block


def _searcher(shared, key: str, percent: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64(), id_type, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(key, shared, percent)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc, index.ids[k], both, n) for k, both, n in index.search(text.as_py())]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_found", "n_item"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each document and test item in it: doc_id, item_id, n_found, n_item, containment.

    ``item_id`` has the type that it has in ``items``.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    kind = items.schema["item_id"].dataType
    schema = f"doc_id long, item_id {kind.simpleString()}, n_found long, n_item long"
    out = None
    for block in item_blocks(items):
        found = slim.mapInArrow(_searcher(spark.sparkContext.broadcast(block), uuid.uuid4().hex, percent, to_arrow_type(kind)), schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("containment", F.col("n_found") / F.col("n_item"))


def _flagger(shared, key: str, percent: int, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(key, shared, percent)
        for batch in batches:
            clean = [not index.search(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents that hold no test item, with the columns of ``docs``."""
    spark = docs.sparkSession
    at = docs.columns.index(text)
    for block in item_blocks(items):
        docs = docs.mapInArrow(_flagger(spark.sparkContext.broadcast(block), uuid.uuid4().hex, percent, at), docs.schema)
    return docs
