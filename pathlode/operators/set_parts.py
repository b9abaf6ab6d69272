"""Candidates for similar sets, found in parts of the items.

If two sets have J = sum(o) / sum(u) over ``least``, where o and u are their common and united items in each
part of a partition of all items, then o / u is over ``least`` in one part at least. So each part is searched
alone, in the memory of one task, and only pairs that are similar there leave it: no link is lost, and no pair
is shuffled that merely shares an item. Items are 64-bit hashes here; should two collide, a pair may be
found needlessly but none is lost. Pairs are to be confirmed on their whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Items that are split, and pairs that are looked at, at a time.
BLOCK = 1 << 20
#: Guards against products that are rounded up to an integer.
TINY = 1e-9


def splitter(parts: int, below: int, document: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (d, h: hashes) to rows (p, d, own, h) for each part that has any; own: the set has fewer than ``below`` items."""

    def split(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column("h")
        sizes = np.diff(lists.offsets.to_numpy())
        items = lists.flatten().to_numpy()
        key = np.repeat(np.arange(len(sizes)), sizes) * parts + items % parts
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        at = key[heads] // parts
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)), pa.int32()), pa.array(items[order], pa.int64()))
        columns = [pa.array(key[heads] % parts, pa.int32()), rows.column("d").take(pa.array(at)).cast(document), pa.array((sizes < below)[at]), lists]
        return pa.RecordBatch.from_arrays(columns, names=["p", "d", "own", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column("h").offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
                yield split(batch.slice(at, to - at))
                at = to

    return run


def finder(least: float, document: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """The rows of one part to the pairs (a, b) that are similar there and of which one is own."""

    def run(rows: pa.Table) -> pa.Table:
        # sets that are not own come first: each own one looks back at all before it
        rows = rows.take(pa.array(np.argsort(rows["own"].to_numpy(zero_copy_only=False), kind="stable"))).combine_chunks()
        lists = rows["h"].chunk(0) if rows["h"].num_chunks else pa.array([], pa.list_(pa.int64()))
        a, b = similar_pairs(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), int(np.count_nonzero(~rows["own"].to_numpy(zero_copy_only=False))), least)
        return pa.table({"a": rows["d"].take(pa.array(a)).cast(document), "b": rows["d"].take(pa.array(b)).cast(document)})

    return run


def similar_pairs(sizes: np.ndarray, items: np.ndarray, skip: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b), b < a and a >= ``skip``, of the sets that are similar; ``items`` has one set after the other.

    Prefix filter with rare items first: only pairs that share one of the first few are counted, and only
    those whose count can still be enough are compared whole.
    """
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    _, token, df = np.unique(items, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    # all items as set * number of tokens + token, sorted
    whole = np.sort(doc * len(df) + rank[token])
    token = whole - doc * len(df)
    first = np.cumsum(sizes) - sizes
    rest = np.maximum(np.floor(least * sizes - TINY), 0).astype(np.int64)
    last = token[first + sizes - rest - 1]
    keep = np.arange(len(doc)) - first[doc] < (sizes - rest)[doc]
    doc, prefix = doc[keep], token[keep]
    by = np.argsort(prefix, kind="stable")
    posting, sorted_prefix = doc[by], prefix[by]
    start = np.empty(len(by), np.int64)
    before = np.empty(len(by), np.int64)
    start[by] = np.searchsorted(sorted_prefix, sorted_prefix, "left")
    before[by] = np.arange(len(by)) - start[by]
    before[doc < skip] = 0
    ends = np.cumsum(before)
    heads = np.searchsorted(doc, np.arange(n + 1))

    def meeting(at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys a * n + b of the pairs that entries at..to of the prefixes make, and how often each."""
        many = before[at:to]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.unique(np.repeat(doc[at:to], many) * n + posting[np.repeat(start[at:to], many) + step], return_counts=True)

    def compared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair is similar, counted on the whole sets."""
        many = sizes[a]
        ends = np.cumsum(many)
        step = np.arange(many.sum()) - np.repeat(ends - many, many)
        want = np.repeat(b, many) * len(df) + token[np.repeat(first[a], many) + step]
        there = np.searchsorted(whole, want)
        hit = whole[np.minimum(there, len(whole) - 1)] == want
        common = np.bincount(np.repeat(np.arange(len(a)), many), weights=hit, minlength=len(a))
        return common > least * (sizes[a] + sizes[b] - common) - TINY

    found: list[tuple[np.ndarray, np.ndarray]] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        if to < len(doc) and heads[doc[to]] > at:
            to = int(heads[doc[to]])
        parts.append(meeting(at, to))
        if to < len(doc) and doc[to] == doc[to - 1]:  # a set of its own block goes on
            if len(parts) > 1:
                parts = [_added(parts)]
            at = to
            continue
        key, count = _added(parts) if len(parts) > 1 else parts[0]
        parts, at = [], to
        a, b = key // n, key % n
        # common items that were not met stand behind the prefix that ends first
        most = count + np.where(last[a] <= last[b], rest[a], rest[b])
        enough = (a != b) & (most * (1 + least) > least * (sizes[a] + sizes[b]) - TINY)
        a, b = a[enough], b[enough]
        room = np.cumsum(sizes[a])
        x = 0
        while x < len(a):
            y = max(x + 1, int(np.searchsorted(room, (room[x - 1] if x else 0) + BLOCK, "right")))
            similar = compared(a[x:y], b[x:y])
            found.append((a[x:y][similar], b[x:y][similar]))
            x = y
    none = np.empty(0, np.int64)
    return np.concatenate([none, *[a for a, _ in found]]), np.concatenate([none, *[b for _, b in found]])


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in counts]), minlength=len(keys)).astype(np.int64)
