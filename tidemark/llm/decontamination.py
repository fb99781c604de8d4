"""Benchmark decontamination by greedy string tiling (operator 5).

Documents and benchmark items that share a seed of MIN_TILE words are tiled: the longest match between words not yet
marked is found by running Karp-Rabin hashes, marked in both, and so on until no match of MIN_TILE words is left.
The share of the item's words under tiles tells contamination, in whatever order its passages come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import small_batches, trimmed

MIN_TILE, COVERAGE = 5, 0.5
#: Benchmarks of at most so many bytes of text are sent to every task; larger ones meet the documents in joins.
BROADCAST_BYTES = 16 << 20

_SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, tiles array<struct<doc_start:int,item_start:int,length:int>>"


def tile(doc: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (doc start, item start, length) of two arrays of word hashes, longest first, ties from the left."""
    if len(doc) < least or len(item) < least:
        return []
    sums_d, sums_i = T.Prefix(doc), T.Prefix(item)
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []

    def windows(sums: T.Prefix, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        marked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(marked[n:] == marked[: len(marked) - n]) if n <= len(free) else np.zeros(0, np.int64)
        return at, T.mix(sums.of(at, at + n))

    def common(n: int) -> bool:
        return bool(np.isin(windows(sums_i, free_i, n)[1], windows(sums_d, free_d, n)[1]).any())

    longest = min(len(doc), len(item))
    while longest >= least and common(least):
        low, high = least, longest  # a common run of n words holds one of n - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        longest, placed = low, len(tiles)
        at_i, h_i = windows(sums_i, free_i, low)
        at_d, h_d = windows(sums_d, free_d, low)
        places: dict[int, list[int]] = {}
        for a, h in zip(at_d[np.isin(h_d, h_i)].tolist(), h_d[np.isin(h_d, h_i)].tolist(), strict=True):
            places.setdefault(h, []).append(a)
        for a, h in zip(at_i.tolist(), h_i.tolist(), strict=True):
            if h not in places or not free_i[a : a + low].all():
                continue
            for b in places[h]:
                # equal hashes count for equal words only where each word agrees
                if free_d[b : b + low].all() and np.array_equal(doc[b : b + low], item[a : a + low]):
                    free_i[a : a + low] = free_d[b : b + low] = False
                    tiles.append((b, a, low))
                    break
        longest -= placed == len(tiles)
    return tiles


def _seeds(w: T.Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    at = w.windows(least)
    return T.mix(T.Prefix(w.hash).of(at, at + least)), np.searchsorted(w.first, at, "right") - 1


def _output(rows: list[tuple]) -> pa.RecordBatch:
    tiles = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), tiles]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "tiles"]
    )


def _judge(doc_id, item_id, doc: np.ndarray, item: np.ndarray, least: int, coverage: float) -> tuple | None:
    if len(doc) < least or len(item) < least:
        return None
    starts = [np.arange(len(x) - least + 1) for x in (doc, item)]
    seeds = [T.Prefix(x).of(s, s + least) for x, s in zip((doc, item), starts, strict=True)]
    under = np.zeros(len(item) + 1, np.int64)  # tiles lie under seeds that both have
    met = starts[1][np.isin(seeds[1], seeds[0])]
    np.add.at(under, met, 1)
    np.add.at(under, met + least, -1)
    if (np.cumsum(under)[:-1] > 0).sum() < coverage * len(item):
        return None
    tiles = tile(doc, item, least)
    share = sum(t[2] for t in tiles) / max(1, len(item))
    if not tiles or share < coverage:
        return None
    return doc_id, item_id, share, len(tiles), [{"doc_start": a, "item_start": b, "length": n} for a, b, n in tiles]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, tiles) of every pair whose tiles cover at least that share of the item.

    Words are compared with A-Z in lower case. Null and empty texts, and items of fewer than ``least`` words, match
    nothing; null and repeated ids are passed through, a row for every pair of rows; texts of any length are tiled whole;
    of equally long matches the leftmost counts; an empty table on either side gives no rows; other columns are dropped.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return _by_broadcast(docs, items, least, coverage)
    return _by_join(docs, items, least, coverage)


def _by_broadcast(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    rows = items.collect()  # BROADCAST_BYTES at most
    w = T.words(pa.array([r.text for r in rows], pa.string()), lower=True)
    seed, owner = _seeds(w, least)
    order = np.argsort(seed, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((w.hash, w.first, [r.item_id for r in rows], seed[order], owner[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, ids, seeds, owners = shared.value
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 18):
                w = T.words(part.column("text"), lower=True)
                h, doc = _seeds(w, least)
                left, right = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
                many = right - left
                pairs = np.unique(np.stack([np.repeat(doc, many), owners[T.ranges(left, many)]], 1), axis=0)
                doc_ids, out = part.column("doc_id").to_pylist(), []
                for d, i in pairs.tolist():
                    texts = w.hash[w.first[d] : w.first[d + 1]], words[first[i] : first[i + 1]]
                    out.append(_judge(doc_ids[d], ids[i], *texts, least, coverage))
                yield _output([r for r in out if r])

    return docs.mapInArrow(trimmed(run), _SCHEMA)


def _by_join(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                h, owner = _seeds(T.words(part.column("text"), lower=True), least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column("key").take(pa.array(owner))], ["seed", "key"]
                )

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                d, i = (T.words(part.column(c), lower=True) for c in ("text", "item_text"))
                found = [
                    _judge(x, y, d.hash[d.first[k] : d.first[k + 1]], i.hash[i.first[k] : i.first[k + 1]], least, coverage)
                    for k, (x, y) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("item_id").to_pylist(), strict=True))
                ]
                yield _output([r for r in found if r])

    keyed = lambda df, c: df.withColumn("key", F.xxhash64(F.coalesce(c, F.lit(-1)), "text"))
    docs, items = keyed(docs, "doc_id"), keyed(items, "item_id")
    a = docs.select("text", "key").mapInArrow(seeds, "seed long, key long").distinct()
    b = items.select("text", "key").mapInArrow(seeds, "seed long, key long").withColumnRenamed("key", "item").distinct()
    pairs = a.join(b, "seed").select("key", "item").distinct()
    both = pairs.join(docs, "key").join(items.select("item_id", F.col("text").alias("item_text"), F.col("key").alias("item")), "item")
    return both.select("doc_id", "item_id", "text", "item_text").mapInArrow(tiles, _SCHEMA)
