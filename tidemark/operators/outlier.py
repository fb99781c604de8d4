"""Outliers among connections: itemsets of categorical values, running covariances, anomaly scores.

Rows have row (unique, ordered), source, cats (array of strings in feature order) and x (array of doubles). An itemset
is an ordered choice of values of different features, written as an array; values carry no feature names, as
published, unless ``qualified``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .clock import assign_marker

# Fixed values of the published method.
SUPPORT, TAU, DELTA, FACTOR, SCORES, LEVEL = 10, 1.96, 0.3, 10.0, 40, 2
#: Consecutive rows of one block, fewer where they have more than CELLS numbers; a block's itemsets are scanned by one
#: task, STEP rows of an itemset at a time, fewer of wide rows.
CHUNK, CELLS, STEP = 32_768, 1 << 18, 4096
#: Blocks whose sums one task adds up along an itemset, and itemsets that a task gathers sums of before it gives them on.
RUN_OF_BLOCKS, GATHERED = 256, 4096
#: Rows of sums that a task adds up at a time, and the step in which large sums are counted apart from their rest.
SUMMED, GRID = 256, 2.0**32
#: Rows of a source that one task scans for outliers.
SCAN_ROWS = 65_536
#: Outliers that are sent to every task at most.
SENT_OUTLIERS = 400_000


def itemset_lattice(domains: DataFrame, max_level: int = LEVEL) -> DataFrame:
    """(itemset) of all sizes up to ``max_level`` from (feature, value) rows, one value a feature, in feature order.

    The lattice is a product of the domains by definition; domains are distinct values, not data."""
    one = domains.select("feature", "value").distinct()
    level = one.select(F.col("feature").alias("last"), F.array("value").alias("itemset"))
    out = level
    for _ in range(max_level - 1):
        level = level.join(one, F.col("last") < F.col("feature"))
        level = level.select(F.col("feature").alias("last"), F.concat("itemset", F.array("value")).alias("itemset"))
        out = out.unionByName(level)
    return out.select("itemset").distinct()


def _matching(n: int, max_level: int, qualified: bool) -> Column:
    value = lambda i: F.concat_ws("=", F.lit(str(i)), F.col("cats")[i]) if qualified else F.col("cats")[i]
    sets = [F.array(*[value(i) for i in c]) for k in range(1, max_level + 1) for c in combinations(range(n), k)]
    return F.array_distinct(F.array(*sets))


def match_itemsets(conn: DataFrame, features: int, max_level: int = LEVEL, qualified: bool = False) -> DataFrame:
    """``conn`` with a row per itemset that it contains."""
    return conn.withColumn("itemset", F.explode(_matching(features, max_level, qualified)))


def itemset_support(conn: DataFrame, features: int, max_level: int = LEVEL) -> DataFrame:
    return match_itemsets(conn, features, max_level).groupBy("itemset").agg(F.count("*").alias("n"))


def _summed(parts: DataFrame, keys: list[str], arrays: list[str], over: str | None) -> DataFrame:
    """n and array columns, added element by element along rows that lie sorted by ``keys`` (and ``over``): one row a
    key with the sums, or with ``over`` every row with the sums of the rows before it. Arrays stay arrays."""
    carried = [*keys, over] if over else keys
    types = [parts.schema[c].dataType.simpleString() for c in carried]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in zip(carried, types, strict=True)], "n long", *[f"{a} array<double>" for a in arrays]])
    names = [*carried, "n", *arrays]

    def cells(values: np.ndarray, sizes: list[int]) -> list[pa.Array]:
        out, at = [pa.array(values[:, 0].astype(np.int64))], 1
        for size in sizes:
            ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * size)
            out.append(pa.ListArray.from_arrays(ends, pa.array(values[:, at : at + size].ravel())))
            at += size
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, last, sizes = None, None, None, []
        for batch in (b.slice(at, SUMMED) for b in batches for at in range(0, b.num_rows, SUMMED)):
            own = list(zip(*[map(_plain, batch.column(k).to_pylist()) for k in keys], strict=True))
            matrices = [_numbers(batch.column(a)) for a in arrays]
            sizes = [m.shape[1] for m in matrices]
            values = np.concatenate([batch.column("n").to_numpy()[:, None].astype(float), *matrices], axis=1)
            new = [i for i in range(len(own)) if own[i] != (own[i - 1] if i else now)]
            earlier, done, whole = np.empty_like(values), [], []
            for i, j in zip(sorted({0, *new}), [*sorted({0, *new})[1:], len(own)], strict=True):
                if own[i] != now:
                    if now is not None:
                        done.append(last)
                        whole.append(sums)
                    now, sums = own[i], np.zeros(values.shape[1])
                line = np.cumsum(np.concatenate([sums[None], values[i:j]]), 0)
                earlier[i:j], sums = line[:-1], line[-1]
                last = batch.slice(j - 1, 1)
            if over:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *cells(earlier, sizes)], names)
            elif done:
                yield given(done, whole, sizes)
        if now is not None and not over:
            yield given([last], [sums], sizes)

    def given(rows: list[pa.RecordBatch], sums: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
        heads = pa.Table.from_batches([r.select(keys) for r in rows]).combine_chunks()
        heads = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in heads.columns]
        return pa.RecordBatch.from_arrays([*heads, *cells(np.array(sums), sizes)], names)

    sorted_ = parts.select(*carried, "n", *arrays).repartition(*keys).sortWithinPartitions(*carried)
    return sorted_.mapInArrow(run, schema)


def _plain(value):
    """A list as a tuple, so that it can be compared and hashed."""
    return tuple(value) if isinstance(value, list) else value


def _added(parts: DataFrame, keys: list[str], arrays: list[str], over: str | None = None, chunk: Column | None = None) -> DataFrame:
    """Element-wise sums of array columns (and n) by ``keys``; with ``over``, sums of all earlier rows in that order.

    Rows go through one shuffle and never apart into cells. With ``chunk``, a number that grows along ``over``, the
    rows of a key are dealt by it too: each chunk starts from the sums of the chunks before it."""
    if not over or chunk is None:
        return _summed(parts, keys, arrays, over)
    parts = parts.withColumn("_chunk", chunk)
    starts = _summed(_summed(parts, [*keys, "_chunk"], arrays, None), keys, arrays, "_chunk")
    starts = starts.withColumn(over, F.lit(None).cast(parts.schema[over].dataType))  # nulls come first
    rows = parts.select(*keys, "_chunk", over, "n", *arrays).unionByName(starts)
    return _summed(rows, [*keys, "_chunk"], arrays, over).filter(F.col(over).isNotNull()).drop("_chunk")


def _itemsets(cats: pa.Array | pa.ChunkedArray, max_level: int) -> tuple[list[list], np.ndarray, np.ndarray]:
    """The distinct itemsets of some rows, and (itemset, row) places sorted by itemset and row, with where each itemset's
    begin. A row has an itemset once, in however many of its features."""
    cats = cats.combine_chunks() if isinstance(cats, pa.ChunkedArray) else cats
    flat, n = cats.flatten().dictionary_encode(null_encoding="encode"), len(cats)
    codes, values = flat.indices.to_numpy().reshape(n, -1).astype(np.int64) if n else np.zeros((0, 0), np.int64), flat.dictionary.to_pylist()
    base = max(1, len(values))
    if base**max_level >= 1 << 62:
        raise ValueError("too many values for itemsets of this size")
    sets: list[list] = []
    ids, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for level in range(1, max_level + 1):
        chosen = list(combinations(range(codes.shape[1]), level))
        if not chosen or not n:
            continue
        code = np.zeros((n, len(chosen)), np.int64)
        for k in range(level):
            code = code * base + codes[:, [c[k] for c in chosen]]
        code.sort(axis=1)
        new = np.ones(code.shape, bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        row, column = np.nonzero(new)
        at, own = pd.factorize(code[row, column])
        ids.append(at + len(sets))
        rows.append(row)
        for x in own.tolist():
            digits = []
            for _ in range(level):
                x, d = divmod(x, base)
                digits.append(values[d])
            sets.append(digits[::-1])
    ids, rows = np.concatenate(ids), np.concatenate(rows)
    small = ids.astype(np.int16) if len(sets) < 1 << 15 else ids  # few itemsets are sorted by counting
    first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(sets)))])
    return sets, rows[np.argsort(small, kind="stable")], first


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def _sums(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    return len(x), x.sum(0), (x.T @ x).ravel()


def _split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multiples of GRID and what is left of them: added up apart, they keep what a double beyond 2^53 would lose."""
    high = np.rint(v / GRID) * GRID
    return high, np.where(np.isfinite(v), v - np.where(np.isfinite(v), high, 0.0), 0.0)


def _added_moments(parts: DataFrame) -> DataFrame:
    """n, and l and s put together from the sums of both their parts, rounded once."""
    sums = _added(parts, ["itemset"], ["l", "s", "l_low", "s_low"])
    return sums.select("itemset", "n", *[F.zip_with(c, f"{c}_low", lambda a, b: a + b).alias(c) for c in ("l", "s")])


def itemset_moments(conn: DataFrame, features: int, max_level: int = LEVEL) -> DataFrame:
    """(itemset, n, l, s): count, sums and sums of products (row-major). Tasks add their rows up before the shuffle;
    rows are not copied for each itemset, their places are. Sums of whole numbers are the doubles nearest to them."""

    def given(found: dict[tuple, list]) -> pa.RecordBatch:
        sums = list(found.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(map(list, found), pa.list_(pa.string())), pa.array([o[0] for o in sums], pa.int64())]
            + [pa.array([o[k] for o in sums], pa.list_(pa.float64())) for k in (1, 2, 3, 4)],
            ["itemset", "n", "l", "s", "l_low", "s_low"],
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _numbers(part.column("x"))
                sets, rows, first = _itemsets(part.column("cats"), max_level)
                for g, a, b in zip(map(tuple, sets), first, first[1:], strict=False):
                    n, *whole = _sums(x[rows[a:b]])
                    (high_l, low_l), (high_s, low_s) = map(_split, whole)
                    more = [n, high_l, high_s, low_l, low_s]
                    found[g] = [u + v for u, v in zip(found[g], more, strict=True)] if g in found else more
                if len(found) >= GATHERED:
                    yield given(found)
                    found = {}
        yield given(found)

    rows = conn.select(F.slice("cats", 1, features).alias("cats"), "x")
    parts = rows.mapInArrow(partial, "itemset array<string>, n long, l array<double>, s array<double>, l_low array<double>, s_low array<double>")
    return _added_moments(parts)


def itemset_covariance(moments: DataFrame, textbook: bool = False) -> DataFrame:
    """``moments`` with c: ``S/(n-1) + L L'/(n (n-1))``, or ``S + L L'`` for one row. The plus is the published form;
    ``textbook`` subtracts."""
    sign, n = (-1.0 if textbook else 1.0), F.col("n").cast("double")
    d = F.size("l")
    outer = F.transform(F.sequence(F.lit(0), d * d - 1), lambda i: F.get("l", F.floor(i / d).cast("int")) * F.get("l", (i % d).cast("int")))
    a, b = F.when(n <= 1, 1.0).otherwise(1 / (n - 1)), F.when(n <= 1, sign).otherwise(sign / (n * (n - 1)))
    return moments.withColumn("c", F.zip_with("s", outer, lambda s, o: s * a + o * b))


def merge_moments(*parts: DataFrame) -> DataFrame:
    """Moments of equal itemsets, added."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    high = lambda v: F.rint(v / GRID) * GRID
    finite = lambda v: F.abs(v) < float("inf")
    low = lambda v: F.when(finite(v), v - high(v)).otherwise(0.0)
    lows = {f"{c}_low": F.transform(c, low) for c in ("l", "s")}
    return _added_moments(merged.withColumns(lows).withColumns({c: F.transform(c, high) for c in ("l", "s")}))


def _products(x: np.ndarray) -> np.ndarray:
    """Products of all pairs of features, the first not after the second; a column a row."""
    a, b = np.triu_indices(len(x))
    return x[a] * x[b]


def _steps(x: np.ndarray, n: int, low: np.ndarray, step: int) -> Iterator[tuple]:
    """Consecutive rows of an itemset (a column each), counts, sums and CovP after each of them, some rows at a time; ``n``
    and ``low`` are those before them."""
    step = max(1, min(step, (1 << 15) // (len(x) * len(x) + 1)))
    for at in range(0, x.shape[1], step):
        part = x[:, at : at + step]
        counts = n + np.arange(1, part.shape[1] + 1, dtype=float)
        lows = np.cumsum(part, 1) + low[:, None]
        yield part, counts, lows, _products(part - lows / counts)
        n, low = n + part.shape[1], lows[:, -1]


_KEYS = ["_s", "_m", "_b"]
_KEY_KINDS = "_s string, _m long, _b long"
_NEVER = (1 << 63) - 1


def _consecutive(batches: Iterator[pa.RecordBatch], most: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    """The rows of a task in parts of ``most``, which is asked once."""
    held, n, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size, at = size or max(1, most(batch)), 0
        while at < batch.num_rows:
            held.append(batch.slice(at, size - n))
            at, n = at + held[-1].num_rows, n + held[-1].num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _list(values, kind: pa.DataType | None = None) -> pa.ListArray:
    """One row with all ``values``."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).ravel()))


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


class _Scan:
    """Statistics of itemsets along rows, in blocks of consecutive rows that are scanned in parallel.

    Rows are shuffled and their itemsets found once: a block is one row that lists its numbers and the places of its
    itemsets. Blocks give their sums first, then, with the sums of the blocks before them, their CovP; both are small
    tables of one row an itemset and block. With ``by``, each of its values has statistics of its own; with
    ``markers``, blocks end at markers of ``row``. Matrices are symmetric and kept as halves."""

    def __init__(self, conn: DataFrame, features: int, max_level: int, by: str | None, markers: DataFrame | None):
        self.tables, self.step = Scratch(conn.sparkSession, "outliers"), STEP
        own = F.col(by) if by else F.lit("")
        rows = conn.select("row", own.alias("_v"), F.slice("cats", 1, features).alias("cats"), "x")
        rows = rows.withColumn("_m", F.lit(0).cast("long"))
        if markers is not None:
            rows = assign_marker(rows.drop("_m"), markers, ts="row").withColumn("_m", F.coalesce("marker", F.lit(_NEVER)))
        key = F.coalesce(F.concat(F.lit("="), F.col("_v").cast("string")), F.lit("")).alias("_s")
        rows = rows.select("row", key, "_v", "_m", "cats", "x")
        self.row, self.value = (rows.schema[c].dataType.simpleString() for c in ("row", "_v"))
        # ranges follow each other as the rows do, so that blocks are numbered within them
        ranged = rows.repartitionByRange("row").sortWithinPartitions("row")
        kind = (
            f"{_KEY_KINDS}, _v {self.value}, row array<{self.row}>, x array<double>, at array<int>, first array<int>, "
            "sets array<array<string>>, itemset array<string>, n long, l array<double>, s array<double>"
        )
        packed = self.tables.table("packed", ranged.mapInArrow(_packing(max_level, CHUNK, CELLS), kind), large_rows=True)
        self.blocks = packed.filter("n is null").drop("itemset", "n", "l", "s")
        self.sums = packed.filter("n is not null").select(*_KEYS, "itemset", "n", "l", "s")
        self.many = self.blocks.count()
        self.carry = self.tables.table("carry", self._before(self.sums, ["l", "s"]))
        kind = f"{_KEY_KINDS}, itemset array<string>, n long, vs array<double>, vl array<double>"
        spreads = self.blocks.groupBy(*_KEYS).cogroup(self.carry.groupBy(*_KEYS)).applyInArrow(self._second, kind)
        self.spreads = self.tables.table("spreads", spreads)

    def _before(self, parts: DataFrame, arrays: list[str]) -> DataFrame:
        """Sums over the blocks before each block."""
        ordered = parts.withColumn("_o", F.struct("_m", "_b"))
        chunk = F.floor(F.col("_b") / RUN_OF_BLOCKS) if self.many > RUN_OF_BLOCKS else None
        return _added(ordered, ["_s", "itemset"], arrays, "_o", chunk).select("*", "_o.*").drop("_o")

    @property
    def _second(self):
        step = self.step

        def run(block: pa.Table, before: pa.Table) -> pa.Table:
            state, n, vs, vl = _states(before, "l", "s"), [], [], []
            sets = block.column("sets")[0].as_py()
            for g, x in zip(sets, _parts(block), strict=True):
                n.append(x.shape[1])
                vs.append(0.0)
                vl.append(0.0)
                count, low, _ = state[tuple(g)]
                for _, _, _, cov_p in _steps(x, count, low, step):
                    vs[-1] += np.einsum("ck,ck->c", cov_p, cov_p)
                    vl[-1] += cov_p.sum(1)
            key = {k: pa.array([block.column(k)[0].as_py()] * len(sets), block.schema.field(k).type) for k in _KEYS}
            more = {"itemset": pa.array(sets, pa.list_(pa.string())), "n": pa.array(n, pa.int64())}
            return pa.table(key | more | {"vs": _lists(np.array(vs)), "vl": _lists(np.array(vl))})

        return run

    def _judged(self, support: int, tau: float, delta: float, given: Callable, kind: str) -> DataFrame:
        """What ``given`` makes of each block and the contributions at its places."""
        more = self._before(self.spreads, ["vs", "vl"]).drop("n")
        both, step = self.tables.table("both", self.carry.join(more, [*_KEYS, "itemset"])), self.step

        def run(block: pa.Table, before: pa.Table) -> pa.Table:
            sums, spreads, out = _states(before, "l", "s"), _states(before, "vs", "vl"), [np.zeros(0)]
            for g, x in zip(block.column("sets")[0].as_py(), _parts(block), strict=True):
                (count, low, s), (_, vs, vl) = sums[tuple(g)], spreads[tuple(g)]
                for part, n, lows, cov_p in _steps(x, count, low, step):
                    s, vs, vl = (c[:, None] + np.cumsum(v, 1) for c, v in ((s, _products(part)), (vs, cov_p * cov_p), (vl, cov_p)))
                    out.append(np.where(_violates(cov_p, n, lows, s, vs, vl, support, tau, delta), 1 / len(g), 0.0))
                    s, vs, vl = s[:, -1], vs[:, -1], vl[:, -1]
            return given(block, np.concatenate(out))

        return self.blocks.groupBy(*_KEYS).cogroup(both.groupBy(*_KEYS)).applyInArrow(run, kind)

    def contributions(self, support: int, tau: float, delta: float) -> DataFrame:
        """(row, itemset, contribution) of every row and itemset."""

        def given(block: pa.Table, found: np.ndarray) -> pa.Table:
            at, first = (_flat(block, c) for c in ("at", "first"))
            sets = pa.array(block.column("sets")[0].as_py(), pa.list_(pa.string()))
            ids = pa.array(np.repeat(np.arange(len(sets)), np.diff(first)))
            rows = block.column("row").combine_chunks().flatten().take(pa.array(at))
            return pa.table({"row": rows, "itemset": sets.take(ids), "contribution": pa.array(found)})

        return self._judged(support, tau, delta, given, f"row {self.row}, itemset array<string>, contribution double")

    def scores(self, support: int, tau: float, delta: float) -> DataFrame:
        """(_v, row, score): contributions added up by row; a block has all of its rows' itemsets."""

        def given(block: pa.Table, found: np.ndarray) -> pa.Table:
            rows = block.column("row").combine_chunks().flatten()
            value = pa.array([block.column("_v")[0].as_py()], block.schema.field("_v").type)
            score = np.bincount(_flat(block, "at"), weights=found, minlength=len(rows))
            return pa.table({"_v": value.take(pa.array(np.zeros(len(rows), np.int32))), "row": rows, "score": pa.array(score)})

        return self._judged(support, tau, delta, given, f"_v {self.value}, row {self.row}, score double")


def _packing(max_level: int, chunk: int, cells: int):
    """Blocks of consecutive rows that share source and marker, each followed by its itemsets' sums."""

    def packed(rows: pa.Table, b: int) -> Iterator[pa.RecordBatch]:
        x = np.ascontiguousarray(_numbers(rows.column("x")).T)
        sets, at, first = _itemsets(rows.column("cats"), max_level)
        head = {c: rows.column(c).combine_chunks()[:1] for c in ("_s", "_m", "_v")} | {"_b": pa.array([b], pa.int64())}
        block = {"row": _list(rows.column("row")), "x": _list(x.ravel(), pa.float64())}
        block |= {"at": _list(at, pa.int32()), "first": _list(first, pa.int32()), "sets": _list(sets, pa.list_(pa.string()))}
        half = np.triu_indices(len(x))
        lows, squares = np.zeros((len(sets), len(x))), np.zeros((len(sets), len(half[0])))
        for i, (u, v) in enumerate(zip(first, first[1:], strict=False)):
            part = x[:, at[u:v]]
            lows[i], squares[i] = part.sum(1), (part @ part.T)[half]
        sums = {"itemset": pa.array(sets, pa.list_(pa.string())), "n": pa.array(np.diff(first), pa.int64())}
        sums |= {"l": _lists(lows), "s": _lists(squares)}
        kinds = {k: a.type for k, a in (head | block | sums).items()}
        names = [*_KEYS, "_v", *block, *sums]
        for n, own in ((1, block), (len(sets), sums)):
            columns = {k: a.take(pa.array(np.zeros(n, np.int32))) for k, a in head.items()} | own
            yield pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, kinds[k]) for k in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = TaskContext.get().partitionId() << 32
        for table in _consecutive(batches, lambda batch: min(chunk, cells // max(1, _numbers(batch.column("x")[:1]).shape[1]))):
            marks = _codes(table.column("_m")).astype(np.int64)
            group = _codes(table.column("_s")) * (marks.max() + 1) + marks
            order = np.argsort(group, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                yield from packed(table.take(pa.array(own)) if len(own) < len(order) else table, b)
            b += 1

    return run


def _parts(block: pa.Table) -> Iterator[np.ndarray]:
    """The numbers of each itemset's rows, a column a row."""
    at, first = _flat(block, "at"), _flat(block, "first")
    x = _flat(block, "x").reshape(-1, len(block.column("row")[0]))
    for a, b in zip(first, first[1:], strict=False):
        yield x[:, at[a:b]]


def _states(table: pa.Table, a: str, b: str) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """n and two arrays of each itemset."""
    columns = (table.column("itemset").to_pylist(), table.column("n").to_pylist(), _numbers(table.column(a)), _numbers(table.column(b)))
    return {tuple(g): (n, x, y) for g, n, x, y in zip(*columns, strict=True)}


def _violates(cov_p, n, low, s, vs, vl, support: int, tau: float, delta: float) -> np.ndarray:
    """Whether rows (a column each) violate their itemset, given the statistics after each of them."""
    less = np.maximum(n - 1, 1)
    c = s / less + _products(low) / (n * less)
    sigma = np.sqrt(np.maximum((vs + 2 * c * vl + n * c * c) / less, 0))
    far = (np.abs(cov_p - c) > tau * sigma) & (sigma > 0)
    a, b = np.triu_indices(len(low))
    v = np.where(a == b, 1, 2).astype(np.float32) @ far.astype(np.float32)  # small whole numbers
    return (n < support) | (v > delta * len(low) ** 2)


def violation_scores(
    conn: DataFrame,
    features: int,
    max_level: int = LEVEL,
    support: int = SUPPORT,
    tau: float = TAU,
    delta: float = DELTA,
    by: str | None = None,
) -> DataFrame:
    """(row, itemset, contribution): 1 / size of the itemset where it is rare so far, or where over ``delta`` of the
    cells lie more than ``tau`` deviations from the covariance; running statistics include the row itself.

    ``row`` is unique. With ``by``, each of its values has a model of its own (local scores)."""
    return _Scan(conn, features, max_level, by, None).contributions(support, tau, delta)


def row_scores(
    conn: DataFrame,
    features: int,
    max_level: int = LEVEL,
    support: int = SUPPORT,
    tau: float = TAU,
    delta: float = DELTA,
    by: str | None = None,
) -> DataFrame:
    """(row, score), with ``by`` before them: the ``anomaly_score`` of ``violation_scores``, added up where they are found."""
    scores = _Scan(conn, features, max_level, by, None).scores(support, tau, delta)
    return scores.withColumnRenamed("_v", by) if by else scores.drop("_v")


def anomaly_score(violations: DataFrame) -> DataFrame:
    """(row, score): the sum of contributions."""
    return violations.groupBy("row").agg(F.sum("contribution").alias("score"))


def _flagged(scores: list[float], normal: deque, factor: float) -> tuple[list, list, list]:
    """Bound, verdict and next bound of consecutive scores; ``normal`` holds the last normal scores and moves on."""
    bounds, flags, after = [], [], []
    bound = factor * (sum(normal) / len(normal) if normal else 0.0)
    for score in scores:
        bounds.append(bound)
        flags.append(score > bound)
        if not flags[-1]:
            normal.append(score)
            bound = factor * (sum(normal) / len(normal))
        after.append(bound)
    return bounds, flags, after


def flag_outliers(scores: DataFrame, factor: float = FACTOR, window: int = SCORES, chunk: int = SCAN_ROWS) -> DataFrame:
    """(source, row, score, bound, outlier, after): in row order per source, an outlier scores above ``factor`` times the
    mean of the last ``window`` normal scores (0 where there are none) and does not enter that mean. ``after`` is the
    bound that the next row meets.

    A source is scanned in chunks of at most ``chunk`` rows at the same time. A chunk guesses its window from a scan of the
    last scores before it; chunks whose guess differs from the window that the one before them ends with are scanned
    again from that, until all agree. The first chunk needs no guess, so this ends, with the rows of one scan."""
    tables = Scratch(scores.sparkSession, "flags")
    rows = scores.select("source", "row", "score").withColumn("score", F.col("score").cast("double"))
    source, row = (rows.schema[c].dataType.simpleString() for c in ("source", "row"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for table in _consecutive(batches, lambda _: chunk):
            new = np.flatnonzero(np.diff(_codes(table.column("source")))) + 1
            for a, b in zip([0, *new], [*new, table.num_rows], strict=True):
                part = table.slice(a, b - a)
                first = part.column("source").combine_chunks()[:1]
                yield pa.RecordBatch.from_arrays(
                    [first, pa.array([k], pa.int64()), _list(part.column("row")), _list(part.column("score"))], ["source", "_k", "rows", "scores"]
                )
                k += 1

    # ranges follow each other as sources and rows do; a row is a chunk
    ranged = rows.repartitionByRange("source", "row").sortWithinPartitions("source", "row")
    chunks = tables.table("chunks", ranged.mapInArrow(pack, f"source {source}, _k long, rows array<{row}>, scores array<double>"), large_rows=True)

    def one(batch: pa.RecordBatch, normals: list[list]) -> pa.RecordBatch:
        normals = pa.array(normals, pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("source"), batch.column("_k"), normals], ["source", "_k", "normal"])

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            normals = []
            for scores in batch.column("last").to_pylist():
                normals.append(deque(scores[:window], maxlen=window))
                _flagged(scores[window:], normals[-1], factor)
            yield one(batch, list(map(list, normals)))

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            normals = [deque(x, maxlen=window) for x in batch.column("normal").to_pylist()]
            for scores, normal in zip(batch.column("scores"), normals, strict=True):
                _flagged(scores.values.to_pylist(), normal, factor)
            yield one(batch, list(map(list, normals)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("bound", "outlier", "after"), (pa.float64(), pa.bool_(), pa.float64())
        for batch in batches:
            for i, normal in enumerate(batch.column("normal").to_pylist()):
                rows, scores = batch.column("rows")[i].values, batch.column("scores")[i].values
                found = _flagged(scores.to_pylist(), deque(normal, maxlen=window), factor)
                sources = batch.column("source").take(pa.array(np.full(len(rows), i, np.int32)))
                columns = [sources, rows, scores, *[pa.array(v, t) for v, t in zip(found, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, ["source", "row", "score", *names])

    kind = f"source {source}, _k long, normal array<double>"
    last = F.slice("scores", F.greatest(F.lit(1), F.size("scores") - 8 * window + 1), 8 * window).alias("last")
    ends = tables.table("ends", chunks.select("source", "_k", last).mapInArrow(guessed, kind))  # one row a chunk
    before = F.lag("normal").over(Window.partitionBy("source").orderBy("_k"))
    starts = None
    while True:
        new = ends.select("source", "_k", F.coalesce(before, F.array().cast("array<double>")).alias("normal"))
        new = tables.table("starts", new)
        redo = new
        if starts is not None:
            old = starts.select("_k", F.col("normal").alias("old"))
            redo = tables.table("redo", new.join(old, "_k").filter("normal <> old").select("source", "_k", "normal"))
            if redo.isEmpty():
                break
        scan = chunks.select("_k", "scores").join(redo, "_k").select("source", "_k", "scores", "normal").mapInArrow(ended, kind)
        ends = tables.table("ends", ends.join(redo.select("_k"), "_k", "left_anti").select("source", "_k", "normal").unionByName(scan))
        starts = new
    out = chunks.join(new.select("_k", "normal"), "_k")
    return out.mapInArrow(judged, f"source {source}, row {row}, score double, bound double, outlier boolean, after double")


def _judged(rows: DataFrame, support: int, tau: float, delta: float) -> DataFrame:
    """(marker, row, contribution) of rows (marker, row, itemset, x) scored once against n, l, s, vs, vl."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, low, s, vs, vl = (_numbers(batch.column(c)).T for c in ("x", "l", "s", "vs", "vl"))
            n, size = batch.column("n").to_numpy() + 1.0, pc.list_value_length(batch.column("itemset")).to_numpy()
            low = low + x
            cov_p = _products(x - low / n)
            hit = _violates(cov_p, n, low, s + _products(x), vs + cov_p * cov_p, vl + cov_p, support, tau, delta)
            yield pa.RecordBatch.from_arrays(
                [batch.column("marker"), batch.column("row"), pa.array(np.where(hit, 1 / size, 0.0))], ["marker", "row", "contribution"]
            )

    return rows.mapInArrow(run, f"marker long, row {rows.schema['row'].dataType.simpleString()}, contribution double")


def confirm_outliers(
    flags: DataFrame,
    conn: DataFrame,
    markers: DataFrame,
    features: int,
    max_level: int = LEVEL,
    factor: float = FACTOR,
    support: int = SUPPORT,
    tau: float = TAU,
    delta: float = DELTA,
    by: str = "source",
) -> DataFrame:
    """(marker, row, score, bound): local outliers that the merged model confirms at the next check marker.

    ``flags`` comes from ``flag_outliers`` over local scores. At each marker the models of all values of ``by`` are
    added up; every local outlier of the check window is scored against that sum, itself counted once more, and stays
    if it passes ``factor`` times the mean normal score of the least source at that check. Nothing of a check enters the
    models. Outliers after the last marker are not confirmed."""
    scan = _Scan(conn, features, max_level, by, markers)
    tables = scan.tables
    placed = assign_marker(flags.select("source", "row", "outlier", "after"), markers, ts="row").filter("marker is not null")
    placed = tables.table("placed", placed.select("marker", "source", "row", "outlier", "after"))
    bounds = placed.groupBy("marker").agg(F.min_by("after", F.struct("source", -F.col("row"))).alias("bound"))
    hits = placed.filter("outlier").select("marker", "row")
    hits = F.broadcast(hits) if hits.limit(SENT_OUTLIERS + 1).count() <= SENT_OUTLIERS else hits
    found = conn.select("row", "cats", "x").join(hits, "row")
    found = tables.table("found", match_itemsets(found, features, max_level).select("marker", "row", "itemset", "x"))
    # increments of all sources at each marker, and a tick after them wherever a model is asked for
    parts = scan.sums.join(scan.spreads.drop("n"), [*_KEYS, "itemset"]).withColumn("_o", F.struct(F.col("_m").alias("m"), F.lit(0).alias("t")))
    parts = _added(parts.join(found.select("itemset").distinct(), "itemset", "left_semi"), ["itemset", "_o"], ["l", "s", "vs", "vl"])
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    d = F.size("x")
    half = (d * (d + 1) / 2).cast("int")
    ticks = found.select(
        "itemset", F.struct(F.col("marker").alias("m"), F.lit(1).alias("t")).alias("_o"), F.lit(0).cast("long").alias("n"),
        zeros(d).alias("l"), zeros(half).alias("s"), zeros(half).alias("vs"), zeros(half).alias("vl"),
    )
    model = _added(parts.unionByName(ticks.dropDuplicates(["itemset", "_o"])), ["itemset"], ["l", "s", "vs", "vl"], over="_o")
    model = tables.table("model", model).filter("_o.t = 1").withColumn("marker", F.col("_o.m")).drop("_o")
    scores = _judged(found.join(model, ["itemset", "marker"]), support, tau, delta)
    scores = scores.groupBy("marker", "row").agg(F.sum("contribution").alias("score"))
    return scores.join(bounds, "marker").filter("score > bound").select("marker", "row", "score", "bound")
