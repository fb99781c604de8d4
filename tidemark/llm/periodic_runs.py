"""Periodic runs of words, found by online dyadic square catching (operator 11).

Words are appended to one growing sequence. Whenever a block of 2**k words is complete, a catcher is set on it: it holds
the block against the 2**k windows that lie one to two block lengths before it, which are all the places where the
block can stand one period of 2**k to 2**(k+1) - 1 words earlier. A match is a stretch of one period: it is extended
backwards at once, and forwards by every word appended from then on, until a word differs. A stretch of two periods is
a square; squares of one period that overlap have the same left end, so they merge into one run. A run of three periods
contains a whole block that also stands one period earlier, so none is missed; of the stretches with the same ends the
smallest period is the run's.

Blocks, windows and extensions are compared by prefix hashes, many at a time, and every run is then compared word by
word; texts whose hashes deceive (none is known) are searched plainly. Texts are parted by a word that occurs once.

Defined results: null and empty texts have no words and no runs; a text of any length is searched whole; repeated rows
give a row each, null ids are passed through; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import small_batches, words_column

#: The fewest words and periods of a run.
LEAST_WORDS, LEAST_PERIODS = 24, 3

_KIND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"


class Catchers:
    """Runs of a sequence of word hashes that grows by ``append``; periods go up to ``longest``.

    ``append`` takes any number of words; how a sequence is cut into them changes no run. Positions count from the
    first word ever appended, which must be one that occurs once."""

    def __init__(self, longest: int, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS):
        self.longest, self.least, self.periods = longest, least, periods
        self.words, self.sums = np.zeros(0, np.uint64), np.zeros(1, np.uint64)
        self.blocks = [0] * max(1, int(longest).bit_length())  # complete ones of each size that have their catchers
        self.open = np.zeros((3, 0), np.int64)  # stretches that the next word may extend
        self.closed: list[np.ndarray] = []

    def _of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def _reach(self, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
        """How many words from ``at`` on (before it for -1) equal the words one period earlier, by bisection."""
        low = np.zeros(len(at), np.int64)
        high = len(self.words) - at if step > 0 else at - period
        while (low < high).any():
            mid = (low + high + 1) // 2
            a = at if step > 0 else at - mid
            same = self._of(a, a + mid) == self._of(a - period, a - period + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _catch(self, k: int) -> np.ndarray:
        """Stretches that blocks of 2**k words completed since the last call begin or belong to."""
        size, done = 1 << k, max(self.blocks[k], 2)
        self.blocks[k] = many = len(self.words) // size
        if many <= done:
            return self.open[:, :0]
        x = np.arange((done - 2) * size + 1, (many - 2) * size + 1)
        own = np.arange(done, many) * size
        hit = self._of(x, x + size).reshape(-1, size) == self._of(own, own + size)[:, None]
        block, place = np.nonzero(hit)
        period = 2 * size - 1 - place
        keep = period <= self.longest
        block, period = block[keep], period[keep]
        order = np.lexsort((block, period))
        block, period = block[order] + done, period[order]
        new = np.ones(len(block), bool)  # blocks in a row with the same period lie in the same stretch
        new[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + 1)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(block))[: len(at)] - 1
        period, begin, end = period[at], block[at] * size, (block[last] + 1) * size
        return np.array([period, begin - period - self._reach(begin, period, -1), end])

    def append(self, words: np.ndarray) -> np.ndarray:
        """(period, first word) of the stretches in which these words complete the first square."""
        old = len(self.words)
        self.words = np.concatenate([self.words, words])
        power, self.inverse = T._power_tables(T._WORD_BASE, len(self.words))
        grown = self.sums[-1] + np.cumsum(words * power[old : len(self.words)], dtype=np.uint64)
        self.sums = np.concatenate([self.sums, grown])
        known = self.open
        found = [known, *[self._catch(k) for k in range(len(self.blocks))]]
        before = np.concatenate([known[2] - known[1], np.zeros(sum(x.shape[1] for x in found[1:]), np.int64)])
        period, first, end = np.concatenate(found, axis=1)
        end = end + self._reach(end, period, 1)
        order = np.lexsort((-before, first, period))  # the stretch as it was known comes first
        period, first, end, before = period[order], first[order], end[order], before[order]
        new = np.ones(len(period), bool)
        new[1:] = (period[1:] != period[:-1]) | (first[1:] != first[:-1])
        begin = np.flatnonzero(new)
        end = np.maximum.reduceat(end, begin) if len(begin) else end
        period, first, before = period[begin], first[begin], before[begin]
        open_ = end == len(self.words)
        self.open = np.array([period, first, end])[:, open_]
        long = ~open_ & (end - first >= np.maximum(self.least, self.periods * period))
        self.closed.append(np.array([period, first, end])[:, long])
        square = (end - first >= 2 * period) & (before < 2 * period)
        return np.array([period[square], first[square]])

    def runs(self) -> np.ndarray:
        """(period, first, end) of the runs that a later word has closed, by first word and period."""
        period, first, end = np.concatenate([self.open[:, :0], *self.closed], axis=1)
        order = np.lexsort((period, end, first))
        period, first, end = period[order], first[order], end[order]
        new = np.ones(len(period), bool)  # a multiple of a run's period has its ends
        new[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
        period, first, end = period[new], first[new], end[new]
        order = np.lexsort((period, first))
        return np.array([period[order], first[order], end[order]])


def _holds(words: np.ndarray, period: int, first: int, end: int) -> bool:
    """Whether the run is one, word by word; both ends have a neighbour."""
    ends = words[first - 1] != words[first - 1 + period] and words[end] != words[end - period]
    return bool(ends) and np.array_equal(words[first + period : end], words[first : end - period])


def _plainly(words: np.ndarray, least: int, periods: int) -> list[tuple[int, int, int]]:
    """The same runs by comparing the words with those of every period before them: in square time."""
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // periods + 1):
        same = np.concatenate([[False], words[p:] == words[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in edge[edge[:, 1] - edge[:, 0] + p >= max(least, periods * p)].tolist():
            found.setdefault((a, b + p), p)
    return sorted(((p, a, b) for (a, b), p in found.items()), key=lambda r: (r[1], r[0]))


def runs_of(w: T.Words, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers of all runs of ``w``, and their (period, first, end) by first word and period, words counted from
    the text's first."""
    counts = np.diff(w.first)
    shift = w.first[:-1] + np.arange(len(counts)) + 1  # place of each text's first word, after the word that parts texts
    line = np.empty(len(w.hash) + len(counts) + 1, np.uint64)
    parted = np.append(shift - 1, len(line) - 1)
    line[parted] = T.mix(np.arange(len(parted), dtype=np.uint64), 0x6A09E667F3BCC909)
    rest = np.ones(len(line), bool)
    rest[parted] = False
    line[rest] = w.hash
    catchers = Catchers(int(counts.max(initial=0)) // periods, least, periods)
    catchers.append(line)
    found = catchers.runs()
    doc = np.searchsorted(shift, found[1], "right") - 1
    true = [_holds(line, *r) for r in found.T.tolist()]
    for d in np.unique(doc[~np.array(true, bool)]).tolist():
        own = _plainly(w.hash[w.first[d] : w.first[d + 1]], least, periods)
        own = np.array(own, np.int64).reshape(-1, 3).T + np.array([[0], [shift[d]], [shift[d]]])
        found, doc = np.concatenate([found[:, doc != d], own], axis=1), np.append(doc[doc != d], np.full(own.shape[1], d))
        order = np.argsort(doc, kind="stable")
        found, doc = found[:, order], doc[order]
    found[1:] -= shift[doc]
    return doc, found


def _collapsed(least: int, periods: int):
    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        w = T.words(part.column("text"))
        doc, (period, first, end) = runs_of(w, least, periods)
        change = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(change, w.first[doc] + first + period, 1)
        np.add.at(change, w.first[doc] + end, -1)
        stays = np.cumsum(change[:-1]) == 0
        texts, data = [], w.data.tobytes()
        for i in range(part.num_rows):
            keep = np.flatnonzero(stays[w.first[i] : w.first[i + 1]]) + w.first[i]
            s, e = w.start[keep].tolist(), w.end[keep].tolist()
            texts.append(b" ".join([data[x:y] for x, y in zip(s, e, strict=True)]))
        offsets = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array(first), pa.array(end - first), pa.array(period)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(np.diff(w.first)),
                pa.ListArray.from_arrays(pa.array(offsets), each),
                pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
            ],
            ["doc_id", "n_words", "runs", "kept_text"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 19):
                yield one(part)

    return run, _KIND


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, kept_text), one row per input row.

    A run is a stretch of words with smallest period q and at least ``least`` words and ``periods`` (3 or more) times q
    that no neighbouring word extends; ``runs`` has start, length and period of each, by start and period. ``kept_text``
    has the words that no run contains after its first q words, joined by one space. No shuffle."""
    if periods < 3:
        raise ValueError("blocks are sure to meet runs of three periods or more")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(*_collapsed(least, periods))


def strongest(runs: F.Column) -> F.Column:
    """Of ``runs`` in their order, the one with the greatest length per period; the first of ties, null without any."""
    better = lambda r, b: b["period"].isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda b, r: F.when(better(r, b), r).otherwise(b))


def repeat_some_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where documents whose id's crc32 ends in 0 are periodic from some word on, words joined by one
    space: the test data of the query. Null ids and texts without words stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / F.lit(10))

    def repeated(words: F.Column) -> F.Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")
        moved = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text"))

    listed = F.array(words_column("text"))
    text = F.when(h % 10 == 0, F.get(F.transform(listed, repeated), F.lit(0))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))
