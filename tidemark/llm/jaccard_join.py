"""Set-similarity join over word shingles with parity sketches (operator 7).

Each distinct shingle is hashed to one of the sketch's 64-bit symbols and XORed into it. A shingle that only one
of two sets has changes one symbol at most, so the number of differing symbols (the Hamming distance over symbols)
is at most the symmetric difference, which a Jaccard bound limits by the sizes. Sketches of one size band have two
symbols more than that limit: two linked sets agree in two symbols at least, and meet in a hash join on symbols.
Empty symbols say little, so they only meet in pairs: two agreeing symbols are either not both empty or form such
a pair. Links are verified on the whole shingle sets.

Copies of one set are folded before the join. Only sets that have enough shingles which any other shares are sketched.
Those that meet in a symbol are first linked to the smallest of it; after contraction only pairs that meet and are still
apart are verified, so no link between components is lost and no group of copies is expanded into pairs. Pairs whose
parity sketches of single bits differ in more bits than linked sets do in shingles are ruled out inside that join, and
by sketches of more bits before their shingles are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch, partitions, sent, small_batches, trimmed
from .graph import components


@cache
def _bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last set size of each band, and the symbols of sketches in it: two more than two linked sets can
    differ in when the smaller is of the band. None where no difference is allowed."""
    low = [1]
    while low[-1] < 1 << 31:
        low.append(max(low[-1] + 1, low[-1] * 3 // 2))
    high = np.array(low[1:]) - 1
    differ = high * (100 - percent) // percent
    return np.array(low[:-1]), high, np.where(differ > 0, differ + 2, 0)


def shingles(w: T.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted in each, and where each text's begin. Texts with fewer words
    than ``size`` have their whole sequence as one shingle, texts without words none."""
    sums, counts = T.Prefix(w.hash), np.diff(w.first)
    length = np.minimum(counts, size)
    many = np.where(counts > 0, counts - length + 1, 0)
    at = T.ranges(w.first[:-1], many)
    span = np.repeat(length, many)
    h = T.mix(sums.of(at, at + span) + span.astype(np.uint64))
    doc = np.repeat(np.arange(len(counts)), many)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def _parity(h: np.ndarray, longs: int) -> np.ndarray:
    """``longs`` longs of bits, each the parity of the shingles of a set that fall on it."""
    place = (T.mix(h, 0x7FB5D329728EA185) % np.uint64(64 * longs)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=64 * longs) & 1).astype(np.uint8)).view(np.int64)


def _totals(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: the sum of its mixed hashes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h, 0x2545F4914F6CDD1D), dtype=np.uint64)])
    return T.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def _sketch(h: np.ndarray, band: int, symbols: int) -> np.ndarray:
    """The join keys of one set in one band."""
    word = np.zeros(symbols, np.uint64)
    np.bitwise_xor.at(word, (h % np.uint64(symbols)).astype(np.int64), T.mix(h, 0x9FB21C651E98DF25))
    full = np.flatnonzero(word)
    keys = [T.mix(word[full] + np.uint64(band << 32) + full.astype(np.uint64), 3)]
    empty = np.flatnonzero(word == 0)
    if len(empty) > 1:
        i, j = np.triu_indices(len(empty), 1)
        pair = (empty[i] * symbols + empty[j]).astype(np.uint64)
        keys.append(T.mix(pair + (np.uint64(band) << np.uint64(56)), 11))
    return np.concatenate(keys)


def _identified(size: int):
    """The number of shingles and the set id of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 18):
                h, first = shingles(T.words(part.column("text"), lower=True), size)
                n, sid = pa.array(np.diff(first).astype(np.int64)), pa.array(_totals(h, first).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), n, sid], ["doc_id", "text_hash", "n_shingles", "sid"]
                )

    return trimmed(run), "doc_id long, text_hash long, n_shingles long, sid long"


#: Keys or shingles that a task gathers before it gives them on.
GATHERED = 200_000
#: Longs of the bit sketch that tells most pairs apart before their sets are read, of the wide one that tells apart what
#: the first leaves over (it is full at some 500 shingles), and keys of a set that are compared so that a pair comes out once.
SKETCH_LONGS, WIDE_LONGS, LOWEST = 4, 64, 8


def _gathered(sets: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, sids) of GATHERED or more values at a time, out of (sid, values) of single sets."""
    found, sids, many = [np.zeros(0, np.int64)], [0], 0

    def given() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(found), np.repeat(np.array(sids, np.int64), [len(v) for v in found])

    for sid, values in sets:
        found.append(values)
        sids.append(sid)
        many += len(values)
        if many >= GATHERED:
            yield given()
            found, sids, many = [], [], 0
    if found:
        yield given()


def _ends(value: np.ndarray, sid: np.ndarray, name: str) -> pa.RecordBatch:
    """(name, low, high): each value once, with its least and greatest sid."""
    order = np.lexsort((sid, value))
    value, sid = value[order], sid[order]
    new = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
    last = np.append(new[1:], len(value))[: len(new)] - 1
    by_set = np.argsort(sid[new], kind="stable")  # rows of one set side by side compress well
    new, last = new[by_set], last[by_set]
    return pa.RecordBatch.from_arrays([pa.array(value[new]), pa.array(sid[new]), pa.array(sid[last])], [name, "low", "high"])


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(sid, hashes) of the rows of a batch of sets."""
    for sid, grams in zip(batch.column("sid").to_pylist(), batch.column("grams"), strict=True):
        yield sid, np.frombuffer(grams.as_buffer(), np.int64)


def _keys(percent: int, ends: bool):
    """(key, sid) of each set's sketches, or with ``ends`` (key, low, high): the least and greatest sid of each key
    among those gathered, so that a key of many sets travels as few rows."""
    low, high, symbols = _bands(percent)

    def keys(h: np.ndarray) -> np.ndarray:
        n, out = len(h), [np.zeros(0, np.uint64)]
        # the bands that this set, or a smaller one linked with it, can be of
        for band in np.flatnonzero((low <= n) & (100 * high >= percent * n)):
            if symbols[band]:
                out.append(_sketch(h, int(band), int(symbols[band])))
        return np.concatenate(out).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sid in _gathered((sid, keys(h.view(np.uint64))) for batch in batches for sid, h in _read(batch)):
            if ends:
                yield _ends(key, sid, "key")
            else:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid)], ["key", "sid"])

    return trimmed(run), "key long, low long, high long" if ends else "key long, sid long"


def _sets(size: int):
    """(sid, grams, bits, wide): the sorted shingle hashes, as bytes, and the bit sketches of the texts whose set is the
    one ``wanted`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 18):
                h, first = shingles(T.words(part.column("text"), lower=True), size)
                grams = [h[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                sid = _totals(h, first).view(np.int64)
                same = np.flatnonzero(sid == part.column("wanted").to_numpy(zero_copy_only=False))
                sketches = [[_parity(h[first[i] : first[i + 1]], n) for i in same] for n in (SKETCH_LONGS, WIDE_LONGS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid[same]), pa.array([grams[i] for i in same], pa.binary()), *(pa.array(s, pa.list_(pa.int64())) for s in sketches)],
                    ["sid", "grams", "bits", "wide"],
                )

    return trimmed(run), "sid long, grams binary, bits array<long>, wide array<long>"


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return trimmed(run), "a long, b long"


def _differ(a: str, b: str) -> Column:
    """In how many bits two sketches differ: no more than their sets do in shingles."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_LONGS)), F.lit(0))


def _differ_widely(a: str, b: str) -> Column:
    """The same of wide sketches."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def _links(tables: Scratch, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b), those whose sets reach the bound. Only pairs that sizes, bit sketches and then wide ones
    leave over are given their shingles."""
    n = (F.length("grams") / 8).cast("long")
    left = sets.select(F.col("sid").alias("a"), n.alias("na"), F.col("bits").alias("bits_a"))
    right = sets.select(F.col("sid").alias("b"), n.alias("nb"), F.col("bits").alias("bits_b"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    close = (100 + percent) * _differ("bits_a", "bits_b") <= (100 - percent) * (F.col("na") + F.col("nb"))
    left_over = pairs.join(left, "a").join(right, "b").filter(near & close).select("a", "b", (F.col("na") + F.col("nb")).alias("both"))
    wide_a = sets.select(F.col("sid").alias("a"), F.col("wide").alias("wide_a"))
    wide_b = sets.select(F.col("sid").alias("b"), F.col("wide").alias("wide_b"))
    close = (100 + percent) * _differ_widely("wide_a", "wide_b") <= (100 - percent) * F.col("both")
    left_over = tables.table("close", left_over.join(wide_a, "a").join(wide_b, "b").filter(close).select("a", "b"))
    ends = tables.table("ends", left_over.select(F.col("a").alias("sid")).union(left_over.select("b")).distinct())
    these = sets.join(sent(ends), "sid", "left_semi")
    left = these.select(F.col("sid").alias("a"), F.col("grams").alias("ga"))
    right = these.select(F.col("sid").alias("b"), F.col("grams").alias("gb"))
    found = left_over.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(*_verified(percent))
    links = tables.table("links", found)
    tables.drop("close", "ends")
    return links


def _hashed(size: int):
    """(sid, hashes) of every text of a batch (text)."""

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for part in T.slices(batch, "text", 1 << 18):
            h, first = shingles(T.words(part.column("text"), lower=True), size)
            for sid, a, b in zip(_totals(h, first).view(np.int64).tolist(), first, first[1:], strict=False):
                yield sid, h[a:b].view(np.int64)

    return sets


def _grams(sets: Callable, per_cent: int = 100):
    """(gram, low, high) of the sets that ``sets`` finds in a batch: their shingles, or those whose hashes are in the
    lowest ``per_cent``, with the least and greatest sid among the gathered sets that have it."""
    # hashes are signed here, and the lowest of them is -2**63
    limit = min(per_cent * (1 << 64) // 100 - (1 << 63), (1 << 63) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, sid in _gathered((sid, h[h <= limit]) for batch in batches for sid, h in sets(batch)):
            yield _ends(gram, sid, "gram")

    return trimmed(run), "gram long, low long, high long"


def _shareable(grams: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(sid, n, c) of the ``sizes`` (sid, n) that can be linked with any other: c is n without the shingles that no other
    set has, as far as ``grams`` (gram, low, high) tells. A link needs ``percent`` of n in c; and no two sets can have
    more shingles in common than the smaller c."""
    dealt = grams.repartition(partitions(grams.sparkSession), "gram")  # tasks have folded them already
    alone = dealt.groupBy("gram").agg(F.min("low").alias("sid"), F.max("high").alias("high")).filter("sid = high")
    own = alone.groupBy("sid").agg(F.count("*").alias("own"))
    both = sizes.join(own, "sid", "left").select("sid", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c"))
    return both.filter(100 * F.col("c") >= percent * F.col("n"))


def _meet(live: DataFrame, others: DataFrame, percent: int, order: Column | bool = True) -> DataFrame:
    """Distinct pairs (a < b) of ``live`` and ``others`` (key, m) in one key and different components that have enough
    shingles which anyone shares."""
    enough = (100 + percent) * F.least("c", "m.c") >= percent * (F.col("n") + F.col("m.n"))
    pairs = live.join(others, "key").filter((F.col("root") != F.col("m.root")) & enough & F.lit(order))
    return pairs.select(F.least("sid", "m.sid").alias("a"), F.greatest("sid", "m.sid").alias("b")).distinct()


def _rooted(live: DataFrame, links: DataFrame) -> DataFrame:
    """``live`` with the root of each set after ``links``."""
    roots = components(links).withColumnRenamed("node", "sid")
    return live.drop("root").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def _open(live: DataFrame) -> DataFrame:
    """``live`` at the keys where sets of several roots meet."""
    several = live.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key")
    return live.join(several, "key", "left_semi")


def _classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, root), one row per row of ``docs`` (doc_id, text, text_hash); root is
    the id of one set of the component, which tells components of one smallest doc_id apart."""
    tables = Scratch(docs.sparkSession, "op7")
    sized = tables.table("sized", docs.mapInArrow(*_identified(size)))
    reps = sized.filter("n_shingles > 0 and doc_id is not null").groupBy("sid")
    reps = tables.table("reps", reps.agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")))
    # twice the shingles that a linked set can have of its own, of all shingles, rule most sets out: of those that nobody
    # shares any, and of the others many that share less than half
    known = docs.filter("doc_id is not null").select("text")
    some = known.mapInArrow(*_grams(_hashed(size), min(100, 2 * (100 - percent))))
    able = tables.table("able", _shareable(some, reps.select("sid", "n"), percent))
    wanted = reps.join(able.select("sid"), "sid", "left_semi").select("doc_id", F.col("sid").alias("wanted"))
    wanted = tables.table("wanted", wanted)
    texts = docs.select("doc_id", "text").join(sent(wanted, "shuffle_hash"), "doc_id")
    sets = tables.table("sets", texts.mapInArrow(*_sets(size)).dropDuplicates(["sid"]))
    full = _shareable(sets.select("sid", "grams").mapInArrow(*_grams(_read)), able.select("sid", "n"), percent)
    full = tables.table("full", full)
    sets = tables.table("sets", sets.join(sent(full.select("sid")), "sid", "left_semi"))
    tables.drop("sets", but_last=True)

    # keys are computed twice rather than kept. The tasks have folded them already, so they are dealt by key before they
    # are grouped: hash tables of Spark need no room beside the Python workers
    sketched = sets.select("sid", "grams")
    met = sketched.mapInArrow(*_keys(percent, True)).repartition(partitions(docs.sparkSession), "key")
    met = met.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    met = tables.table("met", met.select("key"))
    members = sketched.mapInArrow(*_keys(percent, False)).join(met, "key")
    live = tables.table("live", members.join(full, "sid").distinct().withColumn("root", F.col("sid")))
    tables.drop("met", "able", "wanted", "full")

    # the smallest member of each key is the centre that the others are held against
    centre = live.groupBy("key").agg(F.min(F.struct("sid", "root", "n", "c")).alias("m"))
    first = tables.table("first", _meet(live, centre, percent))
    links = _links(tables, first, sets, percent)
    live = tables.table("live", _open(_rooted(live, links)))
    tables.drop("live", but_last=True)

    # the member with the fewest shingles of its own is the likeliest to be linked with the others
    middle = live.groupBy("key").agg(F.max_by(F.struct("sid", "root", "n", "c"), F.struct(F.col("c") - F.col("n"), "sid")).alias("m"))
    near = tables.table("near", _meet(live, middle, percent))
    links = links.union(_links(tables, near.join(first, ["a", "b"], "left_anti"), sets, percent))
    live = _open(_rooted(live, links))
    low = live.groupBy("sid").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOWEST).alias("low"))  # of one set
    live = tables.table("live", live.join(low.join(sets.select("sid", "bits"), "sid"), "sid"))
    tables.drop("live", but_last=True)
    # a pair comes out of the smallest key that both sets have among their lowest, or of each key where they have none
    lowest = F.array_min(F.array_intersect("low", "m.low"))
    once = (F.col("sid") < F.col("m.sid")) & (lowest.isNull() | (lowest == F.col("key")))
    close = (100 + percent) * _differ("bits", "m.bits") <= (100 - percent) * (F.col("n") + F.col("m.n"))
    rest = _meet(live, live.select("key", F.struct("sid", "root", "n", "c", "low", "bits").alias("m")), percent, once & close)
    tested = first.union(near)
    more = _links(tables, rest.join(tested, ["a", "b"], "left_anti"), sets, percent)
    tables.drop("live", "near", "first", "sets")

    classes = components(links.union(more)).withColumnRenamed("node", "sid")
    tables.drop("links")
    smallest = reps.join(classes, "sid").groupBy("root").agg(F.min("doc_id").alias("least"))
    per_set = classes.join(smallest, "root").select("sid", "root", "least")
    # written, so that the last join has nothing but two shuffles below it and can be split where copies crowd a set
    own = tables.table("own", reps.join(per_set, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), F.coalesce("least", "doc_id").alias("least")))
    tables.drop("reps")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return sized.join(own, "sid", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), "root"
    )


def _rows(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Texts are lower-cased (A-Z) and split at ASCII white space. Two documents are linked when
    ``100 * |A & B| >= percent * |A | B|`` over their sets of ``size``-word shingles; component_id is the smallest
    doc_id reachable by links. Null and empty texts have no shingles and are linked with nothing; a null doc_id
    has a null component and links nothing; copies under any ids are linked, ties go to the smaller id. Unlike texts
    under one doc_id are sets of their own. Texts of any length are taken whole, an empty table gives no rows. Extra
    columns are ignored. Sets are told apart by 64-bit ids and shingles by 64-bit hashes.
    """
    return _classes(_rows(docs), size, percent).drop("text_hash", "root")


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are not near duplicates of another row, with all their columns.

    Of each group of linked texts the row of the smallest doc_id stays; where that id has several texts of the group,
    one of them (the smallest text hash), and of repeated rows one. Rows without words or without doc_id stay all.
    """
    tables = Scratch(docs.sparkSession, "op7-kept")
    classes = _classes(_rows(docs), size, percent).filter("n_shingles > 0 and doc_id is not null")
    texts = classes.groupBy("doc_id", "text_hash", "component_id", "root").agg(F.count("*").alias("n"))
    texts = tables.table("texts", texts)
    best = texts.filter("doc_id = component_id").groupBy("root").agg(F.min("text_hash").alias("best"))
    judged = texts.join(best, "root").withColumn("stays", F.expr("doc_id = component_id and text_hash = best"))
    verdicts = tables.table("verdicts", judged.filter("n > 1 or not stays").select("doc_id", "text_hash", "stays"))
    stay = sent(verdicts.filter("stays")).alias("v")
    rows = docs.alias("d")
    same = (F.col("d.doc_id").cast("long") == F.col("v.doc_id")) & (F.xxhash64("d.text") == F.col("v.text_hash"))
    single = rows.join(sent(verdicts).alias("v"), same, "left_anti")
    repeated = rows.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)
