"""Outlier scores against a plain single-process scan."""

from itertools import combinations

import numpy as np
import pytest

from tidemark.operators import outlier as O

DIMENSIONS = 3


def rows(n, seed=1, d=DIMENSIONS):
    rng = np.random.default_rng(seed)
    cats = [["tcp", "udp"], ["http", "smtp", "ftp"], ["0", "1"], ["0", "1"]]
    return [
        (i, int(i % 2), [str(rng.choice(c)) for c in cats], [float(x) for x in rng.normal(size=d) * (1 + 9 * (rng.random() < 0.05))])
        for i in range(n)
    ]


class Plain:
    """The published scan, one row after the other."""

    def __init__(self):
        self.state = {}

    def score(self, cats, x, keep=True, tau=O.TAU):
        x, score = np.array(x), 0.0
        for g in dict.fromkeys(c for k in (1, 2) for c in combinations(cats, k)):
            zero = np.zeros((len(x), len(x)))
            n, low, s, vs, vl = self.state.get(g, (0, 0 * x, zero, zero, zero))
            n, low, s = n + 1, low + x, s + np.outer(x, x)
            p = np.outer(x - low / n, x - low / n)
            c = s + np.outer(low, low) if n <= 1 else s / (n - 1) + np.outer(low, low) / (n * (n - 1))
            vs, vl = vs + p * p, vl + p
            q = vs + 2 * c * vl + n * c * c
            sigma = np.sqrt(np.maximum(q if n <= 1 else q / (n - 1), 0))
            v = int(((np.abs(p - c) > tau * sigma) & (sigma > 0)).sum())
            if keep:
                self.state[g] = (n, low, s, vs, vl)
            score += 1 / len(g) if n < O.SUPPORT or v > O.DELTA * len(x) ** 2 else 0.0
        return score

    def __add__(self, other):
        both = Plain()
        for g in {**self.state, **other.state}:
            have = [m.state[g] for m in (self, other) if g in m.state]
            both.state[g] = tuple(sum(parts) for parts in zip(*have, strict=True))
        return both


def mean_bound(normal):
    return 10 * sum(normal) / len(normal) if normal else 0.0


SCHEMA = "row long, source int, cats array<string>, x array<double>"


@pytest.mark.parametrize(("chunk", "step", "run"), [(8192, 256, 256), (37, 5, 256), (7, 3, 4)])
def test_scores(spark, monkeypatch, chunk, step, run):
    monkeypatch.setattr(O, "CHUNK", chunk)
    monkeypatch.setattr(O, "STEP", step)
    monkeypatch.setattr(O, "RUN_OF_BLOCKS", run)
    data, model = rows(400), Plain()
    want = {row: model.score(cats, x) for row, _, cats, x in data}
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {r.row: r.score for r in O.anomaly_score(O.violation_scores(df, 4)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("by", [None, "source"])
def test_scores_of_34_features(spark, monkeypatch, by):
    """As wide as the recorded connections; blocks of a few rows, so that sums are carried through several chunks."""
    monkeypatch.setattr(O, "CHUNK", 16)
    monkeypatch.setattr(O, "RUN_OF_BLOCKS", 3)
    data, models = rows(150, seed=7, d=34), {0: Plain(), 1: Plain()}
    want = {row: models[source if by else 0].score(cats, x) for row, source, cats, x in data}
    got = O.anomaly_score(O.violation_scores(spark.createDataFrame(data, SCHEMA).repartition(3), 4, by=by)).collect()
    assert {r.row for r in got} == want.keys() and all(abs(r.score - want[r.row]) < 1e-9 for r in got)
    assert len(set(want.values())) > 2


def test_sums_are_never_cells(spark):
    """One row an itemset and block goes through the shuffles."""
    df = spark.createDataFrame(rows(50), SCHEMA)
    plan = O.itemset_moments(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_itemsets_of_odd_values(spark):
    """Null values, equal values of different features, rows without rows beside them, no rows at all."""
    data = [(0, 0, ["a", None, "a"], [1.0, 2.0, 3.0]), (1, 0, ["b", "a", None], [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, SCHEMA)
    want = {(tuple(r.itemset), r["count"]) for r in O.match_itemsets(df, 3).groupBy("itemset").count().collect()}
    assert {(tuple(r.itemset), r.n) for r in O.itemset_moments(df, 3).collect()} == want
    assert {tuple(r.itemset) for r in O.violation_scores(df, 3).collect()} == {g for g, _ in want}
    assert O.violation_scores(df.limit(0), 3).count() == 0 == O.itemset_moments(df.limit(0), 3).count()


def test_flags_and_confirmation(spark, monkeypatch):
    """Local models per source, checks at markers against the sum of the models."""
    monkeypatch.setattr(O, "CHUNK", 50)
    data, marks = rows(600, seed=3), [151, 152, 400, 580]
    data = [(r, s, c, x if r % 41 else [v * 60 for v in x]) for r, s, c, x in data]
    models, normal, waiting = {0: Plain(), 1: Plain()}, {0: [], 1: []}, []
    flags, confirmed = {}, {}
    for row, source, cats, x in data:
        for m in [m for m in marks if m == row]:  # a marker comes before the row of its own place
            merged, bound = models[0] + models[1], mean_bound(normal[0])
            for r, c, y in waiting:
                if (score := merged.score(c, y, keep=False)) > bound:
                    confirmed[r] = (m, score, bound)
            waiting = []
        score = models[source].score(cats, x)
        flags[row] = (score, mean_bound(normal[source]), score > mean_bound(normal[source]))
        if flags[row][2]:
            waiting.append((row, cats, x))
        else:
            normal[source] = [*normal[source], score][-40:]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    scores = O.anomaly_score(O.violation_scores(df, 4, by="source")).join(df.select("row", "source"), "row")
    local = O.flag_outliers(scores)
    got = {r.row: (r.score, r.bound, r.outlier) for r in local.collect()}
    assert got.keys() == flags.keys() and all(np.allclose(got[k], flags[k]) for k in flags)
    out = O.confirm_outliers(local, df, spark.createDataFrame([(m,) for m in marks], "ts long"), 4).collect()
    assert confirmed and {r.row for r in out} == confirmed.keys()
    assert all(np.allclose((r.marker, r.score, r.bound), confirmed[r.row]) for r in out)


def test_merged_moments_are_the_whole(spark):
    df = spark.createDataFrame(rows(200), SCHEMA)
    whole = {tuple(r.itemset): r for r in O.itemset_moments(df, 4).collect()}
    parts = O.merge_moments(*[O.itemset_moments(df.filter(f"source = {s}"), 4) for s in (0, 1)])
    for r in parts.collect():
        w = whole[tuple(r.itemset)]
        assert r.n == w.n and np.allclose(r.l, w.l) and np.allclose(r.s, w.s)
    c = {tuple(r.itemset): r.c for r in O.itemset_covariance(O.itemset_moments(df, 4), textbook=True).collect()}
    x = np.array([r[3] for r in rows(200) if "tcp" in r[2]])
    assert np.allclose(c[("tcp",)], np.cov(x.T).ravel())


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_flags_of_chunks_are_those_of_one_scan(spark, chunk):
    """Sources of several kinds: usual scores, only high ones (all outliers), none, jumps that wrong guesses get wrong."""
    rng = np.random.default_rng(chunk)
    makers = {"usual": lambda i: rng.random() * (1 + 30 * (rng.random() < 0.02)), "high": lambda i: 5.0, "zero": lambda i: 0.0, "jumps": lambda i: float(20 ** (i // 60 % 3)), None: lambda i: float(i % 3)}
    data = [(s, i, make(i)) for s, make in makers.items() for i in range(300 if chunk < 7 else 400)]
    want = {}
    for s in makers:
        normal = []
        for _, i, score in (d for d in data if d[0] == s):
            bound = mean_bound(normal[-40:])
            want[(s, i)] = (bound, score > bound)
            normal = normal if score > bound else [*normal, score]
    df = spark.createDataFrame(data if chunk > 1 else [d for d in data if d[0] in ("usual", None) and d[1] < 12], "source string, row long, score double")
    got = {(r.source, r.row): (r.bound, r.outlier) for r in O.flag_outliers(df.repartition(3), chunk=chunk).collect()}
    assert len(got) == df.count() and all(np.allclose(got[k], want[k]) for k in got)
    assert O.flag_outliers(df.limit(0), chunk=chunk).count() == 0
