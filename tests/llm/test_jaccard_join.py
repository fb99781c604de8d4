import random
import re

import pytest

from tests.conftest import SF
from tidemark.llm.common import Scratch
from tidemark.llm.graph import components
from tidemark.llm.jaccard_join import deduplicated, near_duplicates

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    def shingle(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = WORDS.findall(text)
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))

    sets = [(d, shingle(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    live = sorted([(len(s), d, s) for d, s in sets if s and d is not None], key=lambda x: x[:2])
    for i, (n, d, s) in enumerate(live):
        for m, e, t in live[i + 1 :]:
            if 100 * n < percent * m:
                break
            common = len(s & t)
            if 100 * common >= percent * (n + m - common):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sorted([(d, len(s), None if d is None else find(d)) for d, s in sets], key=str)


def result(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == brute(rows, 3, 90)


@pytest.mark.parametrize("percent", [70, 90])
def test_chains_and_copies(spark, percent):
    """Families whose members drift, so that links form chains; sizes around every small band edge."""
    rng = random.Random(5)
    rows, i = [], 0
    for family in range(25):
        words = [f"f{family}w{rng.randrange(200)}" for _ in range(rng.choice([2, 3, 11, 12, 14, 22, 60, 300]))]
        for _ in range(rng.choice([2, 8, 25])):
            rows.append((i, " ".join(words)))
            i += 1
            if rng.random() < 0.8 and len(words) > 2:
                words = list(words)
                words[rng.choice([0, len(words) - 1, rng.randrange(len(words))])] = f"x{rng.randrange(10**6)}"
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df, 3, percent)) == brute(rows, 3, percent)


def test_hard_rows(hard_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()]
    rows = [r for r in rows if r != (3, "one")] + [(3, "one")] * 2
    assert result(near_duplicates(hard_docs)) == brute(rows, 3, 90)
    assert near_duplicates(no_docs).count() == 0


def test_deduplicated_rows(spark, hard_docs, no_docs):
    """Unlike texts of one doc_id do not stand for each other; repeated rows count once; rows without words stay."""
    base = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(reversed(base))
    rows = [(1, text), (5, text), (5, other), (5, other), (7, near), (7, near + " y"), (8, None), (8, None), (9, ""), (None, text)]
    rows += [(20, "rare words here"), (20, "rare words here"), (21, near + " z " + other)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, stays int")
    out = deduplicated(docs)
    assert out.columns == docs.columns
    want = [(1, text), (5, other), (8, None), (8, None), (9, ""), (None, text), (20, "rare words here"), (21, near + " z " + other)]
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted(want, key=str)
    assert deduplicated(hard_docs).columns == hard_docs.columns and deduplicated(no_docs).count() == 0


def test_far_pairs_are_not_given_their_shingles(spark, monkeypatch):
    """Texts of 1,600 words that share less than linked ones do are told apart by the wide sketches."""
    rng, rows = random.Random(3), []
    for i in range(12):
        words = [f"w{k}" for k in range(1600)]
        for k in range(40, 1600, 40 if i else 1700):  # some 60 % shared with the first, and 40 % among each other
            words[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    words[-1] = "near the last"
    rows.append((99, " ".join(words)))
    left_over, table = [], Scratch.table

    def counted(self, name, df, *more):
        out = table(self, name, df, *more)
        if name == "close":
            left_over.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df, 5, 80)) == brute(rows, 5, 80)
    assert sum(left_over) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert got == want
