import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF, SMALL
from tidemark.llm import periodic_runs as P
from tidemark.llm import queries
from tidemark.llm import text as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, periods=3):
    """(start, length, period) by looking at every period."""
    found, n = {}, len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def caught(texts, least=24, periods=3):
    doc, (period, first, end) = P.runs_of(T.words(pa.array(texts)), least, periods)
    out = [[] for _ in texts]
    for d, q, a, b in zip(doc.tolist(), period.tolist(), first.tolist(), end.tolist(), strict=True):
        out[d].append((a, b - a, q))
    return out


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def row(doc_id, text):
    words = planted(doc_id, WORDS.findall(text or ""))
    runs = brute(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab"), max_size=60), min_size=1, max_size=4))
def test_small_alphabets(lists):
    for least, periods in ((24, 3), (3, 3), (6, 4)):
        assert caught([" ".join(x) for x in lists], least, periods) == [brute(x, least, periods) for x in lists]


def test_runs_within_runs():
    r = random.Random(5)
    for _ in range(60):
        line = []
        for _ in range(r.randrange(1, 6)):
            unit = [str(r.randrange(3)) for _ in range(r.randrange(1, 40))]
            line += (unit * r.randrange(1, 8))[: r.randrange(1, 200)]
        line = (line * r.randrange(1, 5))[: r.randrange(1, 900)]
        assert caught([" ".join(line)]) == [brute(line)]


def test_cuts_change_nothing():
    r = random.Random(6)
    words = [str(r.randrange(2)) for _ in range(50)] * 4 + ["x"] * 90 + [str(i % 7) for i in range(100)] + ["end"]
    line = T.words(pa.array([" ".join(["begin", *words])])).hash
    whole = P.Catchers(200)
    squares = {tuple(s) for s in whole.append(line).T.tolist()}
    for size in (1, 7, 64):
        parts, told = P.Catchers(200), set()
        for i in range(0, len(line), size):
            new = {tuple(s) for s in parts.append(line[i : i + size]).T.tolist()}
            assert not new & told
            told |= new
        assert np.array_equal(parts.runs(), whole.runs()) and told == squares


def test_deceiving_hashes():
    """Words in the order of Thue and Morse, whose polynomial hashes modulo 2**64 collide."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 12)]
    line = [str(b) for b in bits] + [str(1 - b) for b in bits]
    assert caught([" ".join(line), "a b c"]) == [brute(line, 24, 3), []]
    long = [str(b) for b in bits] * 4 + [str(1 - b) for b in bits]
    found = caught([" ".join(long)])[0]
    assert (0, 4 << 12, 1 << 12) in found


def test_long_text():
    words = [f"w{i % 5003}" for i in range(60000)]
    assert caught([" ".join(words)]) == [[(0, 60000, 5003)]]
    assert caught([" ".join(["same"] * 60000)]) == [[(0, 60000, 1)]]


@pytest.mark.parametrize("folder", [SMALL, SF])
def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    docs = [d for d in docs if folder == SMALL or d.doc_id % 10 == 0]
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, folder).collect()}
    assert any(got[d.doc_id][1] for d in docs)
    for d in docs:
        assert got[d.doc_id] == row(d.doc_id, d.text)


def test_hard_rows(hard_docs, no_docs):
    want = []
    for d in hard_docs.collect():
        words = WORDS.findall(d.text or "")
        runs = brute(words)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        want.append((d.doc_id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in P.collapse_runs(hard_docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert P.collapse_runs(no_docs).count() == 0


def test_no_shuffle(spark):
    plan = queries.op11_periodic_runs(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
