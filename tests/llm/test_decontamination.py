import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF, SMALL
from tidemark.llm import decontamination as D
from tidemark.llm import text as T
from tidemark.llm.common import trimmed


def slow_tiles(a, b, least):
    """Greedy string tiling by dynamic programming, one longest match at a time, leftmost in b, then in a."""
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        run = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for j in range(len(b) - 1, -1, -1):
            for i in range(len(a) - 1, -1, -1):
                if a[i] == b[j] and free_a[i] and free_b[j]:
                    run[j][i] = run[j + 1][i + 1] + 1
        for j in range(len(b)):
            for i in range(len(a)):
                if run[j][i] > best[0]:
                    best = (run[j][i], j, i)
        n, j, i = best
        if n < least:
            return total
        total += n
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n


def test_tiles_cover_as_much_as_the_plain_algorithm():
    rng = random.Random(3)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        doc = [rng.randrange(6) for _ in range(rng.randint(0, 20))]
        if len(item) > 12:
            cut = rng.randrange(len(item))
            doc += item[cut:] + [rng.randrange(6)] + item[:cut]
        a, b = (np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (doc, item))
        tiles = D.tile(a, b, 4)
        assert sum(t[2] for t in tiles) == slow_tiles(doc, item, 4)
        used_d = [x for s, _, n in tiles for x in range(s, s + n)]
        used_i = [x for _, s, n in tiles for x in range(s, s + n)]
        assert len(set(used_d)) == len(used_d) and len(set(used_i)) == len(used_i)
        assert all(doc[s : s + n] == item[t : t + n] for s, t, n in tiles)


def test_equal_hashes_of_unlike_words_are_no_tile(monkeypatch):
    """Every window hashes alike here: only words that agree may be marked, and the search must end."""
    monkeypatch.setattr(D.T, "mix", lambda h, salt=0: np.zeros_like(h))
    item, doc = np.arange(1, 13, dtype=np.uint64), np.arange(101, 121, dtype=np.uint64)
    assert D.tile(doc, item, 4) == []
    doc[3:9] = item[2:8]
    assert all((doc[a : a + n] == item[b : b + n]).all() for a, b, n in D.tile(doc, item, 4))


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_pairs_against_brute_force(spark, monkeypatch, limit):
    """Pairs and coverages of whole tables, tiled by dynamic programming."""
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    seeds = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted, want = [(r.item_id, low(r.text)) for r in items.collect()], {}
    for r in docs.collect():
        words = low(r.text)
        own = seeds(words)
        for i, item in wanted:
            if own & seeds(item) and (total := slow_tiles(words, item, 5)) >= 0.5 * len(item):
                want[r.doc_id, i] = total / len(item)
    got = {(r.doc_id, r.item_id): r.coverage for r in D.contaminated(docs, items).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def planted(rows, items):
    low = [(i, t.lower()) for i, t in items]
    return {(d, i) for d, text in rows for i, t in low if t in (text or "").lower()}


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = D.contaminated(docs, items).collect()
    want = planted([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and want <= {(r.doc_id, r.item_id) for r in got}
    assert all(r.coverage >= 0.5 for r in got) and len(got) < len(want) * 2


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_reordered_and_hard_rows(spark, monkeypatch, hard_docs, no_docs, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    words = [f"w{i}" for i in range(30)]
    moved = " ".join(words[20:] + ["x"] + words[10:20] + ["y"] + words[:10])
    docs = hard_docs.select("doc_id", "text").union(spark.createDataFrame([(77, moved), (None, moved)], "a long, b string"))
    items = spark.createDataFrame(
        [(1, " ".join(words)), (2, None), (3, ""), (4, "too short"), (1, " ".join(words))], "item_id long, text string"
    )
    got = [(r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in D.contaminated(docs, items).collect()]
    assert {g for g in got if g[0] in (77, None)} >= {(77, 1, 3, 1.0), (None, 1, 3, 1.0)}
    assert D.contaminated(no_docs, items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0


def test_a_task_keeps_no_powers():
    """Workers stay for later stages; the powers of a long text's hashes go with its task."""

    def run(batches):
        for batch in batches:
            T.words(batch.column("text"))
            assert T._powers
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 100_000])], ["text"])
    assert len(list(trimmed(run)(iter([batch])))) == 1 and not T._powers
