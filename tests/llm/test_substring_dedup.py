import hashlib
import re

from tidemark.llm.substring_dedup import remove_repeated_windows
from tests.conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    first = {}
    split = [(d, WORDS.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    rows = df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted([tuple(r) for r in rows], key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = result(remove_repeated_windows(docs, 50))
    assert got == brute(rows, 50)
    assert sum(r[2] for r in got) > 1000


def test_odd_length_and_hard_rows(hard_docs):
    rows = [(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()]
    for length in (7, 50):
        assert result(remove_repeated_windows(hard_docs, length)) == brute(rows, length)


def test_empty_table(no_docs):
    assert remove_repeated_windows(no_docs).count() == 0
