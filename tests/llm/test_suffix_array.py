import re

from tests.conftest import SF
from tidemark.llm.suffix_array import repeated_passages

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """Word positions of each document below windows that another document has."""
    owners, split = {}, [(d, WORDS.findall(t or "")) for d, t in rows if d is not None]
    for d, w in split:
        for i in range(len(w) - length + 1):
            owners.setdefault(tuple(w[i : i + length]), set()).add(d)
    out = {}
    for d, w in split:
        for i in range(len(w) - length + 1):
            if len(owners[tuple(w[i : i + length])]) > 1:
                out.setdefault(d, set()).update(range(i, i + length))
    return out


def covered(df, rows):
    """Word positions of each document below its passages; every window of a passage must occur in its partner."""
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(WORDS.findall(t or ""))
    known, out = {}, {}
    for r in df.collect():
        assert r.end_word - r.start_word == r.n_words >= 50 and r.other_doc_id != r.doc_id
        if r.other_doc_id not in known:
            known[r.other_doc_id] = {hash(tuple(w[i : i + 50])) for w in texts[r.other_doc_id] for i in range(len(w) - 49)}
        starts = range(r.start_word, r.end_word - 49)
        assert any(len(w) >= r.end_word and all(hash(tuple(w[i : i + 50])) in known[r.other_doc_id] for i in starts) for w in texts[r.doc_id])
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 50)
    got = covered(repeated_passages(docs, 50), rows)
    assert len(want) > 50 and got == want


def test_planted_passages(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(d, " ".join([f"a{d}_{i}" for i in range(d * 3)] + passage + [f"b{d}_{i}" for i in range(90 - d)])) for d in range(30)]
    rows += [(100, " ".join(passage[:49])), (101, " ".join(passage[5:56] + ["z"] * 10))]
    got = covered(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50), rows)
    assert got == brute(rows, 50)


def test_hard_rows(hard_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in hard_docs.select("doc_id", "text").collect()]
    assert covered(repeated_passages(hard_docs, 50), rows) == brute(rows, 50)
    assert repeated_passages(no_docs, 50).count() == 0


def test_passage_many_times_in_one_document(spark):
    passage = [f"p{i}" for i in range(55)]
    for times in (4, 10, 20, 50):
        many = [w for k in range(times) for w in [f"x{k}_{i}" for i in range(40)] + passage]
        rows = [(1, " ".join([*many, *[f"e{i}" for i in range(40)]])), (2, " ".join(["a"] * 40 + passage + ["b"] * 40))]
        got = covered(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50), rows)
        assert got == brute(rows, 50)


def test_slices_of_one_text(spark):
    source = [f"s{i}" for i in range(400)]
    rows = [(d, " ".join([f"a{d}_{i}" for i in range(40)] + source[d : d + 50 + d % 7] + [f"b{d}_{i}" for i in range(40)])) for d in range(300)]
    got = covered(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50), rows)
    assert got == brute(rows, 50)


def test_large_documents(spark):
    docs = spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.1/documents.parquet")
    owner, want = {}, {}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    split = [(d, WORDS.findall(t or "")) for d, t in rows]
    hashed = lambda w: (hash(tuple(w[i : i + 50])) for i in range(len(w) - 49))
    for d, w in split:
        for h in hashed(w):
            owner[h] = d if owner.get(h, d) == d else None
    for d, w in split:
        for i, h in enumerate(hashed(w)):
            if owner[h] is None:
                want.setdefault(d, set()).update(range(i, i + 50))
    assert covered(repeated_passages(docs, 50), rows) == want


def test_partners_between_two_that_match(spark):
    """Pairs that share one passage, whose gram others have too with one word less than a window on either side."""
    rows, d = [], 0
    for pair in range(10):
        p = [f"q{pair}_{i}" for i in range(50)]
        for _ in range(2):
            rows.append((d, " ".join([f"l{d}_{i}" for i in range(60)] + p + [f"r{d}_{i}" for i in range(60)])))
            d += 1
        for cut in (1, 2, 3, 4):
            for part in (p[cut:], p[:-cut]):
                rows.append((d, " ".join([f"l{d}_{i}" for i in range(60)] + part + [f"r{d}_{i}" for i in range(60)])))
                d += 1
    got = covered(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50), rows)
    want = brute(rows, 50)
    assert len(want) == 20 and got == want


def test_partners_stay_apart(spark):
    words = [f"w{i}" for i in range(95)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50])), (3, " ".join(words[-50:])), (4, " ".join([*words[:60], "x", *words[20:95]]))]
    df = repeated_passages(spark.createDataFrame(rows[:3], "doc_id long, text string"), 50)
    got = {(r.doc_id, r.start_word, r.end_word, r.other_doc_id) for r in df.collect()}
    assert got == {(1, 0, 50, 2), (1, 45, 95, 3), (2, 0, 50, 1), (3, 0, 50, 1)}
    assert covered(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50), rows) == brute(rows, 50)
