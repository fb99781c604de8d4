import re
from collections import Counter

from tests.conftest import SF
from tidemark.llm import quality_rules as R

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(windows)
    covered = {j for i, x in enumerate(windows) if many[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    dup = len(lines) - len(set(lines))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def check(df):
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(brute(r.text))
    got = {}
    for r in R.judged(df).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:7])
        assert not (r.kept and r.base_failed)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_hard_rows(hard_docs, no_docs):
    check(hard_docs)
    check(no_docs)


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = R.judged(docs).join(labels, "doc_id").filter("quality = 1 and not base_failed").collect()
    assert len(rows) > 200 and sum(r.kept for r in rows) > 0.99 * len(rows)


def test_no_python_and_no_shuffle(spark):
    plan = R.judged(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_table_of_thresholds(spark):
    docs = spark.createDataFrame([(1, "word " * 30), (2, "### " * 30)], "doc_id long, text string")
    rules = [R.Rule("symbols", "symbols_per_word", None, 1.0)]
    got = {r.doc_id: r.broken for r in R.apply_rules(docs, rules).collect()}
    assert got == {1: [], 2: ["symbols"]} and R.apply_rules(docs, []).count() == 2


def test_shares_of_stop_words_and_capitals(spark):
    plain = [f"word{i}" for i in range(100)]
    texts = {
        1: ["de", *plain],  # one stop word in 101
        2: ["THE", "of,", "And.", *plain],  # stop words in capitals and before marks
        3: ["the", "of", "and"] + [f"WORD{i}" for i in range(3)] + ["lowercaseletters"] * 2,
        4: ["the"] * 10 + ["NO"] * 11,
    }
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    rules = [r for r in R.RULES if r.name in ("stop_words", "capitals")]
    got = {r.doc_id: r for r in R.apply_rules(docs, rules).collect()}
    assert {d: r.broken for d, r in got.items()} == {1: ["stop_words"], 2: [], 3: [], 4: ["capitals"]}
    assert (got[2].n_stop, got[2].n_capital, got[3].n_capital, got[4].n_capital) == (3, 1, 3, 11)


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(R.ORACLE).fetchall()
    assert sorted(tuple(r) for r in R.judged(spark.read.parquet(f"{SF}/documents.parquet")).collect()) == sorted(want)
