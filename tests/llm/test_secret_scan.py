import re

import pytest

from tests.conftest import SF
from tidemark.llm import secret_scan as S

PLANTED = re.compile(r'(?i)(token = ")([0-9a-f]{40})(?=")')


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return S.fitted(docs)


def test_planted_secrets_and_nothing_else(docs, model):
    got = {(r.doc_id, r.finding) for r in S.findings(docs, model).collect()}
    want = {(r.doc_id, m[1]) for r in docs.collect() for m in PLANTED.findall(r.text or "")}
    assert want and got == want
    assert S.candidates(docs).count() > 3 * len(want)


def test_false_positives_go(spark, model):
    rows = [
        (1, 'set password = "9fGh27LKq0zPx81VbTnR55Ws" now'),
        (2, "see commit 0f3a9c7be2d14588a1b0c9d8e7f60514233a9bcd for more words"),
        (3, "an unbelievablyinterconnectedthing of the world that is there"),
        (4, "read https://www.example.com/the/other/page/about/words today please"),
    ]
    got = {r.doc_id for r in S.findings(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1}


def test_redaction(docs, model):
    out = {r.doc_id: r for r in S.redacted(docs, model).collect()}
    assert len(out) == docs.count()
    for r in docs.collect():
        text = PLANTED.sub(r"\1<secret>", r.text or "")
        assert out[r.doc_id].text == text
        assert out[r.doc_id].n_chars == (len(text) if text != r.text else r.n_chars)


def test_held_out_findings_by_kind(spark, docs):
    """Trained on three quarters of the labelled findings, judged on the rest: every kind on its own."""
    words = S.dictionary(docs)
    labelled = S.labelled_findings(spark, words)
    held = "crc32(cast(doc_id as string)) % 4 = 0"
    model = S.fit(labelled.filter(f"not {held}"), words)
    best = S.scored(labelled.filter(held), model).groupBy("doc_id").agg({"score": "max"}).toDF("doc_id", "score")
    rows = best.join(labelled, "doc_id").select("kind", "label", "score").collect()
    for kind, label in {(r.kind, r.label) for r in rows}:
        right = [(r.score >= S.ACCEPT) == (label == 1) for r in rows if (r.kind, r.label) == (kind, label)]
        assert sum(right) >= 0.9 * len(right), (kind, label)
    assert sum((r.score >= S.ACCEPT) == (r.label == 1) for r in rows) >= 0.98 * len(rows)


def test_findings_written_by_others(spark, model):
    """Fifteen plain findings that the labelled ones were not made for."""
    hexa = "9c1f0be27d5a8436e1f70a2bc94d6835b7e02f9a6c13d84e50a7f3b92d6c81e4"
    base = "pX3qk9TzLr0WvB7nYc2HsM5dJf8GaEuKi1OeQx4RmZ6tUyVbNwSlCgDhAoPjF7k2Q9sL1xWcZr"
    rows = [
        (0, f'<script src="/lib/main.js" integrity="sha512-{base}==" crossorigin>', 0),
        (1, f"ssh-rsa AAAAB3NzaC1yc2EAAAADAQABAAABgQ{base} someone@laptop", 0),
        (2, f"background: url(data:image/png;base64,iVBORw0KGgoAAAANSUhEUg{base}==)", 0),
        (3, f"github.example.com/pkg/errors v0.9.1 h1:{base[:43]}=", 0),
        (4, f"see https://docs.example.org/document/d/{base[:44]}/edit for notes", 0),
        (5, f'public_key: "{base[:44]}"', 0),
        (6, f"commit {hexa[:40]} fixes the build", 0),
        (7, f"sha256: {hexa}", 0),
        (8, f'hmac: "{hexa}"', 1),
        (9, f"DATABASE_URL=postgres://user:{hexa[:32]}@db.example.net:5432/main", 1),
        (10, f'TWILIO_SID_PAIR = "{hexa[:32]}"', 1),
        (11, f'client_secret = "{base[:40]}"', 1),
        (12, f"Authorization: Bearer {base[:60]}", 1),
        (13, f"export STRIPE_SECRET_KEY={base[:32]}", 1),
        (14, f'"password": "{base[:22]}"', 1),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id for r in S.findings(docs, model).collect()}
    wrong = [d for d, _, label in rows if (d in got) != bool(label)]
    assert len(wrong) <= 2, wrong


def test_held_out_names_and_places(spark, docs):
    """Trained without a third of the names and places, judged on those alone."""
    words = S.dictionary(docs)
    labelled = S.labelled_findings(spark, words)
    held = "crc32(place) % 3 = 0 AND place <> 'alone'"
    model = S.fit(labelled.filter(f"not ({held})"), words)
    best = S.scored(labelled.filter(held), model).groupBy("doc_id").agg({"score": "max"}).toDF("doc_id", "score")
    rows = best.join(labelled, "doc_id").select("kind", "label", "score").collect()
    right = [(r.score >= S.ACCEPT) == (r.label == 1) for r in rows]
    print("held-out names and places", len(rows), sum(right) / len(right))
    assert len(rows) > 1000 and sum(right) >= 0.85 * len(right)


def test_dictionary(spark, docs):
    words = S.dictionary(docs)
    assert 0 < len(words) <= 1 / S.DICTIONARY_SHARE
    counts = {}
    for r in docs.collect():
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    assert {w for w in words if w.isascii()} == {
        w for w, n in counts.items() if n >= total * S.DICTIONARY_SHARE and 3 <= len(w) <= 12 and w.isascii()
    }


def test_hard_rows(spark, hard_docs, no_docs, model):
    assert S.redacted(hard_docs, model).count() == hard_docs.count()
    assert S.redacted(hard_docs, model).columns == hard_docs.columns
    assert S.findings(no_docs, model).count() == 0 and S.redacted(no_docs, S.fitted(no_docs)).count() == 0
    one_sided = S.labelled_findings(spark, []).filter("label = 1")
    assert S.fit(one_sided, []) is None
    assert S.findings(hard_docs, None).filter("score is not null").count() == 0
    key = "3f9a0c7be2d14588a1b0c9d8e7f60514233a9bcd"
    clash = spark.createDataFrame([(1, f"token = {key}", 5, "k", 7)] * 2, "doc_id int, text string, length int, _key string, found int")
    out = S.redacted(clash, model)
    assert out.columns == clash.columns and out.distinct().collect() == [(1, "token = <secret>", 5, "k", 7)] and out.count() == 2


def test_native(docs, model):
    plan = S.redacted(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_run_of_a_word(spark, model):
    key = ["3f9a0c7be2d14588a1b0c9d8e7f60514233a9bcd", "b7d20e41c9f85a36d1e7304ab82c6f95e0d4713a", "91c4e8a7f02b6d35c8e91f47a0b3d26e5c7f814b"]
    rows = [
        (1, '{"service":"billing-service-production","api_key":"%s"}' % key[0]),
        (2, "see https://host.example.com/long/path?token=%s now" % key[1]),
        (3, '{"user":"somebody-of-the-house","service_account_private_token":"%s","again_api_key":"%s"}' % (key[2], key[0])),
        (4, "read,https://www.example.com/the/other/page;https://www.example.com/about/words/today please"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = {(r.doc_id, r.finding) for r in S.candidates(docs).collect()}
    assert runs == {(d, f) for d, t in rows for f in re.findall(S.RUN, t)}
    found = {(r.doc_id, r.finding[-40:]) for r in S.findings(docs, model).collect()}
    assert found == {(1, key[0]), (2, key[1]), (3, key[2]), (3, key[0])}
    left = {r.doc_id: r.text for r in S.redacted(docs, model).collect()}
    assert not any(k in t for k in key for t in left.values()) and left[4] == rows[3][1]
