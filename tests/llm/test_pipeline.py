import corpus_pipeline
import sentencepiece
from tests.conftest import SF
from tests.llm.test_decontamination import planted
from tests.llm.test_jaccard_join import brute
from tests.llm.test_secret_scan import PLANTED
from tidemark.llm.common import written
from tidemark.llm.queries import tokenizer_path


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "t")
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = [d for d in source if labels.get(d) == 1]
    assert sum(d in kept[0] for d in good) > 0.97 * len(good)
    groups = {d: c for d, _, c in brute([(d, r.text) for d, r in kept[0].items()], 5, 80)}
    assert set(kept[1]) == {d for d, c in groups.items() if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in planted([(d, r.text) for d, r in kept[1].items()], items)}
    gone = set(kept[1]) - set(kept[2])
    assert leaks and leaks <= gone and len(gone) <= 2 * len(leaks)
    assert set(kept[3]) == set(kept[2])
    assert all(kept[3][d].text == PLANTED.sub(r"\1<secret>", r.text) for d, r in kept[2].items())
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        assert r.n_tokens == len(library.encode(kept[3][r.doc_id].text)) + 2


def test_unlike_texts_of_one_id(spark):
    """A leak, a copy and a clean text under one doc_id: each is judged by itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = docs.filter("doc_id is null").unionByName(
        spark.createDataFrame([(1, clean[0]), (5, clean[0]), (5, clean[1]), (5, item), (7, clean[2])], "doc_id long, text string"),
        allowMissingColumns=True,
    )
    left = corpus_pipeline.near_duplicates(spark, rows, SF)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, clean[0]), (5, clean[1]), (5, item), (7, clean[2])])
    left = corpus_pipeline.decontaminate(spark, left, SF)
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, clean[0]), (5, clean[1]), (7, clean[2])} and left.columns == docs.columns


def test_hard_rows(spark, hard_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (hard_docs.select(*columns, "score", "spans"), no_docs.select(*columns)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SF), "t")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
