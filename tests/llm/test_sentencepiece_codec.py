import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import sentencepiece

from tests.conftest import SMALL
from tidemark.llm.sentencepiece_codec import Codec, _coded, codec, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(texts):
    codec = Codec(PATH)
    ids, first = codec.encode(texts)
    for i, text in enumerate(texts):
        want = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        got = ids[first[i] : first[i + 1]].tolist()
        assert got == want, repr(text)[:200]
        assert codec.decode(got) == LIBRARY.decode(want), repr(text)[:200]


def test_random_texts_equal_the_library():
    rng = random.Random(2)
    bits = ["a", "b", "e", "t", "h", "n", "in", "er", " ", "  ", "\n", "▁", ".", ",", "0", "9", "é", "日", "😀", "\t"]
    bits += ["\x00", "aaaa", "ing", "the", "'s", "%", "́", "<s>", "</s>", "<0x0A>", "　"]
    check(["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(5000)])


def test_repetitions_and_long_words():
    check([None, "", " ", "a" * 3000, "ab" * 2000, " " * 500, "\n" * 300, "thethe" * 1000, "x" * 30000])


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check([r.text for r in docs.select("text").collect()])
    rows = encode_decode(docs, PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    assert all(r.decoded == texts[r.doc_id].replace("▁", " ") for r in rows)
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)


def test_a_worker_keeps_no_words(spark):
    """Workers stay for later stages; what a task has learned goes with it."""
    encode_decode(spark.read.parquet(f"{SMALL}/documents.parquet"), PATH).collect()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(codec(PATH).code)] * batch.num_rows)], ["n"])

    assert {r.n for r in spark.range(64, numPartitions=16).mapInArrow(held, "n long").collect()} == {0}


def test_memory_of_a_task():
    """2 MB of words that nobody met took 252 MB when they were encoded at once."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(200)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])
    codec(PATH)
    tracemalloc.start()
    try:
        found = list(_coded(PATH)[0](iter([batch])))
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most < 100 << 20 and held < 4 << 20
    assert [x for b in found for x in b.column("decoded").to_pylist()] == texts
    want = [len(x) + 2 for x in LIBRARY.encode(texts)]
    assert [x for b in found for x in b.column("n_tokens").to_pylist()] == want


def test_plain_and_marked_spaces_are_one():
    check(["a b", "a▁b", "▁ ▁a", " ▁", "日本 語▁ é", "a ▁\n▁ b", "ab.▁cd ef, gh"])


def test_hard_rows(hard_docs, no_docs):
    rows = encode_decode(hard_docs, PATH).collect()
    assert len(rows) == hard_docs.count()
    assert sorted(r.n_tokens for r in rows)[:4] == [2, 2, 2, 2]
    assert encode_decode(no_docs, PATH).count() == 0
