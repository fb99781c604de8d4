import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidemark.llm import token_store as S
from tidemark.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def want(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def stored(spark, docs, folder):
    S.write_store(docs, folder, PATH, 2)
    rows = S.read_store(spark, folder).collect()
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows]
    return sorted(got, key=lambda r: r[1])


@pytest.mark.parametrize("shard", [32 << 20, 3000])
def test_round_trip(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert stored(spark, docs, shared_dir(spark, "t")) == want(rows)


def test_hard_rows(spark, hard_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in hard_docs.collect()]
    got, expected = stored(spark, hard_docs, shared_dir(spark, "t")), want(rows)
    assert sorted((r[0] or -1, r[2:]) for r in got) == sorted((r[0] or -1, r[2:]) for r in expected)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    assert stored(spark, no_docs, shared_dir(spark, "t")) == []


def test_word_by_word_equals_whole_texts():
    texts = ["It's o'clock, they're HERE.%%% x.92@mail <|endoftext|> <|endoftext|>a", "é,́ ΑΣ ΑΣ. İstanbul ﬁ, a.b a...b"]
    texts += ["naïve, ÀÉ! Σας; 12,5% a'b's 's", "x\x00y  z \xa0q"]
    texts += ["don't 'tis rock'n'roll ''s .'s a.'b x' 'x5'll 12's ª'º µ5ß ÿ'd ×÷ é×é 5%'re o'RE", "a\xa0b'\x85c\xadd ¿qué? «x»'s"]
    rng = random.Random(4)
    bits = ["a", "É", "ß", "'", "'s", "'LL", ".", "5", " ", "%", "µ", "×", "\xa0", "\n", "´", "the", "Z", "-"]
    texts += ["".join(rng.choice(bits) for _ in range(30)) for _ in range(3000)]
    ids, first = S.WordTokenizer(PATH).encode(texts, 2)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == [*LIBRARY.encode(t, add_special_tokens=False).ids, 2], t


def test_single_document_access_and_wrong_dictionary(spark):
    import zstandard

    arrays = [np.arange(i, i + 50, dtype="<u2") for i in range(200)]
    dictionary = zstandard.train_dictionary(1024, [a.tobytes() for a in arrays]).as_bytes()
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data = S.pack([press.compress(a.tobytes()) for a in arrays], list(range(200)), [50] * 200, 2, dictionary)
    assert S.Shard(data, dictionary).ids(137).tolist() == arrays[137].tolist()
    with pytest.raises(ValueError):
        S.Shard(data, b"")
