"""Token ids on disk, compressed document by document under one shared zstandard dictionary (operator 4).

A store is a folder. ``dictionary.zdict`` is trained on serialized id arrays of a bounded sample. Each shard
``part-NNNNNNN-NNNNN.tok`` holds one zstandard frame a document, in ascending doc_id order, then an index (doc ids, null
flags, token counts, frame offsets), then a footer with the dictionary's SHA-256; any document is read from its frame
alone. ``manifest`` is a table with the first document, documents and tokens of each shard. Texts of any length are
encoded whole into one frame.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .common import WORD, partitions, small_batches

MAGIC = b"TMTOK1\r\n"
#: Documents that the dictionary is trained on, at most, and its size in bytes.
DICTIONARY_SAMPLE, DICTIONARY_BYTES, SAMPLE_TEXT_BYTES = 1000, 64 << 10, 32 << 10
#: A task starts another shard when one has this many compressed bytes.
SHARD_BYTES = 32 << 20
#: Ids that a reading task holds decompressed at a time.
READ_TOKENS = 1 << 20
#: Words that a worker remembers before it starts anew.
REMEMBERED = 800_000


class WordTokenizer:
    """Encodes texts by their distinct words.

    Exact for tokenizers that fold case and whose pieces never cross white space or join letters with marks, but for
    contractions. Texts of Latin-1 characters are folded and cut into runs of letters and of other characters;
    what holds an apostrophe stays whole. Other texts, and those that may hold a special token, are cut into words.
    """

    # Fixed value: what the tokenizer takes for pieces.
    _pieces = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _word = re.compile(WORD)
    _letters, _gap = "a-zªµºß-öø-ÿ", r"\x20\x09-\x0D"
    _run = re.compile(f"[{_letters}]+|[^{_gap}{_letters}']++(?!')|[^{_gap}]+")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._check()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._forget()

    def _check(self) -> None:
        """Refuses a tokenizer whose settings are not those that the cutting relies on."""
        spec = json.loads(self.tokenizer.to_str())
        folds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [(p["type"], p.get("pattern", {}).get("Regex"), p.get("invert")) for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if folds != ["NFC", "Replace", "Lowercase"] or cuts[:1] != [("Split", self._pieces, True)] or spec["model"].get("dropout"):
            raise ValueError("this tokenizer may join what the store cuts apart")

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.ids, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        new = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self.code.update(zip(words, range(len(self.length), len(self.length) + len(new)), strict=True))
        self.length = np.concatenate([self.length, np.array([len(x) for x in new], np.int64)])
        self.ids = np.concatenate([self.ids, np.array([i for x in new for i in x], np.int64)])

    def _cut(self, text: str) -> list[str]:
        if "<|" in text:
            return self._word.findall(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._word.findall(text)
        return self._run.findall(text.lower())

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, ``end`` after each, and where each text's begin; null counts as empty."""
        split = [self._cut(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.code)
        if new and len(self.code) + len(new) > REMEMBERED:
            self._forget()
            new = set().union(*split)
        if new:
            self._learn(list(new))
        code = self.code
        codes = np.array([code[w] for s in split for w in s], np.int64)
        size = self.length[codes]
        words_before = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])[words_before] + np.arange(len(texts) + 1)
        out = np.full(first[-1], end, np.int64)
        inner = np.ones(len(out), bool)
        inner[first[1:] - 1] = False
        out[inner] = self.ids[T.ranges(np.concatenate([[0], np.cumsum(self.length)])[codes], size)]
        return out, first


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _open(folder: str):
    """Filesystem and path of a folder's address, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(folder: str, name: str, data: bytes, attempt: str) -> None:
    """Writes a file whole or not at all; another attempt at the same task writes the same bytes."""
    from pyarrow import fs

    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{attempt}"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{base}/{name}")
    store.move(temporary, f"{base}/{name}")


def pack(frames: list[bytes], doc_ids: list[int | None], counts: list[int], width: int, dictionary: bytes) -> bytes:
    """One shard's bytes."""
    n = len(frames)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8") + len(MAGIC)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    index = ids.tobytes() + null.tobytes() + np.array(counts, "<u4").tobytes() + offsets.tobytes()
    footer = {"documents": n, "width": width, "index": int(offsets[-1]), "dictionary": hashlib.sha256(dictionary).hexdigest()}
    foot = json.dumps(footer).encode()
    return b"".join([MAGIC, *frames, index, foot, struct.pack("<I", len(foot)), MAGIC])


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token shard")
        at = len(data) - len(MAGIC) - 4
        size = struct.unpack_from("<I", data, at)[0]
        foot = json.loads(data[at - size : at])
        if foot["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the shard was written with another dictionary")
        n, at = foot["documents"], foot["index"]
        self.data, self.width = data, foot["width"]
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 13 * n).astype(np.int64)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.reader = zstandard.ZstdDecompressor(dict_data=known)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document, from its own frame."""
        raw = self.reader.decompress(self.data[self.offsets[i] : self.offsets[i + 1]], max_output_size=1 << 31)
        ids = np.frombuffer(raw, f"<u{self.width}")
        if len(ids) != self.counts[i]:
            raise ValueError("a document's length differs from the index")
        return ids


def train_dictionary(docs: DataFrame, tokenizer_path: str, end: int) -> bytes:
    """A zstandard dictionary from serialized ids of at most DICTIONARY_SAMPLE documents, chosen by a hash of doc_id from
    those whose texts have at most SAMPLE_TEXT_BYTES (short documents are what it is for); empty where the sample is too
    small to train on."""
    import zstandard

    docs = small_batches(docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES))
    total = max(1, docs.count())
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    some = docs.filter(pick <= 1_000_003 * min(1.0, 1.5 * DICTIONARY_SAMPLE / total)).orderBy(pick, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_tokenizer(tokenizer_path)
        for batch in batches:
            for part in T.slices(batch, "text", 4 << 20):
                ids, first = t.encode(part.column("text").to_pylist(), end)
                raw = [ids[a:b].astype(f"<u{t.width}").tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])

    rows = some.limit(DICTIONARY_SAMPLE).select("text").mapInArrow(run, "raw binary").collect()
    samples = [bytes(r.raw) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end: int) -> None:
    """Tokenises whole texts and writes a store into ``folder``, an address that every executor reaches.

    Null text is an empty text (its ids are ``end`` alone); null doc_ids come first and stay null; repeated rows are
    stored as often as they come; other columns are dropped; an empty table makes a store without documents.
    """
    import zstandard

    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, tokenizer_path, end)
    _put(folder, "dictionary.zdict", dictionary, "driver")
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        t = word_tokenizer(tokenizer_path)
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        press = zstandard.ZstdCompressor(level=3, dict_data=known)
        frames, doc_ids, counts, size, made = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{task.partitionId():07d}-{made:05d}.tok"
            _put(folder, name, pack(frames, doc_ids, counts, t.width, shared.value), str(task.taskAttemptId()))
            return pa.RecordBatch.from_pydict(
                {"shard": [name], "first_doc": pa.array(doc_ids[:1], pa.int64()), "documents": [len(frames)], "tokens": [sum(counts)]}
            )

        for batch in batches:
            for part in T.slices(batch, "text", 4 << 20):
                ids, first = t.encode(part.column("text").to_pylist(), end)
                packed = ids.astype(f"<u{t.width}").tobytes()
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist(), strict=False):
                    frames.append(press.compress(packed[t.width * a : t.width * b]))
                    doc_ids.append(doc_id)
                    counts.append(b - a)
                    size += len(frames[-1])
                if size >= SHARD_BYTES:
                    yield close()
                    frames, doc_ids, counts, size, made = [], [], [], 0, made + 1
        if frames:
            yield close()

    # rows of one doc_id have an order too, so that every attempt at a task writes the same bytes
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = docs.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)
    done = ordered.mapInArrow(run, "shard string, first_doc long, documents long, tokens long")
    done.write.parquet(f"{folder}/manifest")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start the ids before them."""
    store, base = _open(folder)
    with store.open_input_stream(f"{base}/dictionary.zdict") as f:
        dictionary = f.read()
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(data.as_py(), shared.value)
                before = np.concatenate([[0], np.cumsum(shard.counts)])
                at = 0
                while at < len(shard.counts):  # READ_TOKENS at a time, one document at least
                    to = max(at + 1, int(np.searchsorted(before, before[at] + READ_TOKENS, "right")) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * (to - at), pa.string()),
                            pa.array(shard.doc_ids[at:to], pa.int64(), mask=shard.null[at:to]),
                            pa.array(before[at:to]),
                            pa.array(shard.counts[at:to]),
                            pa.array([shard.ids(i).astype("<u4").tobytes() for i in range(at, to)], pa.binary()),
                        ],
                        ["shard", "doc_id", "inner", "n_tokens", "ids"],
                    )
                    at = to

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", "part-*.tok").load(folder)
    content = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    rows = content.mapInArrow(run, "shard string, doc_id long, inner long, n_tokens long, ids binary")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    starts = spark.read.parquet(f"{folder}/manifest").select(
        "shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before")
    )
    return rows.join(starts, "shard").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids")
