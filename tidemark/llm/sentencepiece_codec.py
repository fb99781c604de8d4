"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 10).

The distinct words of a batch lie in flat numpy symbol arrays. Each round takes the smallest pair rank of every
word (segmented minimum), merges its leftmost occurrences at once and compacts the arrays, until no pair remains.
All occurrences in a word merge in one round only where no pair that arises on the way ranks before them;
otherwise the leftmost alone merges, as the library's priority queue would. Known words are kept in a bounded
table of each task. Texts of any length are encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import small_batches, trimmed

SPACE = "▁"
_CHAR = 1 << 20  # symbols of single characters outside the vocabulary: _CHAR + code point
_SHIFT = 22
_NONE = np.int64(1 << 40)
#: Words that a task remembers before it starts anew.
REMEMBERED = 400_000
#: Bytes of text that a task encodes at a time: a character that is not known yet takes some 100 bytes of working memory.
SLICE = 1 << 18


class Codec:
    """One model: vocabulary, pair ranks, and the words met so far."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            raw = f.read()
        model = pb.ModelProto.FromString(raw)
        norm, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are encoded here")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models with identity normalisation and a leading space are encoded here")
        library = SentencePieceProcessor(model_proto=raw)  # for ids alone; it goes with this call
        self.bos, self.eos = library.bos_id(), library.eos_id()
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.byte = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.joins = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        if any(not x.startswith(SPACE) and x.endswith(SPACE) for x in self.joins):
            raise ValueError("a piece holds a space after another character")
        alone = "\n" if not any("\n" in p for p in normal) else ""
        # words keep a plain space for SPACE: with it, strings of ASCII would take two bytes a character and more to begin with
        self.words = re.compile(f" *[^ {alone}]+| +|\n")
        self.stem = re.compile("( *[A-Za-zÀ-ÖØ-öø-ÿ]+)([^\\w ]+)")

        def symbol(s: str) -> int | None:
            return normal.get(s, _CHAR + ord(s) if len(s) == 1 else None)

        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << _SHIFT) | right] = (-model.pieces[i].score, i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()]).astype(np.int64)
        self.into = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.single = np.arange(_CHAR, _CHAR + 0x110000, dtype=np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        self.single[ord(" ")] = self.single[ord(SPACE)]
        text = [p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in model.pieces]
        for b, i in enumerate(self.byte):
            text[i] = bytes([b])
        unk = library.unk_id()
        text[unk] = model.trainer_spec.unk_surface.encode()
        self.surface = text
        self.forget()

    def forget(self) -> None:
        """Drops the words met so far."""
        self.code: dict[str, int] = {}
        self.ids, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each symbol pair; rank _NONE where they do not merge."""
        key = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.into[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, with their words; ``word`` ascends."""
        done_symbols, done_words = [], []

        def pair_ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rank, into = self._find(symbols[at], symbols[at + 1])
            return np.where(word[at] == word[at + 1], rank, _NONE), into

        rank, into = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], into[:-1] = pair_ranks(np.arange(len(symbols) - 1))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            segment = np.cumsum(np.concatenate([[False], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            over = least[segment] == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
                continue
            n = len(symbols)
            found = np.flatnonzero(rank == least[segment])
            run = np.concatenate([[True], found[1:] != found[:-1] + 1])
            first = np.maximum.accumulate(np.where(run, np.arange(len(found)), 0))
            chosen = found[(np.arange(len(found)) - first) % 2 == 0]  # of overlapping ones, every second from the left
            merged, low, seg = into[chosen], rank[chosen], segment[chosen]
            previous = symbols[np.maximum(chosen - 1, 0)].copy()
            follows = np.concatenate([[False], chosen[1:] == chosen[:-1] + 2])
            previous[follows] = merged[:-1][follows[1:]]
            has_left = (chosen > 0) & (segment[np.maximum(chosen - 1, 0)] == seg)
            after = np.minimum(chosen + 2, n - 1)
            has_right = (chosen + 2 < n) & (segment[after] == seg)
            left_rank = np.where(has_left, self._find(previous, merged)[0], _NONE)
            right_rank = np.where(has_right, self._find(merged, symbols[after])[0], _NONE)
            unsafe = np.zeros(len(starts), bool)
            unsafe[seg[np.minimum(left_rank, right_rank) <= low]] = True
            leftmost = np.concatenate([[True], seg[1:] != seg[:-1]])
            chosen = chosen[leftmost | ~unsafe[seg]]
            symbols[chosen] = into[chosen]
            keep = np.ones(n, bool)
            keep[chosen + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
            touched = moved[chosen]
            rank[touched] = _NONE
            touched = np.unique(np.concatenate([touched, touched[touched > 0] - 1]))
            touched = touched[touched + 1 < len(symbols)]
            rank[touched], into[touched] = pair_ranks(touched)
        if not done_words:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each string, which merges never leave."""
        if not parts:
            return []
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        symbols, word = self.merge(self.single[points].astype(np.int64), word)
        ids, unknown = symbols, np.flatnonzero(symbols >= _CHAR)
        if len(unknown):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[unknown] - _CHAR).tolist()]
            width = np.ones(len(symbols), np.int64)
            width[unknown] = [len(b) for b in raw]
            ids, word = np.repeat(symbols, width), np.repeat(word, width)
            ids[ids >= _CHAR] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return np.split(ids.astype(np.int32), np.searchsorted(word, np.arange(1, len(parts))))

    def _learn(self, words: set[str]) -> None:
        """Encodes new words, apart at a letter and the marks that follow it where no piece joins the two."""
        split, parts = [], {}
        for w in words:
            m = self.stem.fullmatch(w)
            cut = m.groups() if m and m[1][-1] + m[2][0] not in self.joins else (w,)
            split.append([parts.setdefault(p, len(parts)) for p in cut])
        coded = self._encode_parts(list(parts))
        new = [coded[s[0]] if len(s) == 1 else np.concatenate([coded[i] for i in s]) for s in split]
        self.code.update(zip(words, range(len(self.length), len(self.length) + len(new)), strict=True))
        self.length = np.concatenate([self.length, np.array([len(x) for x in new], np.int32)])
        self.ids = np.concatenate([self.ids, *new])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with begin and end ids, and where each text's begin; null encodes as the empty text."""
        split = [self.words.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = set().union(*split).difference(self.code)
        if new and len(self.code) + len(new) > REMEMBERED:
            self.forget()
            new = set().union(*split)
        if new:
            self._learn(new)
        counts = np.array([len(s) for s in split])
        code = self.code
        codes = np.array([code[w] for s in split for w in s], np.int64)
        first = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        size = self.length[codes]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])]
        per_text = total + 2 * np.arange(len(texts) + 1)
        out = np.empty(per_text[-1], np.int64)
        out[per_text[:-1]], out[per_text[1:] - 1] = self.bos, self.eos
        inner = np.ones(len(out), bool)
        inner[per_text[:-1]] = inner[per_text[1:] - 1] = False
        out[inner] = self.ids[T.ranges(first[codes], size)]
        return out, per_text

    def decode(self, ids: list[int]) -> str:
        """As the library's decode: control ids vanish, the leading space goes, broken bytes become U+FFFD."""
        raw = b"".join([self.surface[i] for i in ids])
        if raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _coded(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                ids, first = c.encode(part.column("text").to_pylist())
                listed, packed = ids.tolist(), ids.astype("<u4").tobytes()
                spans = list(zip(first.tolist(), first[1:].tolist(), strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(first)),
                        pa.array([packed[4 * a : 4 * b] for a, b in spans], pa.binary()),
                        pa.array([c.decode(listed[a:b]) for a, b in spans], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            codec(model_path).forget()  # some 50 MB, which the worker would hold through all later stages

    return trimmed(task), "doc_id long, n_tokens long, ids binary, decoded string"


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per input row: ids are little-endian unsigned 32-bit integers with begin and
    end ids, decoded is the text decoded from them. Null text counts as empty (two ids, empty text); doc_id may be
    null or repeated and is passed through; other columns are dropped. ``model_path`` is readable on every worker."""
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(*_coded(model_path))
