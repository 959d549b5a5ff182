"""Sum-of-squares online packing of token sequences.

Every input partition packs its own documents in order, so the operator is one narrow pass without
a shuffle. A level array N holds how many partially filled windows stand at each fill level. A
document of s tokens goes to the level h (0: a new window) for which the sum of squared counts
after the move is smallest; ties go to the fullest window. Documents longer than a window give
whole windows first and place what remains.

When a partition ends, its partially filled windows are laid end to end and cut anew: whole
windows come out, and the rest is split into sequences whose lengths are falling powers of two.
Those need no padding, so a partition adds none. What the rule fills exactly comes out by the rule; the rest waits
for the end, about 6 MB of ids at most, so its share falls with the size of the partition (README).

Edge cases: null or empty texts are a document of one token, the end id; repeated rows are packed
each by itself; null ids are kept; an empty table gives no rows; other columns are ignored.
sequence_id is the partition number times 2**33 plus a count, so a retried task numbers alike.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, scan, trim_memory

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Per worker process: hash of a tokenizer's definition -> the tokenizer, with its cache.
_LOADED: dict[int, ChunkTokenizer] = {}
_CACHE_WORDS = 800_000
#: So many of the first ones stay when it is full: frequent words come early.
_KEPT_WORDS = 400_000
_WORDS_AT_ONCE = 20_000
_BYTES_AT_ONCE = 8 << 20


def _strings(cuts: np.ndarray, data) -> pa.LargeStringArray:
    """The strings between neighbouring cuts of UTF-8 bytes, which are not copied."""
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))


def _cuts(a: pa.Array) -> np.ndarray:
    """The offsets of an array of large strings or binaries."""
    return np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]


class ChunkTokenizer:
    """encode(texts) of a tokenizer that ends every word with `</w>` and whose pre-tokens span no blank or newline.

    Blank-separated chunks are then encoded independently of their neighbours, so Arrow reduces a slice
    of texts to its distinct chunks. A chunk of Latin letters with ASCII marks behind it is further split
    into both, as the tokenizer itself does after lower-casing. Python sees distinct words only, and
    new letter runs are encoded many in one text. The cache holds a fixed number of words, or those of one slice."""

    MARKS = ".,;:!?%$&*#|"
    LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_str(definition), {"": b""}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    @staticmethod
    def load(definition: str) -> ChunkTokenizer:
        key = hash(definition)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = ChunkTokenizer(definition)
        return _LOADED[key]

    def learn(self, words: list[str]) -> None:
        """Put the ids of unseen words, Latin letters in lower case or anything else, into the cache."""
        stems, others, latin = [], [], re.compile(self.LATIN).match
        for w in words:
            (stems if latin(w) else others).append(w)
        for at in range(0, len(stems), _WORDS_AT_ONCE):
            some = stems[at : at + _WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) != len(some):
                raise ValueError("the tokenizer does not end every word with </w>")
            raw = ids.tobytes()
            self.cache.update(zip(some, (raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)), strict=True))
        for at in range(0, len(others), _WORDS_AT_ONCE):
            some = others[at : at + _WORDS_AT_ONCE]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.cache[w] = np.array(e.ids, dtype="<u4").tobytes()

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.cache.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if missing:
            if len(self.cache) + len(missing) > _CACHE_WORDS:
                self.cache = dict(islice(self.cache.items(), _KEPT_WORDS))
            self.learn(missing)
            found = [self.cache[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found

    def look_up(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct chunks, which may have their blank behind them."""
        n, bare = len(chunks), pc.ascii_rtrim(chunks, " ")
        letters = pc.ascii_rtrim(bare, self.MARKS)
        latin = pc.match_substring_regex(letters, self.LATIN)
        cuts = np.empty(2 * n + 1, dtype=np.int64)
        cuts[::2] = _cuts(bare)
        cuts[1::2] = cuts[:-1:2] + np.diff(_cuts(letters))
        marks = _strings(cuts, bare.buffers()[2] or b"").take(pa.array(np.arange(1, 2 * n, 2)))
        stems = pc.if_else(latin, pc.utf8_lower(letters), bare)
        marks = pc.if_else(latin, marks, pa.scalar("", pa.large_string()))
        words = pa.concat_arrays([stems, marks]).dictionary_encode()
        ids = pa.array(self.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        return pc.binary_join_element_wise(ids[:n], ids[n:], pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column; null texts have none."""
        if not len(texts):
            return
        texts = texts.cast(pa.large_string()).fill_null("")
        ends, data = _cuts(texts), np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + _BYTES_AT_ONCE, side="right")) - 1)
            own, some = ends[at : to + 1] - ends[at], data[ends[at] : ends[to]].copy()
            some[some == ord("\n")] = ord(" ")
            cut = np.zeros(len(some) + 1, dtype=bool)
            np.equal(some, ord(" "), out=cut[1:])
            cut[own] = True
            cuts = np.flatnonzero(cut)
            chunks = _strings(cuts, some).dictionary_encode()
            ids = self.look_up(chunks.dictionary).take(chunks.indices)
            bounds = (_cuts(ids)[np.searchsorted(cuts, own)] // 4).tolist()
            flat = np.frombuffer(ids.buffers()[2] or b"", dtype="<u4", count=bounds[-1])
            yield from (flat[i:j] for i, j in zip(bounds, bounds[1:], strict=False))
            at = to


class Packer:
    """Windows of `size` tokens filled by the sum-of-squares rule; finished pieces gather in `rows`."""

    def __init__(self, size: int, first_id: int = 0):
        self.size, self.next_id, self.rows = size, first_id, []
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.filled: list[int] = []

    def emit(self, pieces: list[tuple]) -> None:
        """pieces of one finished sequence: (doc_id, start, ids, doc_tokens)."""
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def choose(self, s: int) -> int:
        """The level, 0 for a new window, at which s < size tokens give the least sum of squared counts."""
        n, room = self.levels, self.size - s
        h = np.array(self.filled[: bisect_right(self.filled, room)], dtype=np.int64)
        if not len(h):
            return 0
        change = 2 * (n[h + s] - n[h]) + 2
        if h[-1] == room:
            change[-1] = 1 - 2 * n[room]
        at = len(h) - 1 - int(np.argmin(change[::-1]))
        return int(h[at]) if change[at] <= 2 * n[s] + 1 else 0

    def count(self, level: int, by: int) -> None:
        """Adds windows to a level; `filled` lists the levels that have any, in order."""
        if by > 0 and not self.levels[level]:
            insort(self.filled, level)
        self.levels[level] += by
        if by < 0 and not self.levels[level]:
            self.filled.remove(level)

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, size = len(ids), self.size
        whole = total // size * size
        for start in range(0, whole, size):
            self.emit([(doc_id, start, ids[start : start + size], total)])
        s = total - whole
        if not s:
            return
        piece, h = (doc_id, whole, ids[whole:], total), self.choose(s)
        pieces = [piece]
        if h:
            pieces = self.open[h].pop() + pieces
            self.count(h, -1)
        if h + s == size:
            self.emit(pieces)
        else:
            self.open.setdefault(h + s, []).append(pieces)
            self.count(h + s, 1)

    def close(self) -> None:
        left = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        rest = sum(len(p[2]) for p in left)
        room, now = 0, []
        for doc_id, start, ids, total in left:
            while len(ids):
                if not room:
                    room = min(self.size, 1 << (rest.bit_length() - 1))
                take = min(room, len(ids))
                now.append((doc_id, start, ids[:take], total))
                ids, start, room, rest = ids[take:], start + take, room - take, rest - take
                if not room:
                    self.emit(now)
                    now = []
        self.open, self.filled, self.levels[:] = {}, [], 0


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    size must be a power of two. The tokenizer file is read on the driver and broadcast."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = ChunkTokenizer.load(definition.value)
        packer = Packer(size, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1)), strict=True):
                packer.add(doc_id, np.concatenate((ids, end)))
            yield arrow_batch(PIECES, packer.rows)
            packer.rows = []
        packer.close()
        yield arrow_batch(PIECES, packer.rows)
        trim_memory()

    return scan(documents, "doc_id", "text").mapInArrow(run, PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir):
    """PIECES of every document by the public 49k word BPE; nulls, empty, long and repeated texts as stated above."""
    from .common import table

    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
