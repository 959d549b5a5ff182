"""Language-model scores by Brown class-based bigrams.

A word's probability is P(class | class of the previous word) * P(word | class). Classes come from
exchange clustering, which moves a word to the class that raises the likelihood of the training bigrams
of classes most:

1. Units move, one at a time, until nothing moves. Units are the `head_units` most frequent words, each by
   itself, and `pools` groups of all other words, dealt by a hash of their last bytes.
2. Each of the next words, `head_words` in all, moves by its own bigrams: left and right neighbours' classes
   are counted over all training texts, and it takes the class of the greatest gain to first order.
3. Every other word of at least `least_count` occurrences moves alike by its left neighbours. Rarer and unseen
   words belong to their pool's class. As the condition of the next word, words of this step count as of
   their pool, so that texts are read without looking them up.

The end of a text is a class of its own and precedes the first word. Transitions are counted over all
training texts with the final classes and smoothed by class frequencies; emissions by 0.1 for each type and
one unseen type: (c + 0.1) / (N_class + 0.1 (V_class + 1)).

What is gathered: word counts and classes of all training words (distributed tables, which grow with the
vocabulary), bigram counts of units (at most (head_units + pools + 1)**2 sums, which the driver clusters),
class contexts of the words of step 2 (at most 2 * (classes + 1) sums for each, judged on the executors),
and token and type counts of the classes.

Texts are read twice, to count words and to write them as numbers, which all further passes read; each pass
works on whole Arrow batches. Words of steps 1 and 2 are looked up in a broadcast bounded by head_words. All
others are dealt by their hash to buckets of about BUCKET bytes, with the classes before them and the rows they
are in, once: there their classes are found, and from there they come back as sums per document. In training
texts they are rare by definition and so cannot make one hot key; occurrences in texts that are held out, which
may have frequent words of their own, pass by after a bucket's classes are known, piece by piece. What tasks
send each other are arrays, a row for each task and block or bucket, not a row for each sum or word.

Edge cases: null and empty texts are one end token; null ids are trained on and not held out;
repeated rows are scored each; without training rows every probability but the smoothing's is the
unseen type's, so the base score is 0; extra columns are ignored.
"""

from __future__ import annotations

import copy
import math
import warnings
import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, arrow_batch, crc_of_id, materialise, scan, scratch, trim_memory

ALPHA = 0.1
COUNTS = "word binary, c long"
#: Bytes of rare words' occurrences, about, that are judged at a time; tokens, about, whose pairs are summed in a block.
BUCKET, BLOCK = 2_000_000, 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER_BYTES).split() if text else []


def split(texts):
    """words_of() every text of an Arrow array: a list of strings for each; null: null or empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty string
    if pc.all(some).as_py() is not False:
        return lists
    sizes = np.diff(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).cumsum(), prepend=0)
    owner = np.repeat(np.arange(len(lists)), sizes)[some.to_numpy(zero_copy_only=False)]
    offsets = np.concatenate(([0], np.bincount(owner, minlength=len(lists)).cumsum())).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), words.filter(some))


def pool_of(word: bytes, pools: int) -> int:
    return zlib.crc32(word[-3:]) % pools


class Classes:
    """The class of every word as a condition: of frequent words by rank, of all others by the pool of their ending."""

    def __init__(self, rank: dict[bytes, int], of_rank: list[int], pools: list[int]):
        self.rank, self.of_rank, self.pools, self.endings = rank, np.array(of_rank, dtype=np.int64), pools, {}

    def pool(self, word: bytes) -> int:
        e = word[-3:]
        c = self.endings.get(e)
        if c is None:
            if len(self.endings) > 200_000:
                self.endings.clear()
            c = self.endings[e] = self.pools[pool_of(word, len(self.pools))]
        return c

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class and rank (-1: not frequent) of every word."""
        rank = np.fromiter(map(self.rank.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        out = self.of_rank[rank] if len(self.of_rank) else np.zeros(len(words), dtype=np.int64)
        for i in np.flatnonzero(rank < 0).tolist():
            out[i] = self.pool(words[i])
        return out, rank


def xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1e-300))


def exchange(rows: np.ndarray, cols: np.ndarray, n: np.ndarray, units: int, classes: int, fixed: int, sweeps: int = 200) -> np.ndarray:
    """Class of every unit from counts n of bigrams (rows, cols) of units. Units from `fixed` on keep classes of their own.

    The likelihood is sum f(N(a,b)) - sum f(N(a,.)) - sum f(N(.,b)) with f(x) = x log x; a unit's
    move changes one row and one column of N, and all targets are judged at once. Warns if units still move in the last sweep."""
    size = np.bincount(rows, n, units) + np.bincount(cols, n, units)
    cls = np.empty(units, dtype=np.int64)
    cls[:fixed][np.argsort(-size[:fixed], kind="stable")] = np.arange(fixed) % classes
    cls[fixed:] = classes + np.arange(units - fixed)
    total = classes + units - fixed
    loop = rows == cols
    own = np.bincount(rows[loop], n[loop], units)
    r, c, w = rows[~loop], cols[~loop], n[~loop].astype(np.float64)
    by_row, by_col = np.argsort(r, kind="stable"), np.argsort(c, kind="stable")
    r_at, c_at = np.searchsorted(r[by_row], np.arange(units + 1)), np.searchsorted(c[by_col], np.arange(units + 1))
    r_other, r_w, c_other, c_w = c[by_row], w[by_row], r[by_col], w[by_col]
    table = np.zeros((total, total))
    np.add.at(table, (cls[rows], cls[cols]), n)
    order = np.argsort(-size[:fixed], kind="stable")
    least = 1e-11 * float(xlogx(table.sum() + 1))  # what rounding may make of no gain
    for _ in range(sweeps):
        moved = 0
        for u in order:
            out = np.bincount(cls[r_other[r_at[u] : r_at[u + 1]]], r_w[r_at[u] : r_at[u + 1]], total)
            into = np.bincount(cls[c_other[c_at[u] : c_at[u + 1]]], c_w[c_at[u] : c_at[u + 1]], total)
            a, s = cls[u], own[u]
            if not (out.any() or into.any() or s):
                continue
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= s
            np.maximum(table, 0, out=table)
            gain = (xlogx(table + out) - (base := xlogx(table))).sum(axis=1) + (xlogx(table + into[:, None]) - base).sum(axis=0)
            d = np.arange(total)
            diag = table[d, d]
            gain -= xlogx(diag + out) + xlogx(diag + into) - 2 * xlogx(diag)
            gain += xlogx(diag + out + into + s) - xlogx(diag)
            left, right = table.sum(axis=1) + into, table.sum(axis=0) + out
            gain -= xlogx(left + out.sum() + s) - xlogx(left) + xlogx(right + into.sum() + s) - xlogx(right)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + least:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += s
            moved += b != a
            cls[u] = b
        if not moved:
            return cls
    if sweeps > 100:
        warnings.warn(f"{moved} units still move after {sweeps} sweeps", stacklevel=2)
    return cls


class Gains:
    """First-order gains of a word in each class, given how often each class is to its left and right.

    The likelihood's derivative by N(a,b) is log N(a,b) - log N(a,.) - log N(.,b) up to a constant."""

    def __init__(self, table: np.ndarray):
        t, k = table + 0.5, len(table) - 1  # the last class is the end
        self.left = np.log(t[:, :k]) - np.log(t.sum(axis=0)[:k])
        self.right = (np.log(t[:k]) - np.log(t.sum(axis=1)[:k, None])).T

    def best(self, left: np.ndarray, right: np.ndarray | None = None) -> np.ndarray:
        return (left @ self.left + (right @ self.right if right is not None else 0)).argmax(axis=1)


def is_held_out(c: Column) -> Column:
    return F.coalesce(F.pmod(crc_of_id(c), F.lit(10)) == 0, F.lit(False))


def word_counts(texts: DataFrame, flush: int = 48_000_000) -> DataFrame:
    """word and c over all texts; counted per task, or flush bytes of words, before the shuffle."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(split(b.column(0)).flatten())
            size += held[-1].nbytes
            if size > flush:
                yield from pieces(held)
                held, size = [], 0
        if held:
            yield from pieces(held)
        trim_memory()

    def pieces(held):
        import pyarrow as pa

        found = pa.chunked_array(held).value_counts()
        word, c = found.field("values").cast(pa.binary()), found.field("counts")
        for i in range(0, len(word), 50_000):
            yield pa.RecordBatch.from_arrays([word[i : i + 50_000], c[i : i + 50_000]], names=["word", "c"])

    return texts.mapInArrow(run, COUNTS).groupBy("word").agg(F.sum("c").alias("c"))


ENCODED = "row long, doc_id long, held boolean, ids binary, tail binary"


def encode(documents: DataFrame, held: Column, rank, pools: int) -> DataFrame:
    """ENCODED of every document: int32 ids of its words - the rank, or minus one less the pool - and, with a blank between,
    its words without a rank.

    Texts are split once here; all later passes read numbers."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        ranked, row, endings = pa.array(list(rank.value), pa.binary()), TaskContext.get().partitionId() << 33, {}
        for b in batches:
            lists = split(b.column(1))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().cast(pa.binary())
            ids = pc.fill_null(pc.index_in(words, value_set=ranked), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            at = np.flatnonzero(ids < 0)
            tail = words.take(pa.array(at))
            for i, w in zip(at.tolist(), tail.to_pylist(), strict=True):
                e = w[-3:]
                k = endings.get(e)
                if k is None:
                    k = endings[e] = -1 - pool_of(w, pools)
                ids[i] = k
            if len(endings) > 200_000:
                endings.clear()
            upto = np.concatenate(([0], sizes.cumsum()))
            tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, upto).astype(np.int32)), tail)
            raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * upto).astype(np.int32)), pa.py_buffer(ids)])
            rows = pa.array(np.arange(row, row := row + len(sizes)))
            yield pa.RecordBatch.from_arrays([rows, b.column(0), b.column(2), raw, pc.binary_join(tails, b" ")], names=["row", "doc_id", "held", "ids", "tail"])
        trim_memory()

    return scan(documents.withColumn("brown_held", held), "doc_id", "text", "brown_held").mapInArrow(run, ENCODED)


class Lookup:
    """Numbers of encoded words: by rank, or by pool."""

    def __init__(self, of_rank, of_pool):
        self.all = np.array([*of_rank, *of_pool[::-1]], dtype=np.int64)  # a negative id counts from the end: -1 is pool 0

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.all[ids]


def sequence(raw, lookup: Lookup, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow array of encoded texts: ids of all words; sizes of the texts; the numbers of all words, with an end before,
    between and behind the texts; and where in them the words are."""
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.int32) if data and offsets[-1] > offsets[0] else np.zeros(0, np.int32)
    sizes = np.diff(offsets).astype(np.int64) // 4
    at = np.arange(len(ids)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
    numbers = np.full(len(ids) + len(sizes) + 1, end, dtype=np.int64)
    numbers[at] = lookup.of(ids)
    return ids, sizes, numbers, at


class Blocks:
    """Counters of a table of rows, dealt in turn to blocks: where each row's begin, and how many a block has."""

    def __init__(self, rows: int, width: int, tokens: int):
        self.rows, self.width, self.n = rows, width, max(1, min(rows, max(64, tokens // BLOCK)))
        self.span = -(-rows // self.n) * width
        r = np.arange(rows)
        self.start = r % self.n * self.span + r // self.n * width


def pair_sums(encoded: DataFrame, blocks, keys_of, finish, schema: str, flush: int = 4_000_000) -> DataFrame:
    """finish(rows, sums) of every block: how often each of the counters that keys_of(raw texts) names occurs over all texts.

    Summed per task before the shuffle, which moves two arrays for each task and block."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(keys_of(b.column(0)))
            size += len(held[-1])
            if size > flush:
                yield pieces(held)
                held, size = [], 0
        if held:
            yield pieces(held)
        trim_memory()

    def pieces(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        span = blocks.value.span
        block, first = np.unique(key // span, return_index=True)
        at, n, ends = (key % span).astype(np.uint32), n.astype(np.uint32), np.append(first, len(key))[1:].tolist()
        return arrow_batch(sums, [(k, at[i:j].tobytes(), n[i:j].tobytes()) for k, i, j in zip(block.tolist(), first.tolist(), ends, strict=True)])

    def total(pieces):
        import pyarrow as pa

        shape, block = blocks.value, pieces.column("block")[0].as_py()
        out = np.zeros(shape.span, np.int64)
        for at, n in zip(pieces.column("at"), pieces.column("n"), strict=True):
            out[np.frombuffer(at.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.uint32)
        out = out.reshape(-1, shape.width)
        return pa.Table.from_batches([finish(block + shape.n * np.arange(len(out)), out)])

    sums = "block int, at binary, n binary"
    return encoded.select("ids").mapInArrow(run, sums).groupBy("block").applyInArrow(total, schema)


def unit_bigrams(encoded: DataFrame, units, n_units: int, tokens: int) -> DataFrame:
    """pair (first * n_units + second) and n over all texts; unit n_units - 1 is the end."""
    blocks = encoded.sparkSession.sparkContext.broadcast(Blocks(n_units, n_units, tokens))

    def keys_of(raw):
        _, sizes, numbers, _ = sequence(raw, units.value, n_units - 1)
        return blocks.value.start[numbers[:-1]] + numbers[1:] if len(sizes) else numbers[:0]

    def finish(rows, sums):
        import pyarrow as pa

        i, second = np.nonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(rows[i] * n_units + second), pa.array(sums[i, second])], names=["pair", "n"])

    return pair_sums(encoded, blocks, keys_of, finish, "pair long, n long")


def head_classes(encoded: DataFrame, classes, n_ranks: int, least_rank: int, end: int, gains, tokens: int) -> np.ndarray:
    """Ranks from least_rank on and the classes of greatest gain, by the classes around these words in all texts."""
    blocks = encoded.sparkSession.sparkContext.broadcast(Blocks(n_ranks, 2 * (end + 1), tokens))

    def keys_of(raw):
        ids, _, numbers, at = sequence(raw, classes.value, end)
        own = ids >= least_rank
        start, at = blocks.value.start[ids[own]], at[own]
        return np.concatenate((start + numbers[at - 1], start + end + 1 + numbers[at + 1]))

    def finish(rows, sums):
        some = sums.any(axis=1)
        best = gains.value.best(sums[some, : end + 1].astype(np.float64), sums[some, end + 1 :].astype(np.float64))
        return arrow_batch("rank long, k int", list(zip(rows[some].tolist(), best.tolist(), strict=True)))

    return np.array([tuple(r) for r in pair_sums(encoded, blocks, keys_of, finish, "rank long, k int").collect()], dtype=np.int64).reshape(-1, 2)


TAIL = "bucket int, held boolean, words binary, at binary, rows binary, before binary, seen binary"


def tail_contexts(encoded: DataFrame, classes, end: int, buckets: int, flush: int = 16_000_000) -> DataFrame:
    """Rows of TAIL, a task's for each bucket of the words without a rank, of training texts and of others: the words, with a
    blank between; of every occurrence the word's place among them, the row and the class before; and, in one row of a task,
    how often the training texts have each of the other transitions, at class before * (end + 1) + class."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        held, size, table = {False: [], True: []}, 0, np.zeros((end + 1) ** 2, np.int64)
        for b in batches:
            ids, sizes, numbers, at = sequence(b.column(1), classes.value, end)
            row, out = b.column(0).to_numpy(), pc.fill_null(b.column(2), True).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            seen = np.zeros(len(numbers), dtype=bool)  # which numbers are of training texts and no tail words
            seen[at] = (ids >= 0) & ~out[owner]
            seen[np.cumsum(sizes + 1)] = ~out
            now = np.flatnonzero(seen)
            table += np.bincount(numbers[now - 1] * (end + 1) + numbers[now], minlength=len(table))
            tail = ids < 0
            words = pc.split_pattern(b.column(3), b" ").flatten()
            words = words.filter(pc.greater(pc.binary_length(words), 0))
            owner, before = owner[tail], numbers[at[tail] - 1].astype(np.uint8)
            for side, found in held.items():
                own = out[owner] == side
                found.append((words.filter(pa.array(own)), row[owner[own]], before[own]))
            size += words.nbytes
            if size > flush:
                yield from map(pieces, held.items())
                held, size = {False: [], True: []}, 0
        if held[False]:
            yield from map(pieces, held.items())
        yield arrow_batch(TAIL, [(TaskContext.get().partitionId() % buckets, False, b"", b"", b"", b"", table.tobytes())])
        trim_memory()

    def pieces(item):
        import pyarrow as pa

        side, held = item
        found = pa.chunked_array([x[0] for x in held]).combine_chunks().dictionary_encode()
        rows, before = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        words, of = found.dictionary.to_pylist(), found.indices.to_numpy()
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        by = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[by], np.arange(buckets + 1))
        place = np.empty(len(words), np.int64)
        place[by] = np.arange(len(words)) - first[bucket[by]]
        order = np.argsort(bucket[of], kind="stable")
        of, rows, before = of[order], rows[order], before[order]
        start, place = np.searchsorted(bucket[of], np.arange(buckets + 1)), place[of].astype(np.uint32)
        words = [words[i] for i in by.tolist()]
        return arrow_batch(TAIL, [
            (k, side, b" ".join(words[first[k] : first[k + 1]]), place[i:j].tobytes(), rows[i:j].tobytes(), before[i:j].tobytes(), b"")
            for k, (i, j) in enumerate(zip(start.tolist(), start[1:].tolist(), strict=False)) if j > i
        ])

    return encoded.select("row", "ids", "held", "tail").mapInArrow(run, TAIL)


def places(pieces: list[tuple]) -> tuple[list[bytes], np.ndarray, bytes, np.ndarray]:
    """Of pieces (words, at, rows, before): all words, and of every occurrence the place among them, the row and the class before."""
    lists = [words.split() for words, *_ in pieces]
    starts = np.cumsum([0, *map(len, lists)]).tolist()
    at = [i + np.frombuffer(x[1], np.uint32).astype(np.int64) for i, x in zip(starts, pieces, strict=False)]
    return [w for x in lists for w in x], np.concatenate([*at, np.zeros(0, np.int64)]), b"".join(x[2] for x in pieces), np.frombuffer(b"".join(x[3] for x in pieces), np.uint8)


class Bucket:
    """Words without a rank of a bucket, with their training counts and classes, from the pieces of training texts."""

    def __init__(self, pieces: list[tuple], pool, end: int, gains: Gains, least_count: int):
        import pyarrow as pa

        words, at, self.rows, before = places(pieces)
        known = pa.array(words, pa.binary()).dictionary_encode()
        self.words, self.pool, self.before = known.dictionary.to_pylist(), pool, before
        self.of = of = known.indices.to_numpy().astype(np.int64)[at]
        self.c, self.k = np.bincount(of, minlength=len(self.words)), np.zeros(len(self.words), np.int64)
        order, step = np.argsort(of, kind="stable"), 20_000
        upto = np.searchsorted(of[order], np.arange(0, len(self.words) + step, step)).tolist()
        for i, x, y in zip(range(0, len(self.words), step), upto, upto[1:], strict=False):
            part, n = order[x:y], min(step, len(self.words) - i)
            m = np.bincount((of[part] - i) * (end + 1) + before[part], minlength=n * (end + 1)).reshape(n, end + 1)
            self.k[i : i + n] = gains.best(m.astype(np.float64))
        for i in np.flatnonzero(self.c < least_count).tolist():
            self.k[i] = pool(self.words[i])
        self.seen = np.bincount(before.astype(np.int64) * (end + 1) + self.k[of], minlength=(end + 1) ** 2)
        self.number = dict(zip(self.words, range(len(self.words)), strict=True))

    def others(self, pieces: list[tuple]) -> tuple:
        """A row of KINDS for pieces of texts that are no training texts."""
        words, at, rows, before = places(pieces)
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        known = number >= 0
        c, k = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8)
        c[known], k[known] = self.c[number[known]], self.k[number[known]]
        for i in np.flatnonzero(~known).tolist():
            k[i] = self.pool(words[i])
        return True, b"", c.tobytes(), k.tobytes(), at.astype(np.uint32).tobytes(), rows, before.tobytes(), b""


KINDS = "held boolean, words binary, c binary, k binary, at binary, rows binary, before binary, seen binary"


def tail_classes(found: DataFrame, classes, end: int, gains, least_count: int, room: int = 2_000_000) -> DataFrame:
    """Rows of KINDS, for each bucket of tail_contexts one of the training texts and others of about room bytes: training counts
    and classes of words without a rank; of every occurrence the word's place among them, the row and the class before; and, of
    the training texts, the words and how often there is each transition."""

    def judge(batches):
        import itertools

        rows = (row for b in batches for row in zip(*(x.to_pylist() for x in b.columns), strict=True))
        for _, own in itertools.groupby(rows, lambda x: x[0]):
            trained, seen, bucket = [], np.zeros((end + 1) ** 2, np.int64), None
            held, size = [], 0
            for _, out, *piece, table in own:
                if not out:
                    trained.append(piece)
                    seen += np.frombuffer(table, np.int64) if table else 0
                    continue
                bucket = bucket or Bucket(trained, classes.value.pool, end, gains.value, least_count)
                held.append(piece)
                size += sum(map(len, piece))
                if size > room:
                    yield arrow_batch(KINDS, [bucket.others(held)])
                    held, size = [], 0
            bucket = bucket or Bucket(trained, classes.value.pool, end, gains.value, least_count)
            if held:
                yield arrow_batch(KINDS, [bucket.others(held)])
            arrays = bucket.c.astype(np.int64), bucket.k.astype(np.uint8), bucket.of.astype(np.uint32)
            yield arrow_batch(KINDS, [(False, b" ".join(bucket.words), *(x.tobytes() for x in arrays), bucket.rows, bucket.before.tobytes(), (seen + bucket.seen).tobytes())])
        trim_memory()

    return found.repartition("bucket").sortWithinPartitions("bucket", "held").mapInArrow(judge, KINDS)


def class_sums(kinds: DataFrame, end: int) -> np.ndarray:
    """Over all buckets: counts of the transitions, then tokens and types without a rank of each class."""
    square = (end + 1) ** 2

    def run(batches):
        out = np.zeros(square + 2 * (end + 1), np.int64)
        for b in batches:
            for c, k, seen in zip(*(x.to_pylist() for x in b.columns), strict=True):
                c, k = np.frombuffer(c, np.int64), np.frombuffer(k, np.uint8)
                out[:square] += np.frombuffer(seen, np.int64)
                np.add.at(out, square + k.astype(np.int64), c)
                out[square + end + 1 :] += np.bincount(k, minlength=end + 1)
        at = np.flatnonzero(out)
        yield arrow_batch("code long, n long", list(zip(at.tolist(), out[at].tolist(), strict=True)))

    out = np.zeros(square + 2 * (end + 1))
    for code, n in kinds.where("not held").select("c", "k", "seen").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n")).collect():
        out[code] = n
    return out


def tail_words(kinds: DataFrame) -> DataFrame:
    """word, c and k (its class) of every training word without a rank."""

    def run(batches):
        for b in batches:
            for words, c, k in zip(*(x.to_pylist() for x in b.columns), strict=True):
                rows = zip(words.split(), np.frombuffer(c, np.int64).tolist(), np.frombuffer(k, np.uint8).tolist(), strict=True)
                yield arrow_batch("word binary, c long, k int", list(rows))

    return kinds.where("not held").select("words", "c", "k").mapInArrow(run, "word binary, c long, k int")


def most_frequent(counts: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """At most n words, all of at least a count that is found from a histogram of a thousand steps."""
    step = F.floor(16 * F.log2(F.col("c").cast("double")))
    steps, room, least = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True), n, None
    for k, words in steps:
        if words > room:
            break
        room, least = room - words, k
    if least is None:
        return []
    return [(bytes(w), int(c)) for w, c in counts.where(step >= least).toLocalIterator()]


class Model:
    """What scoring needs: classes of words, transitions and emission denominators (log10), counts by rank."""

    def __init__(self, classes: Classes, transitions: np.ndarray, emissions: np.ndarray, head: list[int], total: float, end_count: int):
        self.classes, self.transitions, self.emissions, self.total, self.end_count = classes, transitions, emissions, total, end_count
        self.head = np.log10(np.array(head, dtype=np.float64) + ALPHA)

    def without_words(self) -> Model:
        """A copy that knows no ranks, for tasks that read encoded words."""
        out = copy.copy(self)
        out.classes = Classes({}, [], self.classes.pools)
        return out


SCORED = "row long, doc_id long, held boolean, n_tokens long, n_known long, base double, score double"


def train(documents: DataFrame, held: Column, classes: int = 48, head_units: int = 1000, pools: int = 400, head_words: int = 200_000, least_count: int = 3, beta: float = 5.0) -> tuple[Model, DataFrame, DataFrame, int, DataFrame]:
    """From the documents that are not held: the model, the table of words without a rank (word, c, k: its class), ENCODED of
    all documents, the number of training tokens, and KINDS, from which the table of words is read."""
    if not 0 < classes < 255:
        raise ValueError("classes must fit a byte")
    sc = documents.sparkSession.sparkContext
    texts = scan(documents.where(~held), "doc_id", "text").select("text")
    counts = materialise(word_counts(texts), "brown-counts")
    n_words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = dict(sorted(most_frequent(counts, head_words), key=lambda x: (-x[1], x[0])))
    rank = {w: i for i, w in enumerate(head)}
    every = materialise(encode(documents, held, sc.broadcast(rank), pools), "brown-encoded")
    encoded = every.where("not held")
    n_docs, rare = every.agg(F.expr("count_if(not held)"), F.coalesce(F.sum(F.octet_length("tail")), F.lit(0))).first()
    tokens, types, end = n_words + n_docs, types + (n_docs > 0), classes
    # 1: units
    top, in_pool = min(head_units, len(head)), [pool_of(w, pools) for w in rank]
    n_units = top + pools + 1
    units = sc.broadcast(Lookup([i if i < top else top + k for i, k in enumerate(in_pool)], list(range(top, n_units - 1))))
    found = unit_bigrams(encoded, units, n_units, tokens).toArrow()
    pair, n = found.column("pair").to_numpy(), found.column("n").to_numpy().astype(np.float64)
    rows, cols = pair // n_units, pair % n_units
    cls = exchange(rows, cols, n, n_units, classes, n_units - 1)
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (cls[rows], cls[cols]), n)
    gains, of_pool = sc.broadcast(Gains(table)), [int(c) for c in cls[top : n_units - 1]]
    # 2: the other frequent words
    of_rank = [int(cls[i]) if i < top else of_pool[k] for i, k in enumerate(in_pool)]
    if len(head) > top:
        moved = head_classes(encoded, sc.broadcast(Lookup(of_rank, of_pool)), len(head), top, end, gains, tokens)
        for i, k in moved.tolist():
            of_rank[i] = k
    # 3: all words, and the transitions
    final = Classes(rank, of_rank, of_pool)
    found = tail_contexts(every, sc.broadcast(Lookup(of_rank, of_pool)), end, max(16, rare // BUCKET))
    kinds = materialise(tail_classes(found, sc.broadcast(Classes({}, [], of_pool)), end, gains, least_count), "brown-tail")
    found = class_sums(kinds, end)
    table, sums = found[: (end + 1) ** 2].reshape(end + 1, end + 1), found[(end + 1) ** 2 :].reshape(2, end + 1)
    prior = (table.sum(axis=0) + ALPHA) / (table.sum() + ALPHA * (classes + 1))
    transitions = np.log10((table + beta * prior) / (table.sum(axis=1, keepdims=True) + beta))
    np.add.at(sums[0], of_rank, list(head.values()))
    np.add.at(sums[1], of_rank, 1)
    emissions = np.log10(sums[0] + ALPHA * (sums[1] + 1))
    emissions[end] = math.log10(ALPHA)
    return Model(final, transitions, emissions, list(head.values()), math.log10(tokens + ALPHA * (types + 1)), n_docs), tail_words(kinds), every, tokens, kinds


def sums_of_runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values, one after the other; pairwise, so that millions of equal values add up without drift."""
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def score(encoded: DataFrame, model: Model, kinds: DataFrame) -> DataFrame:
    """doc_id, held, n_tokens, n_known, base_score and score of every row."""
    sc, whole = encoded.sparkSession.sparkContext, model.classes
    lookup = sc.broadcast(Lookup(whole.of_rank.tolist(), whole.pools))
    shared = sc.broadcast(model.without_words())

    def run(batches):
        import pyarrow as pa

        m = shared.value
        end = len(m.emissions) - 1
        for b in batches:
            ids, sizes, numbers, at = sequence(b.column(3), lookup.value, end)
            plain, n = ids >= 0, len(sizes)
            own, at, ends = np.bincount(np.repeat(np.arange(n), sizes)[plain], minlength=n), at[plain], np.cumsum(sizes + 1)
            logs = m.head[ids[plain]]
            base = math.log10(m.end_count + ALPHA) - m.total + sums_of_runs(logs - m.total, own)
            total = m.transitions[numbers[ends - 1], end] + sums_of_runs(m.transitions[numbers[at - 1], numbers[at]] + (logs - m.emissions[numbers[at]]), own)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, (sizes + 1, own + int(m.end_count > 0), base, total))], names=[x.split()[0] for x in SCORED.split(", ")])
        trim_memory()

    parts, bits = "part int, row binary, more binary, classed binary, known binary", 33

    def look_up(batches):
        m = shared.value
        for b in batches:
            for c, k, of, rows, before in zip(*(x.to_pylist() for x in b.columns), strict=True):
                of, (rows, owner) = np.frombuffer(of, np.uint32), np.unique(np.frombuffer(rows, np.int64), return_inverse=True)
                c, k = np.frombuffer(c, np.int64), np.frombuffer(k, np.uint8)
                logs, n = np.log10(c + ALPHA), len(rows)
                more = np.bincount(owner, (logs - m.total)[of], n)
                classed = np.bincount(owner, (logs - m.emissions[k])[of] + m.transitions[np.frombuffer(before, np.uint8), k[of]], n)
                sums = rows & ((1 << bits) - 1), more, classed, np.bincount(owner, (c > 0)[of], n).astype(np.int64)
                part, first = np.unique(rows >> bits, return_index=True)
                yield arrow_batch(parts, [(p, *(x[i:j].tobytes() for x in sums)) for p, i, j in zip(part.tolist(), first.tolist(), np.append(first, n)[1:].tolist(), strict=True)])
        trim_memory()

    def add_up(pieces):
        import pyarrow as pa

        joined = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in pieces.column(name)])
        row, owner = np.unique(joined("row", np.int64), return_inverse=True)
        sums = [np.bincount(owner, joined(name, kind), len(row)) for name, kind in (("more", np.float64), ("classed", np.float64), ("known", np.int64))]
        row += pieces.column("part")[0].as_py() << bits
        return pa.table([row, *sums[:2], sums[2].astype(np.int64)], names=["row", "more", "classed", "known"])

    local = materialise(encoded.select("row", "doc_id", "held", "ids").mapInArrow(run, SCORED), "brown-scores")
    rare = kinds.select("c", "k", "at", "rows", "before").mapInArrow(look_up, parts)
    sums = rare.groupBy("part").applyInArrow(add_up, "row long, more double, classed double, known long")
    zero = lambda x, of: F.col(x) + F.coalesce(of, F.lit(0))
    return local.join(sums, "row", "left").select("doc_id", "held", "n_tokens", zero("n_known", "known").alias("n_known"), zero("base", "more").alias("base_score"), zero("score", "classed").alias("score"))


def class_bigram_scores(documents: DataFrame, **params) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    with scratch(documents.sparkSession, "brown-scores", "brown-tail"):
        model, _, encoded, tokens, kinds = train(documents, is_held_out(F.col("doc_id")), **params)
        scored = score(encoded, model, kinds)
    return scored.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op2_brown_scores(spark, sf_dir):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document; nulls and empty texts as stated above."""
    from .common import table

    return class_bigram_scores(table(spark, sf_dir, "documents"))
