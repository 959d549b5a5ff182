"""Exact n-gram Jaccard join and its components, with token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct 5-word shingles. Documents with equal
sets are one set from the start. Two sets x, y link when |x & y| / |x | y| >= t. A set then keeps
at least ceil(t |x|) of its tokens in any partner, so at most tau = |x| - ceil(t |x|) are missing.

1. At most tau of a linked set's tokens are held by no other set, so of any part of its tokens, all
   but tau are shared. The part is those whose hash lies in the lowest `sampled` share of all
   hashes, the same for every set; sets of which too few of these are shared (`shared_counts`) are
   alone, which holds for nearly all unrelated texts, however many chance shingles they share.
2. Among those, tokens' document frequencies are counted, and all further work uses the order by
   (frequency, hash). Tokens of frequency 1 only count; sets with more than tau of them are alone.
3. Signatures (`signatures`): tokens up to frequency `rare` are signatures by themselves. More
   frequent tokens are split into classes by hash, and pairs of tokens of a class are signatures.
   To destroy every signature of a prefix takes one missing token for each rare one, and all but
   one of each class; prefixes are extended until that is more than tau. Of a linked pair, the
   prefix that ends first keeps a signature whose tokens both sets hold, and as the order is the
   same for both, it lies in the other prefix too. The number of classes must be the same for both
   sets of a pair; it depends on the band floor(log(|x|) / log(1/t)), and as linked sets lie in
   the same band or in neighbouring ones, each set emits for its own band and the next.
4. Candidates are verified by exact intersection. Groups of very many near copies share their
   signatures, so pairs within a signature are not enumerated: every set is first compared to the
   pivot of each of its signatures, links are contracted into components, and signatures whose sets
   are all in one component are done. Of signatures held by the same sets one is looked at. Sets of
   what remains are compared block by block (`settle`), which lists only links that join components. So no link between components is
   missed, and no pair cap exists.

Token counting works on blocks of packed hashes dealt by token, and counts distinct sets per token
with numpy; blocks are cleared of repeats where they are made, so exact copies of a third of all
rows cost one set per batch. Blocks hold about `block_tokens` tokens at any size of the corpus. Tokens of
`hot_sets` sets and more are not counted in a block: their frequency is estimated from one text in
`hot_one_in`, and being hot only moves a token to the end of the order, which any function of the token may
set. Broadcasts are these tokens (at most 10 000 times the mean size of a set) and a bitmap of at most
`bitmap_bits` bits, whose false positives only make step 2 count more sets.

Equal sets are told by a 64-bit hash and their size; at a billion distinct sets the chance of any
one false match is below 1 in 1000.

Edge cases: null texts and texts without words have an empty set, link with nothing and are their
own component; texts of fewer words than n have one token, their whole sequence; rows with null
doc_id count as sets but cannot name a component (they get null if alone); repeated rows come back
once each; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, materialise, row_key, scan, scratch, trim_memory
from .components import components

#: A random 64-bit value for every byte, the same for A-Z as for a-z; which bytes part words.
_BYTES = np.random.default_rng(21).integers(1, 2**63, size=256, dtype=np.uint64)[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE = 0x2545F4914F6CDD1D
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text whose powers are kept; longer texts are hashed in parts.
_PART = 1 << 18
_POWERS: list[np.ndarray] = []

SETS = "doc_id long, row_key long, n_shingles long, n_low long, set_id long, hot binary"
BLOCKS = "bucket int, sets binary, sizes binary, counts binary, tokens binary"


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h.copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> list[np.ndarray]:
    """At least the first n powers of _BASE and of its inverse modulo 2**64. Those of a part are kept; more, for a longer word, are not."""
    make = lambda size: [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    if n > _PART + 1:
        return make(n)
    if not _POWERS:
        _POWERS[:] = make(_PART + 1)
    return _POWERS


def hashes_of_part(raw: np.ndarray) -> np.ndarray:
    """The hash of every word of a text's bytes: a polynomial of their random values, from prefix sums."""
    blank = np.concatenate(([True], _BLANK[raw], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start])


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word, in text order. Long texts are cut at blanks into parts."""
    return hashes_of_bytes(np.frombuffer(text.encode("utf-8", "replace") if text else b"", np.uint8))


def hashes_of_bytes(raw: np.ndarray) -> np.ndarray:
    if len(raw) <= _PART:
        return hashes_of_part(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(at + _PART, len(raw))
        if end < len(raw):
            before = np.flatnonzero(_BLANK[raw[at:end]])
            if len(before):
                end = at + int(before[-1]) + 1
            else:
                while end < len(raw) and not _BLANK[raw[end]]:
                    end += 1
        out.append(hashes_of_part(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * _MULTIPLIERS[k]
    return np.unique(mix(out))


def set_id(tokens: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def need(n, percent: int):
    """The least number of common tokens of a set of n tokens with a partner."""
    return -(-percent * n // 100)


def may_link(n, percent: int):
    """Whether a set of n tokens can link with another than an equal set."""
    return 100 * n >= percent * (n + 1)


def low_part(tokens: np.ndarray, share: float) -> np.ndarray:
    """The sorted tokens in the lowest share of all hashes."""
    return tokens[: np.searchsorted(tokens, np.uint64(int(share * 2**64)))]


class Hot:
    """Tokens that very many sets hold, sorted, and their estimated frequencies."""

    def __init__(self, rows: list[tuple[int, int]] = ()):
        rows = sorted((t % (1 << 64), df) for t, df in rows)
        self.tokens, self.df = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32)

    def at(self, tokens: np.ndarray) -> np.ndarray:
        """A mask of the hot ones."""
        if not len(self.tokens):
            return np.zeros(len(tokens), bool)
        return self.tokens[np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)] == tokens

    @staticmethod
    def of(documents: DataFrame, n: int, least: int, one_in: int) -> Hot:
        """Tokens of about `least` sets and more, from one text in `one_in`, told by its hash; repeats count once a batch.

        Which tokens are hot decides only where they are counted. No token can be where there are fewer rows."""
        rows = documents.count()
        if rows < least:
            return Hot()
        least = max(least, rows // 10_000)

        def run(batches):
            for b in batches:
                sets = {set_id(x): x for t in b.column(1) if len(x := shingles(t.as_py(), n))}
                tokens = np.concatenate([*sets.values(), np.zeros(0, np.uint64)]).astype(np.int64)
                for i in range(0, len(tokens), 500_000):
                    yield arrow_batch("token long", [(t,) for t in tokens[i : i + 500_000].tolist()])
            trim_memory()

        some = scan(documents, "doc_id", "text").where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
        counts = some.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= max(2, least // one_in))
        return Hot([(t, min(c * one_in, 2**31 - 1)) for t, c in counts.toLocalIterator()])


def sets_of(documents: DataFrame, n: int, sampled: float, hot) -> DataFrame:
    """doc_id, n_shingles, how many of them are in the sampled part and not hot, set_id (null for an empty set) and hot tokens of every row."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, key in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                s = shingles(text.as_py(), n)
                is_hot = hot.value.at(s)
                rows.append((doc_id, key, len(s), len(low_part(s[~is_hot], sampled)), set_id(s) if len(s) else None, s[is_hot].tobytes() if is_hot.any() else None))
            yield arrow_batch(SETS, rows)
        trim_memory()

    return scan(documents.withColumn("row_key", row_key()), "doc_id", "text", "row_key").mapInArrow(run, SETS)


def blocks(documents: DataFrame, n: int, buckets: int, choose, bitmap=None) -> DataFrame:
    """BLOCKS of the tokens that choose(tokens) keeps, dealt by token modulo buckets.

    A block lists sets, their sizes, how many tokens of each follow, and these tokens. Repeated
    sets of a batch are listed once. With a bitmap, only documents whose id's bit is set."""

    def run(batches):
        for b in batches:
            ids, texts, seen, part = b.column(0).to_pylist(), b.column(1), set(), []
            held = 0
            for i, doc_id in enumerate(ids):
                if bitmap is not None and not bitmap.value.has(doc_id):
                    continue
                s = shingles(texts[i].as_py(), n)
                if not len(s) or (key := set_id(s)) in seen:
                    continue
                seen.add(key)
                chosen = choose(s)
                part.append((key, len(s), chosen))
                held += len(chosen)
                if held > 1_500_000:
                    yield pack(part, buckets)
                    part, held = [], 0
            if part:
                yield pack(part, buckets)
        trim_memory()

    return scan(documents, "doc_id", "text").mapInArrow(run, BLOCKS)


def pack(part: list[tuple[int, int, np.ndarray]], buckets: int):
    keys, sizes = np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.int32)
    owner, tokens = np.repeat(np.arange(len(part)), [len(p[2]) for p in part]), np.concatenate([p[2] for p in part])
    bucket = (tokens % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket, owner, tokens = bucket[order], owner[order], tokens[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = []
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=False):
        who, counts = np.unique(owner[a:z], return_counts=True)
        rows.append((int(bucket[a]), keys[who].tobytes(), sizes[who].tobytes(), counts.astype(np.int32).tobytes(), tokens[a:z].tobytes()))
    return arrow_batch(BLOCKS, rows)


def shared(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: (token, set, size, frequency) for tokens that more than one set holds."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    counts, tokens = read("counts", np.int32), read("tokens", np.uint64)
    keys, sizes = np.repeat(read("sets", np.int64), counts), np.repeat(read("sizes", np.int32), counts)
    order = np.lexsort((keys, tokens))
    tokens, keys, sizes = tokens[order], keys[order], sizes[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    tokens, keys, sizes = tokens[fresh], keys[fresh], sizes[fresh]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    df = np.diff(np.concatenate((first, [len(tokens)])))
    df = np.repeat(df, df)
    keep = df > 1
    return tokens[keep], keys[keep], sizes[keep], df[keep]


def shared_counts(table):
    """How many of each set's tokens in the bucket another set holds, where any."""
    _, keys, _, _ = shared(table)
    trim_memory()
    return arrow_table("set_id long, n_shared long", list(zip(*(x.tolist() for x in np.unique(keys, return_counts=True)), strict=True)))


def arrow_table(ddl: str, rows: list[tuple]):
    import pyarrow as pa

    return pa.Table.from_batches([arrow_batch(ddl, rows)])


FREQUENCIES = "set_id long, n int, tokens binary, df binary"


def frequencies(table):
    """Per set of a bucket: its shared tokens and their frequencies."""
    tokens, keys, sizes, df = shared(table)
    trim_memory()
    if not len(keys):
        return arrow_table(FREQUENCIES, [])
    order = np.argsort(keys, kind="stable")
    tokens, keys, sizes, df = tokens[order], keys[order], sizes[order], df[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    rows = [(int(keys[a]), int(sizes[a]), tokens[a:z].tobytes(), df[a:z].tobytes()) for a, z in zip(first, [*first[1:], len(keys)], strict=True)]
    return arrow_table(FREQUENCIES, rows)


class Bitmap:
    """Membership of ids by one bit of their hash; may say yes to others."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.bits = bits
        self.array = np.zeros(bits // 8, np.uint8)
        for k, raw in parts.items():
            self.array[k * 4096 : (k + 1) * 4096] = np.frombuffer(raw, np.uint8)

    @staticmethod
    def place(doc_id: int, bits: int) -> int:
        return (doc_id * 0x9E3779B97F4A7C15 % (1 << 64) >> 20) % bits

    def has(self, doc_id) -> bool:
        if doc_id is None:
            return True
        p = self.place(doc_id, self.bits)
        return bool(self.array[p >> 3] >> (p & 7) & 1)

    @staticmethod
    def of(ids: DataFrame, most_bits: int) -> Bitmap:
        """ids: a column doc_id. 16 bits for each id, up to most_bits."""
        bits = min(most_bits, max(1 << 15, 1 << (16 * ids.count()).bit_length()))

        def places(batches):
            for b in batches:
                yield arrow_batch("place long", [(Bitmap.place(i, bits),) for i in b.column(0).to_pylist()])

        at = ids.where("doc_id is not null").mapInArrow(places, "place long")
        # bitmap_bucket_number() counts from 1 and its buckets start at position 1
        parts = at.groupBy(F.expr("bitmap_bucket_number(place + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place + 1))").alias("bits"))
        return Bitmap(bits, {r["k"] - 1: bytes(r["bits"]) for r in parts.collect()})


def signatures(n: int, tokens: np.ndarray, df: np.ndarray, percent: int, rare: int) -> np.ndarray | None:
    """Signature hashes of a set of n tokens, of which tokens are shared by df sets, in the order (df, hash).

    None if the tokens of frequency 1 alone make the prefix, or nothing but an equal set can link."""
    tau, alone = n - need(n, percent), n - len(tokens)
    want = tau + 1 - alone
    if want <= 0 or not may_link(n, percent):
        return None
    n_rare = int(np.searchsorted(df, rare, side="right"))
    out = [mix(tokens[: min(want, n_rare)] ^ np.uint64(0x5851F42D4C957F2D))]
    want -= n_rare
    if want > 0:
        band = math.floor(math.log(n) / math.log(100 / percent) + 1e-9)
        frequent = tokens[n_rare:]
        for scheme in (band, band + 1):
            classes = classes_of(scheme, percent)
            cls = (frequent >> np.uint64(17)) % np.uint64(classes)
            seen, members = 0, {}
            pairs_a, pairs_b = [], []
            for token, c in zip(frequent.tolist(), cls.tolist(), strict=True):
                if seen >= want:
                    break
                before = members.setdefault(c, [])
                pairs_a += before
                pairs_b += [token] * len(before)
                seen += bool(before)
                before.append(token)
            if pairs_a:
                a, b = np.array(pairs_a, np.uint64), np.array(pairs_b, np.uint64)
                out.append(mix(np.minimum(a, b) * np.uint64(0xA0761D6478BD642F) + np.maximum(a, b) + np.uint64(scheme)))
    return np.unique(np.concatenate(out))


def classes_of(scheme: int, percent: int) -> int:
    """So many classes of frequent tokens that a prefix has about four of each; never so many that n tokens could not be covered."""
    return max(1, int((100 / percent) ** scheme * (100 - percent) / 400))


CANDIDATES = "set_id long, n int, tokens binary, sigs array<long>"


def candidates(merged: DataFrame, percent: int, rare: int, hot) -> DataFrame:
    """CANDIDATES from rows (set_id, n, tokens list, df list, hot tokens): sets that have signatures; tokens sorted by value."""

    def run(batches):
        for b in batches:
            rows = []
            for key, n, tokens, df, of_hot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t, f = np.frombuffer(b"".join(tokens), np.uint64), np.frombuffer(b"".join(df), np.int32)
                if of_hot:
                    more = np.frombuffer(of_hot, np.uint64)
                    t, f = np.concatenate((t, more)), np.concatenate((f, hot.value.df[np.searchsorted(hot.value.tokens, more)]))
                order = np.lexsort((t, f))
                sigs = signatures(n, t[order], f[order], percent, rare)
                if sigs is not None and len(sigs):
                    rows.append((key, n, np.sort(t).tobytes(), sigs.astype(np.int64).tolist()))
            yield arrow_batch(CANDIDATES, rows)
        trim_memory()

    return merged.mapInArrow(run, CANDIDATES)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with linked: whether the sets reach the similarity."""
    side = lambda k: sets.select(F.col("set_id").alias(k), F.col("n").alias("n" + k), F.col("tokens").alias("t" + k))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    ddl = "a long, b long, linked boolean"

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, na, ta, nb, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "ta", "nb", "tb")), strict=True):
                x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                rows.append((a, b, 100 * common >= percent * (na + nb - common)))
            yield arrow_batch(ddl, rows)

    return joined.select("a", "b", "na", "ta", "nb", "tb").mapInArrow(run, ddl).where("linked").select("a", "b")


def can_reach(percent: int, nx, sx, ny, sy):
    """Whether sets of nx and ny tokens, of which sx and sy are shared with any set at all, may reach the similarity."""
    return (100 + percent) * F.least(sx, sy) >= percent * (nx + ny)


def with_partners(spread: DataFrame, percent: int) -> DataFrame:
    """spread without rows that can't reach even the smallest set of their signature, and without lone rows; m: the signature's sets."""
    least = spread.groupBy("sig").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return spread.join(least, "sig").where((100 + percent) * F.col("s") >= percent * (F.col("n") + F.col("least"))).drop("least")


#: The documents of a component are dealt over so many tasks.
ROOT_SALTS = 16
#: Rows of a key in one task at most, about, where a hot key is dealt over salts.
SALT_ROWS = 256


def to_pivots(now: DataFrame, pivots: DataFrame, by: str = "a") -> DataFrame:
    """now (sig, m, ...) joined to rows of its signatures (sig, m, ...); the rows of a frequent signature are dealt over salts."""
    salts = F.ceil(F.col("m") / SALT_ROWS).cast("int")
    spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("m")
    return now.withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).join(spread, ["sig", "salt"]).drop("salt")


LINKS = "a long, b long"


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """(len(a), len(b)) sizes of the intersections of sorted distinct token arrays, by products of 0/1 matrices."""
    every = [*a, *b]
    tokens, owner = np.concatenate(every), np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[place]
    place, owner = (np.cumsum(shared) - 1)[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner, out = place[order], owner[order], np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(place, [low, low + width])
        part = np.zeros((len(every), width), np.float32)
        part[owner[i:j], place[i:j] - low] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return np.rint(out).astype(np.int64)


def links_of_block(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between different components among rows (block, set_id, comp, n, tokens): within the one
    block there is, or between two. Only links that join what was apart in these rows are listed."""
    first = min(r[0] for r in rows)
    a = [r for r in rows if r[0] == first]
    b = [r for r in rows if r[0] != first] or a
    na, nb = (np.array([r[3] for r in x]) for x in (a, b))
    common = intersections(*([np.frombuffer(r[4], np.uint64) for r in x] for x in (a, b)))
    linked = (100 + percent) * common >= percent * (na[:, None] + nb[None, :])
    linked &= np.array([r[2] for r in a])[:, None] != np.array([r[2] for r in b])[None, :]
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(a[i][2]), find(b[j][2])
        if x != y:
            up[x] = y
            out.append((a[i][1], b[j][1]))
    return out


def settle(now: DataFrame, sets: DataFrame, percent: int, block_sets: int = 256) -> DataFrame:
    """Links between all sets of different components that share an unsettled signature.

    The sets that hang together by signatures are a cluster. Small clusters share tasks; a larger
    one is dealt into blocks, and every pair of blocks is compared in a task of its own."""
    spark = sets.sparkSession
    heads = now.groupBy("sig").agg(F.max("m").alias("m"), F.min("set_id").alias("b"))
    cluster = components(to_pivots(now.select("sig", "m", F.col("set_id").alias("a")), heads).select("a", "b"), "jaccard-clusters").select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    sizes = cluster.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block_sets).cast("int").alias("blocks"))
    groups = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = now.select("set_id", "comp").distinct().join(cluster, "set_id").join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.select("set_id", "n", "tokens"), "set_id")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(F.col("cluster")).alias("g"),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cluster", "block", "set_id", "comp", "n", "tokens",
    )

    def compare(table):
        from itertools import groupby

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("cluster", "block", "set_id", "comp", "n", "tokens")), strict=True), key=lambda r: r[0])
        out = []
        for _, part in groupby(rows, key=lambda r: r[0]):
            out += links_of_block([r[1:] for r in part], percent)
        return arrow_table(LINKS, out)

    return keyed.groupBy("g", "i", "j").applyInArrow(compare, LINKS)


def linked_sets(sets: DataFrame, percent: int, rounds: int, few: int = 4096) -> DataFrame | None:
    """set_id and root for sets that link with another one; None if there is no candidate.

    Pivots are tried for up to `rounds` rounds, while each leaves at most 7 of 10 signature rows open and more than `few`."""
    spread = sets.select("set_id", "n", (F.octet_length("tokens") / 8).cast("int").alias("s"), F.explode("sigs").alias("sig"))
    held = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("set_id") % (1 << 40)).alias("h"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("x"))
    busy = held.where("m > 1").groupBy("m", "h", "x").agg(F.min("sig").alias("sig")).select("sig")
    # written between the two: a sum right behind a join on its own key would keep a skewed join from being split
    spread, label = materialise(spread.join(busy, "sig"), "jaccard-shared-signatures"), None
    spread = materialise(with_partners(spread, percent), "jaccard-signatures")
    before = None
    for k in range(rounds + 1):
        now = spread.withColumn("comp", F.col("set_id")) if label is None else spread.join(label, "set_id", "left").withColumn("comp", F.coalesce("root", "set_id")).drop("root")
        per = now.groupBy("sig").agg(F.max("m").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("sig", "m")
        now = materialise(to_pivots(now, per, "set_id"), "jaccard-open")
        is_open = now.count()
        if not is_open:
            break
        if last := k == rounds or is_open <= few or (before is not None and is_open > 0.7 * before):
            found = settle(now, sets, percent)
        else:
            central = F.struct(F.floor(-20 * F.col("s") / F.col("n")), F.xxhash64("set_id", F.lit(k)))
            pivots = now.groupBy("sig").agg(F.max("m").alias("m"), F.min_by(F.struct(F.col("set_id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("s").alias("sb")), central).alias("p")).select("sig", "m", "p.*")
            pairs = to_pivots(now.select("sig", "m", F.col("set_id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("s").alias("sa")), pivots)
            pairs = pairs.where("ca <> cb").where(can_reach(percent, F.col("na"), F.col("sa"), F.col("nb"), F.col("sb")))
            found = verify(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent)
        before, found = is_open, materialise(found, "jaccard-links")
        if label is not None:
            names = lambda x: label.select(F.col("set_id").alias(x), F.col("root").alias("r" + x))
            found = found.join(names("a"), "a", "left").join(names("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        root = components(found, "jaccard-components")
        if label is None:
            label = root.select(F.col("node").alias("set_id"), "root")
        else:
            moved = label.select("set_id", F.col("root").alias("node")).join(root, "node", "left").select("set_id", F.coalesce("root", "node").alias("root"))
            label = moved.unionByName(root.select(F.col("node").alias("set_id"), "root").join(label, "set_id", "left_anti"))
        label = materialise(label, "jaccard-labels")
        if last:
            break
    return label


def near_duplicates(documents: DataFrame, **params) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    keyed = components_of_rows(documents, **params).withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(ROOT_SALTS)).cast("int"))
    lowest = keyed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    lowest = lowest.select("root", "low", F.explode(F.sequence(F.lit(0), F.lit(ROOT_SALTS - 1))).alias("salt"))
    return keyed.join(lowest, ["root", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def further_rows(documents: DataFrame, **params) -> DataFrame:
    """doc_id, row_key, first of the rows that are not the first of their component, and of repeats of the first row.

    Rows of a component go by doc_id, nulls last, then by row_key; first says that the row has the id and key of the first one
    and is there more than once. Rows without words have no component and are not listed."""
    keyed = components_of_rows(documents, **params).where("root is not null").withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(ROOT_SALTS)).cast("int"))
    keyed = keyed.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    lowest = keyed.groupBy("root").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    lowest = lowest.select("root", "low", F.explode(F.sequence(F.lit(0), F.lit(ROOT_SALTS - 1))).alias("salt"))
    joined = keyed.join(lowest, ["root", "salt"]).select("doc_id", "row_key", (F.col("place") == F.col("low")).alias("first"))
    counted = joined.groupBy("doc_id", "row_key", "first").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("not first or n > 1").select("doc_id", "row_key", "first")


def components_of_rows(documents: DataFrame, n: int = 5, percent: int = 75, sampled: float = 0.35, rare: int = 24, rounds: int = 6, block_tokens: int = 4_000_000, bitmap_bits: int = 1 << 29, hot_sets: int = 200_000, hot_one_in: int = 256) -> DataFrame:
    """doc_id, row_key (of id and text), n_shingles and root (null without words, else the same for a component's rows) of every row."""
    with scratch(documents.sparkSession, "jaccard-sets", "jaccard-labels"):
        docs, label = labelled(documents, n, percent, sampled, rare, rounds, block_tokens, bitmap_bits, hot_sets, hot_one_in)
    keyed = docs.select("doc_id", "row_key", "n_shingles", "set_id")
    keyed = keyed.join(label, "set_id", "left") if label is not None else keyed.withColumn("root", F.lit(None).cast("long"))
    return keyed.withColumn("root", F.coalesce("root", "set_id"))


def labelled(documents: DataFrame, n: int, percent: int, sampled: float, rare: int, rounds: int, block_tokens: int, bitmap_bits: int, hot_sets: int, hot_one_in: int) -> tuple[DataFrame, DataFrame | None]:
    """SETS of every row, and set_id and root of the sets that link with others."""
    spark = documents.sparkSession
    hot = spark.sparkContext.broadcast(Hot.of(documents, n, hot_sets, hot_one_in))
    docs = materialise(sets_of(documents, n, sampled, hot), "jaccard-sets")
    reps = docs.where(may_link(F.col("n_shingles"), percent)).groupBy("set_id", "n_shingles", "n_low").agg(F.min("doc_id").alias("rep"))
    tokens = docs.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = lambda share: int(max(48, min(1 << 30, tokens * share // block_tokens)))
    cold = lambda s: s[~hot.value.at(s)]
    low = blocks(documents, n, buckets(sampled), lambda s: low_part(cold(s), sampled))
    shared_by = low.groupBy("bucket").applyInArrow(shared_counts, "set_id long, n_shared long").groupBy("set_id").agg(F.sum("n_shared").alias("n_shared"))
    tau = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100)
    some = reps.join(shared_by, "set_id", "left").where(F.coalesce("n_shared", F.lit(0)) >= F.col("n_low") - tau)
    ids = materialise(some.select(F.col("rep").alias("doc_id")), "jaccard-sharing")
    bitmap = spark.sparkContext.broadcast(Bitmap.of(ids, bitmap_bits))
    counted = blocks(documents, n, buckets(1), cold, bitmap).groupBy("bucket").applyInArrow(frequencies, FREQUENCIES)
    if len(hot.value.tokens):
        of_hot = docs.where("hot is not null").groupBy("set_id").agg(F.max("n_shingles").cast("int").alias("n"), F.max("hot").alias("hot"))
        counted = counted.unionByName(of_hot, allowMissingColumns=True)
    else:
        counted = counted.withColumn("hot", F.lit(None).cast("binary"))
    merged = counted.groupBy("set_id").agg(F.max("n").alias("n"), F.collect_list("tokens").alias("tokens"), F.collect_list("df").alias("df"), F.max("hot").alias("hot"))
    sets = materialise(candidates(merged, percent, rare, hot), "jaccard-candidates")
    return docs, linked_sets(sets, percent, rounds)


def op8_jaccard(spark, sf_dir):
    """doc_id, n_shingles, component_id of every document; nulls, empty texts and ties as in near_duplicates."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
