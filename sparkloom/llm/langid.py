"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

The network reads every byte of a text. Texts of up to `SEGMENT` bytes are one run. Longer ones are cut into
equal segments of at most so many, and each is run together with the `WARM` bytes on either side, whose
positions count in their own segment only, so that no position begins from a blank state but at the text's
ends. `segment=None` runs every text unbroken, however long; README gives the difference and the cost. Rows of
similar length form batches. Every position gets a probability for every language, and a document's
probabilities are the means over its positions. Training is backpropagation through time in
numpy, on the driver, from a bounded sample: about `per_language` documents of each language, drawn by hash
of the id over the whole table, `segments` stretches of `TRAIN` bytes spread over each one's whole text, and
`steps` batches. Prediction is one narrow pass over all documents with the broadcast weights.

Edge cases: null texts and texts without a letter get `und` with score 0; rows with null lang are
not learned from; without any language to learn, every document is `und` with score 0; repeated
rows are predicted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, crc_of_id, materialise, scan, scratch, trim_memory

SEGMENT, WARM, TRAIN = 8192, 256, 96
#: Bytes of a block of rows that are run together, and rows of it, at most.
CELLS, ROWS = 2_000_000, 2048
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double"


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's letter categories occurs."""
    return any(map(str.isalpha, text))


class BiGRU:
    """Two GRUs of `hidden` units over one-hot bytes and a softmax at every position; float32.

    Gates stand in one matrix of 3 * hidden columns: update, reset, candidate. Byte 256 is padding, where states are zero."""

    def __init__(self, hidden: int, classes: int, seed: int = 3):
        rng, h = np.random.default_rng(seed), hidden
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.hidden = h
        self.p = {k: v for d in "fb" for k, v in ((f"W{d}", normal(0.3, 257, 3 * h)), (f"U{d}", normal(h**-0.5, h, 3 * h)))}
        self.p |= {"V": normal((2 * h) ** -0.5, 2 * h, classes), "c": np.zeros(classes, np.float32)}

    def direction(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, rows, hidden) of one direction over x (steps, rows); keep gathers what BPTT needs."""
        h, w, u = self.hidden, self.p[f"W{d}"], self.p[f"U{d}"]
        state, out = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, r = w.take(x[t], axis=0), state @ u
            zr = a[:, : 2 * h]
            zr += r[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            n = r[:, 2 * h :] * zr[:, h:]
            n += a[:, 2 * h :]
            np.tanh(n, out=n)
            new = state - n
            new *= zr[:, :h]
            new += n
            new *= (x[t] < 256)[:, None]
            if keep is not None:
                keep.append((t, state, zr, n, r[:, 2 * h :]))
            state = out[t] = new
        return out

    def segment_sums(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(classes, rows): probabilities of the positions of bytes x (steps, rows) where counts is 1, summed over the steps.

        As direction() and a softmax, with features before rows, so that every gate is contiguous."""
        h, rows = self.hidden, x.shape[1]
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * h, h])  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        v, forward, a = self.p["V"].T.copy(), np.empty((len(x), h, rows), np.float32), np.empty((3 * h, rows), np.float32)
        sums, real = np.zeros((v.shape[0], rows), np.float32), (x < 256) if x.max() == 256 else None
        for d in "fb":
            w, u = (np.ascontiguousarray((self.p[k + d] * half).T) for k in "WU")
            state = np.zeros((h, rows), np.float32)
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                w.take(x[t], axis=1, out=a, mode="clip")
                r = u @ state
                zr, n = a[: 2 * h], a[2 * h :]
                zr += r[: 2 * h]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                rn = r[2 * h :]
                rn *= zr[h:]
                n += rn
                np.tanh(n, out=n)
                state = np.subtract(state, n, out=forward[t] if d == "f" else None)
                state *= zr[:h]
                state += n
                if real is not None:
                    state *= real[t]
                if d == "b":
                    p = v[:, :h] @ forward[t]
                    p += v[:, h:] @ state
                    p += self.p["c"][:, None]
                    p -= p.max(axis=0)
                    np.exp(p, out=p)
                    p *= counts[t] / p.sum(axis=0)
                    sums += p
        return sums

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions that are not padding, and its gradients."""
        h, kept = self.hidden, {"f": [], "b": []}
        states = {d: self.direction(d, x, kept[d]) for d in "fb"}
        both = np.concatenate((states["f"], states["b"]), axis=2)
        logits = both @ self.p["V"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        real = (x < 256).astype(np.float32) / max(1, (x < 256).sum())
        loss = float(-(np.log(np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2))[..., 0] * real).sum())
        delta = prob
        np.put_along_axis(delta, np.broadcast_to(y[None, :, None], (*x.shape, 1)), np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2) - 1, 2)
        delta *= real[..., None]
        flat = delta.reshape(-1, delta.shape[2])
        g = {"V": both.reshape(-1, 2 * h).T @ flat, "c": flat.sum(axis=0)}
        back = delta @ self.p["V"].T
        order = np.argsort(x.ravel(), kind="stable")
        values, first = np.unique(x.ravel()[order], return_index=True)
        for d, part in (("f", back[..., :h]), ("b", back[..., h:])):
            u, carry = self.p[f"U{d}"], np.zeros((x.shape[1], h), np.float32)
            gu, ga = np.zeros_like(u), np.empty((*x.shape, 3 * h), np.float32)
            for t, state, zr, n, rn in reversed(kept[d]):
                z, r = zr[:, :h], zr[:, h:]
                dh = (part[t] + carry) * (x[t] < 256)[:, None]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (state - n) * z * (1 - z)
                dr = dn * rn * r * (1 - r)
                ga[t, :, :h], ga[t, :, h : 2 * h], ga[t, :, 2 * h :] = dz, dr, dn
                at_u = np.concatenate((dz, dr, dn * r), axis=1)
                gu += state.T @ at_u
                carry = dh * z + at_u @ u.T
            g[f"U{d}"], gw = gu, np.zeros_like(self.p[f"W{d}"])
            gw[values] = np.add.reduceat(ga.reshape(-1, 3 * h)[order], first, axis=0)
            g[f"W{d}"] = gw
        return loss, g


def train(segments: np.ndarray, y: np.ndarray, classes: int, hidden: int = 8, steps: int = 700, batch: int = 128, rate: float = 0.02, seed: int = 3) -> BiGRU:
    """A network trained by Adam on (rows, TRAIN) bytes, with every class drawn equally often."""
    net, rng = BiGRU(hidden, classes, seed), np.random.default_rng(seed)
    by_class = [np.flatnonzero(y == k) for k in range(classes)]
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, -(-batch // classes)) for c in by_class])
        _, g = net.gradients(np.ascontiguousarray(segments[pick].T), y[pick])
        norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
        for k, a in g.items():
            a *= min(1, 1 / (norm + 1e-9))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a * a - v[k])
            net.p[k] -= np.float32(rate * min(1, 2 - 2 * t / steps)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return net


def raw_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)


def stretches(text: str, count: int, size: int = TRAIN) -> np.ndarray:
    """Up to `count` rows of `size` bytes spread over a text, from the first byte of a character on, padded with 256; int16."""
    raw = raw_of(text)
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    at = np.unique(first[np.searchsorted(first, np.linspace(0, max(0, len(raw) - size), count).astype(int))])
    out = np.full((len(at), size), 256, dtype=np.int16)
    for row, i in zip(out, at, strict=True):
        part = raw[i : i + size]
        row[: len(part)] = part
    return out


def segments_of(raw: np.ndarray, size: int | None = SEGMENT, warm: int = WARM) -> list[tuple[int, int, int, int]]:
    """(from, first counted, behind the last counted, to) of the segments of a text's bytes."""
    k = -(-len(raw) // (size or len(raw)))
    cuts = [len(raw) * i // k for i in range(k + 1)]
    return [(max(0, a - warm), a, z, min(len(raw), z + warm)) for a, z in zip(cuts, cuts[1:], strict=False)]


def pooled(net: BiGRU, texts: list[str], size: int | None = SEGMENT, warm: int = WARM) -> np.ndarray:
    """Mean probabilities of each text over all its bytes; segments of similar length form a block."""
    raws = [raw_of(t) for t in texts]
    parts = sorted(((z - a, i, a, b, c, z) for i, raw in enumerate(raws) for a, b, c, z in segments_of(raw, size, warm)), reverse=True)
    sums, at = np.zeros((len(texts), len(net.p["c"]))), 0
    while at < len(parts):
        longest = parts[at][0]
        some = parts[at : at + max(1, min(ROWS, CELLS // longest))]
        at += len(some)
        x, counts = np.full((len(some), longest), 256, np.int16), np.zeros((len(some), longest), np.float32)
        for j, (n, i, a, b, c, z) in enumerate(some):
            x[j, :n] = raws[i][a:z]
            counts[j, b - a : c - a] = 1
        np.add.at(sums, [p[1] for p in some], net.segment_sums(np.ascontiguousarray(x.T), np.ascontiguousarray(counts.T)).T)
    return sums / sums.sum(axis=1, keepdims=True)


def is_held_out(c: Column) -> Column:
    return F.coalesce(F.pmod(crc_of_id(c), F.lit(4)) == 2, F.lit(False))


def sample(documents: DataFrame, per_language: int, segments: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages, (rows, TRAIN) bytes and class numbers of the training sample."""
    docs = scan(documents, "doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    docs = docs.where(~is_held_out(F.col("doc_id")))
    narrow = docs.select("doc_id", "lang")
    bars = materialise(narrow.groupBy("lang").agg((per_language / F.count(F.lit(1))).alias("bar")), "languages")
    bars = F.broadcast(bars) if bars.count() <= 100_000 else bars
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / float(1 << 52)
    ids = materialise(narrow.join(bars, "lang").where(place < F.col("bar")).select("doc_id", "lang").distinct(), "language-sample")
    n = ids.count()
    if not n:
        return [], np.zeros((0, TRAIN), np.int16), np.zeros(0, np.int64)
    ddl = "place long, lang string, bytes binary"

    def take(batches):
        for b in batches:
            rows = []
            for at, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if has_letter(text):
                    rows.append((at, lang, stretches(text, segments).tobytes()))
            yield arrow_batch(ddl, rows)

    # about per_language ids a language; a table of very many languages is joined instead of broadcast
    picked = docs.join(F.broadcast(ids) if n <= 1_000_000 else ids, ["doc_id", "lang"], "left_semi").select(F.xxhash64("doc_id", "text").alias("place"), "lang", "text")
    got = picked.mapInArrow(take, ddl).dropDuplicates(["place", "lang"]).orderBy("place", "lang").limit(2 * n).collect()
    got.sort(key=lambda r: (r[1], r[0]))
    langs = sorted({r[1] for r in got})
    number = {lang: i for i, lang in enumerate(langs)}
    x = [np.frombuffer(bytes(r[2]), dtype=np.int16).reshape(-1, TRAIN) for r in got]
    y = np.repeat([number[r[1]] for r in got], [len(a) for a in x]) if x else np.zeros(0, np.int64)
    return langs, np.concatenate(x) if x else np.zeros((0, TRAIN), np.int16), np.asarray(y, dtype=np.int64)


def fit(documents: DataFrame, per_language: int = 500, segments: int = 12, **params) -> tuple[list[str], BiGRU | None]:
    with scratch(documents.sparkSession):
        langs, x, y = sample(documents, per_language, segments)
    return langs, train(x, y, len(langs), **params) if len(langs) else None


def predict(documents: DataFrame, model: tuple[list[str], BiGRU | None], segment: int | None = SEGMENT) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, net = shared.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = {}
            todo = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
            while todo:
                some, size = [], 0
                while todo and size < 4_000_000:
                    some.append(todo.pop())
                    size += len(texts[some[-1]])
                for i, p in zip(some, pooled(net, [texts[i] for i in some], segment), strict=True):
                    out[i] = (langs[int(p.argmax())], float(p.max()))
            yield arrow_batch(PREDICTED, [(doc_id, *out.get(i, (UNKNOWN, 0.0))) for i, doc_id in enumerate(ids)])
        trim_memory()

    return scan(documents, "doc_id", "text").mapInArrow(run, PREDICTED)


def identify(documents: DataFrame, **params) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score."""
    out = predict(documents, fit(documents, **params))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred, score of every document; nulls, empty and long texts as stated above."""
    from .common import table

    return identify(table(spark, sf_dir, "documents"))
