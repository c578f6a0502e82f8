"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

Words are counted over all training rows, by 64-bit hash (a table that grows with the corpus). The output is factored by
classes: the `vocab` most frequent words and the end are classes of their own; any other word belongs to one of CLASSES
classes by its last two bytes, and has its share of the class's counts (add one half, one more share for all unseen
words of the class). So every word of the corpus takes part, as context by its class, and the probabilities of all words
and the end sum to one.

With context classes u (two before) and v (one before), the score of class w is (R[u] C2 + R[v] C1) . Q[w] + b[w].
Training rows are dealt to shards of about `shard` tokens by a hash of the row and lie in its order; a copy of the model
is trained on each shard, on every position, by noise-contrastive estimation with noise words shared by a batch; the
copies are averaged, `rounds` times, by sums of fixed-point numbers, so that the model depends on neither the partitions of the
input nor the order of tasks. Because the score is a sum of two tables A2[u, w] + A1[v, w] + b[w], the normaliser of
all contexts is one matrix product, log(exp(A2) diag(exp b) exp(A1)'), and a token's log-probability is four look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold_of, materialize, with_row
from .shingles import buffers, slices, word_hashes, word_places

END = 1  # the hash that stands for the end; a class's number as well
CLASSES = 509
LN10 = float(np.log(10.0))
FIXED = 1 << 24


def start(base: np.ndarray, dim: int, seed: int = 7) -> list[np.ndarray]:
    """R, C1, C2, Q, b at the beginning; base: log of the unigram probabilities."""
    g, n = np.random.default_rng(seed), len(base)
    return [g.normal(0, 0.1, (n, dim)).astype("f4"), np.eye(dim, dtype="f4"), 0.5 * np.eye(dim, dtype="f4"), g.normal(0, 0.1, (n, dim)).astype("f4"), base.astype("f4")]


def summed(at: np.ndarray, x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Rows of x added up at the rows `at` of a matrix."""
    flat = at[:, None].astype("i8") * shape[1] + np.arange(shape[1])
    return np.bincount(flat.ravel(), x.ravel(), shape[0] * shape[1]).reshape(shape).astype("f4")


class Trainer:
    """Adagrad on the loss of noise-contrastive estimation, batch by batch."""

    def __init__(self, params: list[np.ndarray], noise: np.ndarray, k: int = 50, rate: float = 0.1, seed: int = 1):
        self.p, self.k, self.rate = [x.copy() for x in params], k, rate
        self.sq = [np.full(x.shape, 1e-6, "f4") for x in params]
        self.cum, self.logk = np.cumsum(noise), np.log(k * np.maximum(noise, 1e-12)).astype("f4")
        self.rng, self.seen, self.steps = np.random.default_rng(seed), 0, 0
        self.wait: list[np.ndarray] = []

    def batch(self) -> int:
        """Small batches first, when every step counts."""
        return 512 if self.steps < 128 else 4096

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        R, C1, C2, Q, b = self.p
        m = len(w)
        neg = np.searchsorted(self.cum, self.rng.random(self.k) * self.cum[-1]).clip(max=len(b) - 1)
        ru, rv, qw, qn = R[u], R[v], Q[w], Q[neg]
        h = ru @ C2 + rv @ C1
        with np.errstate(over="ignore"):
            gp = (1 / (1 + np.exp(-(np.einsum("ij,ij->i", h, qw) + b[w] - self.logk[w]))) - 1).astype("f4")
            gn = (1 / (1 + np.exp(-(h @ qn.T + b[neg] - self.logk[neg])))).astype("f4")
        dh = gp[:, None] * qw + gn @ qn
        grads = [
            summed(np.concatenate((u, v)), np.concatenate((dh @ C2.T, dh @ C1.T)), R.shape), rv.T @ dh, ru.T @ dh,
            summed(np.concatenate((w, neg)), np.concatenate((gp[:, None] * h, gn.T @ h)), Q.shape),
            np.bincount(w, gp, len(b)).astype("f4") + np.bincount(neg, gn.sum(0), len(b)).astype("f4"),
        ]
        for x, s, d in zip(self.p, self.sq, grads):
            d /= m
            s += d * d
            x -= self.rate * d / np.sqrt(s)
        self.seen += m
        self.steps += 1

    def texts(self, held: list[np.ndarray], last: bool) -> None:
        """Train on whole texts; tokens that do not fill a batch wait for the next ones, with their contexts."""
        if held:
            ids = np.concatenate(held)
            new = (*contexts(ids), ids)
            self.wait = [np.concatenate(x) for x in zip(self.wait, new)] if self.wait else [*new]
        at, n = 0, len(self.wait[0]) if self.wait else 0
        while n - at >= self.batch() or last and at < n:
            e = min(at + self.batch(), n)
            self.step(*(x[at:e] for x in self.wait))
            at = e
        self.wait = [x[at:] for x in self.wait]


def tables(params: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A2, A1, b and log Z over all contexts (u, v), in one batched product."""
    R, C1, C2, Q, b = (x.astype("f8") for x in params)
    a2, a1 = (R @ C2) @ Q.T, (R @ C1) @ Q.T
    m2, m1 = a2.max(1, keepdims=True), a1.max(1, keepdims=True)
    z = np.log((np.exp(a2 - m2) * np.exp(b)) @ np.exp(a1 - m1).T) + m2 + m1.T
    return a2.astype("f4"), a1.astype("f4"), b.astype("f4"), z.astype("f4")


def contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a run of whole texts, each closed by its end, the class two before and the one before; before a
    text stands the end, twice."""
    v = np.concatenate((np.full(1, END, ids.dtype), ids[:-1]))
    u = np.concatenate((np.full(1, END, ids.dtype), v[:-1]))
    u[v == END] = END
    return u, v


def ending(texts: pa.Array) -> np.ndarray:
    """The class of each word by its last two bytes, A-Z lower-cased; from 0."""
    data, at = buffers(texts)
    if not len(data):
        return np.zeros(0, "i8")
    first, last, _ = word_places(data, at)
    low = np.frombuffer(bytes(range(256)).lower(), "u1")
    return (256 * np.where(last > first, low[data[last - 1]], 0).astype("i8") + low[data[last]]) % CLASSES


@dataclass
class Vocabulary:
    """Sorted hashes of the frequent words with their counts; those of the inner words with their classes; log10 of the
    weight of each of the other classes."""

    known: np.ndarray
    count: np.ndarray
    inner: np.ndarray
    number: np.ndarray
    log_left: np.ndarray

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of words by hash, -1 if a word is not among the frequent ones."""
        if not len(self.known):
            return np.full(len(h), -1)
        i = np.searchsorted(self.known, h).clip(max=len(self.known) - 1)
        return np.where(self.known[i] == h, self.count[i], -1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(classes of all texts' tokens, where each text begins, word hashes, where each text's words begin)"""
        h, at = word_hashes(texts, True)
        cls = 2 + len(self.inner) + ending(texts)
        if len(self.inner) and len(h):
            i = np.searchsorted(self.inner, h).clip(max=len(self.inner) - 1)
            cls = np.where(self.inner[i] == h, self.number[i], cls)
        docs = len(at) - 1
        ids = np.full(len(h) + docs, END, "u2")
        ids[np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(at))] = cls
        return ids, at[:-1] + np.arange(docs), h, at


def count_words(train: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(h, cls, c): how often each word, and the end, occurs in the column text."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            h, cls = (np.concatenate(x) for x in zip(*held))
            held.clear()
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_pydict({"h": pa.array(h.view("i8")), "cls": pa.array(cls[first].astype("i4")), "n": pa.array(n.astype("i8"))})

        size = 0
        for b in batches:
            for part in slices(b, 0):
                h = word_hashes(part.column(0), True)[0]
                held.append((np.concatenate((h, np.full(part.num_rows, END, "u8"))), np.concatenate((ending(part.column(0)), np.full(part.num_rows, -1)))))
                size += len(held[-1][0])
                if size > most:
                    yield out()
                    size = 0
        if held:
            yield out()

    return train.select("text").mapInArrow(local, "h long, cls int, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("c"))


def trained(encoded: DataFrame, model: list[np.ndarray], noise: np.ndarray, shards: int, shard: int, turn: int) -> list[np.ndarray]:
    """The mean of the copies of the model that are trained on each shard of (h, ids)."""
    at = encoded.sparkSession.sparkContext.broadcast((model, noise))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trainer(*at.value, seed=turn + 1)
        held: list = []
        size = 0
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(np.frombuffer(x, "u2"))
                size += len(held[-1])
                if size > 1 << 18:
                    t.texts(held, False)
                    held, size = [], 0
        t.texts(held, True)
        if t.seen:
            weight = -(-64 * t.seen // shard)
            x = np.rint(np.concatenate([p.ravel() for p in t.p]).astype("f8") * FIXED).astype("i8") * weight
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(-1, len(x)).astype("i4")), "x": pa.array(np.concatenate(([weight], x)))})

    dealt = encoded.repartition(shards, "h").sortWithinPartitions("h", "ids")
    got = dealt.select("ids").mapInArrow(learn, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i").x.to_numpy("i8")
    at.unpersist()
    flat, out, i = (got[1:] / got[0] / FIXED).astype("f4"), [], 0
    for p in model:
        out.append(flat[i : i + p.size].reshape(p.shape))
        i += p.size
    return out


def fit(train: DataFrame, vocab: int = 1022, dim: int = 16, rounds: int = 2, share: int = 1_000_000, shard: int = 4_000_000) -> tuple[DataFrame, int, int, Vocabulary, list[np.ndarray]]:
    """(counts, tokens, distinct tokens, vocabulary, parameters) of the rows (doc_id, text)."""
    counts = materialize(count_words(train), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total.n, total.v
    known = counts.where((F.col("c") > n / share) & (F.col("h") != END)).toPandas()
    h, c, cls = known.h.to_numpy("i8").view("u8"), known.c.to_numpy("i8"), known.cls.to_numpy("i8")
    order = np.lexsort((h, -c))
    top = order[:vocab]
    ends = counts.where(F.col("h") == END).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    # what all words of a class weigh, inner words left out, and one share for those unseen
    left = np.full(CLASSES, 0.5)
    for r in counts.where("cls >= 0").groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        left[r.cls] += r.c + 0.5 * r.v
    left -= np.bincount(cls[top], c[top] + 0.5, CLASSES)
    by_hash, rank = np.argsort(h), np.argsort(h[top])
    vocabulary = Vocabulary(h[by_hash], c[by_hash], h[top][rank], 2 + rank, np.log10(left))
    of = np.concatenate(([0.5, ends + 0.5], c[top] + 0.5, left))
    uni = of / of.sum()
    model = start(np.log(uni), dim)
    if n and rounds:
        spark = train.sparkSession
        at = spark.sparkContext.broadcast(vocabulary)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in slices(b, 1):
                    ids, begin, *_ = at.value.encode(part.column(1))
                    stop = np.append(begin[1:], len(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ids[s:e].tobytes() for s, e in zip(begin.tolist(), stop.tolist())], pa.binary())], ["h", "ids"])

        encoded = materialize(train.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(encode, "h long, ids binary"), "lm-ids")
        for turn in range(rounds):
            model = trained(encoded, model, uni, max(1, -(-n // shard)), shard, turn)
        discard(encoded)
    return counts, n, v, vocabulary, model


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, **how) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs; how: see fit.

    Rows whose crc32(id as text) mod folds is `held` are scored but not learned from. Null text is empty (one token,
    the end); null and repeated ids give a row each; other columns are ignored; an empty table gives no rows. With no
    training row all counts are 0: every known count is 0, and both scores still are finite. Every round trains on
    every position of every training row, its end included. Words of over one in `share` of the tokens, fewer than
    `share` by counting, are broadcast with their counts; all others are joined. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = with_row(docs, id_col, text_col).withColumn("held_out", fold_of(F.col("doc_id"), folds) == held)
    counts, n, v, vocabulary, model = fit(rows.where(~F.col("held_out")).select("doc_id", "text"), **how)
    space = float(np.log10(n + 0.5 * (v + 1)))
    lookup, ready = spark.sparkContext.broadcast(tables(model)), spark.sparkContext.broadcast((vocabulary, counts.where(F.col("h") == END).select("c").first()))

    def per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a2, a1, bias, z = lookup.value
        voc, ends = ready.value
        ends = ends[0] if ends else 0
        inside = 2 + len(voc.inner)
        for b in batches:
            for part in slices(b, 1):
                rid, docs_ = part.column(0).to_numpy(zero_copy_only=False), part.num_rows
                ids, begin, h, at = voc.encode(part.column(1))
                u, v_ = contexts(ids)
                neural = np.add.reduceat((a2[u, ids] + a1[v_, ids] + bias[ids] - z[u, v_]).astype("f8"), begin) / LN10
                of, c = np.repeat(np.arange(docs_), np.diff(at)), voc.counts(h)
                own = ids[np.arange(len(h)) + of].astype("i8") - inside
                here = c >= 0
                x = np.where(here, np.log10(np.maximum(c, 0) + 0.5), 0)
                rest = np.where(own >= 0, x - voc.log_left[own.clip(0)], 0)
                sums = [np.bincount(of, y, docs_) for y in (x, rest, here)]
                # words that are not among the frequent ones, once for each text
                far_of, far = of[~here], h[~here]
                order = np.lexsort((far, far_of))
                far_of, far = far_of[order], far[order]
                new = np.flatnonzero(np.concatenate(([True], (far[1:] != far[:-1]) | (far_of[1:] != far_of[:-1])))) if len(far) else np.zeros(0, "i8")
                k = np.diff(np.append(new, len(far)))
                zero = np.zeros(len(new))
                yield pa.RecordBatch.from_pydict({
                    "rid": pa.array(np.concatenate((rid, rid[far_of[new]]))), "h": pa.array(np.concatenate((np.zeros(docs_, "i8"), far[new].view("i8"))), mask=np.concatenate((np.ones(docs_, bool), np.zeros(len(new), bool)))),
                    "k": pa.array(np.concatenate((np.zeros(docs_, "i8"), k))), "base": pa.array(np.concatenate((sums[0] + np.log10(ends + 0.5), zero))), "rest": pa.array(np.concatenate((sums[1], zero))),
                    "neural": pa.array(np.concatenate((neural, zero))), "n_known": pa.array(np.concatenate((sums[2].astype("i8") + (ends > 0), np.zeros(len(new), "i8")))),
                    "n_tokens": pa.array(np.concatenate((np.diff(at) + 1, np.zeros(len(new), "i8")))),
                })

    freq = rows.select("rid", "text").mapInArrow(per_row, "rid long, h long, k long, base double, rest double, neural double, n_known long, n_tokens long")
    # what the broadcast part lacks has at most one in `share` of the tokens, so no word is hot here; sums at hand are spread
    key = F.coalesce("h", F.xxhash64("rid", F.lit("sum")))
    x = F.when(F.col("h").isNotNull(), F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(F.lit(0.0))
    sums = (
        freq.withColumn("key", key).join(counts.select(F.col("h").alias("key"), "c"), "key", "left")
        .select("rid", (F.col("base") + x).alias("base"), (F.col("rest") + x).alias("rest"), "neural", (F.col("n_known") + F.when(F.col("h").isNotNull() & F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("n_known"), "n_tokens")
        .groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("base", "rest", "neural", "n_known", "n_tokens")))
    )
    return rows.select("rid", "doc_id", "held_out").join(sums, "rid").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * space).alias("base_score"), (F.col("neural") + F.col("rest")).alias("score")
    )
