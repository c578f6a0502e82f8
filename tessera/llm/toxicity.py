"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled training rows, those whose ids hash lowest (`per_class` of each label,
`sample_bytes` of text in all). Terms are all words and word beginnings whose counts in the sample differ between the
labels (chi-square at least `chi`, near copies counted once; however many they are); a row's vector is its terms'
TF-IDF at length 1. Equal vectors are one entry with the counts of both labels. Entries are ordered so that alike ones
share a block, and each block keeps the greatest weight of every term in it: a document's terms times these bound
the cosine with any entry of the block, blocks are visited by falling bound, and the search ends, exactly, when the
next bound is below the k-th best cosine. Neighbours vote by distance; votes are calibrated on the sample with each
example left out of its own vote, by pooled adjacent violators.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold_of, materialize, with_row
from .shingles import Hashes, shingle_set

#: Terms are the words of a text in lower case, and the beginnings of the longer ones.
LETTERS = re.compile(r"\w+")
BEGIN = (4, 5)
BLOCK = 64


class Terms(dict):
    """word -> numbers of its known terms; filled by need, emptied at `most` words."""

    def __init__(self, number: dict[str, int], most: int = 200_000):
        super().__init__()
        self.number, self.most = number, most
        #: What a word with a known term begins with; few other words do.
        self.starts = {t.removesuffix("-")[: min(BEGIN)] for t in number}

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = tuple(self.number[t] for t in (word, *(word[:n] + "-" for n in BEGIN if len(word) > n)) if t in self.number)
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got

    def counts(self, text: str) -> tuple[tuple[int, int], ...]:
        """(term, times) of a text, by term."""
        seen: dict[int, int] = {}
        starts, most = self.starts, min(BEGIN)
        for w, n in Counter(LETTERS.findall(text.lower())).items():
            if w[:most] in starts:
                for t in self[w]:
                    seen[t] = seen.get(t, 0) + n
        return tuple(sorted(seen.items()))


def distinct(texts: list[str], k: int = 4) -> list[int]:
    """One text of each group of near copies (a shared least shingle by one of eight orders): a text that is copied a
    hundred times says no more about its words than one does."""
    seen: set[tuple[int, int]] = set()
    hashes, out = Hashes(), []
    for i, t in enumerate(texts):
        x = shingle_set(hashes.of(t.encode().split()), k)
        least = [(j, int((x * np.uint64(2 * j + 1) ^ (x >> np.uint64(j + 7))).min())) for j in range(8)] if len(x) else [(-1, 0)]
        if not seen.intersection(least):
            out.append(i)
        seen.update(least)
    return out


class Index:
    """Entries with counts of both labels, and postings by block."""

    def __init__(self, texts: list[str], toxic: list[int], ids: list, weight: tuple[float, float], chi: float, k: int):
        self.k, self.weight = k, weight
        n = len(texts)
        df: tuple[Counter, Counter] = (Counter(), Counter())
        own = distinct(texts)
        for t, label in ((texts[i], toxic[i]) for i in own):
            words = set(LETTERS.findall(t.lower()))
            df[label].update(words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in BEGIN)))
        n1 = sum(toxic[i] for i in own)
        n, n0, good = len(own), len(own) - n1, []
        if n0 and n1:
            for t in df[0].keys() | df[1].keys():
                a, b = df[1][t], df[0][t]
                c = a + b
                if c >= 3 and c < n:
                    x = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (c * (n - c) * n1 * n0)
                    if x >= chi:
                        good.append((-x, t))
        names = [t for _, t in sorted(good)]
        self.number = {t: i for i, t in enumerate(names)}
        self.idf = np.array([np.log((n + 1) / (df[0][t] + df[1][t] + 1)) + 1 for t in names], "f8")
        self.terms = Terms(self.number)
        groups: dict[tuple, list] = {}
        bare = [0, 0]
        for t, label, i in zip(texts, toxic, ids):
            key = self.terms.counts(t)
            if key:
                g = groups.setdefault(key, [0, 0, i])
                g[label] += 1
            else:
                bare[label] += 1
        w0, w1 = weight
        y1 = sum(toxic)
        prior = y1 * w1 / ((len(toxic) - y1) * w0 + y1 * w1) if toxic else 0.5
        self.base = (bare[1] * w1 + prior) / (bare[0] * w0 + bare[1] * w1 + 1)
        # entries of the same rarest term lie together
        keys = sorted(groups, key=lambda key: (max((self.idf[t], t) for t, _ in key)[1], key))
        self.entries = [groups[key] for key in keys]
        self.count = np.array([[g[0], g[1]] for g in self.entries], "f8").reshape(-1, 2)
        blocks = -(-len(keys) // BLOCK)
        self.bound = np.zeros((len(names), max(blocks, 1)), "f4")
        self.post: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for b in range(blocks):
            lists: dict[int, list] = {}
            for j, key in enumerate(keys[b * BLOCK : (b + 1) * BLOCK]):
                for t, x in zip((t for t, _ in key), self.vector(key)):
                    lists.setdefault(t, []).append((j, x))
            self.post.append({t: (np.array([j for j, _ in v], "i4"), np.array([x for _, x in v], "f8")) for t, v in lists.items()})
            for t, (_, x) in self.post[-1].items():
                self.bound[t, b] = np.nextafter(np.float32(x.max()), np.float32(2))
        self.blocks = blocks
        self.steps: list[float] = []
        self.values: list[float] = []
        self.calibrate(keys)
        self.terms.clear()
        self.kept: dict[tuple, tuple] = {}

    def vector(self, key: tuple) -> np.ndarray:
        x = np.array([1 + np.log(c) for _, c in key]) * self.idf[[t for t, _ in key]]
        return x / np.sqrt((x * x).sum())

    def nearest(self, key: tuple) -> list[tuple[float, int]]:
        """The k entries of greatest cosine over 0, as (cosine, entry), exactly; of ties the first entries."""
        q = self.vector(key)
        ts = [t for t, _ in key]
        upper = q.astype("f4") @ self.bound[ts] * np.float32(1.00001)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-upper, kind="stable"):
            if upper[b] <= 0 or len(best) == self.k and upper[b] < -best[-1][0]:
                break
            score, post = np.zeros(BLOCK), self.post[b]
            for t, x in zip(ts, q):
                if t in post:
                    at, w = post[t]
                    score[at] += x * w
            hit = np.flatnonzero(score)
            # what is surely below the k-th best so far, or of the block, is not rounded and sorted
            least = -best[-1][0] if len(best) == self.k else 0.0
            if len(hit) > self.k:
                least = max(least, float(np.partition(score[hit], -self.k)[-self.k]))
            hit = hit[score[hit] >= least - 1e-11]
            best = sorted([*best, *((-round(float(s), 12), int(b) * BLOCK + int(i)) for i, s in zip(hit, score[hit]))])[: self.k]
        return [(-s, i) for s, i in best]

    def vote(self, near: list[tuple[float, int]], less: tuple[int, int] | None = None) -> float | None:
        """Share of the toxic label among the neighbours by 1 / (1 - cosine + 0.05) and label weight; less: (entry,
        label) of an example to leave out."""
        have = [0.0, 0.0]
        for s, i in near:
            for label in (0, 1):
                n = self.count[i, label] - (less == (i, label))
                have[label] += n * self.weight[label] / (1.05 - s)
        return have[1] / (have[0] + have[1]) if have[0] + have[1] > 0 else None

    def calibrate(self, keys: list[tuple]) -> None:
        points: dict[float, list[float]] = {}  # equal votes are one point, whatever their labels
        for i, key in enumerate(keys):
            near = self.nearest(key)
            for label in (0, 1):
                if self.count[i, label] and (v := self.vote(near, (i, label))) is not None:
                    w = self.count[i, label] * self.weight[label]
                    at = points.setdefault(round(v, 12), [0.0, 0.0])
                    at[0] += w * label
                    at[1] += w
        pools: list[list[float]] = []
        for v, (good, w) in sorted(points.items()):
            pools.append([v, good, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1][1] += last[1]
                pools[-1][2] += last[2]
        self.steps = [p[0] for p in pools]
        self.values = [(p[1] + 0.02) / (p[2] + 0.04) for p in pools]

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        key = self.terms.counts(text)
        if not key:
            return self.base, []
        if (got := self.kept.get(key)) is None:
            near = self.nearest(key)
            v = self.vote(near)
            if v is None or not self.steps:
                p = self.base if v is None else v
            else:
                p = self.values[max(bisect_right(self.steps, round(v, 12)) - 1, 0)]
            got = (min(max(p, 0.0), 1.0), near[:3])
            if len(self.kept) > 50_000:
                self.kept.clear()
            self.kept[key] = got
        return got


def lowest(rows: DataFrame, many: int, most: int) -> list[tuple]:
    """(doc_id, toxic, hash) of the `most` rows whose ids hash lowest. A bound on the hash lets about twice as many
    rows reach the driver, whatever the table's size and number of tasks."""
    share = (2 * most + 200) / max(many, 1)
    while True:
        h = F.xxhash64("doc_id")
        near = rows.select("doc_id", "toxic", h.alias("h"))
        if share < 1:
            near = near.where(F.col("h") <= int(share * 2**64) - 2**63)
        got = sorted((tuple(r) for r in near.collect()), key=lambda r: (r[2], r[0]))
        if len(got) >= most or share >= 1:
            return got[:most]
        share *= 2


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = 3000, sample_bytes: int = 64 << 20, chi: float = 20.0, k: int = 15, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of at most per_class rows of either label, those whose ids hash lowest, as far as sample_bytes of text
    go; labels: (doc_id, toxic). Of repeated ids the greatest text is taken."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = rows.where(fold_of(F.col("doc_id"), folds) != held)
    many = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    picked = [x for y in (0, 1) for x in lowest(train.where(F.col("toxic") == y), many.get(y, 0), per_class)]
    sample = F.broadcast(docs.sparkSession.createDataFrame(picked, train.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).schema))  # 2 * per_class rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(sample, "doc_id").groupBy("doc_id", "toxic", "h").agg(F.max("text").alias("text"))
    held = materialize(texts, "examples")
    total, fit_in = 0, []
    for r in sorted(held.select("doc_id", "h", F.octet_length("text").alias("n")).collect(), key=lambda r: (r.h, r.doc_id)):
        if total + r.n <= sample_bytes:
            total += r.n
            fit_in.append(r.doc_id)
    got = sorted(held.where(F.col("doc_id").isin(fit_in)).collect() if len(fit_in) < len(picked) else held.collect(), key=lambda r: r.doc_id)
    discard(held)
    used = Counter(r.toxic for r in got)
    weight = tuple(many.get(y, 0) / used[y] if used[y] else 1.0 for y in (0, 1))
    return Index([r.text for r in got], [r.toxic for r in got], [r.doc_id for r in got], weight, chi, k)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row for each row of docs.

    Labels are learned from rows whose crc32(id as text) mod folds is not `held`; conflicting labels of an id count
    as toxic; null labels are left out. A text without a known term, empty and null ones included, gets the calibrated
    share of such texts. evidence: the nearest entries (id of an example, cosine, toxic and other examples). With no
    training rows of either label every score is the same. Repeated rows give a row each; other columns are ignored.
    """
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held, id_col=id_col, text_col=text_col, **how))
    rows = with_row(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    near = pa.list_(pa.struct([("doc_id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int64()), ("other", pa.int64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for b in batches:
            got = [at.score(t) for t in b.column(1).to_pylist()]
            said = [[{"doc_id": str(at.entries[i][2]), "cosine": s, "toxic": at.entries[i][1], "other": at.entries[i][0]} for s, i in n] for _, n in got]
            p = [x for x, _ in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(said, near)], ["doc_id", "score", "predicted", "evidence"])

    out = rows.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id string, cosine double, toxic long, other long>>")
    return out.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted", "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is under the threshold."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col, **how))
    at = docs.columns.index(text_col)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([index.value.score(t or "")[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)
