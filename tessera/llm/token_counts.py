"""Token counts without materialising ids.

Pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies. Pre-tokens are
Zipf-distributed, so the join has two parts: a dictionary of frequent pre-tokens (over one in `share` of those that tasks report, fewer than `share`
of at most 64 characters by counting) is broadcast and summed where the document is read; all other pre-tokens are
dealt by pre-token, counted once where they meet, and summed by row. A pre-token that is left to the second part
holds at most one in `local` of its tasks' pre-tokens, so no partition of it is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_row

LONG = 64


class Counting:
    """The pre-tokens of a text and the number of tokens of a pre-token, by the library of the vocabulary file."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.split, self.count = (lambda t: [t]), (lambda p: len(model.encode(p, num_threads=1)))
        else:
            from . import tokens

            ids = tokens.ids(path)
            self.split, self.count = ids.chunks, (lambda p: len(ids[p] if ids.drops_blanks else ids.whole(p)) // 4)


_KEPT: dict[str, Counting] = {}


def counting(path: str) -> Counting:
    if path not in _KEPT:
        _KEPT[path] = Counting(path)
    return _KEPT[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, share: int = 1_000_000, local: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs.

    path: a .json vocabulary (library tokenizers) or a .model one (sentencepiece). Where the vocabulary drops white
    space, pre-tokens are runs without blanks; otherwise a text is one pre-token, which the library counts whole.
    Null text counts as empty (0 tokens); null and repeated ids give a row each; other columns are ignored; an empty
    table gives no rows. n_bytes is the text's UTF-8 length.
    """
    spark, rows = docs.sparkSession, with_row(docs, id_col, text_col)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = counting(path).split, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(split(t))
            if len(seen) > 8 * local:  # Misra-Gries: what goes has at most one in `local` of the pre-tokens so far
                seen = Counter(dict(seen.most_common(local)))
        kept = [(p, n) for p, n in seen.most_common(local) if p and len(p) <= LONG]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counting(path).count
        for b in batches:
            yield pa.RecordBatch.from_pydict({"piece": b.column(0), "k": pa.array([count(p) for p in b.column(0).to_pylist()], pa.int64())})

    top = materialize(rows.select("text").mapInArrow(frequent, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "frequent")
    total = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    known = spark.sparkContext.broadcast({r.piece: r.k for r in top.where(F.col("n") > total / share).select("piece").mapInArrow(counted, "piece string, k long").collect()})

    def per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ready = counting(path).split, known.value
        for b in batches:
            rid, piece, n = [], [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at_hand = 0
                for p, k in Counter(split(t)).items():
                    if (c := ready.get(p)) is not None:
                        at_hand += c * k
                    elif p:
                        rid.append(r), piece.append(p), n.append(k)
                rid.append(r), piece.append(None), n.append(at_hand)
                if len(rid) > 100_000:
                    yield pa.RecordBatch.from_pydict({"rid": pa.array(rid, pa.int64()), "piece": pa.array(piece, pa.string()), "n": pa.array(n, pa.int64())})
                    rid, piece, n = [], [], []
            if rid:
                yield pa.RecordBatch.from_pydict({"rid": pa.array(rid, pa.int64()), "piece": pa.array(piece, pa.string()), "n": pa.array(n, pa.int64())})

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pre-token: each is counted once, when its run begins. A null one's n is a sum already."""
        count, last, k = counting(path).count, None, 1
        for b in batches:
            out = []
            for p, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if p is not None and p != last:
                    last, k = p, count(p)
                out.append(n if p is None else n * k)
            yield pa.RecordBatch.from_pydict({"rid": b.column(0), "n": pa.array(out, pa.int64())})

    freq = rows.select("rid", "text").mapInArrow(per_row, "rid long, piece string, n long")
    # rows without a pre-token (the sums at hand) are spread by their row's number
    dealt = freq.repartition(F.coalesce("piece", F.concat(F.lit(" "), F.col("rid").cast("string")))).sortWithinPartitions("piece")
    sums = dealt.mapInArrow(once, "rid long, n long").groupBy("rid").agg(F.sum("n").alias("n_tokens"))
    sizes = rows.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(sums, "rid").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
