"""Best-fit packing of token pieces into sequences by bin completion.

Only the histogram of piece lengths is planned on the driver: it has at most `size` entries, however many rows there
are. The plan is a list of fillings (a multiset of lengths, used for a number of sequences); pieces of a length are
ranked by a salted count, and rank and length alone say in which sequence and where a piece lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, with_row

Filling = tuple[tuple[int, int], ...]  # (length, times), lengths falling


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: alike bins are kept together as (what is in one, how many)."""
    room: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = [r for r in room if r >= length]
            r = min(fits) if fits else size
            inside, bins = room[r].pop() if fits else ((), left)
            if fits and not room[r]:
                del room[r]
            each = min(r // length, left)
            use = min(bins, left // each)
            if bins > use and fits:
                room.setdefault(r, []).append([inside, bins - use])
            room.setdefault(r - each * length, []).append([(*inside, (length, each)), use])
            left -= each * use
    return [(inside, bins) for groups in room.values() for inside, bins in groups]


def dominates(a: list[int], b: list[int]) -> bool:
    """Martello and Toth: the items of b fit into bins as large as the items of a, so that taking a is no worse."""
    if sum(b) > sum(a):
        return False
    if not b:
        return True
    first, rest = b[0], b[1:]
    return any(first <= x and dominates(sorted([*a[:i], x - first, *a[i + 1 :]], reverse=True), rest) for i, x in enumerate(a) if not i or a[i - 1] != x)


def completions(counts: np.ndarray, room: int, width: int, steps: int) -> list[list[int]]:
    """Undominated sets of lengths that fill `room`, least waste first; at most `width`, found in `steps` steps.

    Sets are built with falling lengths; a set that fills the room is taken as soon as a length equal to the rest is
    there. The largest single length that fits dominates all sets of no larger sum, which bounds the search.
    """
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [[]]
    least, single = int(have[0]), int(have[-1])
    found: list[list[int]] = [[single]]
    if single == room:
        return found
    done = 0

    def extend(chosen: list[int], rest: int, top: int) -> None:
        nonlocal done
        done += 1
        if done > steps or len(found) > 4 * width:
            return
        if rest <= top and counts[rest] > chosen.count(rest):
            found.append([*chosen, rest])
            return
        if rest < least:
            if sum(chosen) > single:
                found.append(chosen)
            return
        took = False
        for x in have[: np.searchsorted(have, min(rest, top), "right")][::-1][: 2 * width]:
            x = int(x)
            if counts[x] > chosen.count(x):
                took = True
                extend([*chosen, x], rest - x, x)
        if not took and sum(chosen) > single:
            found.append(chosen)

    extend([], room, room)
    found = sorted({tuple(f) for f in found}, key=lambda f: (room - sum(f), [-x for x in f]))[: 2 * width]
    kept: list[list[int]] = []
    for f in found:
        if len(f) > 6 or not any(len(k) <= 6 and dominates(k, list(f)) for k in kept):
            kept.append(list(f))
    return kept[:width]


@dataclass
class Search:
    """Depth-first bin completion on a histogram; each step repeats a filling as often as the counts allow.

    The search takes up to `nodes` steps, `width` fillings at each, found in `steps` steps among the longest lengths
    that fit. `least` is a lower bound on the sequences; where `bins` equals it, the solution is proven least.
    """

    size: int
    nodes: int = 20_000
    width: int = 6
    steps: int = 300
    best: list[tuple[Filling, int]] = field(default_factory=list)
    bins: int = 0
    least: int = 0

    def fillings(self, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(lengths, times, bins, waste) of each filling around the largest length that is left."""
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        options = completions(left, self.size - top, self.width, self.steps)
        left[top] += 1
        for o in options:
            lengths, times = np.unique([top, *o], return_counts=True)
            q = int((left[lengths] // times).min())
            yield lengths, times, q, q * (self.size - top - sum(o))

    def run(self, counts: dict[int, int]) -> list[tuple[Filling, int]]:
        total = sum(n * k for n, k in counts.items())
        self.best = best_fit(counts, self.size)
        self.bins = sum(k for _, k in self.best)
        self.least = max(-(-total // self.size), sum(k for n, k in counts.items() if 2 * n > self.size))
        left = np.zeros(self.size + 1, "i8")
        for n, k in counts.items():
            left[n] = k
        # one frame of untried fillings for each step taken, and one for the next; `left` is undone on the way back
        chain: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        frames, bins, waste, seen = [self.fillings(left) if total else iter(())], 0, 0, 0
        while frames and self.bins > self.least and seen < self.nodes:
            step = next(frames[-1], None)
            if step is None:
                frames.pop()
                if chain:
                    lengths, times, q, lost = chain.pop()
                    left[lengths] += q * times
                    bins, waste = bins - q, waste - lost
                continue
            lengths, times, q, lost = step
            left[lengths] -= q * times
            chain.append(step)
            bins, waste, seen = bins + q, waste + lost, seen + 1
            # a better solution wastes at most this much in all its bins together
            more = waste <= (self.bins - 1) * self.size - total
            if more and not left.any():
                self.bins = bins
                self.best = [(tuple((int(n), int(t)) for n, t in zip(ls[::-1], ts[::-1])), k) for ls, ts, k, _ in chain]
                more = False
            frames.append(self.fillings(left) if more else iter(()))
        return self.best


def layout(plan: list[tuple[Filling, int]]) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks: key (length << 40 | first rank), first sequence, pieces a sequence, offset."""
    key, first, each, offset, used, bins = [], [], [], [], {}, 0
    for filling, n in plan:
        at = 0
        for length, times in filling:
            key.append(length << 40 | used.get(length, 0))
            used[length] = used.get(length, 0) + times * n
            first.append(bins), each.append(times), offset.append(at)
            at += length * times
        bins += n
    order = np.argsort(np.array(key, "i8"))
    return tuple(np.array(x, "i8")[order] for x in (key, first, each, offset))


def pieces(docs: DataFrame, path: str, end: int = 1, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(rid, doc_id, piece, start, length, ids_crc32[, ids]): the token ids of each text, then `end`, cut at `size`."""
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.ids(path).encode
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for rid, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = encode(text) + last
                for i in range(0, len(ids), 4 * size):
                    part = ids[i : i + 4 * size]
                    for a, x in zip(out, (rid, doc, i // (4 * size), i // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None)):
                        a.append(x)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], b.column(1).type), *(pa.array(a, t) for a, t in zip(out[2:6], (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            names = ["rid", "doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(out[6], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = with_row(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"rid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, end: int = 1, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, nodes: int = 20_000, group: int = 50_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset, n_sequences, least_sequences), one row for
    each piece.

    Null text is empty: its document is the end id alone. Repeated rows are packed each on its own; null ids stay
    null; other columns are ignored; an empty table gives no rows. keep_ids adds the ids, little-endian unsigned
    32-bit. nodes bounds the search, not the rows: the best solution so far, at worst best-fit decreasing, holds all.
    n_sequences is what it uses, least_sequences a lower bound of any packing: where they are equal none is better.
    """
    cut = materialize(pieces(docs, path, end, size, id_col, text_col, keep_ids), "pieces")
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    search = Search(size, nodes)
    plan = layout(search.run(counts))
    spark = docs.sparkSession
    at = spark.sparkContext.broadcast(plan)
    salts = max(1, -(-max(counts.values(), default=1) // group))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("rid", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid", "piece"))).join(base, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ready = ranked.select(*names, (F.col("base") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, each, offset = at.value
        for b in batches:
            length, rank = (b.column(names.index("length")).to_numpy(zero_copy_only=False), b.column(len(names)).to_numpy(zero_copy_only=False))
            i = np.searchsorted(key, length << 40 | rank, "right") - 1
            rank = rank - (key[i] & ((1 << 40) - 1))
            placed = [pa.array(first[i] + rank // each[i]), pa.array(offset[i] + rank % each[i] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), *placed], [*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    placed = ready.mapInArrow(place, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", sequence_id long, `offset` long")
    return placed.select("*", F.lit(search.bins).cast("long").alias("n_sequences"), F.lit(search.least).cast("long").alias("least_sequences"))
