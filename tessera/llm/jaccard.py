"""Exact n-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Documents of equal shingle sets are one class. Class sizes lie in bands so that partners of a link are in one band or
two next ones. Two linked sets of a band differ in at most `most` elements. So their elements, dealt by hash range to
`most` + 1 + `spare` parts, agree in at least `spare` + 1 whole parts: a tile holds the classes of a band with equal
content of one part, and any link shares a tile. A set with more than `spare` empty parts (about one in a thousand,
of the shortest texts one in twenty) also opens tiles for the shingles of its prefix, among such sets alone. A whole part is several shingles, so unrelated
texts hardly ever share a tile, and what is shuffled grows as the input does. Within a tile, the bits in which two
256-bit parity signatures differ bound the overlap from above; what passes is verified on sorted arrays of shingles.

Components alone are asked for, so groups of near copies are not paired out. First each class of a tile is verified
against the tile's hub, the class that shares the most tiles. The components of these links are labels; in tiles that
still hold several, each class outside the most frequent label meets all classes of other labels, in salted blocks of
`block` by `block` classes, and all pairs that pass the bounds are verified. Near copies share many tiles of one hub;
where that is less to compare and to move, the tiles of a hub are one group in which a pair meets once. There the bound is
taken once more from signatures as long as the sets: 256 bits are all at random, and bound nothing, once sets may differ
in about 100 elements. Signatures let pass what differs in a few elements too many, which in a group of near copies may be
most pairs, so the last bound is the overlap of the sets' elements themselves, by their lower 32 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, materialize, with_row
from .graph import components
from .shingles import mixed, shingle_sets, slices

BITS = 256
SIG = ["s0", "s1", "s2", "s3"]
SMALL = 500_000


def apart(total: int, percent: int) -> int:
    """In how many elements two sets of this total size may differ and still link."""
    return total - 2 * ((percent * total + 99 + percent) // (100 + percent))


class Bands:
    """Edges of the size bands, and for tiles whose larger partner lies in a band the numbers of parts and of spare
    parts."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, np.array([1])

    def of(self, n: np.ndarray) -> np.ndarray:
        """The band of each size."""
        while len(n) and self.edges[-1] <= n.max():
            self.edges = np.append(self.edges, 100 * self.edges[-1] // self.percent + 1)
        return np.searchsorted(self.edges, n, "right") - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def parts(self, band: int) -> tuple[int, int]:
        """(parts, spare) of a band; no parts where links need equal sets."""
        edge = [1]
        while len(edge) < band + 2:
            edge.append(100 * edge[-1] // self.percent + 1)
        least, largest = edge[max(band - 1, 0)], edge[band + 1] - 1
        most = max(apart(2 * largest, self.percent), apart(2 * largest - 1, self.percent))
        if not most:
            return 0, 0
        if most >= 30:  # about normal: four deviations
            spare = 0
            for _ in range(20):
                mean = (most + 1 + spare) * exp(-least / (most + 1 + spare))
                spare = int(mean + 4 * mean**0.5) + 1
            return most + 1 + spare, spare
        best = (2.0, 0, 0)
        for spare in range(10):
            p = most + 1 + spare
            mean = p * (1 - 1 / p) ** least
            tail, term = 1.0, exp(-mean)
            for i in range(spare + 1):
                tail -= term
                term *= mean / (i + 1)
            best = min(best, (tail, p, spare))
            if tail < 1e-3:
                break
        return best[1:]


def signatures(x: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Parity of the number of a set's elements at each of 256 places."""
    odd = np.bincount(doc * BITS + (x & np.uint64(BITS - 1)).astype("i8"), minlength=docs * BITS) & 1
    return np.packbits(odd.astype("u1")).view("<i8").reshape(docs, BITS // 64)


def long_signature(x: np.ndarray) -> np.ndarray:
    """Parity of the number of a set's elements at each of as many places as it has elements, rounded up to a power of
    two, 256 at least. The halves' difference is the signature of half the length."""
    bits = max(BITS, 1 << (len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1")).view("<i8")


def tile_keys(x: np.ndarray, doc: np.ndarray, n: np.ndarray, sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of all tiles of sets that lie one after another in x, in order of documents."""
    at, keys = [], []
    own = bands.of(n)
    for up in (0, 1):
        shape = [bands.parts(int(b)) for b in own + up]
        p = np.array([s[0] for s in shape], "u8")
        part = ((x >> np.uint64(32)) * p[doc]) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])))) if len(x) else np.zeros(0, "i8")
        first = first[p[doc[first]] > 0]
        if len(first):
            # parts of documents without tiles lie between, so sums run to the next part's first element of any document
            ends = np.flatnonzero(np.concatenate(((doc[1:] != doc[:-1]) | (part[1:] != part[:-1]), [True]))) + 1
            stop = ends[np.searchsorted(ends, first, "right")]
            total = np.concatenate((np.zeros(1, "u8"), np.cumsum(mixed(x))))
            seed = mixed((own[doc[first]] + up).astype("u8") << np.uint64(32) | part[first])
            keys.append(mixed((total[stop] - total[first]) ^ seed))
            at.append(doc[first])
        empty = p.astype("i8") - np.bincount(doc[first], minlength=len(n))
        for i in np.flatnonzero(empty > np.array([s[1] for s in shape])):
            need = len(sets[i]) - (bands.percent * len(sets[i]) + 99) // 100 + 1
            keys.append(mixed(sets[i][:need] + mixed(np.full(1, (own[i] + up) << 1 | 1, "u8"))))
            at.append(np.full(need, i))
    if not keys:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    at, keys = np.concatenate(at), np.concatenate(keys)
    order = np.argsort(at, kind="stable")
    return at[order], keys[order].view("i8")


def describe(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(rid, doc_id, n, key, tiles, s0..s3) of each row; the later ones of equal sets of a task have no tiles."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for b in batches:
            for part in slices(b, 2):
                sets = shingle_sets(part.column(2), k)
                n = np.array([len(v) for v in sets])
                x, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
                at, keys = tile_keys(x, doc, n, sets, bands)
                names = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() if len(v) else None for v in sets]
                # the first of equal sets in a task stands for all of them
                first = np.array([not (v in seen or seen.add(v)) for v in names], bool)
                at, keys = at[first[at]], keys[first[at]]
                ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(sets)))))
                sig = signatures(x, doc, len(sets))
                tiles = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(names, pa.binary()), tiles, *(pa.array(np.ascontiguousarray(sig[:, i])) for i in range(4))], ["rid", "doc_id", "n", "key", "tiles", *SIG])

    return rows.mapInArrow(emit, f"rid long, doc_id {kind}, n long, key binary, tiles array<long>, " + ", ".join(f"{s} long" for s in SIG))


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether the classes in the structs x and y may link by their sizes and the bits of their signatures."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    bits = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in SIG), F.lit(0))
    need = F.expr(f"({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent}")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (bits <= a + b - 2 * need)


def may_link_long(x: str, y: str, percent: int) -> Column:
    """may_link by the long signatures (l) of the structs x and y; the longer of two lengths is folded, and what is still
    of another length passes."""
    differ = "aggregate(zip_with({}, {}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)".format
    half = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (p, q) -> p ^ q)".format
    a, b = f"{x}.l", f"{y}.l"
    bits = f"CASE WHEN size({a}) = size({b}) THEN {differ(a, b)} WHEN size({a}) = 2 * size({b}) THEN {differ(half(a), b)} WHEN 2 * size({a}) = size({b}) THEN {differ(a, half(b))} ELSE 0 END"
    return F.expr(f"{bits} <= {x}.n + {y}.n - 2 * (({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent})")


def may_link_whole(x: str, y: str, percent: int) -> Column:
    """may_link by the lower halves (e) of the elements of the structs x and y. Elements of x without an equal half in y
    are not in y; halves that meet by chance only raise the bound."""
    return F.expr(f"{100 + percent} * ({x}.n - size(array_except({x}.e, {y}.e))) >= {percent} * ({x}.n + {y}.n)")


def lower_halves(x: np.ndarray) -> np.ndarray:
    return x.astype("u4").view("i4")


def arrays_of(rows: DataFrame, ids: DataFrame, k: int, of: dict[str, Callable[[np.ndarray], np.ndarray]], small: int = SMALL) -> DataFrame:
    """(rid, and an array for each name in `of`), made of the set of each text whose number is in ids. The texts of up to
    `small` classes (8 bytes a class) are picked by a broadcast of their numbers, of more by a shuffled join."""
    kinds = {name: {8: "long", 4: "int"}[make(np.zeros(1, "u8")).itemsize] for name, make in of.items()}
    picked = F.broadcast(ids) if ids.count() <= small else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                each, columns = shingle_sets(part.column(1), k), [part.column(0)]
                for make in of.values():
                    x = [make(v) for v in each]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))))
                yield pa.RecordBatch.from_arrays(columns, ["rid", *of])

    return materialize(rows.select("rid", "text").join(picked, "rid", "left_semi").mapInArrow(sets, "rid long, " + ", ".join(f"{name} array<{kind}>" for name, kind in kinds.items())), "arrays")


def verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int, small: int = SMALL) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets link, by exact intersection of sorted arrays."""
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    ids = materialize(ids, "ids")
    arrays = arrays_of(rows, ids, k, {"x": lambda x: x.view("i8")}, small)
    discard(ids)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            ox, oy, vx, vy = x.offsets.to_numpy(), y.offsets.to_numpy(), x.values.to_numpy().view("u8"), y.values.to_numpy().view("u8")
            good = []
            for i in range(b.num_rows):
                p, q = vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]]
                at = np.searchsorted(p, q).clip(max=len(p) - 1)
                both = int((p[at] == q).sum())
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = arrays.select(F.col("rid").alias("a"), F.col("x").alias("xa")), arrays.select(F.col("rid").alias("b"), F.col("x").alias("xb"))
    links = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(check, "a long, b long"), "links")
    discard(arrays)
    discard(pairs)
    return links


def labelled(rows: DataFrame, *by: str) -> DataFrame:
    """For each group its most frequent label (top), its size, its number of labels and of rows outside the top label, and
    what it costs: the pairs to compare and the elements to move."""
    each = rows.groupBy(*by, "label").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy(*by)
    found = each.agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("size"), F.count("*").alias("labels"), F.sum("n").alias("n"))
    found = found.select(*by, F.col("most.label").alias("top"), "size", (F.col("size") - F.col("most.c")).alias("outside"), "labels", "n")
    return found.withColumn("cost", F.col("size") * F.col("outside") + F.col("n")).drop("n")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = 1000) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, root), one row for each row of docs; rid is the row's number in the
    table, root that of a row which stands for the component.

    Words are runs without ASCII white space, A-Z lower-cased; a set is a text's distinct k-word shingles, as 64-bit
    hashes. Null, empty and blank texts have none and link with nothing; repeated rows are one class; of a component
    the least id that is not null is its id (null if there is none); other columns are ignored; an empty table gives
    no rows. A document, however long, has about 0.4 tiles for each of its shingles.
    """
    rows = with_row(docs, id_col, text_col)
    sets = materialize(describe(rows, k, percent), "sets")
    full = materialize(sets.drop("tiles"), "rows")
    classes = materialize(full.where("n > 0").groupBy("key").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")

    # one step after another, so that the shuffle files of one are gone when the next writes its own; copies within a
    # task have no tiles, those of other tasks leave once only the tiles that several rows share are left
    spread = sets.select(F.explode("tiles").alias("tile"), "rid")
    several = materialize(spread.groupBy("tile").agg(F.count("*").alias("size")).where("size > 1").select("tile"), "several")
    held = materialize(spread.join(several.hint("shuffle_hash"), "tile", "left_semi"), "held")
    discard(sets)
    discard(several)
    own = materialize(held.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi"), "own")
    discard(held)
    shared = materialize(own.join(own.groupBy("tile").agg(F.count("*").alias("size")).where("size > 1"), "tile"), "shared")
    discard(own)
    weight = shared.groupBy("rid").agg(F.sum(F.col("size") - 1).alias("w"))
    info = materialize(full.select("rid", "n", *SIG).join(weight, "rid"), "info")

    def meeting(pairs: DataFrame) -> DataFrame:
        """(a, b) of the distinct pairs that pass the bounds."""
        one, two = (info.select(F.col("rid").alias(c), F.struct("n", *SIG).alias(f"i{c}")) for c in "ab")
        return pairs.distinct().join(one, "a").join(two, "b").where(may_link("ia", "ib", percent)).select("a", "b")

    # each class with the hub of each of its tiles
    hubs = shared.join(info.select("rid", "w"), "rid").groupBy("tile").agg(F.max(F.struct("w", "rid"))["rid"].alias("a"))
    others = materialize(shared.join(hubs, "tile").where("rid <> a"), "others")
    discard(shared)
    links = verified(meeting(others.select("a", F.col("rid").alias("b"))), rows, k, percent)
    roots = components(links)
    discard(links)

    # hubs are done; where the others of a tile have several labels, the classes outside the most frequent one meet all
    # classes of other labels
    named = others.where("size > 2").select("tile", F.col("a").alias("hub"), "rid").join(roots.withColumnRenamed("node", "rid"), "rid", "left").join(info.select("rid", "n"), "rid").select("tile", "hub", "rid", "n", F.coalesce("root", "rid").alias("label"))
    tiles = materialize(labelled(named, "tile", "hub").where("labels > 1"), "tiles")
    mixed_ = materialize(named.join(tiles.select("tile"), "tile", "left_semi"), "mixed")
    groups = materialize(mixed_.select("hub", "rid", "n", "label").distinct(), "groups")
    hubs = materialize(labelled(groups, "hub").withColumnRenamed("cost", "once").join(tiles.groupBy("hub").agg(F.sum("cost").alias("each")), "hub"), "hubs")
    # (key, rid, label, top, size, outside): the tiles of a hub one by one, or as one group where that costs less
    shape = ["rid", "label", "top", "size", "outside"]
    by_tile = mixed_.join(tiles.join(hubs.where("each <= once"), "hub", "left_semi").drop("hub"), "tile").select(F.col("tile").alias("key"), *shape)
    by_hub = hot_join(groups, hubs.where("once < each").select("hub", "top", "size", "outside"), "hub", "size", groups.count(), "inner").select(F.col("hub").alias("key"), *shape)
    asked = materialize(by_tile.unionByName(by_hub).withColumn("blocks", F.ceil(F.col("size") / block)).withColumn("rounds", F.ceil(F.col("outside") / block)).drop("size", "outside"), "asked")
    ids = materialize(groups.select("rid").distinct(), "ids")
    signed = arrays_of(rows, ids, k, {"l": long_signature, "e": lower_halves})
    for t in (others, tiles, mixed_, groups, hubs):
        discard(t)
    held = asked.join(info.join(signed, "rid").select("rid", F.struct("n", *SIG, "l", "e").alias("i")), "rid")
    # a probe meets the targets of all blocks in its round; two that both lie outside the most frequent label meet once
    salt, count = F.xxhash64("rid"), lambda c: F.sequence(F.lit(0), F.col(c).cast("int") - 1)
    probes = held.where("label <> top").withColumn("block", F.explode(count("blocks"))).select("key", (F.pmod(salt, "rounds") * F.col("blocks") + F.col("block")).alias("salt"), F.col("rid").alias("a"), F.col("label").alias("la"), F.col("i").alias("ia"))
    targets = held.withColumn("round", F.explode(count("rounds"))).select("key", (F.col("round") * F.col("blocks") + F.pmod(salt, "blocks")).alias("salt"), F.col("rid").alias("b"), F.col("label").alias("lb"), (F.col("label") == F.col("top")).alias("inside"), F.col("i").alias("ib"))
    new = (F.col("la") != F.col("lb")) & (F.col("inside") | (F.col("a") < F.col("b")))
    met = probes.join(targets, (probes.key == targets.key) & (probes.salt == targets.salt) & new & may_link("ia", "ib", percent) & may_link_long("ia", "ib", percent) & may_link_whole("ia", "ib", percent))
    links = verified(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows, k, percent)
    if not links.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    for t in (info, ids, signed, asked, links):
        discard(t)

    whole = classes.join(roots, classes.rep == roots.node, "left").select("key", "least", "copies", F.coalesce("root", "rep").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(hot_join(whole, least.join(whole.groupBy("root").count(), "root"), "root", "count", classes.count(), "inner").select("key", "copies", "component_id", "root"), "components")
    linked = hot_join(full.where("n > 0"), named, "key", "copies", full.count()).select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "root")
    return linked.unionByName(full.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("rid").alias("root")))
