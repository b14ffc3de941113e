"""SimHash near-dedup: fingerprints of word shingles, linked by exact tiled comparison."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm._shared import col, fresh, map_arrow, materialise
from pipelens.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCKS = 4  # 64 bits in so many blocks; a tile has one population count for each
TILE = 4096  # fingerprints compared at once with as many others


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of all shingles, repeats included; a text of fewer words is one shingle, one without a word has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    view, digest = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    last = ends[min(shingle, len(ends)) - 1 :]
    return np.array([digest(view[a : b - 1], SEED) for a, b in zip([0, *ends], last, strict=False)], np.uint64)


def fold(h: np.ndarray) -> int:
    """Bit b is set if bit b is set in over half of the hashes. Zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return fold(hashes(text, shingle))


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", out: str = "fp") -> DataFrame:
    """The columns `keep` of docs and out (long, the fingerprint's bits as a signed number)."""
    picked = docs.select(*(col(c) for c in keep), col(text_col).alias("text" if "text" not in keep else fresh(docs, "text")[0]))
    schema = docs.select(*(col(c) for c in keep), F.lit(0).cast("long").alias(out)).schema

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], names=[*keep, out])

    return map_arrow(picked, run, schema)


def _counts(fp: np.ndarray) -> np.ndarray:
    """The tile key: the blocks' population counts as the digits of one number."""
    bits, key = 64 // BLOCKS, np.zeros(len(fp), np.int64)
    for k in range(BLOCKS):
        key = key * (bits + 1) + np.bitwise_count((fp.view(np.uint64) >> np.uint64(k * bits)) & np.uint64(2**bits - 1))
    return key


def _key_column(fp: str):
    bits, key = 64 // BLOCKS, F.lit(0).cast("long")
    for k in range(BLOCKS):
        key = key * (bits + 1) + F.bit_count(F.shiftrightunsigned(F.col(fp), k * bits).bitwiseAND(F.lit(2**bits - 1)))
    return key


def _neighbours(keys: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (a <= b) of places in the sorted keys whose counts differ by RADIUS at most, summed over the blocks."""
    bits = 64 // BLOCKS
    base = [(bits + 1) ** (BLOCKS - 1 - k) for k in range(BLOCKS)]
    digits = np.stack([keys // b % (bits + 1) for b in base], axis=1)
    out = [(a, a) for a in range(len(keys))]
    for d in product(range(-RADIUS, RADIUS + 1), repeat=BLOCKS):
        if (shift := sum(x * b for x, b in zip(d, base, strict=True))) > 0 and sum(map(abs, d)) <= RADIUS:
            ok = ((digits + d >= 0) & (digits + d <= bits)).all(axis=1)
            at = np.searchsorted(keys, keys + shift)
            ok &= (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == keys + shift)
            out += zip(np.flatnonzero(ok).tolist(), at[ok].tolist(), strict=True)
    return out


class Tiles:
    """Which pairs of tiles a fingerprint takes part in. A key with over TILE fingerprints has several tiles. There
    are (64 / BLOCKS + 1) ** BLOCKS = 83,521 keys at most, whatever the number of documents."""

    def __init__(self, counts: dict[int, int]):
        self.keys = np.array(sorted(counts), np.int64)
        self.subs = np.array([-(-counts[int(k)] // TILE) for k in self.keys], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.subs)[:-1]]) if len(self.keys) else np.zeros(0, np.int64)
        self.total = int(self.subs.sum())
        self.left: list[list[int]] = [[] for _ in self.keys]
        self.right: list[list[int]] = [[] for _ in self.keys]
        for a, b in _neighbours(self.keys):
            self.left[a].append(b)
            if a != b:
                self.right[b].append(a)

    def pairs(self, place: int, sub: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the tile pairs of tile `sub` of a key, and the side on which it stands in each."""
        own, out, side = int(self.first[place]) + sub, [], []
        for others, s in ((self.left[place], 0), (self.right[place], 1)):
            for o in others:
                t = int(self.first[o]) + np.arange(int(self.subs[o]))
                lo, hi = np.minimum(own, t), np.maximum(own, t)
                out.append(lo * self.total + hi)
                side.append(np.where(t == own, 2, (own > t).astype(np.int8)) if o == place else np.full(len(t), s, np.int8))
        return np.concatenate(out), np.concatenate(side).astype(np.int8)


def compare(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links within one tile pair (b None: within a) as (fingerprint, smallest one its links reach here)."""
    both = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    low = np.arange(len(both))
    ia, ib, step = [], [], max(1, (1 << 20) // max(1, len(other)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ other[None, :]) <= RADIUS)
        ok = slice(None) if b is not None else x + i < y
        ia.append(x[ok] + i)
        ib.append(y[ok] + shift)
    x, y = np.concatenate(ia), np.concatenate(ib)
    if not len(x):
        return both[:0], both[:0]
    order = np.argsort(both.view(np.int64), kind="stable")  # the smallest by value is the smallest by rank
    rank = np.empty(len(both), np.int64)
    rank[order] = np.arange(len(both))
    x, y, low = rank[x], rank[y], np.arange(len(both))
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (before == low).all():
            break
    moved = np.flatnonzero(low != np.arange(len(low)))
    return both[order[moved]], both[order[low[moved]]]


def links(fps: DataFrame) -> DataFrame:
    """fps: one long column fp, distinct. Returns (u, v) links that span every group of fingerprints which differ in
    RADIUS bits at most, directly or over others."""
    tiles = Tiles({r["key"]: r["count"] for r in fps.select(_key_column("fp").alias("key")).groupBy("key").count().collect()})

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            place = np.searchsorted(tiles.keys, _counts(fp))
            sub = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % tiles.subs[place]
            tile = tiles.first[place] + sub
            order = np.argsort(tile, kind="stable")
            cuts = np.flatnonzero(np.diff(tile[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                pair, side = tiles.pairs(int(place[rows[0]]), int(sub[rows[0]]))
                for k in range(0, len(rows), max(1, (1 << 18) // len(pair))):
                    own = fp[rows[k : k + max(1, (1 << 18) // len(pair))]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(pair, len(own))), pa.array(np.repeat(side, len(own))), pa.array(np.tile(own, len(pair)))], names=["pair", "side", "fp"])

    def meet(batches):
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64))
        for batch in batches:
            now = tuple(np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            yield from out(*(x[:cut] for x in now))
            rest = tuple(x[cut:] for x in now)
        yield from out(*rest)

    def out(pair, side, fp):
        us, vs = [], []
        for rows in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(pair)) + 1) if len(pair) else ():
            a, b = fp[rows][side[rows] != 1].view(np.uint64), fp[rows][side[rows] == 1].view(np.uint64)
            own = bool(len(rows)) and side[rows[0]] == 2
            if own and len(a) > 1 or not own and len(a) and len(b):
                u, v = compare(a, None if own else b)
                us.append(u)
                vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], names=["u", "v"])

    # by their own shuffle: few small files would be few tasks
    dealt = map_arrow(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"), deal, "pair long, side byte, fp long")
    return map_arrow(dealt.repartition("pair").sortWithinPartitions("pair"), meet, "u long, v long")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for every row of docs. Documents link if their fingerprints differ in RADIUS bits at
    most; component_id is the smallest id reachable over links.

    Null and empty texts and texts without a word have fingerprint zero and link like any other. Null ids take part;
    a component that has nothing but null ids has a null component_id. Rows with the same id are rows of their own.
    Whole texts are hashed in one Arrow pass; from there on only (id, fingerprint) moves. Equal fingerprints are one
    node, so a group of copies of any size costs one row. Tiles bound what a task compares at once.
    """
    own, node, comp = (f"{x}__simhash" for x in ("fp", "node", "component"))
    rows, _ = materialise(fingerprints(docs, [id_col], text_col, own), "fingerprints")
    least = rows.groupBy(own).agg(F.min(col(id_col)).alias("least"))
    least, _ = materialise(least, "nodes")
    comps = components(links(least.select(F.col(own).alias("fp")))).select(F.col("node").alias(node), F.col("component").alias(comp))
    placed = least.join(comps, F.col(own) == F.col(node), "left").select(own, "least", F.coalesce(comp, own).alias(comp))
    smallest = placed.groupBy(comp).agg(F.min("least").alias("component_id"))
    named = placed.select(own, comp).join(smallest, comp).select(F.col(own).alias(node), "component_id")
    return rows.join(named, F.col(own) == F.col(node), "left").select(col(id_col), F.col(own).alias("fp"), "component_id")


def group_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) for every row of docs, where texts link if their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more (`shingle_sets`, which says what becomes of odd rows). Fingerprints of these shingles
    that differ in RADIUS bits at most give the first candidates, which are then compared by their whole sets. A few
    edits change more bits than that, so pairs which no fingerprint has brought together are found by shared shingles."""
    from pipelens.llm import shingle_sets

    def candidates(marks: DataFrame) -> DataFrame:
        least = marks.groupBy("fp").agg(F.min("node").alias("first"))
        near = links(least.select("fp"))
        far = near.join(least.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
        same = marks.join(least, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
        return same.unionAll(far.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))

    return shingle_sets.group(docs, id_col, text_col, candidates)


def near_dups(spark, docs: DataFrame) -> DataFrame:
    return group(docs.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
