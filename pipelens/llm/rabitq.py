"""Embedding near-dedup: randomly rotated binary codes with correction factors screen pairs for exact cosines."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm._shared import col, map_arrow, materialise
from pipelens.llm.components import components

BITS = 128  # of a code, at least; vectors are padded with zeros up to a multiple of 64
PLANES = 4  # bits of a rotated coordinate on the other side of an estimate
SIGMAS = 5.5  # of the confidence bounds: a link is missed with a chance under 1e-7
SLACK = 1e-4  # for estimates, which are made in single precision
TILES, TILE = 8, 8192  # tiles at least (of over so many vectors), and vectors a tile, about
SEED = 20260


def rotation(dim: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """(padded, dim): the first columns of a random rotation of the padded space."""
    padded = max(bits, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(padded, padded)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def code_type(padded: int) -> np.dtype:
    words = padded // 64
    return np.dtype([("key", "i8"), ("key2", "i8"), ("code", "u8", words), ("planes", "u8", (PLANES, words)), ("fit", "f4"), ("low", "f4"), ("step", "f4")])


def row_type(dim: int, vector: str, padded: int) -> np.dtype:
    return np.dtype([*((n, code_type(padded)[n]) for n in code_type(padded).names), ("copies", "i8"), ("norm", "f8"), ("v", vector, dim)])


def scaled(v: np.ndarray) -> np.ndarray:
    """v in double precision, by powers of two near 1: no square overflows or vanishes, and cosines stay what they are."""
    v = v.astype(float)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def encode(v: np.ndarray, turn: np.ndarray, out: np.ndarray) -> None:
    """v: scaled. Fills the code of every vector and what estimates need: `fit`, the inner product of the rotated unit vector and
    its code; and the rotated vector in PLANES bits, rounded at random (by the row's key), which keeps estimates unbiased."""
    y = (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ turn.T
    padded = y.shape[1]
    out["fit"] = np.abs(y).sum(axis=1) / math.sqrt(padded)
    bits = lambda b: np.packbits(b, axis=1, bitorder="little").view("<u8")
    out["code"] = bits(y > 0)
    low, top = y.min(axis=1), y.max(axis=1)
    step = np.maximum((top - low) / (2**PLANES - 1), 1e-12)
    noise = np.random.default_rng(SEED).random(padded)[None, :]
    noise = np.modf(noise + (out["key"] % 9973)[:, None] / 9973.0)[0]
    u = np.clip(np.floor((y - low[:, None]) / step[:, None] + np.abs(noise)), 0, 2**PLANES - 1).astype(np.int64)
    for j in range(PLANES):
        out["planes"][:, j] = bits((u >> j & 1).astype(bool))
    out["low"], out["step"] = low, step


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def signs(rows: np.ndarray) -> np.ndarray:
    """The codes as vectors of +1 and -1, divided by fit and by the root of their length: an estimate's left side."""
    padded = rows["code"].shape[1] * 64
    return (_bits(rows["code"]).astype(np.float32) * 2 - 1) / (rows["fit"] * np.float32(math.sqrt(padded)))[:, None]


def levels(rows: np.ndarray) -> np.ndarray:
    """The rotated vectors as their PLANES bits give them: an estimate's right side."""
    u = sum(_bits(rows["planes"][:, j]).astype(np.float32) * (1 << j) for j in range(PLANES))
    return rows["low"][:, None] + rows["step"][:, None] * u


def width(fit: np.ndarray, step: np.ndarray, padded: int) -> np.ndarray:
    """Of the bounds of estimates: SIGMAS deviations of what the code leaves out and of the rounding."""
    fit = fit.astype(float)
    return SIGMAS * np.sqrt((1 - fit**2) / fit**2 / (padded - 1) + (step / 2 / fit) ** 2) + SLACK


def screen(a: np.ndarray, b: np.ndarray | None, least: float):
    """Pairs (i, j) of rows of a and b (None: within a, i < j) whose estimate's upper bound reaches `least`, in runs.
    Every pair is estimated: a run's estimates are one matrix product."""
    other = a if b is None else b
    padded = a["code"].shape[1] * 64
    if not len(a) or not len(other):
        return
    right, coarse = levels(other).T, float(other["step"].max())
    step = max(1, (1 << 20) // len(other))
    for at in range(0, len(a), step):
        own = a[at : at + step]
        first = at + 1 if b is None else 0
        value = signs(own) @ right[:, first:]
        i, j = np.nonzero(value >= (least - width(own["fit"], coarse, padded)).astype(np.float32)[:, None])
        near = value[i, j] + width(own["fit"][i], other["step"][j + first], padded) >= least
        i, j = i[near] + at, j[near] + first
        yield (i[i < j], j[i < j]) if b is None else (i, j)


def tile_links(a: np.ndarray, b: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j) of rows of a and b (None: within a, i < j) with a cosine of `least` or more; and how many pairs
    were computed exactly."""
    other = a if b is None else b
    out_i, out_j, exact = [], [], 0
    va, vb = scaled(a["v"]), scaled(other["v"])
    for i, j in screen(a, b, least):
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            exact += len(x)
            cos = np.einsum("ij,ij->i", va[x], vb[y]) / (a["norm"][x] * other["norm"][y])
            out_i.append(x[cos >= least])
            out_j.append(y[cos >= least])
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *out_i]), np.concatenate([z, *out_j]), exact


def _smallest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (before == low).all():
            return low


def tile_count(n: int, dim: int = BITS) -> int:
    """Long vectors have smaller tiles, as a task holds two of them."""
    return max(TILES, -(-n // max(1, TILE * BITS // max(dim, BITS)))) if n > TILES else 1


def _by_pair(batches, dtype: np.dtype):
    """Of rows (pair, side, row) by pair: (pair, rows of sides 0 and 2, rows of side 1; None: within the tile)."""
    now, parts = None, []

    def out():
        side, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return now, rows[side != 1], None if side[0] == 2 else rows[side == 1]

    for b in batches:
        pair = b.column(0).to_numpy()
        for s, e in zip(*(lambda c: ([0, *c], [*c, len(pair)]))((np.flatnonzero(np.diff(pair)) + 1).tolist()), strict=True) if len(pair) else ():
            if pair[s] != now:
                if parts:
                    yield out()
                now, parts = pair[s], []
            parts.append((b.column(1)[s:e].to_numpy(), np.frombuffer(b"".join(b.column(2)[s:e].to_pylist()), dtype)))
    if parts:
        yield out()


def linked(nodes: DataFrame, n: int, dim: int, vector: str, least: float) -> DataFrame:
    """nodes: key, key2, copies long, v binary. (key, key2, n, root): for each node and tile pair in which it has
    links, the copies of its partners there, and the smallest key that it reaches there.

    Codes go to all pairs of tiles, which tell the nodes that take part in a pair whose bound reaches `least`. Only these
    nodes' vectors follow, to the pairs of tiles that asked for them."""
    tiles, turn = tile_count(n, dim), rotation(dim)
    codes, dtype = code_type(len(turn)), row_type(dim, vector, len(turn))

    def read(b):
        rows = np.zeros(len(b), dtype)
        for name, k in (("key", 0), ("key2", 1), ("copies", 2)):
            rows[name] = b.column(k).to_numpy()
        rows["v"] = np.frombuffer(b"".join(b.column(3).to_pylist()), vector).reshape(len(b), dim)
        v = scaled(rows["v"])
        rows["norm"] = np.sqrt((v * v).sum(axis=1))
        encode(v, turn, rows)
        return rows

    def tile_of(key2):
        return (key2.view(np.uint64) % np.uint64(tiles)).astype(np.int64)

    def deal(batches):
        for b in batches:
            rows, own = read(b), np.zeros(len(b), codes)
            for name in codes.names:
                own[name] = rows[name]
            tile, raw = tile_of(rows["key2"]), pa.array([r.tobytes() for r in own], pa.binary())
            for other in range(tiles):
                lo, hi = np.minimum(tile, other), np.maximum(tile, other)
                side = np.where(tile == other, 2, (tile > other).astype(int)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(lo * tiles + hi), pa.array(side), raw], names=["pair", "side", "row"])

    def ask(batches):
        for pair, a, b in _by_pair(batches, codes):
            at_a, at_b = np.zeros(len(a), bool), np.zeros(len(a if b is None else b), bool)
            for i, j in screen(a, b, least):
                at_a[i], at_b[j] = True, True
            parts = [(a[at_a | at_b], 2)] if b is None else [(a[at_a], 0), (b[at_b], 1)]
            for rows, side in parts:
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), pair)), pa.array(np.full(len(rows), side, np.int8)), pa.array(rows["key"]), pa.array(rows["key2"])], names=["pair", "side", "key", "key2"])

    def send(batches):
        for b in batches:
            raw = pa.array([r.tobytes() for r in read(b.select([2, 3, 4, 5]))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw], names=["pair", "side", "row"])

    def meet(batches):
        for _, a, b in _by_pair(batches, dtype):
            i, j, _ = tile_links(a, b, least)
            if not len(i):
                continue
            rows, j = (a, j) if b is None else (np.concatenate([a, b]), j + len(a))
            order = np.lexsort((rows["key2"], rows["key"]))
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows))
            count = np.bincount(i, rows["copies"][j], len(rows)) + np.bincount(j, rows["copies"][i], len(rows))
            low = _smallest(len(rows), rank[i], rank[j])
            at = np.flatnonzero(count)
            root = rows["key"][order[low[rank[at]]]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["key"][at]), pa.array(rows["key2"][at]), pa.array(count[at].astype(np.int64)), pa.array(root)], names=["key", "key2", "n", "root"])

    by_pair = lambda df: df.repartition("pair").sortWithinPartitions("pair")
    dealt = map_arrow(nodes.select("key", "key2", "copies", "v"), deal, "pair long, side byte, row binary")
    asked = map_arrow(by_pair(dealt), ask, "pair long, side byte, key long, key2 long")
    wanted = asked.join(nodes, ["key", "key2"]).select("pair", "side", "key", "key2", "copies", "v")
    return map_arrow(by_pair(map_arrow(wanted, send, "pair long, side byte, row binary")), meet, "key long, key2 long, n long, root long")


def _as_bytes(df: DataFrame, vector: str) -> DataFrame:
    def run(batches):
        for b in batches:
            flat, width = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(vector), np.dtype(vector).itemsize
            ends = np.cumsum([len(x) for x in b.column(3)]) * width
            data = flat.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([data[e0:e] for e0, e in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], names=["key", "key2", "copies", "v"])

    return df.mapInArrow(run, "key long, key2 long, copies long, v binary")


def near_dups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: the other rows that it links to by a cosine of `least` or
    more in double precision, the smallest id reachable over links, and whether it is the row's own.

    Null vectors, zero vectors and those with a null or non-finite component link with nothing; vectors of different
    lengths don't link with each other. Null ids take part; a component of nothing else has a null component_id. Rows with
    the same id are rows of their own. Vectors are scaled by powers of two, so large and tiny components count as they are.

    Equal vectors are one node with a number of copies, so groups of copies cost one row. Nodes of one length meet in
    pairs of tiles, each of which holds about TILE of them, whatever groups there are. A node's code goes to as many
    tasks as there are tiles, its vector only where an estimate's bound asks for it. Every pair is estimated, so the work
    grows with the square of the number of different vectors, a few nanoseconds a pair. Tasks return counts and a
    spanning forest, never pairs.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    vector = "<f4" if kind == "float" else "<f8"
    e = col(vector_col)
    ok = e.isNotNull() & F.exists(e, lambda x: x != 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(col(id_col).alias("id"), F.when(F.coalesce(ok, F.lit(False)), e.cast("array<float>" if kind == "float" else "array<double>")).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("key2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("2"), "v")))
    nodes = rows.where("v is not null").groupBy("key", "key2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("v").alias("v"))
    nodes, _ = materialise(nodes, "vectors")
    sizes = sorted((r["dim"], r["count"]) for r in nodes.groupBy(F.size("v").alias("dim")).count().collect())
    parts = [linked(_as_bytes(nodes.where(F.size("v") == dim).select("key", "key2", "copies", "v"), vector), n, dim, vector, least) for dim, n in sizes]
    found, _ = materialise(reduce(DataFrame.unionAll, parts, nodes.select("key", "key2", F.lit(0).cast("long").alias("n"), F.col("key").alias("root")).limit(0)), "found")
    counts = found.groupBy("key", "key2").agg(F.sum("n").alias("links"))
    comps = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    placed = nodes.select("key", "key2", "copies", "least").join(counts, ["key", "key2"], "left").join(comps, F.col("key") == F.col("node"), "left")
    placed = placed.select("key", "key2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.coalesce("component", "key").alias("comp"))
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    placed = placed.join(smallest, "comp").select("key", "key2", "n_links", "component_id")
    out = rows.select("id", "key", "key2").join(placed, ["key", "key2"], "left")
    comp = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))




ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
reach AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM reach r JOIN l ON r.w = l.u)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN (SELECT u, least(u, min(w)) AS c FROM reach GROUP BY u) r ON r.u = e.vec_id
"""
