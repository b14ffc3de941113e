"""Near-dedup by sets of word shingles: every pair of texts with a Jaccard similarity of 0.8 or more is linked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm._shared import col, map_arrow, materialise, remove
from pipelens.llm.components import components
from pipelens.llm.simhash import fold, hashes

SHINGLE = 5
NUM, DEN = 4, 5  # the least similarity is NUM / DEN
SHARE, FREQUENT = 16, 200_000  # one text in so many is asked for frequent hashes, of which so many at most come last
WANTED = 27  # so many bits, at most, say which texts may be asked for
PAIRS = 1 << 18  # of a bucket's rows, looked at at once


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingles' XXH64 in ascending order; {0} without a word."""
    return _set(hashes(text, SHINGLE))


def _set(h: np.ndarray) -> np.ndarray:
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur repeatedly in a share of the texts, ascending, and how often. They only give the order in
    which hashes are met; any order finds all similar pairs, this one makes fewer others meet."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *map(shingle_set, b.column(0).to_pylist())]).view(np.int64))], names=["h"])

    share = texts.where(F.pmod(F.xxhash64("node", F.lit("order")), F.lit(SHARE)) == 0).select("text")
    found = map_arrow(share, run, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(s: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first hashes, rare ones before frequent ones, of which one at least is also in the prefix of any set that
    is similar enough. Such sets share NUM / DEN of their members, so the first hash that they share can't come later
    in either."""
    h, n = often
    if len(h):
        at = np.minimum(np.searchsorted(h, s), len(h) - 1)
        s = s[np.argsort(np.where(h[at] == s, n[at], 0), kind="stable")]
    return s[: len(s) - -(-NUM * len(s) // DEN) + 1]


def possible(n, at, m, bt) -> np.ndarray:
    """Whether sets of n and m members, whose first shared hash is at places at and bt, can be similar enough."""
    return (NUM + DEN) * np.minimum(n - at, m - bt) >= NUM * (n + m)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


_two = np.arange(1 << 16, dtype=np.uint32)
_HALF = sum((((_two >> (2 * j)) & 3) > 0).astype(np.uint8) << j for j in range(8)).astype(np.uint8)  # 16 buckets as 8


def sketch(s: np.ndarray) -> bytes:
    """Which buckets of the hashes' first bits a set occupies; two buckets a member at least, 64 at least."""
    bits = max(6, (2 * len(s) - 1).bit_length())
    full = np.zeros(1 << bits, np.uint8)
    full[s >> np.uint64(64 - bits)] = 1
    return np.packbits(full, bitorder="little").tobytes()


def may_be_similar(n: np.ndarray, a: list[bytes], m: np.ndarray, b: list[bytes]) -> np.ndarray:
    """Whether sets of n and m members with sketches a and b can be similar enough. A bucket that one occupies and the
    other doesn't holds a member that isn't shared, so what is ruled out is certain."""
    out = np.zeros(len(a), bool)
    size = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for la, lb in np.unique(size, axis=0):
        rows = np.flatnonzero((size == (la, lb)).all(axis=1))
        x, y = (np.frombuffer(b"".join([t[i] for i in rows]), np.uint8).reshape(len(rows), -1) for t in (a, b))
        while x.shape[1] > y.shape[1]:
            x = _HALF[x.view("<u2")]
        while y.shape[1] > x.shape[1]:
            y = _HALF[y.view("<u2")]
        both = np.minimum(n[rows] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m[rows] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        out[rows] = (NUM + DEN) * both >= NUM * (n[rows] + m[rows])
    return out


def _marks(texts: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def run(batches):
        for b in batches:
            sizes, first, fp, bits = [], [], [], []
            for t in b.column(1).to_pylist():
                h = hashes(t, SHINGLE)
                fp.append(fold(h))
                own = _set(h)
                sizes.append(len(own))
                bits.append(sketch(own))
                first.append(prefix(own, often))
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(bits, pa.binary())], names=["node", "n", "fp", "prefix", "sketch"])

    return map_arrow(texts, run, "node long, n int, fp long, prefix array<long>, sketch binary")


def _stars(met: DataFrame) -> DataFrame:
    """Of rows by (h, node): every one but the first of its hash, with that one's columns. Holds one row."""

    def run(batches):
        last = None
        for b in batches:
            if not len(b):
                continue
            h, *rest = (c.to_numpy() for c in b.columns)
            if last is not None:
                h, rest = np.concatenate([last[0], h]), [np.concatenate([x, y]) for x, y in zip(last[1], rest, strict=True)]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            own = np.flatnonzero(~new)
            last = (h[first[-1] :][:1], [x[first[-1] :][:1] for x in rest])
            yield pa.RecordBatch.from_arrays([pa.array(h[own]), *(pa.array(x[own]) for x in rest), *(pa.array(x[first[own]]) for x in rest)], names=["h", "node", "n", "pos", "node0", "n0", "pos0"])

    return map_arrow(met, run, "h long, node long, n int, pos int, node0 long, n0 int, pos0 int")


def _others(rows: DataFrame) -> DataFrame:
    """Of rows (h, node, n, pos, comp, sketch) by h: the pairs (u, v) with the same hash and different components that
    neither sizes and places nor sketches rule out."""

    def run(batches):
        now = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, object)]
        for b in batches:
            now = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(now, b.columns, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            yield from out([x[:cut] for x in now])
            now = [x[cut:] for x in now]
        yield from out(now)

    def out(now):
        h, node, n, pos, comp, bits = now
        cuts = np.flatnonzero(np.diff(h)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(h)], strict=True):
            if e - s < 2 or (comp[s:e] == comp[s]).all():
                continue
            step = max(1, PAIRS // int(e - s))
            for i in range(s, e, step):
                a, z = slice(i, min(i + step, e)), slice(s, e)
                ok = (comp[a, None] != comp[None, z]) & (node[a, None] < node[None, z])
                ok &= possible(n[a, None], pos[a, None], n[None, z], pos[None, z])
                x, y = np.nonzero(ok)
                most = max(1, (8 << 20) // max(map(len, bits[s:e])))
                for k in range(0, len(x), most):
                    u, v = x[k : k + most] + i, y[k : k + most] + s
                    left = may_be_similar(n[u].astype(np.int64), bits[u].tolist(), n[v].astype(np.int64), bits[v].tolist())
                    if left.any():
                        yield pa.RecordBatch.from_arrays([pa.array(node[u[left]]), pa.array(node[v[left]])], names=["u", "v"])

    return map_arrow(rows.repartition("h").sortWithinPartitions("h"), run, "u long, v long")


def _hoped(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The different pairs (u, v) that sizes and sketches don't rule out."""

    def test(batches):
        for b in batches:
            n, m = (b.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            ok = pa.array(may_be_similar(n, b.column(3).to_pylist(), m, b.column(5).to_pylist()))
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in b.columns[:2]], names=["u", "v"])

    u = marks.select(F.col("node").alias("u"), F.col("n").alias("n"), F.col("sketch").alias("a"))
    v = marks.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("sketch").alias("b"))
    met = pairs.distinct().join(u, "u").join(v, "v").where((NUM + DEN) * F.least("n", "m") >= NUM * (F.col("n") + F.col("m")))
    return map_arrow(met.select("u", "v", "n", "a", "m", "b"), test, "u long, v long")


def _asked(nodes: DataFrame):
    """A function that tells of an array of nodes which may be among these: all of them, and few others unless there are
    over 2 ** WANTED / 64. By one bit for each; the driver sees 2 ** WANTED / 64 numbers at most."""
    bits = min(WANTED, max(12, (64 * nodes.count()).bit_length()))
    at = F.shiftrightunsigned("node", 64 - bits)
    words = nodes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("x")).toArrow()
    mask = np.zeros(1 << (bits - 6), np.int64)
    mask[words.column("w").to_numpy()] = words.column("x").to_numpy()

    def asked(node: np.ndarray) -> np.ndarray:
        at = node.view(np.uint64) >> np.uint64(64 - bits)
        return (mask.view(np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    return asked


def _verified(pairs: DataFrame, texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose whole sets are similar enough. Sketches rule out most others first. Texts stay
    where they are read; only the sets of those that are asked for move."""
    pairs, pairs_path = materialise(_hoped(pairs, marks), "pairs")
    asked = _asked(pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct())

    def build(batches):
        seen: set[int] = set()
        for b in batches:
            at = [i for i in np.flatnonzero(asked(b.column(0).to_numpy())).tolist() if (k := b.column(0)[i].as_py()) not in seen and not seen.add(k)]
            if at:
                own = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([shingle_set(t).tobytes() for t in own.column(1).to_pylist()], pa.binary())], names=["node", "s"])

    def test(batches):
        for b in batches:
            a, z = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, z, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in b.columns[:2]], names=["u", "v"])

    sets, sets_path = materialise(map_arrow(texts, build, "node long, s binary").groupBy("node").agg(F.first("s").alias("s")), "sets")
    u, v = sets.select(F.col("node").alias("u"), F.col("s").alias("a")), sets.select(F.col("node").alias("v"), F.col("s").alias("b"))
    met = pairs.join(u, "u").join(v, "v").select("u", "v", "a", "b")
    found, _ = materialise(map_arrow(met, test, "u long, v long"), "similar")
    for path in (pairs_path, sets_path):
        remove(pairs.sparkSession, path)
    return found


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (u, v) that lie in different components."""
    a, b = comps.select(F.col("node").alias("u"), F.col("component").alias("a")), comps.select(F.col("node").alias("v"), F.col("component").alias("b"))
    return pairs.distinct().join(a, "u", "left").join(b, "v", "left").where(F.coalesce("a", "u") != F.coalesce("b", "v")).select("u", "v")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates=None) -> DataFrame:
    """(id_col, component_id) for every row of docs. Texts link if their sets of SHINGLE-word shingles have a Jaccard
    similarity of NUM / DEN at least; component_id is the smallest id reachable over links.

    Texts of fewer words are one shingle; those without a word link with each other. Null ids take part; a component
    of nothing else has a null component_id. Rows with the same id are rows of their own.

    Similar sets share a hash of their prefixes, a fifth of their members, so texts meet there by equality and no
    similar pair is missed. In each such bucket texts are first compared with the first one; pairs that this hasn't
    linked, directly or over others, are compared next. What sizes and sketches (`may_be_similar`) don't rule out is
    compared by whole sets. `candidates` makes pairs (u, v) of nodes out of the table of
    marks (node, n, fp, prefix); they are compared before all others, and what they link needs no other comparison. So copies in a large group cost one comparison a text; texts
    that share a hash but aren't similar cost one a pair, unless sizes and places rule it out.
    """
    texts = docs.select(F.xxhash64(col(text_col)).alias("node"), col(text_col).alias("text"))
    marks = _marks(texts, frequent(texts)).groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "fp", "prefix", "sketch")))
    marks, marks_path = materialise(marks, "marks")
    if candidates:
        linked = _verified(candidates(marks), texts, marks)
    else:
        linked = marks.sparkSession.createDataFrame([], "u long, v long")
    met = marks.select("node", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "node", "n", "pos")
    stars, stars_path = materialise(_stars(met.repartition("h").sortWithinPartitions("h", "node")), "buckets")
    fits = (NUM + DEN) * F.least(F.col("n") - F.col("pos"), F.col("n0") - F.col("pos0")) >= NUM * (F.col("n") + F.col("n0"))
    pairs = stars.where(fits).select(F.col("node0").alias("u"), F.col("node").alias("v"))
    linked = linked.unionAll(_verified(_apart(pairs, components(linked)) if candidates else pairs, texts, marks))
    comps = components(linked)
    own = stars.select("h", "node", "n", "pos").join(comps, "node", "left").select("h", "node", "n", "pos", F.coalesce("component", "node").alias("comp"))
    mixed = own.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a <> z")
    rows = own.join(mixed, "h", "left_semi").join(marks.select("node", "sketch"), "node").select(*own.columns, "sketch")
    more = _verified(_others(rows), texts, marks)
    comps = components(linked.unionAll(more))
    for path in (marks_path, stars_path):
        remove(docs.sparkSession, path)
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("node"))
    placed = rows.groupBy("node").agg(F.min("id").alias("least")).join(comps, "node", "left").select("node", "least", F.coalesce("component", "node").alias("comp"))
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = placed.select("node", "comp").join(smallest, "comp").select("node", "component_id")
    return rows.join(named, "node").select(F.col("id").alias(id_col), "component_id")
