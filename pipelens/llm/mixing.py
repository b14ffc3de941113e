"""Mixing sources to target weights: Pfair scheduling of source blocks, earliest deadline first."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm._shared import col, fresh

BLOCK = 32  # documents a block, unless that makes over SLOTS blocks
SLOTS = 1 << 18  # blocks of all sources together, about: what the driver schedules, and a task gets to know
BUCKET = 2048  # rows of a source that one sort orders, about
TARGET = (5, 3, 1)  # weights of the registered query and of the pipeline's stage: sources in the order of their names take them in turn


def shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers without a common divisor, in exactly their proportions."""
    if not weights or any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    exact = {s: Fraction(w) for s, w in weights.items()}
    whole = math.lcm(*(w.denominator for w in exact.values()))
    common = math.gcd(*(int(w * whole) for w in exact.values()))
    return {s: int(w * whole) // common for s, w in exact.items()}


def windows(share: int, period: int, k: int) -> tuple[int, int]:
    """Release time and deadline of a source's block k: it runs in one of the slots floor(k/w) to ceil((k+1)/w)-1."""
    return k * period // share, -(-(k + 1) * period // share)


def phases(share: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """The schedule, slot by slot: of the released blocks, that with the earliest deadline (ties: by name). A phase ends
    when a source has no block left; the rest then go on by their weights among themselves. Each phase has its first
    slot, the sum of its shares (period), its shares, the blocks that each source had before, and their slots in it."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        now = {s: share[s] for s in left}
        common = math.gcd(*now.values())
        now = {s: w // common for s, w in now.items()}
        period, slots, t = sum(now.values()), {s: [] for s in now}, 0
        ready = [(windows(w, period, 0)[1], s) for s, w in now.items()]
        heapq.heapify(ready)
        waiting: list[tuple[int, str]] = []  # a source's next block, by its release
        ended = False
        while not ended:
            while waiting and waiting[0][0] <= t:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (windows(now[s], period, len(slots[s]))[1], s))
            deadline, s = heapq.heappop(ready)
            if deadline <= t:
                raise AssertionError(f"a block of {s} misses its deadline {deadline}")
            slots[s].append(t)
            heapq.heappush(waiting, (windows(now[s], period, len(slots[s]))[0], s))
            ended, t = len(slots[s]) == left[s], t + 1
        out.append({"start": start, "period": period, "share": now, "before": {s: done[s] for s in now}, "slots": slots})
        for s, own in slots.items():
            done[s] += len(own)
            left[s] -= len(own)
            if not left[s]:
                del left[s]
        start += t
    return out


def _slot(plan: list[dict], source: str, k: int) -> int:
    p = [p for p in plan if source in p["share"] and p["before"][source] <= k][-1]
    return p["start"] + p["slots"][source][k - p["before"][source]]


def in_turn(target=TARGET):
    """Weights for any sources: in the order of their names they take the numbers of target in turn."""
    return lambda names: {s: target[k % len(target)] for k, s in enumerate(sorted(names, key=lambda s: (s is not None, s)))}


def schedule(docs: DataFrame, weights=None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, slots: int = SLOTS):
    """Places every row of docs: returns (rows with columns block, slot, release, deadline, position, number of rows).

    A source's rows, in the order of the rows' hash, make blocks of `block` rows (the last may be shorter); blocks are
    larger where that would make over `slots` of them. Source s of weight w, taken exactly, releases block k at slot
    floor(k/w), due by ceil((k+1)/w); earliest deadline first fills each slot, so after every slot of a phase each source
    has had its weight's share but for less than one block. When a source runs out, the others go on by their weights
    among themselves. weights: by source, or a function of the list of sources (`in_turn`). Without weights every source
    counts alike; a source that weights doesn't name counts as the least that it names. No row is dropped or repeated.
    Null is a source of its own; null ids are ordinary rows, and so are repeated rows: the order is that of a hash of
    the whole row, so it doesn't depend on how rows are dealt, and rows that are alike in every column may stand for
    each other. Columns named like ours are kept, ours get an underscore.

    Rows are ranked in (source, bucket) pieces of about BUCKET rows; only counts by piece meet, so no source lands in
    one task. The driver works out the slot of each block and hands the list on: four numbers a block, so about 8 MB
    at most, and a row for each source. Its time grows with the blocks, and with the square of the number of sources
    where these run out one by one.
    """
    spark, (src, bucket, rank, b, slot, release, deadline, position, name_, piece, before_, plan_) = docs.sparkSession, fresh(docs, "src", "bucket", "rank", "block", "slot", "release", "deadline", "position", "src_name", "piece", "rows_before", "plan")
    name = F.coalesce(F.concat(F.lit("="), col(source_col)), F.lit("null"))
    counts = {r["s"]: r["n"] for r in docs.groupBy(name.alias("s")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    block = max(block, -(-total // slots))
    if callable(weights):
        weights = weights([s[1:] if s != "null" else None for s in counts])
    given = {f"={s}" if s is not None else "null": w for s, w in (weights or {}).items()}
    share = shares({s: given.get(s, min(given.values(), default=1)) for s in counts}) if counts else {}

    hashed = [col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    key, second = F.xxhash64(F.lit("mix"), *hashed), F.xxhash64(F.lit("mix again"), *hashed)
    table = spark.createDataFrame(_table(share, counts, block), "s string, pieces long, at array<struct<slot: long, release: long, deadline: long, position: long>>")
    small = F.broadcast if len(counts) <= slots else lambda x: x
    ranked = docs.withColumn(src, name).join(small(table.select(F.col("s").alias(name_), F.col("pieces").alias(piece))), F.col(src) == F.col(name_))
    # the hash's range, cut into equal parts: a piece holds smaller hashes than the next one
    ranked = ranked.withColumn(bucket, F.floor((F.shiftrightunsigned(key, 33) * F.col(piece)) / F.lit(2**31)).cast("long")).drop(name_, piece)
    sizes = ranked.groupBy(F.col(src).alias(name_), F.col(bucket).alias(piece)).agg(F.count("*").alias(rank))
    earlier = Window.partitionBy(name_).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(name_, piece, F.coalesce(F.sum(rank).over(earlier), F.lit(0)).alias(before_))
    ranked = ranked.withColumn(rank, F.row_number().over(Window.partitionBy(src, bucket).orderBy(F.shiftrightunsigned(key, 33), key, second)) - 1)
    ranked = ranked.join(before, (F.col(src) == F.col(name_)) & (F.col(bucket) == F.col(piece)))
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before_)).withColumn(b, F.floor(F.col(rank) / block)).drop(name_, piece, before_)
    out = ranked.join(small(table.select(F.col("s").alias(name_), F.col("at").alias(plan_))), F.col(src) == F.col(name_))
    place = F.col(plan_)[F.col(b)]
    found = {b: F.col(b), slot: place["slot"], release: place["release"], deadline: place["deadline"], position: place["position"] + F.col(rank) % block}
    return out.select(*(col(c) for c in docs.columns), *(x.cast("long").alias(c) for c, x in found.items())), total


def _table(share: dict[str, int], counts: dict[str, int], block: int) -> list[tuple]:
    """(source, pieces to rank it in, slot, release, deadline and first row's position of every block)."""
    blocks = {s: -(-n // block) for s, n in counts.items()}
    order, found = [], {s: [] for s in counts}
    for p in phases(share, blocks):
        for s, own in p["slots"].items():
            for k, t in enumerate(own):
                order.append((p["start"] + t, s, p["before"][s] + k))
                found[s].append([p["start"] + t, *(p["start"] + x for x in windows(p["share"][s], p["period"], k)), 0])
    position = 0
    for _, s, k in sorted(order):
        found[s][k][3] = position
        position += min(block, counts[s] - k * block)
    return [(s, max(1, n // BUCKET), [tuple(x) for x in found[s]]) for s, n in counts.items()]


def mix(docs: DataFrame, weights=None, rows_a_part: int = 5_000, **options) -> DataFrame:
    """docs in the order of the schedule: written as they are, the files follow each other in it. Positions are dense,
    so each row knows its partition, and no sampling pass is needed."""
    out, n = schedule(docs, weights, **options)
    position = out.columns[-1]
    parts = max(1, min(-(-n // rows_a_part), 100_000))
    return out.repartitionById(parts, F.floor(F.col(position) * parts / max(1, n)).cast("int")).sortWithinPartitions(position).select(*(col(c) for c in docs.columns))


def placed(spark, docs: DataFrame) -> DataFrame:
    """op3: where each document goes, by the target weights 5, 3 and 1."""
    return schedule(docs.select("doc_id", "source"), in_turn())[0]
