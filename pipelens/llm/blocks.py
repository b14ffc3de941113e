"""Texts that meet what is known of their parts, without a hot key and without the parts' table in any task's memory.

A task cuts its texts into blocks of BLOCK bytes and names each block's distinct parts (words, units) once. What is
known of them comes by a join over all documents and goes back to the blocks that hold them, where the texts, kept in
compressed batches, meet their dictionary in one sorted stream: memory holds one block's dictionary. A part has one row
a block, however often it occurs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm._shared import col, fresh, map_arrow, materialise

BLOCK = 32 << 20  # bytes of text that share one dictionary in a worker's memory
SLICE = 1 << 20  # bytes of text that are looked at at once
PACK = 1 << 18  # bytes of text, and at most that many rows / 32 of known parts, that are packed into one row: larger ones
# would be objects of whole heap regions in the executor; divides BLOCK
PACKED = "block long, late boolean, packed binary"


def _same_twice(df: DataFrame) -> bool:
    """Whether two scans of df deal its rows to the same partitions: nothing but projections and filters of a source."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(re.match(r"[\s:+-]*(Project|Filter|Relation|LocalRelation|LogicalRDD)\b", x) for x in plan.splitlines())


def _blocks(batches, at: int):
    """(block, slice) of the batches; text is column `at`. A row's block follows from the bytes of text before it in
    its task alone, as the two scans' batches may be cut differently. The last column is the number of the scan's
    partition; within a union the task's own number would be another."""
    total = 0
    for b in batches:
        if not len(b):
            continue
        base = b.column(b.num_columns - 1)[0].as_py() << 24
        b = b.select(list(range(b.num_columns - 1)))
        ends = np.cumsum(pc.binary_length(b.column(at)).fill_null(0).to_numpy(), dtype=np.int64) + total
        starts = np.concatenate([[total], ends[:-1]])
        cuts = (np.flatnonzero(np.diff(starts // PACK)) + 1).tolist()
        for s, e in zip([0, *cuts], [*cuts, len(b)], strict=True):
            yield base + int(starts[s]) // BLOCK, b.slice(s, e - s)
        total = int(ends[-1])


def slices(batch: pa.RecordBatch, at: int):
    """batch in runs of about SLICE bytes of text, which is column `at`; one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist()
    for s, e in zip([0, *cuts], [*cuts, len(batch)], strict=True):
        if e > s:
            yield batch.slice(s, e - s)


def _row(block: int, late: bool, table) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write(table)
    data = sink.getvalue()
    packed = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], np.int32)), data])
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([late]), packed], names=["block", "late", "packed"])


def meet(docs: DataFrame, text_col: str, parts, known, begin, finish, schema, trim=lambda b: b, at_once: int = SLICE) -> DataFrame:
    """finish(rows, begin(tables)) for all rows of docs in batches of about `at_once` bytes of text, by tasks.

    parts(texts): the distinct parts of a column of texts that are looked up. known(pairs): of rows (block, part), the
    rows of those that are known with more columns, by a join on part. trim(batch) may change these rows before they are
    packed. begin(tables): what finish is given; a block's known rows without their block. If docs isn't a plain scan it
    is written to the shared folder first, as it is read twice."""
    if not _same_twice(docs):
        docs, _ = materialise(docs, "to-meet")
    place, number = docs.columns.index(text_col), fresh(docs, "number")[0]

    def name_parts(batches):
        now, seen, n = None, [], 0
        for block, b in _blocks(batches, 0):
            if block != now:
                yield from flush(now, seen)
                now, seen, n = block, [], 0
            seen.append(parts(b.column(0)))
            n += len(seen[-1])
            if n > 2 * len(seen[0]) + 100_000:
                seen = [pa.concat_arrays(seen).unique()]
                n = len(seen[0])
        yield from flush(now, seen)

    def flush(block, seen):
        found = pa.concat_arrays(seen).unique() if seen else pa.array([], pa.string())
        for i in range(0, len(found), 50_000):
            own = found.slice(i, 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), own], names=["block", "part"])

    def pack_texts(batches):
        for block, b in _blocks(batches, place):
            yield _row(block, True, b)

    def pack_known(batches):
        held, n = [], 0
        for b in batches:
            held.append(trim(b))
            n += len(b)
            if n > 60_000:
                yield from by_block(held)
                held, n = [], 0
        yield from by_block(held)

    def by_block(held):
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(np.argsort(t.column("block").to_numpy(), kind="stable"))
        block, rest = t.column("block").to_numpy(), t.drop_columns(["block"])
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            for i in range(a, e, PACK // 32):
                yield _row(int(block[a]), False, rest.slice(i, min(e - i, PACK // 32)).combine_chunks())

    def meeting(batches):
        now, tables, given, held, size = None, [], None, [], 0
        for b in batches:
            for r in range(len(b)):
                if (block := b.column(0)[r].as_py()) != now:
                    yield from finished(held, given)
                    now, tables, given, held, size = block, [], None, [], 0
                with pa.ipc.open_stream(b.column(2)[r].as_buffer()) as s:
                    if not b.column(1)[r].as_py():
                        tables.append(s.read_all())
                        continue
                    if given is None:
                        given, tables = begin(tables), []
                    held.append(s.read_all())
                    size += held[-1].nbytes
                if size > at_once:
                    yield from finished(held, given)
                    held, size = [], 0
        yield from finished(held, given)

    def finished(held, given):
        if held:
            for texts in pa.concat_tables(held).combine_chunks().to_batches():
                yield finish(texts, given)

    pairs = map_arrow(docs.select(col(text_col), F.spark_partition_id().alias(number)), name_parts, "block long, part string").repartition("part")
    texts = map_arrow(docs.withColumn(number, F.spark_partition_id()), pack_texts, PACKED)
    both = map_arrow(known(pairs), pack_known, PACKED).unionAll(texts)
    # several times as many partitions as blocks: a task then has a block or two, and small Arrow batches
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # not known
    tasks = min(100_000, 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BLOCK))
    return map_arrow(both.repartition(tasks, "block").sortWithinPartitions("block", "late"), meeting, schema)
