"""SentencePiece encoding and decoding: a relational lattice of pieces, folded with Viterbi.

Texts are encoded over their distinct units. A unit is a run of characters that some piece may span: a text is cut
wherever no piece contains the two neighbouring characters, which changes no path through the lattice. Substrings of
units are exploded up to the longest piece, joined to the piece table, grouped by unit, and folded by `aggregate`.

A unigram model's best path has the largest sum of piece scores: the fold is Viterbi's. The scores of a merge (BPE)
model are ranks whose sums mean nothing, so Viterbi can't give its ids; there a second fold takes the lattice's edges in
the order of the merges, which gives the ids of the model's own library (README), and Viterbi's best path over the same
lattice is returned beside them. Characters without a piece become byte pieces.

Units of over LONG characters (a run that no piece boundary cuts, such as base64) don't enter the lattice, as folds copy
their state at every step: the tasks that hold them fold them in place, by the same rules in linear time. So do units
with a piece whose merges don't come in rank order (`Pieces.indexed`); the installed model has one, sixteen spaces.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from pipelens.llm import blocks
from pipelens.llm._shared import col, fresh, map_arrow

SPACE = "▁"
MODEL = os.path.join(os.environ.get("PIPELENS_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
BYTE_SCORE = -1e12  # below every path of pieces
LONG = 62  # characters of the longest unit that the lattice takes: the merge fold's state is the bits of a number
LATE = 32  # late pieces that units are searched for; with more of them, every unit is folded where it stands
CACHE = 100_000  # characters of long units whose paths a task keeps


@dataclass
class Pieces:
    """A piece table. Its size is that of the vocabulary, whatever the data."""

    pieces: list[str]
    scores: list[float]
    normal: list[int]
    byte_ids: list[int]
    merges: bool = False  # merged in rank order instead of scored by path
    late: tuple[str, ...] = ()  # pieces of a merge table whose merges don't come in rank order

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        sp, spec = sentencepiece.SentencePieceProcessor(model_file=path), proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = sp.get_piece_size()
        own = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.add_dummy_prefix or not all(map(sp.is_byte, byte_ids)):
            raise ValueError("only models with byte pieces and a space before the text, without normalisation rules, are supported")
        return cls(names, [sp.get_score(i) for i in range(n)], own, byte_ids, spec.trainer_spec.model_type == spec.trainer_spec.BPE).indexed()

    def indexed(self) -> Pieces:
        """Finds the late pieces. The merge fold tries each edge once, in rank order. That misses a merge which a worse
        one has made possible; the first such merge of a text makes a piece out of two parts, whose own merges were the
        same when that piece stands alone. So each piece is tried alone, and units without a late piece are safe."""
        if self.merges:
            scores = self.table()
            orders = ((p, _merges(p, scores)[1]) for p in scores)
            self.late = tuple(p for p, done in orders if any(a > b for a, b in zip(done[:-1], done[1:], strict=True)))
        return self

    def fits(self, units: pa.Array) -> pa.Array:
        """Which units the lattice takes: those of LONG characters at most, without a late piece."""
        ok = pc.less_equal(pc.utf8_length(units), LONG if len(self.late) <= LATE else 0)
        for p in self.late[:LATE]:
            ok = pc.and_(ok, pc.invert(pc.match_substring(units, p)))
        return ok

    def table(self) -> dict[str, tuple[float, int]]:
        return {self.pieces[i]: (self.scores[i], i) for i in self.normal}

    @property
    def longest(self) -> int:
        return max((len(self.pieces[i]) for i in self.normal), default=1)

    def cutter(self) -> Cutter:
        return Cutter(sorted({p[i : i + 2] for p in (self.pieces[k] for k in self.normal) for i in range(len(p) - 1)}))

    def decoder(self) -> Decoder:
        raw = [b""] * len(self.pieces)
        for i in self.normal:
            raw[i] = self.pieces[i].encode()
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        size = np.array([len(r) for r in raw])
        return Decoder(size, np.cumsum(size) - size, np.frombuffer(b"".join(raw), np.uint8))

    def decode(self, ids) -> str:
        return self.decoder()(np.asarray(ids, np.int32), np.array([len(ids)]))[0]

    def path(self, unit: str, table: dict | None = None) -> tuple[list[int], float]:
        """What the lattice and its folds give for a unit, in time linear in its length (merges: but for a logarithm):
        ids with -1 for characters without a piece, and the score of Viterbi's path."""
        table = self.table() if table is None else table
        ids, score = _viterbi(unit, table, self.longest)
        return (_merges(unit, table)[0] if self.merges else ids), score

    def spelled(self, unit: str, ids: list[int]) -> list[int]:
        """ids with byte pieces in the place of -1."""
        out, at = [], 0
        for i in ids:
            out += [i] if i >= 0 else [self.byte_ids[x] for x in unit[at].encode("utf-8", "replace")]
            at += len(self.pieces[i]) if i >= 0 else 1
        return out


def _merges(unit: str, table: dict) -> tuple[list[int], list[tuple[float, int]]]:
    """The pieces after all merges, best score first (ties: from the left), and (rank, place) of every merge."""
    end, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
    heap, done = [], []

    def offer(a: int) -> None:
        if a >= 0 and (m := end[a]) < len(unit) and (found := table.get(unit[a : end[m]])):
            heap.append((-found[0], a, m, end[m])) if not done else heapq.heappush(heap, (-found[0], a, m, end[m]))

    for a in range(len(unit)):
        offer(a)
    heapq.heapify(heap)
    while heap:
        rank, a, m, e = heapq.heappop(heap)
        if end[a] != m or end[m] != e:  # a part has gone into another piece
            continue
        done.append((rank, a))
        end[a], end[m] = e, -1
        if e < len(unit):
            before[e] = a
        offer(a)
        offer(before[a])
    ids, a = [], 0
    while a < len(unit):
        ids.append(table.get(unit[a : end[a]], (0, -1))[1])
        a = end[a]
    return ids, done


def _viterbi(unit: str, table: dict, longest: int) -> tuple[list[int], float]:
    """The path with the largest sum of scores; ties by the longer last piece, then the larger id."""
    best: list[tuple] = [(0.0, 0, -1)]
    for e in range(1, len(unit) + 1):
        options = []
        for n in range(1, min(longest, e) + 1):
            if found := table.get(unit[e - n : e]) or ((BYTE_SCORE, -1) if n == 1 else None):
                options.append((best[e - n][0] + found[0], n, found[1]))
        best.append(max(options))
    ids, e = [], len(unit)
    while e:
        ids.append(best[e][2])
        e -= best[e][1]
    return ids[::-1], best[-1][0]


class Cutter:
    """Cuts texts into units by whole columns. Characters that stand in a pair of some piece have small numbers."""

    def __init__(self, pairs: list[str]):
        self.pairs = pairs

    def _tables(self):
        if not hasattr(self, "kind"):  # made where they are used: most of it is zeros
            chars = sorted({c for p in self.pairs for c in p})
            number = {c: i + 1 for i, c in enumerate(chars)}
            self.kind, self.n = np.zeros(0x110000, np.uint16), len(chars) + 1
            self.kind[[ord(c) for c in chars]] = np.arange(1, self.n)
            self.spanned = np.zeros(self.n * self.n, bool)
            self.spanned[[number[p[0]] * self.n + number[p[1]] for p in self.pairs]] = True
        return self.kind, self.spanned, self.n

    def __getstate__(self):
        return {"pairs": self.pairs}

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts in a row, and the number of units up to the end of each text. Null and empty texts
        have none; others start with a space mark."""
        kind, spanned, n = self._tables()
        marked = pc.binary_join_element_wise(SPACE, pc.replace_substring(pc.fill_null(texts, ""), " ", SPACE), "")
        marked = pc.if_else(pc.equal(pc.binary_length(pc.fill_null(texts, "")), 0), pa.scalar("", marked.type), marked)
        offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        if lo == hi:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        data = marked.buffers()[2].slice(lo, hi - lo)
        raw = np.frombuffer(data, np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)  # of characters
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets - lo] = True
        last = 0
        for at in range(0, len(starts), 1 << 18):  # as index arrays have eight bytes a character
            own = starts[at : at + (1 << 18)]
            end = starts[at + len(own)] if at + len(own) < len(starts) else len(raw)
            k = kind[np.frombuffer(raw[own[0] : end].tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
            before = np.concatenate([np.array([last], np.uint16), k[:-1]])
            cut[own] |= ~spanned[before.astype(np.int32) * n + k]
            last = int(k[-1])
        at = np.flatnonzero(cut).astype(np.int32)
        units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data)
        return units, np.searchsorted(at, offsets[1:] - lo)


@dataclass
class Decoder:
    """The bytes of all pieces."""

    size: np.ndarray
    at: np.ndarray
    raw: np.ndarray

    def __call__(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of consecutive lists of ids. Unknown and control pieces stand for nothing; broken byte runs for
        U+FFFD. The pieces' bytes are gathered for all lists at once."""
        n = self.size[flat]
        to = np.cumsum(n, dtype=np.int64)
        at = np.arange(int(to[-1]) if len(to) else 0, dtype=np.int32)  # one slice's texts; far below 2 GB
        at += np.repeat((self.at[flat] - (to - n)).astype(np.int32), n)
        raw, cuts = self.raw.take(at).tobytes(), np.concatenate([[0], to])[np.concatenate([[0], ends])].tolist()
        out = [raw[a:b].decode("utf-8", "replace").replace(SPACE, " ") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [t[1:] if t[:1] == " " else t for t in out]


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """units: one string column unit, distinct, not empty and of LONG characters at most. Returns (unit, ids array<int>,
    score): the pieces, -1 for a character without one, and the score of Viterbi's path."""
    spark = units.sparkSession
    table = spark.createDataFrame([(pieces.pieces[i], i, float(pieces.scores[i])) for i in pieces.normal], "piece string, id int, score double")
    starts = units.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("start"))
    spans = starts.select("unit", "start", F.explode(F.expr(f"sequence(1, least({pieces.longest}, length(unit) - start + 1))")).alias("n"))
    edges = spans.select("unit", (F.col("start") + F.col("n") - 1).alias("end"), "n", F.expr("substring(unit, start, n)").alias("piece")).join(F.broadcast(table), "piece", "left")
    edges = edges.where("id is not null or n = 1")  # a unit without any piece keeps its place
    grouped = edges.groupBy(F.xxhash64("unit").alias("h"), "unit").agg(F.sort_array(F.collect_list(F.struct(F.col("end").alias("b"), (F.col("end") - F.col("n")).alias("a"), "id", "score"))).alias("edges"))
    if pieces.merges:
        return grouped.select("unit", F.expr(_MERGED).alias("ids"), F.expr(_SCORES).alias("best")).select("unit", "ids", F.expr("best[length(unit)]").alias("score"))
    return grouped.select("unit", F.expr(_BEST).alias("best")).select("unit", F.expr(_BACK).alias("ids"), F.expr("best[length(unit)].score").alias("score"))


def _fold(start: str, step: str) -> str:
    """Viterbi's fold: the best way to every place of a unit. Edges come by their ends, so every place before an edge
    has its own already; the last place is replaced if the edge does better."""
    return f"aggregate(edges, array({start}), (best, x) -> if(size(best) = x.b, concat(best, array({step})), if(best[x.b] >= {step}, best, concat(slice(best, 1, x.b), array({step})))))"


#: The best score at every place; and with the length of the last piece and its id (ties: the longer one, the larger id).
_SCORES = _fold("0D", f"best[x.a] + coalesce(x.score, {BYTE_SCORE!r}D)")
_BEST = _fold("struct(0D as score, 0 as len, -1 as id)", f"struct(best[x.a].score + coalesce(x.score, {BYTE_SCORE!r}D) as score, x.b - x.a as len, coalesce(x.id, -1) as id)")
_BACK = """aggregate(reverse(sequence(1, length(unit))), struct(length(unit) as at, cast(array() as array<int>) as ids),
    (s, e) -> if(s.at = e, struct(e - best[e].len as at, concat(array(best[e].id), s.ids) as ids), s), s -> s.ids)"""

#: The fold of merge tables: edges of several characters are tried from the best score down (ties: from the left), and
#: one is taken if just two parts make it up. The state is where parts begin, as the bits of a number.
_MERGED = """transform(array(aggregate(
    sort_array(transform(filter(edges, x -> x.b > x.a + 1), x -> struct(-x.score as rank, x.a as a, shiftleft(1L, x.a) | shiftleft(1L, x.b) as ab, shiftleft(1L, x.b) - shiftleft(2L, x.a) as inner))),
    shiftleft(1L, length(unit) + 1) - 1L, (s, x) -> if((s & x.ab) = x.ab and bit_count(s & x.inner) = 1, s & ~x.inner, s))),
    s -> transform(filter(edges, x -> (s & (shiftleft(1L, x.a) | shiftleft(1L, x.b))) = (shiftleft(1L, x.a) | shiftleft(1L, x.b)) and (s & (shiftleft(1L, x.b) - shiftleft(2L, x.a))) = 0), x -> coalesce(x.id, -1)))[0]"""


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of consecutive ranges."""
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    out += np.repeat(starts - (ends - sizes), sizes)
    return out


class Dictionary:
    """A block's units with their ids, and the paths of long units that were looked at."""

    def __init__(self, pieces: Pieces, parts: list[pa.Table]):
        t = pa.concat_tables(parts).combine_chunks() if parts else None
        self.pieces, self.table, self.long, self.held = pieces, pieces.table(), {}, 0
        self.units = t.column("part").chunk(0) if t is not None and len(t) else pa.array([], pa.string())
        ids = t.column("ids").chunk(0) if len(self.units) else pa.array([], pa.list_(pa.int32()))
        offsets = ids.offsets.to_numpy().astype(np.int64)
        self.flat, self.at, self.size = ids.values.to_numpy(), offsets[:-1], np.diff(offsets)
        self.score = t.column("score").to_numpy() if len(self.units) else np.zeros(0)

    def __call__(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all units in a row; by unit their number, and the score of Viterbi's path. A unit that
        isn't here means that the two scans dealt rows differently, which is an error, never a guess."""
        at = pc.index_in(units, value_set=self.units)
        flat, start, size, score = self.flat, self.at, self.size, self.score
        if at.null_count:
            place = at.fill_null(-1).to_numpy().copy()
            missing = np.flatnonzero(place < 0)
            found = {u: self._path(u) for u in set(units.take(pa.array(missing)).to_pylist())}
            number = {u: len(self.units) + k for k, u in enumerate(found)}
            place[missing] = [number[u] for u in units.take(pa.array(missing)).to_pylist()]
            more = [np.array(ids, np.int32) for ids, _ in found.values()]
            size = np.concatenate([size, [len(m) for m in more]]).astype(np.int64)
            start = np.concatenate([start, len(flat) + np.cumsum([0, *map(len, more[:-1])])]).astype(np.int64)
            flat = np.concatenate([flat, *more]).astype(np.int32)
            score = np.concatenate([score, [s for _, s in found.values()]])
        else:
            place = at.to_numpy()
        return flat[_ranges(start[place], size[place])].astype("<i4"), size[place], score[place]

    def _path(self, unit: str) -> tuple[list[int], float]:
        if self.pieces.fits(pa.array([unit]))[0].as_py():
            raise KeyError(f"the unit {unit!r} wasn't named by the first scan")
        if unit not in self.long:
            ids, score = self.pieces.path(unit, self.table)
            if self.held + len(unit) > CACHE:
                self.long, self.held = {}, 0
            self.long[unit], self.held = (self.pieces.spelled(unit, ids), score), self.held + len(unit)
        return self.long[unit]


DIGEST = "n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean, viterbi_score double"


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_out: str = "ids", digest: bool = False) -> DataFrame:
    """docs with ids_out (array<int>): the pieces of each whole text. With digest, instead of the text and the ids:
    n_pieces, ids_sha256 (of the ids as little-endian int32), decoded_sha256 and round_trip, made from the decoded ids,
    and viterbi_score, that of Viterbi's path (a character without a piece counts BYTE_SCORE). Columns
    of docs with these names are kept; ours get an underscore.

    Null texts have null ids (digest: no pieces, null digests and round_trip), empty texts none. Repeated rows are
    ordinary rows. A text that holds U+2581 decodes to a space there. A text takes memory in proportion to its length.

    Units are encoded once over all documents, then meet the texts that hold them (`blocks`).
    """
    place, names = docs.columns.index(text_col), docs.columns
    keep = [i for i in range(len(names)) if not (digest and i == place)]
    cutter, decoder, narrow = pieces.cutter(), pieces.decoder(), len(pieces.pieces) < 1 << 15

    def named(texts):
        units = cutter(texts)[0].unique()
        return units.filter(pieces.fits(units))

    def known(pairs):
        units = pairs.groupBy("part").agg(F.max("block").alias("block")).where("block >= 0")  # reads the same shuffle as pairs
        return pairs.join(lattice(units.select(F.col("part").alias("unit")), pieces).withColumnRenamed("unit", "part").hint("merge"), "part").select("block", "part", "ids", "score")

    def spell(b):
        """b with byte pieces for characters without a piece, and narrow ids."""
        ids = b.column(2)
        bad = np.unique(np.searchsorted(ids.offsets.to_numpy(), np.flatnonzero(ids.values.to_numpy() < 0), "right") - 1)
        if len(bad):
            lists = ids.to_pylist()
            for r in bad.tolist():
                lists[r] = pieces.spelled(b.column(1)[r].as_py(), lists[r])
            ids = pa.array(lists, ids.type)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids.cast(pa.list_(pa.int16() if narrow else pa.int32())), b.column(3)], names=["block", "part", "ids", "score"])

    def finish(batch, dictionary):
        texts = batch.column(place)
        units, ends = cutter(texts)
        flat, sizes, score = dictionary(units)
        ends = np.concatenate([[0], ends])
        cuts = np.concatenate([[0], np.cumsum(sizes)])[ends]  # of the texts' ids
        cols, of = [batch.column(i) for i in keep], np.repeat(np.arange(len(batch)), np.diff(ends))
        if not digest:
            ids = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat), mask=texts.is_null())
            return pa.RecordBatch.from_arrays([*cols, ids], names=made)
        back, raw, at = decoder(flat, cuts[1:]), memoryview(flat).cast("B"), (cuts * 4).tolist()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        rows = [(None, None, None) if t is None else (sha(raw[a:e]), sha(d.encode("utf-8", "replace")), d == t) for t, a, e, d in zip(texts.to_pylist(), at[:-1], at[1:], back, strict=True)]
        found = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.bool_()), strict=True)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(cuts)), *found, pa.array(np.bincount(of, score, len(batch)).astype(float))], names=made)

    schema = docs.select(*(col(names[i]) for i in keep)).schema  # of a frame of its own: add() changes it
    kinds = [x.split(" ") for x in DIGEST.split(", ")] if digest else [(ids_out, ArrayType(IntegerType()))]
    for name, (_, kind) in zip(fresh(docs.select(*(col(names[i]) for i in keep)), *(k for k, _ in kinds)), kinds, strict=True):
        schema = schema.add(name, kind)
    made = schema.names

    return blocks.meet(docs, text_col, named, known, lambda tables: Dictionary(pieces, tables), finish, schema, spell)


def decode(docs: DataFrame, pieces: Pieces, ids_col: str = "ids", text_out: str = "text") -> DataFrame:
    """docs with the text of its ids in text_out, which gets an underscore if docs has such a column; null ids give null."""
    place, names, decoder = docs.columns.index(ids_col), [*docs.columns, *fresh(docs, text_out)], pieces.decoder()

    def run(batches):
        for b in batches:
            given = b.column(place)
            sizes = pc.list_value_length(given).fill_null(0).to_numpy()
            texts = decoder(given.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string(), mask=given.is_null().to_numpy(zero_copy_only=False))], names=names)

    return map_arrow(docs, run, docs.withColumn(names[-1], F.lit(None).cast("string")).schema)


def digests(spark: SparkSession, docs: DataFrame, path: str = MODEL) -> DataFrame:
    """op2: encodes every whole text, decodes it, and returns what came out."""
    return encode(docs.select("doc_id", "text"), Pieces.load(path), digest=True)
