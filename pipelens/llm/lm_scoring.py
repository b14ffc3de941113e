"""LM scoring: masked pseudo-likelihood from a bidirectional window network.

Every word is predicted from the words on both of its sides. Words have cells in a grid of classes by places: frequent
words a cell of their own, the others share cells by their endings and hashes. A network trained in numpy gives the
probability of the class and of the place within the class, both from the two neighbours; the corpus counts of all
words give that of the word within its cell. The sum over all words is a document's pseudo-log-likelihood.

What is gathered grows with the corpus: the counts of all its words, which stay a table and meet the documents by
blocks, and the grid, whose cells grow with the square root of the number of different words, as does what reaches the
driver and the tasks. Every task trains on all positions of its rows from the same start; the weighted mean of what they
end with is the network. It depends, within what training leaves open, on how the rows are dealt to tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm import blocks
from pipelens.llm._shared import col, fresh, map_arrow, materialise

CELLS = 1  # cells for each unit of the square root of the number of different words; a word's cost grows with their own root
LEAST = 8  # classes, and places within a class, at least
HIDDEN = 24
BATCH = 2048  # positions that one step of training looks at, whatever the size of the table
PASSES = 1  # over a task's rows, likewise
RATE = 0.1
TEXTS = 4 << 20  # bytes of text that are scored at once; a block's words are made a hash table for each
FLUSH = 300_000  # different words that a task holds at once
TILE = 32  # positions of one class in a matrix product
SHARD = 1 << 16  # numbers of the network that are averaged at once


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, in lower case, and where each text's words end. Null texts have none."""
    # at a last text's end Arrow looks beyond its memory and may keep white space in the word before
    split = pc.utf8_split_whitespace(pc.utf8_rtrim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    flat, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends makes empty ones
    count = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), count[ends[1:] - ends[0]]


@dataclass
class Grid:
    """Where words stand: the first `top` cells are those of the most frequent words, in the order of their ranks."""

    side: int  # classes, and places in each
    top: list[str]

    @classmethod
    def of(cls, different: int, ranked: list[str]) -> Grid:
        side = cls.size(different)
        return cls(side, ranked[: cls.own(side)])

    @staticmethod
    def size(different: int) -> int:
        return max(LEAST, math.ceil(math.sqrt(CELLS * math.sqrt(different))))

    @staticmethod
    def own(side: int) -> int:
        return side // 2 * side

    @property
    def edge(self) -> int:
        """What stands before the first and after the last word."""
        return self.side * self.side

    def shared(self, word: str) -> int:
        """The cell of a word that has none of its own: the class by its ending, the place by the whole word."""
        return int(self._shared(pa.array([word]))[0])

    def _shared(self, words: pa.Array) -> np.ndarray:
        first = self.side // 2
        by_end = _hashed(pc.utf8_slice_codeunits(words, -2)) % np.uint64(self.side - first)
        return (first + by_end.astype(np.int32)) * self.side + (_hashed(words) % np.uint64(self.side)).astype(np.int32)

    def cells(self, words: pa.Array) -> np.ndarray:
        """The cells of many words."""
        at = pc.index_in(words, value_set=pa.array(self.top, pa.string()))
        cell = at.fill_null(-1).to_numpy().astype(np.int32)
        cell[cell < 0] = self._shared(words.filter(at.is_null()))
        return cell


def _powers(x: int) -> np.ndarray:
    out = np.full(HASHED, x, np.uint64)
    out[0] = 1
    return np.cumprod(out)


HASHED, BASE = 1 << 16, 0x9E3779B97F4A7C15  # bytes hashed at once; odd
UP, DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def _hashed(words: pa.Array) -> np.ndarray:
    """64 bits of every word: the sum of its bytes times powers of BASE by their places in the word, mixed. Sums run over
    all words' bytes; a word's are the difference of two, moved back by where it starts."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends -= ends[0]
    sums, back, total = np.zeros(len(ends), np.uint64), np.ones(len(ends), np.uint64), np.zeros(1, np.uint64)
    for lo in range(0, len(raw), HASHED):
        part, turn = raw[lo : lo + HASHED], lo % (1 << 64)
        run = np.cumsum(np.concatenate([total, (part + np.uint64(1)) * (UP[: len(part)] * np.uint64(pow(BASE, turn, 1 << 64)))]))
        i, j = np.searchsorted(ends, [lo, lo + len(part)])
        at = ends[i:j] - lo
        sums[i:j], back[i:j], total = run[at], DOWN[at] * np.uint64(pow(BASE, -turn, 1 << 64)), run[-1:]
    sums[np.searchsorted(ends, len(raw)) :] = total
    h = (sums[1:] - sums[:-1]) * back[:-1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bounded(weights: np.ndarray) -> bool:
    """Whether no scores that hidden values of 1 at most make with these weights are too large or small for exp."""
    return bool(np.abs(weights).sum(axis=-2).max() < 80)


def _exp(z: np.ndarray, bounded: bool) -> np.ndarray:
    """exp of tiles of scores z, which is overwritten, times any number a row; and the sum of each row, by a product of
    a tile's shape."""
    if not bounded:
        z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones((z.shape[2], 1), np.float32)


def _picked(z: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """Log probabilities of one cell of each row of tiles of scores z, which is overwritten."""
    if not bounded:
        z -= z.max(axis=2, keepdims=True)
    own = z.reshape(-1, z.shape[2])[np.arange(len(at)), at]
    return own - np.log(_exp(z, True).ravel())


def _errors(z: np.ndarray, at: np.ndarray, ok: np.ndarray, bounded: bool) -> np.ndarray:
    """Probabilities of rows of tiles of scores z, which is overwritten, less 1 for the right cell; 0 in rows that don't
    count."""
    total = _exp(z, bounded)
    total.ravel()[~ok] = np.inf
    z /= total
    z.reshape(-1)[(np.arange(len(at)) * z.shape[2] + at)[ok]] -= 1
    return z


def _order(at: np.ndarray, below: int) -> np.ndarray:
    return np.argsort(at.astype(np.min_scalar_type(below)), kind="stable")  # of two bytes: by radix


def _tiles(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending classes c in tiles of TILE rows of one class: the tiles' classes, their rows, and which of these count;
    a class's last tile is filled up. Every matrix product has a tile's shape, so its sums depend neither on the number
    of BLAS's threads nor on which rows stand beside a row: equal texts have equal scores wherever they are."""
    first = np.flatnonzero(np.diff(c, prepend=-1))
    size = np.diff(first, append=len(c))
    tiles = -(-size // TILE)
    of = np.repeat(np.arange(len(first)), tiles)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(tiles) - tiles, tiles))[:, None] * TILE + np.arange(TILE)
    return c[first][of], first[of][:, None] + np.minimum(at, size[of][:, None] - 1), (at < size[of][:, None]).ravel()


class Network:
    """log P(cell | left cell, right cell) = log P(class | both) + log P(place | class, both)."""

    def __init__(self, side: int, counts: np.ndarray, seed: int = 3):
        """counts: of the cells, over the whole corpus. The start predicts their frequencies whatever the neighbours."""
        rng, cells = np.random.default_rng(seed), side * side
        self.side, n = side, counts.reshape(side, side).astype(float)
        self.p = {
            "left": rng.normal(0, 0.5, (cells + 1, HIDDEN)), "right": rng.normal(0, 0.5, (cells + 1, HIDDEN)), "bias": np.zeros(HIDDEN),
            "out": np.zeros((HIDDEN, side)), "out_bias": np.log(n.sum(axis=1) + 1),
            "place": np.zeros((side, HIDDEN, side)), "place_bias": np.log(n + 0.01),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def hidden(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.tanh(self.p["left"][left] + self.p["right"][right] + self.p["bias"])

    def edged(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of the scores of classes and of places, each with its bias as the last row."""
        p = self.p
        return np.vstack([p["out"], p["out_bias"]]), np.concatenate([p["place"], p["place_bias"][:, None]], axis=1)

    def logp(self, left: np.ndarray, cell: np.ndarray, right: np.ndarray) -> np.ndarray:
        out, (first, place) = np.zeros(len(cell)), self.edged()
        bounded = _bounded(first), _bounded(place)
        for at in range(0, len(cell), 1 << 14):
            c, j = np.divmod(cell[at : at + (1 << 14)], self.side)
            order = _order(c, self.side)
            k, rows, ok = _tiles(c[order])
            rows = order[rows]
            h = np.ones((*rows.shape, HIDDEN + 1), np.float32)
            h[:, :, :HIDDEN] = self.hidden(left[at : at + (1 << 14)], right[at : at + (1 << 14)])[rows]
            both = _picked(h @ first, np.repeat(k, TILE), bounded[0])
            both += _picked(h @ place[k], j[rows.ravel()], bounded[1])
            out[order + at] = both[ok]
        return out

    def step(self, left: np.ndarray, cell: np.ndarray, right: np.ndarray, state: dict) -> None:
        """One step of Adagrad on the mean cross-entropy of these positions. Cells and classes that don't occur among
        them stay as they are, so a step's cost doesn't grow with the grid."""
        p, n, side = self.p, len(cell), self.side
        order = _order(cell // side, side)
        left, right, (c, j) = left[order], right[order], np.divmod(cell[order], side)
        k, rows, ok = _tiles(c)
        h = np.ones((*rows.shape, HIDDEN + 1), np.float32)
        flat = self.hidden(left, right)
        h[:, :, :HIDDEN] = flat[rows]
        turned, (first, places) = h.transpose(0, 2, 1), self.edged()
        place = places[k]
        d = _errors(h @ first, np.repeat(k, TILE), ok, _bounded(first))
        e = _errors(h @ place, j[rows.ravel()], ok, _bounded(places))
        dh = d @ np.ascontiguousarray(p["out"].T)
        dh += e @ np.ascontiguousarray(p["place"].transpose(0, 2, 1))[k]
        dh = dh.reshape(-1, HIDDEN)[ok]
        dh *= 1 - flat * flat
        cuts = np.flatnonzero(np.diff(k, prepend=-1))
        own, g = turned @ e, (turned @ d).sum(axis=0)
        gp = np.stack([own[a:b].sum(axis=0) for a, b in zip(cuts, [*cuts[1:], len(k)], strict=True)])
        change = [("out", ..., g[:-1]), ("out_bias", ..., g[-1]), ("bias", ..., dh.sum(axis=0)), ("place", k[cuts], gp[:, :-1]), ("place_bias", k[cuts], gp[:, -1])]
        weights = dh.ravel().astype(float)
        for name, at in (("left", left), ("right", right)):
            own = np.flatnonzero(np.bincount(at))
            few = len(own) < side * side // 4
            at = np.searchsorted(own, at) if few else at
            g = np.bincount((at[:, None] * HIDDEN + np.arange(HIDDEN)).ravel(), weights).reshape(-1, HIDDEN)
            change.append((name, own, (g if few else g[own]).astype(np.float32)))
        state["t"] = state.get("t", 0) + 1
        for name, rows, g in change:
            g = g / np.float32(n)
            if name not in state:
                state[name] = np.full_like(p[name], 1e-8)  # less, and the noise of sums would make steps
            v = g * g
            v += state[name][rows]
            state[name][rows] = v
            g *= np.float32(RATE)
            g /= np.sqrt(v, out=v)
            p[name][rows] -= g

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self


def positions(texts: pa.Array, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of all words of all texts: the cell on the left, its own, and on the right; and the words and their texts' ends."""
    words, ends = words_of(texts)
    cell = grid.cells(words)
    left, right = np.concatenate([[grid.edge], cell[:-1]])[: len(cell)], np.concatenate([cell[1:], [grid.edge]])[: len(cell)]
    starts = np.concatenate([[0], ends[:-1]])
    left[starts[starts < ends]] = grid.edge
    right[ends[starts < ends] - 1] = grid.edge
    return left, cell, right, words, ends


@dataclass
class Model:
    grid: Grid
    cells: np.ndarray  # counts of the cells over the corpus
    spell: np.ndarray  # (257, 257) log P(byte | byte before) over the different words; 256 is a word's edge
    words: DataFrame  # (word, n) of all words of the corpus
    network: Network

    def within(self, n: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """log P(word | its cell) of words that occur n times; one count of each cell is kept for unknown words."""
        return np.log(n) - np.log(self.cells[cell] + 1)

    def unknown(self, word: str, cell: int) -> float:
        b = np.frombuffer(word.encode("utf-8", "replace"), np.uint8).astype(np.int64)
        return float(-np.log(self.cells[cell] + 1) + self.spell[np.concatenate([[256], b]), np.concatenate([b, [256]])].sum())


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents. A task hands on its counts when it holds FLUSH words."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            for s in blocks.slices(b, 0):
                c = words_of(s.column(0))[0].value_counts()
                held.append(pa.table({"word": c.field(0), "n": c.field(1)}))
                n += len(c)
            if n > FLUSH:
                held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                n = len(held[0])
                if n > FLUSH / 2:
                    yield from out(held)
                    held, n = [], 0
        yield from out(held)

    def out(held):
        if held:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            yield from t.combine_chunks().to_batches(50_000)

    return map_arrow(docs.select(col(text_col)), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all words, then trains on every position of every document. The driver sees the grid's words and counts,
    257 * 257 byte pairs and the network, all of which grow with the square root of the number of different words."""
    words, _ = materialise(word_counts(docs, text_col), "words")
    different = words.count()
    side = Grid.size(different)
    grid = Grid.of(different, [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(Grid.own(side)).collect()])

    def gather(batches):
        cells, pairs = np.zeros(side * side, np.int64), np.zeros(257 * 257, np.int64)
        for b in batches:
            word, n = b.column(0), b.column(1).to_numpy()
            cells += np.bincount(grid.cells(word), n, side * side).astype(np.int64)
            size = pc.binary_length(word).to_numpy().astype(np.int64)
            raw = np.frombuffer("".join(word.to_pylist()).encode("utf-8", "replace"), np.uint8).astype(np.int64)
            ends = np.cumsum(size)
            edged = np.insert(raw, ends, 256)  # an edge after every word
            pairs += np.bincount(np.concatenate([[256], edged[:-1]]) * 257 + edged, minlength=257 * 257)[: 257 * 257] if len(edged) else 0
        both = np.concatenate([cells, pairs])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], names=["cell", "n"])

    both = np.zeros(side * side + 257 * 257)
    got = map_arrow(words, gather, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    both[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    cells, pairs = both[: side * side], both[side * side :].reshape(257, 257)
    spell = np.log((pairs + 0.1) / (pairs + 0.1).sum(axis=1, keepdims=True))
    return Model(grid, cells, spell, words, train(docs, text_col, grid, cells))


def passes(per_task: float) -> int:
    """Over the rows of a task of so many positions: as many for small tables as for large ones."""
    return PASSES


def learn(network: Network, left: np.ndarray, cell: np.ndarray, right: np.ndarray, state: dict, times: int = 1) -> None:
    """Passes over these positions in a shuffled order, by steps of BATCH positions; the last one has what is left."""
    for _ in range(times):
        order = np.random.default_rng(state.get("t", 0)).permutation(len(cell))
        for at in range(0, len(order), BATCH):
            s = order[at : at + BATCH]
            network.step(left[s], cell[s], right[s], state)


def train(docs: DataFrame, text_col: str, grid: Grid, counts: np.ndarray) -> Network:
    """Every task learns from its rows; the mean of the tasks' networks, weighted by their positions, is what counts."""
    texts = docs.select(col(text_col).alias("text"), F.spark_partition_id().alias("task"))
    times = passes(counts.sum() / max(1, texts.rdd.getNumPartitions()))

    def run(batches):
        network, state, n, task = Network(grid.side, counts), {}, 0, 0
        for b in batches:
            for s in blocks.slices(b, 0):
                left, cell, right, _, _ = positions(s.column(0), grid)
                if len(cell):
                    learn(network, left, cell, right, state, times)
                    n, task = n + len(cell), s.column(1)[0].as_py()
        if n:
            flat = network.flat()
            for k in range(0, len(flat), SHARD):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([task], pa.int64()), pa.array([n]), pa.array([flat[k : k + SHARD].tobytes()], pa.binary())], names=["shard", "task", "n", "p"])

    def mean(batches):
        now, total, n = None, None, 0
        for b in batches:
            for shard, weight, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if shard != now:
                    yield from out(now, total, n)
                    now, total, n = shard, 0.0, 0
                total, n = total + weight * np.frombuffer(raw, np.float32).astype(float), n + weight
        yield from out(now, total, n)

    def out(shard, total, n):
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["shard", "p"])

    learned = map_arrow(texts, run, "shard long, task long, n long, p binary")
    found = map_arrow(learned.repartition("shard").sortWithinPartitions("shard", "task"), mean, "shard long, p binary").collect()
    network = Network(grid.side, counts)
    return network.load(np.frombuffer(b"".join(r["p"] for r in sorted(found, key=lambda r: r["shard"])), np.float32)) if found else network


class _Known:
    """The counts of a block's words."""

    def __init__(self, tables: list[pa.Table]):
        t = pa.concat_tables(tables).combine_chunks() if tables else None
        self.words = t.column("part").chunk(0) if t is not None and len(t) else pa.array([], pa.string())
        self.n = t.column("n").to_numpy() if len(self.words) else np.zeros(0, np.int64)

    def counts(self, words: pa.Array) -> np.ndarray:
        """How often each word occurs in the corpus; 0 if it doesn't."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        return np.concatenate([self.n, [0]])[at]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, pll, mean_logp) of every row: every word of the whole text is masked and predicted in turn.
    Null and empty texts and those of white space have n_tokens 0, pll 0 and a null mean. Words that the corpus doesn't
    have are spelled by byte pairs. Repeated rows are ordinary rows; a text takes memory in proportion to its length."""
    picked = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    grid, network, lean = model.grid, model.network, Model(model.grid, model.cells, model.spell, None, model.network)

    def finish(batch, known):
        left, cell, right, words, ends = positions(batch.column(1), grid)
        logp, n = network.logp(left, cell, right), known.counts(words)
        seen = n > 0
        logp[seen] += lean.within(n[seen], cell[seen])
        new = np.flatnonzero(~seen)
        logp[new] += [lean.unknown(w, int(cell[i])) for i, w in zip(new, words.take(pa.array(new)).to_pylist(), strict=True)]
        size = np.diff(ends, prepend=0)
        pll = np.bincount(np.repeat(np.arange(len(ends)), size), logp, len(ends)).astype(float)
        mean = pa.array(np.divide(pll, size, out=np.zeros(len(size)), where=size > 0), mask=size == 0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(pll), mean], names=["id", "n_tokens", "pll", "mean_logp"])

    def known(pairs):
        return pairs.join(model.words.select(F.col("word").alias("part"), "n").hint("merge"), "part").select("block", "part", "n")

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, pll double, mean_logp double"
    out = blocks.meet(picked, "text", lambda texts: words_of(texts)[0].unique(), known, _Known, finish, schema, at_once=TEXTS)
    return out.withColumnRenamed("id", id_col)


def scored(spark, docs: DataFrame) -> DataFrame:
    """op1: fits on all documents and scores them."""
    return score(docs, fit(docs))
