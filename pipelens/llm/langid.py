"""Language ID: a byte convolutional network, trained in numpy, applied to fixed-length windows of whole texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.llm._shared import col, fresh, map_arrow

WINDOW = 256  # bytes pooled together
WIDTHS = (2, 4)  # of the filters, in bytes
FILTERS = 16  # of each width
EMBED = 8
SAMPLE = 1500  # labelled rows a language that the network is fitted on, about, by their whole texts; the documented bound
ROWS = 24_000  # of all languages together: with many of them, each has fewer rows
STEPS = 1200  # of training at least; more if the rows have more windows than that
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width * EMBED, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters' responses to byte pairs: of width 2 and of the first half of width 4; of the second half."""
        byte = {w: [self.embed @ f[i * EMBED : (i + 1) * EMBED] for i in range(w)] for w, f in self.filters.items()}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        first = np.concatenate([pair(*byte[2]), pair(byte[4][0], byte[4][1])], axis=1) + self.bias
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(pair(byte[4][2], byte[4][3]), np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _crop(text: np.ndarray, at: int, rng: np.random.Generator) -> np.ndarray:
    """The window at a place of a text, shifted and cut to a random length."""
    take = min(len(text), WINDOW if rng.random() < 0.4 else int(rng.integers(8, WINDOW + 1)))
    start = min(len(text) - take, max(0, at + int(rng.integers(0, WINDOW)) - take // 2))
    return text[start : start + take]


def _learn(p: dict, m: dict, v: dict, step: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """The step-th step of Adam on the weighted cross-entropy of windows x of languages y; p, and the moments m and v, change."""
    e = p["embed"][x]
    pooled, where, shifted = [], [], {}
    for k, w in enumerate(WIDTHS):
        shifted[w] = np.concatenate([e[:, j : j + WINDOW] for j in range(w)], axis=2)
        r = shifted[w] @ p[f"w{w}"] + p["bias"][k * FILTERS : (k + 1) * FILTERS]
        where.append(r.argmax(axis=1))
        pooled.append(np.take_along_axis(r, where[-1][:, None, :], 1)[:, 0])
    z = np.concatenate(pooled, axis=1)
    h = np.maximum(z, 0)
    d = _softmax(h @ p["out"] + p["out_bias"])
    d[np.arange(len(y)), y] -= 1
    d *= weight[:, None]
    g = {"out": h.T @ d, "out_bias": d.sum(0)}
    dz = (d @ p["out"].T) * (z > 0)
    g["bias"] = dz.sum(0)
    ge = np.zeros_like(p["embed"])
    for k, w in enumerate(WIDTHS):
        dk = dz[:, k * FILTERS : (k + 1) * FILTERS]
        seen = shifted[w][np.arange(len(y))[:, None], where[k]]
        g[f"w{w}"] = np.einsum("bf,bfi->if", dk, seen)
        back = (dk[:, :, None] * p[f"w{w}"].T[None]).reshape(len(y), FILTERS, w, EMBED)
        for j in range(w):
            np.add.at(ge, np.take_along_axis(x, where[k] + j, 1), back[:, :, j])
    ge[0] = 0
    g["embed"] = ge
    for k in p:
        m[k] = 0.9 * m[k] + 0.1 * g[k]
        v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
        p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def train(rows: list[tuple[str, str]], steps: int = STEPS, batch: int = 64, seed: int = 7) -> Model | None:
    """rows: (text, language), already bounded and in a fixed order. Adam on cross-entropy over every window of every
    text, `steps` batches at least; windows are shifted and cut to random lengths so that short texts count too. None
    without rows."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    raw = [np.frombuffer(t.lower().encode("utf-8", "replace"), np.uint8) for t, _ in rows]
    reach = WINDOW + max(WIDTHS) - 1
    n_pool = len(WIDTHS) * FILTERS
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(n_pool), "out": rng.normal(0, 0.1, (n_pool, len(langs))), "out_bias": np.zeros(len(langs))}
    p |= {f"w{w}": rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)) for w in WIDTHS}
    p["embed"][0] = 0
    wins = np.array([max(1, -(-len(r) // WINDOW)) for r in raw])
    row = np.repeat(np.arange(len(raw)), wins)
    at_window = (np.arange(len(row)) - np.repeat(np.cumsum(wins) - wins, wins)) * WINDOW
    y = np.array([number[lang] for _, lang in rows])[row]
    steps = max(steps, -(-len(row) // batch))
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    while step < steps:
        order = rng.permutation(len(row))
        for at in range(0, len(order), batch):
            if step == steps:
                break
            ids = order[at : at + batch]
            x = np.zeros((len(ids), reach), np.uint8)
            for r, i in enumerate(ids):
                own = _crop(raw[row[i]], int(at_window[i]), rng)
                x[r, : len(own)] = own
            step += 1
            _learn(p, m, v, step, x, y[ids], np.full(len(ids), 1 / len(ids)), 0.004)
    return Model(langs, p["embed"], {w: p[f"w{w}"] for w in WIDTHS}, p["bias"], p["out"], p["out_bias"])


def sampled(docs: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, language) of about `sample` rows of each language, or an equal share of ROWS if that is less, chosen by
    the hash of key; null texts and languages don't count. All rows are counted by language; the whole texts of the
    chosen rows reach the driver."""
    labelled = docs.where(col(text_col).isNotNull() & col(lang_col).isNotNull()).select(col(text_col).alias("text"), col(lang_col).alias("lang"), key.alias("key"))
    counts = labelled.groupBy("lang").count()
    if not (langs := counts.count()):
        return []
    counts = F.broadcast(counts) if langs <= ROWS else counts  # else all texts would be shuffled
    share = F.least(F.lit(1.0), F.lit(max(1, min(sample, ROWS // langs))) / F.col("count"))
    chosen = labelled.join(counts, "lang").where(F.pmod(F.xxhash64("key", F.lit("language sample")), F.lit(2**30)) < share * 2**30)
    got = chosen.select("text", "lang").toArrow()
    return sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def refine(docs: DataFrame, model: Model | None, counts: dict[str, int], text_col: str = "text", lang_col: str = "lang", batch: int = 64, rate: float = 0.001, seed: int = 13) -> Model | None:
    """The network after training on every window of every labelled row of docs. counts: of the rows by language;
    languages weigh the same, and those that model doesn't have are added. Every task starts from model and trains on its rows; the mean of what they end with,
    weighted by their windows, is the network. It depends a little on how the rows are dealt to tasks."""
    if model is None:
        return None
    langs = model.langs + sorted(set(counts) - set(model.langs))
    number, new = {lang: k for k, lang in enumerate(langs)}, len(langs) - len(model.langs)
    start = {"embed": model.embed, "bias": model.bias, "out": np.pad(model.out, ((0, 0), (0, new))), "out_bias": np.pad(model.out_bias, (0, new))} | {f"w{w}": f for w, f in model.filters.items()}
    share = np.array([1 / counts.get(lang, 1) for lang in langs])
    labelled = docs.where(col(text_col).isNotNull() & col(lang_col).isNotNull()).select(col(text_col).alias("text"), col(lang_col).alias("lang"))

    def run(batches):
        p, rng, step, n = {k: x.copy() for k, x in start.items()}, np.random.default_rng(seed), 0, 0
        m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
        for b in batches:
            raw = [np.frombuffer(t.lower().encode("utf-8", "replace"), np.uint8) for t in b.column(0).to_pylist()]
            wins = np.array([max(1, -(-len(r) // WINDOW)) for r in raw], np.int64)
            row = np.repeat(np.arange(len(raw)), wins)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(wins) - wins, wins)) * WINDOW
            y = np.array([number[k] for k in b.column(1).to_pylist()], np.int64)[row]
            order = rng.permutation(len(row))
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                x = np.zeros((len(ids), WINDOW + max(WIDTHS) - 1), np.uint8)
                for r, i in enumerate(ids):
                    own = _crop(raw[row[i]], int(place[i]), rng)
                    x[r, : len(own)] = own
                step += 1
                _learn(p, m, v, step, x, y[ids], share[y[ids]] / share[y[ids]].sum(), rate)
            n += len(row)
        if n:  # as whole numbers, whose sums don't depend on their order
            flat = np.concatenate([p[k].ravel() for k in start])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.append(np.rint(flat * n * 2.0**20), n).astype(np.int64))], names=["k", "x"])

    got = map_arrow(labelled, run, "k long, x long").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").toArrow().column("x").to_numpy()
    if not len(got):
        return model
    flat, at, p = got[:-1] / got[-1] / 2.0**20, 0, {}
    for k, x in start.items():
        p[k] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    return Model(langs, p["embed"], {w: p[f"w{w}"] for w in WIDTHS}, p["bias"], p["out"], p["out_bias"])


def fit(docs: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fits on the sampled rows."""
    return train(sampled(docs, key, text_col, lang_col, sample))


class Scorer:
    def __init__(self, model: Model):
        self.model, (self.first, self.second) = model, model.tables()

    def windows(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probabilities (window, language) of consecutive windows; flat is whole windows, and texts end at `ends`,
        after which filters read zeros. Only elementwise steps and maxima: a window's result doesn't depend on the
        windows beside it."""
        n, step = len(flat) // WINDOW, 64
        pairs = flat.astype(np.uint16) << 8
        pairs[:-1] |= flat[1:]
        pairs[ends - 1] &= 0xFF00
        later = np.concatenate([pairs[2:], np.zeros(2, np.uint16)])
        later[ends - 1] = later[ends - 2] = 0
        h = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        for w in range(0, n, step):
            a, k = w * WINDOW, min(step, n - w)
            r = self.first.take(pairs[a : a + k * WINDOW], axis=0)
            r[:, FILTERS:] += self.second.take(later[a : a + k * WINDOW], axis=0)
            np.maximum(r.reshape(k, WINDOW, -1).max(axis=1), 0, out=h[w : w + k])
        z = np.repeat(self.model.out_bias[None], n, axis=0)
        for k, weights in enumerate(self.model.out):  # a matrix product may add in another order for another shape
            z += h[:, k : k + 1] * weights
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Every text's language and its probability: the mean log probability over all its windows, by their bytes,
        normalised."""
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        at, parts = [], []
        for i, t in enumerate(texts):
            if t is not None and _LETTER.search(t):
                at.append(i)
                parts.append(t.lower().encode("utf-8", "replace"))
        for lo, hi in _runs([len(b) for b in parts], 1 << 22):
            sizes = np.array([len(b) for b in parts[lo:hi]])
            wins = -(-sizes // WINDOW)
            flat = np.frombuffer(b"".join(b.ljust(int(k) * WINDOW, b"\0") for b, k in zip(parts[lo:hi], wins, strict=True)), np.uint8)
            logp, first = self.windows(flat, np.cumsum(wins) * WINDOW), np.concatenate([[0], np.cumsum(wins)[:-1]])
            left = np.repeat(sizes, wins) - (np.arange(len(logp)) - np.repeat(first, wins)) * WINDOW
            p = _softmax(np.add.reduceat(logp * np.clip(left, 0, WINDOW)[:, None], first, axis=0) / sizes[:, None])
            best = p.argmax(axis=1)
            for r, i in enumerate(at[lo:hi]):
                langs[i], scores[i] = self.model.langs[best[r]], float(p[r, best[r]])
        return langs, scores


def _runs(sizes: list[int], most: int):
    """Ranges of consecutive texts of about `most` bytes together, one text at least."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with a predicted language and its score (0 to 1). Null texts and texts without a letter are `und` with
    score 0, as is every text if there was nothing to learn from. A text's result depends on nothing but the text. Other
    columns pass as they are; if docs has our names, ours get an underscore."""
    lang_out, score_out = fresh(docs, lang_out, score_out)
    schema = docs.select("*", F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema
    place, names = docs.columns.index(text_col), [*docs.columns, lang_out, score_out]

    def run(batches):
        scorer = Scorer(model) if model else None
        for b in batches:
            texts = b.column(place).to_pylist()
            langs, scores = scorer(texts) if scorer else ([UND] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return map_arrow(docs, run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))), F.lit(3)) == 1


def classify(spark, docs: DataFrame) -> DataFrame:
    """op7: fits on rows that aren't held out, predicts all."""
    model = fit(docs.where(~held_out()), F.col("doc_id"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
