"""Whether a text is like those of the language that it was taken for: its likelihood by byte triples, which doesn't
depend on how many languages there are."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm import langid
from pipelens.llm._shared import col, map_arrow

CELLS = 1 << 16  # of hashed byte triples, and as many pairs, a language
SIZES = (24, 96, 600)  # bytes of the crops on which thresholds are set; a text takes that of the largest it reaches
FINE = 4096  # parts of one unit of likelihood in which all rows are counted for the thresholds
DEAR = 10  # a rejected text of a known language counts as much as so many accepted others


def cells(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.int64)
    return ((b[:-2] * 961 + b[1:-1] * 31) * 17 + b[2:]) % CELLS, (b[:-2] * 257 + b[1:-1]) % CELLS


@dataclass
class Gate:
    tables: dict[str, tuple[np.ndarray, np.ndarray]]  # log counts of triples and of the pairs before them
    least: np.ndarray  # mean log likelihood a byte, by SIZES

    def likelihood(self, raw: bytes, lang: str) -> float:
        total, n = 0.0, 0
        for at in range(0, len(raw), 1 << 20):
            x, y = cells(raw[at : at + (1 << 20)])
            a, b = self.tables[lang]
            total, n = total + float((a[x] - b[y]).sum(dtype=np.float64)), n + len(x)
        return total / max(1, n)

    def known(self, text: str | None, lang: str) -> bool:
        raw = (text or "").lower().encode("utf-8", "replace")
        return lang in self.tables and self.likelihood(raw, lang) >= self.least[max(0, int(np.searchsorted(SIZES, len(raw), "right")) - 1)]


def calibrate(rows: list[tuple[str, str]], seed: int = 11) -> Gate:
    """rows: (text, language). Half of each language's rows make its tables. The others are held out: as texts of
    their language; as texts of a language left out, by the best of the remaining tables; and, with their bytes
    shuffled, as gibberish. The thresholds part the first from the other two at the least cost."""
    rng = np.random.default_rng(seed)
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "replace")), r))
    sides: tuple[list, list] = ([], [])
    nth: dict[str, int] = {}
    for text, lang in rows:
        sides[nth.get(lang, 0) % 2].append((text.lower().encode("utf-8", "replace"), lang))
        nth[lang] = nth.get(lang, 0) + 1
    counts = {lang: (np.full(CELLS, 0.5), np.full(CELLS, 32.0)) for lang in nth}
    for raw, lang in sides[0]:
        for table, at in zip(counts[lang], cells(raw), strict=True):
            np.add.at(table, at, 1)
    gate = Gate({k: (np.log(a).astype(np.float32), np.log(b).astype(np.float32)) for k, (a, b) in counts.items()}, np.full(len(SIZES), -np.inf))
    for k, size in enumerate(SIZES):
        own, other = [], []
        for raw, lang in sides[1]:
            start = int(rng.integers(0, max(1, len(raw) - size + 1)))
            crop = raw[start : start + size]
            own.append(gate.likelihood(crop, lang))
            other.append(gate.likelihood(rng.permutation(np.frombuffer(crop, np.uint8)).tobytes(), lang))
            if len(nth) > 1:
                other.append(max(gate.likelihood(crop, m) for m in nth if m != lang))
        if own:
            own, other = np.sort(own), np.sort(other)
            cost = DEAR * np.arange(len(own)) / len(own) + 1 - np.searchsorted(other, own) / len(other)
            best = int(cost.argmin())
            under = other[: np.searchsorted(other, own[best])]
            gate.least[k] = (own[best] + max(under[-1], own[best] - 0.5)) / 2 if len(under) else own[best]
    return gate


def _least(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """The threshold of least cost between likelihoods of known texts and of others, each as (ascending value, count)."""
    (x, n), (y, m) = own, other
    upto = np.concatenate([[0], np.cumsum(m)])
    at = np.searchsorted(y, x)
    cost = DEAR * (np.cumsum(n) - n) / n.sum() + 1 - upto[at] / max(1, m.sum())
    best = int(cost.argmin())
    return float((x[best] + max(y[at[best] - 1], x[best] - 0.5)) / 2 if at[best] else x[best])


def calibrate_all(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 11) -> tuple[Gate, dict[str, int]]:
    """What `calibrate` does, over all labelled rows of docs: tables and the likelihoods under thresholds are counted by
    tasks, so the driver sees 2 * CELLS numbers a language and a row for each FINE part of a unit, whatever the number of
    rows. A hash of the text tells which half a row is in; one row of each language makes its table in any case. Returns
    the gate and the number of rows of each language."""
    labelled = docs.where(col(text_col).isNotNull() & col(lang_col).isNotNull()).select(col(text_col).alias("text"), col(lang_col).alias("lang"), F.crc32(col(text_col)).alias("crc"))
    found = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("crc").alias("least")).orderBy("lang").collect()
    number, least = {r["lang"]: k for k, r in enumerate(found)}, np.array([r["least"] for r in found], np.int64)

    def sides(b):
        """(number of the language, in the half that makes tables, bytes) of a batch's rows."""
        lang, crc = np.array([number[x] for x in b.column(1).to_pylist()], np.int64), b.column(2).to_numpy()
        return zip(lang.tolist(), ((crc // 64 % 2 == 0) | (crc == least[lang])).tolist(), (t.lower().encode("utf-8", "replace") for t in b.column(0).to_pylist()), strict=True)

    def count(batches):
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            held: dict[int, list] = {}
            for lang, first, raw in sides(b):
                if first:
                    x, y = cells(raw)
                    held.setdefault(lang, []).extend((x, y + CELLS))
            for lang, at in held.items():
                tables[lang] = tables.get(lang, 0) + np.bincount(np.concatenate(at), minlength=2 * CELLS)
        for lang, n in tables.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at + lang * 2 * CELLS), pa.array(n[at])], names=["k", "n"])

    got = map_arrow(labelled, count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(found) * 2 * CELLS)
    n[got.column("k").to_numpy()] = got.column("n").to_numpy()
    logs = np.log(n.reshape(-1, 2, CELLS) + np.array([[0.5], [32.0]])).astype(np.float32)
    gate = Gate({r["lang"]: (logs[k, 0], logs[k, 1]) for k, r in enumerate(found)}, np.full(len(SIZES), -np.inf))

    def judge(batches):
        for b in batches:
            seen = []
            for lang, first, raw in sides(b):
                if first:
                    continue
                rng = np.random.default_rng([seed, zlib.crc32(raw)])
                for k, size in enumerate(SIZES):
                    start = int(rng.integers(0, max(1, len(raw) - size + 1)))
                    crop = raw[start : start + size]
                    x, y = cells(crop)
                    each = (logs[:, 0, x] - logs[:, 1, y]).sum(axis=1, dtype=np.float64) / max(1, len(x))
                    shuffled = gate.likelihood(rng.permutation(np.frombuffer(crop, np.uint8)).tobytes(), found[lang]["lang"])
                    seen += [(k, 0, each[lang]), (k, 1, shuffled)]
                    if len(each) > 1:
                        seen.append((k, 1, np.delete(each, lang).max()))
            if seen:
                k, other, x = np.array(seen).T
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(other.astype(np.int64)), pa.array(np.floor(x * FINE).astype(np.int64))], names=["size", "other", "x"])

    bins = map_arrow(labelled, judge, "size long, other long, x long").groupBy("size", "other", "x").count().orderBy("size", "other", "x").toArrow()
    size, other, x, n = (bins.column(c).to_numpy() for c in ("size", "other", "x", "count"))
    for k in range(len(SIZES)):
        own, rest = (size == k) & (other == 0), (size == k) & (other == 1)
        if own.any():
            gate.least[k] = _least((x[own] / FINE, n[own]), (x[rest] / FINE, n[rest]))
    return gate, {r["lang"]: r["n"] for r in found}


def keep_known(docs: DataFrame, model: langid.Model | None, gate: Gate, text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts are like those of the language that the network takes them for: predicted and judged
    in one pass. Null texts and texts without a letter go; so do all if there was nothing to learn from."""
    text = docs.columns.index(text_col)

    def run(batches):
        scorer = langid.Scorer(model) if model else None
        for b in batches:
            texts = b.column(text).to_pylist()
            langs = scorer(texts)[0] if scorer else [langid.UND] * len(texts)
            yield b.filter(pa.array([k != langid.UND and gate.known(t, k) for t, k in zip(texts, langs, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
