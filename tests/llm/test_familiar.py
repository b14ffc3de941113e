"""The first stage keeps texts of learned languages, short ones too, and rejects unknown languages and gibberish."""

import random
import zlib

import numpy as np

import corpus_pipeline
from pipelens.llm import familiar, langid


def test_unknown_languages_go_and_short_clean_texts_stay(spark):
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect() if r["text"] and r["lang"] and len(r["text"]) > 200]
    rng = random.Random(1)
    clean = ["the work of the people", "it was in the same year", "one of them and the other"]
    for left_out in ("fr", "de"):
        rows = [(r["doc_id"], r["text"][:1500], r["lang"]) for r in docs if r["lang"] != left_out]
        foreign = [(10**6 + r["doc_id"], r["text"][:1500], None) for r in docs if r["lang"] == left_out]
        noise = [(2 * 10**6 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)), None) for i in range(50)]
        words = [r[1].split() for r in rows if r[2] == "en"][:100]
        short = [(3 * 10**6 + i, " ".join(w[4:12]), None) for i, w in enumerate(words)] + [(4 * 10**6 + i, t, None) for i, t in enumerate(clean)]
        table = spark.createDataFrame(rows + foreign + noise + short, "doc_id long, text string, lang string")
        kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, table, "").collect()}
        share = lambda part: sum(r[0] in kept for r in part) / len(part)
        found = {"known": share(rows), "foreign": share(foreign), "noise": share(noise), "short": share(short)}
        print(left_out, found)
        assert found["known"] > 0.98 and found["foreign"] < 0.1 and found["noise"] == 0 and found["short"] > 0.95, found


def test_all_rows_count_however_few_are_sampled(monkeypatch, spark):
    """With a sample of twenty rows a language: tables hold half of all rows, and thresholds come from all others."""
    monkeypatch.setattr(langid, "ROWS", 60)
    rng = random.Random(4)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60)] for k, letters in (("aa", "abcdefg"), ("bb", "hijklmno"), ("cc", "pqrstuvw"))}
    known = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(["aa", "bb", "cc"] * 120)]
    noise = [(10**6 + i, "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(300)), None) for i in range(40)]
    docs = spark.createDataFrame(known + noise, "doc_id long, text string, lang string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert len(kept & {r[0] for r in known}) > 350 and not kept & {r[0] for r in noise}
    gate, counts = familiar.calibrate_all(docs)
    assert counts == {"aa": 120, "bb": 120, "cc": 120}
    for lang in counts:
        crcs = {t: zlib.crc32(t.encode()) for _, t, k in known if k == lang}
        n = np.zeros(familiar.CELLS)
        for t, crc in crcs.items():
            if crc // 64 % 2 == 0 or crc == min(crcs.values()):
                np.add.at(n, familiar.cells(t.encode())[0], 1)
        assert np.allclose(np.exp(gate.tables[lang][0]) - 0.5, n, atol=1e-2)


def test_threshold_of_least_cost_against_plain_loops():
    rng = np.random.default_rng(6)
    for _ in range(200):
        own, other = np.sort(rng.integers(-9, 3, rng.integers(1, 30))) / 4, np.sort(rng.integers(-12, 0, rng.integers(0, 30))) / 4
        costs = {x: familiar.DEAR * (own < x).mean() + ((other >= x).mean() if len(other) else 1) for x in own.tolist()}
        best = min(costs, key=lambda x: (round(costs[x], 9), x))
        under = other[other < best]
        want = (best + max(under[-1], best - 0.5)) / 2 if len(under) else best
        got = familiar._least(np.unique(own, return_counts=True), np.unique(other, return_counts=True))
        assert abs(got - want) < 1e-9 or abs(costs[best] - min(costs.values())) < 1e-9 and any(abs(costs[x] - costs[best]) < 1e-9 for x in costs if x != best)
