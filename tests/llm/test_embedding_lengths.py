"""Embedding near-dedup on tables whose vectors have several lengths, against brute force."""

import numpy as np

from pipelens.llm import rabitq


def test_vectors_link_within_every_length(spark):
    rng = np.random.default_rng(2)
    rows = []
    for dim, n in ((64, 55), (128, 45), (3, 1)):
        base = rng.normal(size=(n, dim))
        base[n // 2 : n // 2 * 2] = base[: n // 2] + rng.normal(size=(n // 2, dim)) * rng.uniform(0.1, 0.6, (n // 2, 1))
        rows += [[float(x) for x in v] for v in base.astype("float32")] + [[float(x) for x in base[0].astype("float32")]]
    got = {r["vec_id"]: r for r in rabitq.near_dups(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for v in rows]
    hit = np.array([[i != j and len(a) == len(b) and a @ b >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)])
    comp = np.arange(len(rows))
    for _ in rows:
        comp = np.minimum(comp, np.where(hit, comp[None], len(rows)).min(1))
    assert hit[[len(v) == 128 for v in rows]].sum() > 20
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(len(rows))] == [(hit[i].sum(), comp[i], comp[i] == i) for i in range(len(rows))]
