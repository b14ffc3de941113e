"""Near copies by sets of five-word shingles against brute force."""

import random

import numpy as np

import corpus_pipeline
from pipelens.llm import shingle_sets, simhash


def brute(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, comp = [shingles(t) for _, t in rows], [i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.random()}"
    return " ".join(w)


def test_near_copies_with_a_few_edits_go(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in [200] * 12 + [5, 9, 40, 44, 49, 90]]
    texts = base + [edited(rng, t, k) for t in base[:12] for k in (1, 2, 3, 4, 5)] + [t + " " + " ".join(f"t{i}" for i in range(k)) for t in base[12:] for k in range(1, 14)]
    for _ in range(30):  # a chain of edits, whose ends share little
        texts.append(edited(rng, texts[-1], 1))
    texts += [base[0].upper(), base[1], None, "", " \t", "one two", "one  two"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.group(docs).collect()}
    assert [got[i] for i, _ in rows] == want
    assert {r["doc_id"]: r["component_id"] for r in simhash.group_similar(docs).collect()} == got
    pairs = [(i, j) for i in range(12) for j in range(18 + 5 * i, 23 + 5 * i) if want[i] == want[j]]
    far = [bin(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).count("1") > 2 for i, j in pairs]
    assert len(pairs) > 20 and sum(far) > len(far) / 2  # what the fingerprints' radius lost
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, c in zip(range(len(rows)), want, strict=True) if i == c}


def test_similarity_at_the_bound_and_odd_ids(spark):
    words = [f"w{i}" for i in range(24)]  # 20 shingles
    rows = [(5, " ".join(words)), (6, " ".join([*words, *"abcde"])), (7, " ".join([*words, *"uvwxyz"])), (None, " ".join(words)), (5, "something else of some words")]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in shingle_sets.group(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 5), (5, 5), (5, 5), (6, 5), (7, 7)]  # 20 of 25 are shared, and 20 of 26
    assert shingle_sets.group(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()["component_id"] is None
    assert shingle_sets.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_rule_out_most_pairs_and_no_similar_one():
    rng = np.random.default_rng(8)
    a, b = [], []
    for n in [1, 2, 5, 31, 32, 33, 64, 65, 300, 5000] * 40:
        x = rng.integers(0, 2**64, n, np.uint64, endpoint=False)
        other = rng.integers(0, 2**64, max(1, int(n * rng.uniform(0.5, 2))), np.uint64)
        keep = x[rng.random(n) < rng.choice([0, 0.7, 0.9, 1])]
        y = np.concatenate([keep, other[: max(1, int(n * rng.choice([0, 0.05, 0.12, 0.5])))]])
        a, b = a + [np.unique(x), np.unique(x)], b + [np.unique(y), np.unique(other)]
    sizes = [np.array([len(s) for s in side]) for side in (a, b)]
    got = shingle_sets.may_be_similar(sizes[0], [shingle_sets.sketch(s) for s in a], sizes[1], [shingle_sets.sketch(s) for s in b])
    true = np.array([shingle_sets.similar(x, y) for x, y in zip(a, b, strict=True)])
    assert true.sum() > 100 and (got | ~true).all()
    far = np.array([len(np.intersect1d(x, y)) < 0.6 * len(x) and len(x) >= 300 for x, y in zip(a, b, strict=True)])
    assert far.sum() > 80 and got[far].mean() < 0.02


def test_texts_are_not_shuffled_to_be_compared(spark, monkeypatch):
    """Only texts of pairs that sketches don't rule out become sets, each once."""
    rng, made, known = np.random.default_rng(9), [], shingle_sets.materialise

    def counted(df, tag):
        out = known(df, tag)
        made.append((tag, out[0].count()))
        return out

    monkeypatch.setattr(shingle_sets, "materialise", counted)
    word = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 5000, k))
    shared = word(60)
    texts = [f"{word(100)} {shared} {word(100)}" for _ in range(60)]
    texts += [texts[0] + " more", texts[0], texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.group(docs).collect()}
    assert got == {i: {60: 0, 61: 0, 62: 1}.get(i, i) for i in range(63)}
    assert sum(n for tag, n in made if tag == "pairs") < 20 and sum(n for tag, n in made if tag == "sets") < 30
