"""Line dedup, language ID, SimHash, mixing, LM scoring: brute force, and nulls, empties, ties, repeats and odd columns."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pipelens.llm import langid, line_dedup, lm_scoring, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema)


def brute_dedup(rows):
    seen, gone = {}, {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(x.strip(" \t\r") for x in w):
                continue
            if w not in seen:
                seen[w] = (i, p)
            elif not (seen[w][0] == i and p - seen[w][1] < 3):
                gone.setdefault(i, set()).update((p, p + 1, p + 2))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {k}" for k in range(12)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    texts += [None, "", "one", "a\nb", "x\ny\nz", "x\ny\nz", "\n".join(["same"] * 10), "\n\n\n\n", "a\nb\nc\n" * 4000]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    want = brute_dedup(list(enumerate(texts)))
    assert {i: r["text"] for i, r in out.items()} == want
    assert out[60]["n_lines"] == 0 and out[66]["text"] == "same\nsame\nsame" and out[66]["n_removed"] == 7


def test_line_dedup_repeats_clashes_and_empty_tables(spark):
    rows = [(1, "a\nb\nc", 5, None), (1, "a\nb\nc", 5, None), (None, "a\nb\nc", 6, "k"), (2, "a\nb\nc\nd", 7, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, `cut` string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "cut", "n_lines_", "n_removed"]
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in out.collect()))
    assert got == [(False, 0, "a\nb\nc"), (True, 1, ""), (True, 1, ""), (True, 2, "d")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_language_id_learns_and_handles_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.classify(spark, docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    out = [r for r in rows if r["held_out"] and r["n_chars"] > 40]
    assert len(out) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97
    model = langid.fit(docs, docs["doc_id"])
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "12 !!", 3), (4, "the and of " * 40_000, 4), (None, "é", 5)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in langid.predict(odd, model, score_out="p").collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] == "en" and 0 <= got[None]["p"] <= 1
    assert langid.fit(docs.limit(0), docs["doc_id"]) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None, score_out="p").collect()} == {"und"}


def test_language_windows_cover_the_whole_text():
    rows = [("aaaa bbbb " * 20, "x"), ("cccc dddd " * 20, "y")] * 20
    s = langid.Scorer(langid.train(rows, steps=80))
    long = "aaaa bbbb " * 100 + "cccc dddd " * 400
    assert s([long])[0] == ["y"] and s(["aaaa bbbb " * 400 + "cccc dddd " * 100])[0] == ["x"]


def slow_language(model, text):
    """One text by plain loops over its windows, filters and places: (language, probability)."""
    raw, total = text.lower().encode(), np.zeros(len(model.langs))
    for at in range(0, len(raw), langid.WINDOW):
        pooled = []
        for k, (w, f) in enumerate(sorted(model.filters.items())):
            best = np.full(langid.FILTERS, -np.inf)
            for i in range(at, at + langid.WINDOW):
                seen = np.concatenate([model.embed[raw[i + j] if i + j < len(raw) else 0] for j in range(w)])
                best = np.maximum(best, seen @ f + model.bias[k * langid.FILTERS : (k + 1) * langid.FILTERS])
            pooled.append(np.maximum(best, 0))
        z = np.concatenate(pooled) @ model.out + model.out_bias
        total += (z - np.log(np.exp(z - z.max()).sum()) - z.max()) * min(langid.WINDOW, len(raw) - at)
    p = np.exp(total / len(raw) - (total / len(raw)).max())
    return model.langs[int(p.argmax())], float((p / p.sum()).max())


def test_language_id_against_plain_loops_and_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()), docs["doc_id"])
    texts = [r["text"] for r in docs.collect()] + ["a" * n for n in (1, 253, 254, 255, 256, 257, 512)] + ["é", "x\0y", " the", "of the " * 400]
    scorer = langid.Scorer(model)
    together = list(zip(*scorer(texts), strict=True))
    assert together == [(a[0], b[0]) for a, b in (scorer([t]) for t in texts)]
    assert together[::-1] == list(zip(*scorer(texts[::-1]), strict=True))
    for t, (lang, score) in list(zip(texts, together, strict=True))[-40:]:
        if len(t) < 3000:
            want = slow_language(model, t)
            assert want[0] == lang and abs(want[1] - score) < 1e-4, t
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.classify(spark, docs).collect()}
    assert by_id == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.classify(spark, docs.repartition(7)).collect()}


def test_language_id_names_and_rows(spark):
    rows = [(f"word{i % 7} of x{i}", f"l{i % 30}", 1, "k") for i in range(300)] + [(None, "l1", 1, "k"), ("abc", None, 1, "k")]
    docs = spark.createDataFrame(rows, "text string, lang string, score int, lang_pred string")
    picked = langid.sampled(docs, docs["text"], sample=5)
    assert {lang for _, lang in picked} <= {f"l{i}" for i in range(30)} and all((t, lang) in {r[:2] for r in rows} for t, lang in picked)
    assert langid.predict(docs, None).columns == ["text", "lang", "score", "lang_pred", "lang_pred_", "score_"]


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts = base + [b + " zz" for b in base] + base[:5] + [None, "", " \t", "One", "one two", "Été éTÉ É", "w " * 30_000]
    assert all(simhash.fingerprint(t) == slow_fingerprint(t) for t in texts if len(t or "") < 1000)
    out = {r["doc_id"]: r for r in simhash.near_dups(spark, frame(spark, texts)).collect()}
    fp = [int(out[i]["fingerprint"], 16) for i in range(len(texts))]
    comp = list(range(len(texts)))
    for _ in comp:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(fp[i] ^ fp[j]).count("1") <= 2:
                    comp[i] = min(comp[i], comp[j])
    assert [out[i]["component_id"] for i in range(len(texts))] == comp


def test_simhash_tiles_lose_no_pair(monkeypatch, spark):
    monkeypatch.setattr(simhash, "TILE", 7)
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = np.unique(np.concatenate([fps, *(fps ^ (np.int64(1) << np.int64(b)) ^ (np.int64(1) << np.int64((b * 7 + 3) % 62)) for b in range(0, 60, 9)), np.arange(64), [0, -1]]))
    from pipelens.llm.components import components

    links = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    comp = {int(x): int(x) for x in fps}
    for _ in range(len(fps)):
        before = dict(comp)
        for a in fps:
            for b in fps[np.bitwise_count((fps ^ a).view(np.uint64)) <= 2]:
                comp[int(a)] = min(comp[int(a)], comp[int(b)])
        if comp == before:
            break
    assert {k: got.get(k, k) for k in comp} == comp


def test_simhash_odd_tables(spark):
    rows = [(None, "a b c", 1), (None, "a b c", 1), (7, "a b c", 2), (7, "quite another text here", 3), (9, "a b c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.group(df).collect())
    assert got == [(-1, 7), (-1, 7), (7, 7), (7, 7), (9, 7)]
    assert simhash.group(df.limit(0)).count() == 0


def pfair(share, blocks):
    """Slot by slot: among released blocks of sources that have any left, the earliest deadline; anew when one runs out."""
    left, out = dict(blocks), []
    while left:
        period = sum(share[s] for s in left)
        done, t = dict.fromkeys(left, 0), 0
        while all(left.values()):
            ready = [(Fraction((done[s] + 1) * period, share[s]).__ceil__(), s) for s in left if Fraction(done[s] * period, share[s]).__floor__() <= t]
            s = min(ready)[1]
            out.append(s)
            done[s] += 1
            left[s] -= 1
            t += 1
            assert all(abs(done[x] - Fraction(t * share[x], period)) < 1 for x in done)
        left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mixing_against_slot_by_slot_simulation(seed):
    rng = random.Random(seed)
    share = {f"s{i}": rng.randrange(1, 9) for i in range(rng.randrange(1, 6))}
    blocks = {s: rng.randrange(0, 40) for s in share}
    plan = mixing.phases(share, {s: n for s, n in blocks.items()})
    got = {}
    for s, n in blocks.items():
        for k in range(n):
            got[mixing._slot(plan, s, k)] = s
    assert [got[t] for t in sorted(got)] == pfair(share, {s: n for s, n in blocks.items() if n}) and sorted(got) == list(range(len(got)))


def test_mixing_keeps_every_row_in_a_dense_order(spark):
    rows = [(i if i % 50 else None, f"t{i}", [None, "a", "b", "c.d"][min(3, i % 7)], i) for i in range(500)] + [(3, "t3", "a", 3)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot long")
    out, n = mixing.schedule(df, {"a": 3, "b": 1}, block=4)
    got = out.collect()
    assert n == len(rows) == len(got) and sorted(r["position"] for r in got) == list(range(n))
    assert out.columns[-5:] == ["block", "slot_", "release", "deadline", "position"]
    assert all(r["release"] <= r["slot_"] < r["deadline"] for r in got)
    mixed = mixing.mix(df, block=4, rows_a_part=100)
    assert mixed.columns == df.columns and sorted(map(str, mixed.collect())) == sorted(map(str, df.collect()))
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.schedule(df.limit(0))[0].count() == 0


def slow_positions(rows, weights, block):
    """Rows (row, source) in any order by a slot-by-slot simulation: number of rows of each source before each block."""
    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    order = pfair(mixing.shares(weights), {s: -(-k // block) for s, k in n.items()})
    done, at, out = dict.fromkeys(n, 0), 0, []
    for slot, s in enumerate(order):
        out.append((slot, s, done[s], at))
        at += min(block, n[s] - done[s] * block)
        done[s] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1}, {"a": 1, "b": 1e-6, "c": 0.1}, {"a": 1 / 3, "b": 2 / 3, "c": 5}])
def test_mixing_by_exact_weights(spark, weights):
    rng = random.Random(9)
    rows = [(i, rng.choice("aaabbc")) for i in range(900)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=4)[0].collect()
    first = {}
    for r in got:
        first.setdefault((r["slot"], r["source"], r["block"]), []).append(r["position"])
    want = slow_positions(rows, weights, 4)
    assert sorted((*k, min(v)) for k, v in first.items()) == want
    assert all(sorted(v) == list(range(min(v), min(v) + len(v))) for v in first.values())


def test_mixing_weights_stay_exact_and_blocks_grow(spark):
    assert mixing.shares({"a": 1, "b": 1e-6})["a"] == Fraction(1) / Fraction(1e-6) * mixing.shares({"a": 1, "b": 1e-6})["b"]
    df = spark.range(1000).selectExpr("id as doc_id", "if(id % 3 = 0, 'x', 'y') as source")
    out = mixing.schedule(df, mixing.in_turn(), slots=10)[0]
    assert out.selectExpr("max(slot)").first()[0] <= 11 and out.selectExpr("count(distinct position)").first()[0] == 1000


def test_mixing_order_depends_on_the_rows_alone(spark):
    rows = [(None, f"t{i}", "ab"[i % 2]) for i in range(3000)] + [(1, "same", "a")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = ({(r["text"], r["position"]) for r in mixing.schedule(df.repartition(n), {"a": 2, "b": 1}, block=4)[0].collect()} for n in (7, 3))
    assert one == two and len(one) == 3050
    names = "s, k, before, start, period, share, slots, until, src, bucket, rank, src_name, piece, rows_before, plan"
    odd = df.selectExpr("*", *(f"1 as `{n}`" for n in names.split(", ")))
    assert mixing.schedule(odd)[0].select("position").distinct().count() == 3050
    many = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 1500) as source")
    assert mixing.schedule(many, block=1)[0].selectExpr("max(position)").first()[0] == 2999


def slow_scores(texts, model):
    """Plain loops over words, neighbours, classes and places: (words, sum of log probabilities) of each text."""
    n = Counter(w for t in texts for w in (t or "").lower().split())
    p, side, own = model.network.p, model.grid.side, {w: i for i, w in enumerate(model.grid.top)}
    cell_of = {w: own[w] if w in own else model.grid.shared(w) for w in n}
    cells = Counter()
    for w, k in n.items():
        cells[cell_of[w]] += k
    assert [cells[i] for i in range(side * side)] == model.cells.tolist()
    soft = lambda z: np.log(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    out = []
    for t in texts:
        ws, total = (t or "").lower().split(), 0.0
        at = [model.grid.edge, *(cell_of[w] for w in ws), model.grid.edge]
        for i, w in enumerate(ws):
            h = np.tanh(p["left"][at[i]] + p["right"][at[i + 2]] + p["bias"])
            c, j = divmod(cell_of[w], side)
            total += soft(h @ p["out"] + p["out_bias"])[c] + soft(h @ p["place"][c] + p["place_bias"][c])[j] + np.log(n[w] / (cells[cell_of[w]] + 1))
        out.append((len(ws), total))
    return out


def test_lm_scores_against_plain_loops(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the", "cat", "Dog", "sat", "on", "a", f"w{rng.randrange(90)}", "Été", "漢字"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "", "  \n", " lead trail ", "a\u00a0b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm_scoring.fit(docs.repartition(3))
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, model).collect()}
    for i, (n, total) in enumerate(slow_scores(texts, model)):
        assert got[i]["n_tokens"] == n and abs(got[i]["pll"] - total) < 1e-3 * (1 + n)
        assert got[i]["mean_logp"] is None if not n else abs(got[i]["mean_logp"] - total / n) < 1e-3


def test_lm_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lm_scoring.fit(docs)
    text = docs.first()["text"]
    odd = spark.createDataFrame([(1, text, 1), (2, None, 1), (3, "", 1), (4, "zzz 漢字 zzz", 1), (1, text, 1), (None, " \n", 1), (5, "the of " * 200_000, 1)], "doc_id long, text string, id int")
    got = {r["doc_id"]: tuple(r) for r in lm_scoring.score(odd, model).collect()}
    assert got[1][1] == len(text.lower().split()) and got[1][2] < 0
    assert got[2][1:] == got[3][1:] == got[None][1:] == (0, 0.0, None) and got[4][2] < 0 and got[5][1] == 400_000
    assert [tuple(r) for r in lm_scoring.score(odd, model).where("doc_id = 1").collect()] == [got[1]] * 2
    empty = lm_scoring.fit(docs.limit(0))
    assert lm_scoring.score(odd, empty).count() == 7 and lm_scoring.score(odd.limit(0), model).count() == 0


def test_lm_network_beats_frequencies(spark, sf):
    """Of held-out rows: the words' cells are predicted better with both neighbours than without them."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = lm_scoring.fit(docs.where("doc_id % 5 <> 0"))
    left, cell, right, _, _ = lm_scoring.positions(docs.where("doc_id % 5 = 0").select("text").toArrow().column(0).combine_chunks(), model.grid)
    start = lm_scoring.Network(model.grid.side, model.cells)
    assert model.network.logp(left, cell, right).mean() > start.logp(left, cell, right).mean() + 0.2
    every = np.arange(model.grid.side**2)
    assert abs(np.exp(model.network.logp(np.full_like(every, 3), every, np.full_like(every, 5))).sum() - 1) < 1e-3


def test_lm_grid_grows_with_the_words():
    sizes = [lm_scoring.Grid.size(n) ** 2 for n in (10**4, 10**6, 10**8)]
    assert sizes[0] >= 100 and sizes[1] >= 1000 and sizes[2] >= 10_000
    g = lm_scoring.Grid.of(10**4, [f"w{i}" for i in range(10**4)])
    assert len(g.top) == g.side // 2 * g.side and g.side**2 > g.shared("other") >= len(g.top)


def test_lm_tasks_are_averaged_by_their_positions(spark):
    docs = spark.createDataFrame(spark.sparkContext.parallelize([("a b c d " * 400,), ("d c b a " * 100,)], 2), "text string")
    words = [f"{c}" for c in "abcd"]
    grid, counts = lm_scoring.Grid(8, words), np.zeros(64)
    counts[:4] = 500
    parts = [[r["text"] for r in rows] for rows in docs.rdd.glom().collect() if rows]
    assert len(parts) == 2
    total, n = 0.0, 0
    for rows in parts:
        net, state, k = lm_scoring.Network(8, counts), {}, 0
        left, cell, right, _, _ = lm_scoring.positions(pa.array(rows), grid)
        lm_scoring.learn(net, left, cell, right, state, lm_scoring.passes(2000 / 2))
        total, n = total + len(cell) * net.flat().astype(float), n + len(cell)
    got = lm_scoring.train(docs, "text", grid, counts).flat()
    assert np.allclose(got, total / n, atol=1e-5)


def test_lm_training_is_the_same_for_tables_of_every_size():
    assert len({lm_scoring.passes(n) for n in (1, 10**5, 10**6, 10**7, 10**9)}) == 1
    for n in (1, 300, 4097, 50_000):
        net, state, cell = lm_scoring.Network(8, np.ones(64)), {}, np.arange(n) % 64
        lm_scoring.learn(net, cell, cell, cell, state, lm_scoring.passes(n))
        assert state["t"] == lm_scoring.passes(n) * -(-n // lm_scoring.BATCH)


def test_lm_words_end_before_white_space():
    for n in range(1, 600):
        words, ends = lm_scoring.words_of(pa.array(["b a ", "d c b a " * n]))
        assert words.to_pylist() == ["b", "a", *["d", "c", "b", "a"] * n] and ends.tolist() == [2, 2 + 4 * n]


def test_lm_scores_of_a_position_are_the_same_wherever_it_stands():
    """Also where scores are too large for exp; and hashes, however many bytes are hashed at once."""
    rng = np.random.default_rng(5)
    left, cell, right = rng.integers(0, 64, (3, 40_000))
    for scale in (0.3, 30):
        net = lm_scoring.Network(8, np.arange(64.0))
        net.p["out"], net.p["place"] = (rng.normal(0, scale, net.p[k].shape).astype(np.float32) for k in ("out", "place"))
        every, some = net.logp(left, cell, right), rng.permutation(40_000)[:777]
        assert np.isfinite(every).all() and (net.logp(left[some], cell[some], right[some]) == every[some]).all()
    words = pa.array(["", "a", "\0", "\0a", "漢字", "x" * 200_000, "x" * 200_001, "y" * 65_536, "a"])
    got = lm_scoring._hashed(words)
    assert got[1] == got[-1] and len(set(got.tolist())) == 8
    assert (lm_scoring._hashed(words.slice(2)) == got[2:]).all() and [lm_scoring._hashed(words.slice(i, 1))[0] for i in range(9)] == got.tolist()
