"""Ids against the model's own library and brute-force Viterbi; decoding; odd rows."""

import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece

from pipelens.llm import sentencepiece_ops as S

ODD = ["Hello  world\n\t ünï 漢字🙂 x", "", " lead", "a" * 40, "   ", "trail ", "tab\tonly", "\n\n\n", "é́", "x" * 200 + " " + "ab" * 90]


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces.load()


def test_ids_equal_the_library(spark, sf, pieces):
    lib = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in S.encode(docs, pieces).collect():
        assert r["ids"] == lib.encode(r["text"])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, None), (0, ODD[0])], "i int, text string")
    out = S.decode(S.encode(rows, pieces), pieces, text_out="back").collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        assert r["back"] == r["text"] and (r["text"] is None and r["ids"] is None or r["ids"] == lib.encode(r["text"]))


def test_digest_and_odd_tables(spark, pieces):
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, part string")
    got = sorted((tuple(r) for r in S.encode(rows, pieces, digest=True).collect()), key=str)
    assert [r[:3] for r in got] == [(1, "x", 2), (1, "x", 2), (2, "y", 0), (3, "z", 0)] and got[0] == got[1]
    assert got[2][3:] == (None, None, None, 0.0) and got[3][5:] == (True, 0.0)
    assert S.encode(rows.limit(0), pieces).count() == 0
    grouped = rows.groupBy("doc_id").count().selectExpr("doc_id", "cast(count as string) as text")  # not a plain scan
    assert sorted(r["text"] for r in S.decode(S.encode(grouped, pieces), pieces, text_out="t").collect()) == ["1", "1", "2"]


def test_viterbi_against_brute_force(spark):
    rng = random.Random(2)
    names = ["▁", *"abc", "▁a", "ab", "bc", "abc", "▁ab", "ca", "cab"]
    n = len(names)
    table = S.Pieces(names + [f"<0x{b:02X}>" for b in range(256)], [-rng.random() * 5 for _ in range(n)] + [0.0] * 256, list(range(n)), list(range(n, n + 256))).indexed()
    at = {p: (s, i) for i, (p, s) in enumerate(zip(names, table.scores, strict=False))}
    units = sorted({"▁" + "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(40)})

    def best(u):
        if not u:
            return 0.0, []
        options = []
        for n in range(1, len(u) + 1):
            score, ids = best(u[:-n])
            if u[-n:] in at:
                options.append((score + at[u[-n:]][0], n, ids + [at[u[-n:]][1]]))
            elif n == 1:
                options.append((score + S.BYTE_SCORE, n, ids + [-1]))
        score, _, ids = max(options)
        return score, ids

    for r in S.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), table).collect():
        assert r["ids"] == best(r["unit"])[1], r


def slow_best(unit, table):
    """Viterbi over all pieces, without a lattice: score."""
    best = [0.0]
    for e in range(1, len(unit) + 1):
        found = [best[e - n] + table[unit[e - n : e]][0] for n in range(1, e + 1) if unit[e - n : e] in table]
        best.append(max(found + [best[e - 1] + S.BYTE_SCORE] * (unit[e - 1] not in table)))
    return best[-1]


def test_digests_against_the_library_and_viterbi(spark, sf, pieces):
    """Every column of op2 over a whole table, by text instead of by unit."""
    lib, table = sentencepiece.SentencePieceProcessor(model_file=S.MODEL), pieces.table()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {}
    for r in S.digests(spark, spark.read.parquet(f"{sf}/documents.parquet")).collect():
        text = texts[r["doc_id"]]
        ids = lib.encode(text)
        assert r["n_pieces"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and r["round_trip"]
        words = (S.SPACE + text.replace(" ", S.SPACE)).replace(S.SPACE, " " + S.SPACE).split(" ")[1:] if "  " not in text and text else None
        if words:  # no piece goes on over a single space
            for w in words:
                if w not in known:
                    known[w] = slow_best(w, table)
            assert r["viterbi_score"] == sum(known[w] for w in words)


@pytest.mark.parametrize("merges", [False, True])
def test_long_units_fold_as_the_lattice_does(spark, pieces, merges):
    rng = random.Random(6)
    names = ["▁", *"abc", "▁a", "ab", "bc", "abc", "▁ab", "ca", "cab", "abcab", "bb", "bbbb"]
    small = S.Pieces(names + [f"<0x{b:02X}>" for b in range(256)], [-float(i) for i in range(len(names))] + [0.0] * 256, list(range(len(names))), list(range(len(names), len(names) + 256)), merges)
    units = sorted({"▁" + "".join(rng.choice("abbcd") for _ in range(rng.randrange(1, S.LONG))) for _ in range(60)})
    for r in S.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), small).collect():
        assert (r["ids"], r["score"]) == small.path(r["unit"])


def test_a_megabyte_without_a_space(spark, pieces):
    lib, rng = sentencepiece.SentencePieceProcessor(model_file=S.MODEL), random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(1 << 20))
    began = time.time()
    got = S.encode(spark.createDataFrame([(1, text), (2, "ab " + text[:70])], "i int, text string"), pieces).collect()
    assert time.time() - began < 60
    assert {r["i"]: r["ids"] for r in got} == {1: lib.encode(text), 2: lib.encode("ab " + text[:70])}


def test_merges_out_of_order_are_noticed(spark, pieces):
    """With the piece abcd before cd, a better merge turns up late, and one pass over the edges would miss it."""
    assert pieces.late == (S.SPACE * 16,)
    lib = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    spaces = [("x" + " " * n + "y",) for n in range(12, 40)]
    assert all(r["ids"] == lib.encode(r["text"]) for r in S.encode(spark.createDataFrame(spaces, "text string"), pieces).collect())
    names = [*"▁abcd", "ab", "bc", "bcd", "abcd", "cd"]
    table = S.Pieces(names + [f"<0x{b:02X}>" for b in range(256)], [-float(i) for i in range(len(names))] + [0.0] * 256, list(range(len(names))), list(range(len(names), len(names) + 256)), True).indexed()
    assert table.late == ("abcd",)
    assert S.encode(spark.createDataFrame([("abcd",)], "text string"), table).first()["ids"] == [0, 8]


def test_names_that_clash(spark, pieces):
    rows = spark.createDataFrame([("a b", [1], 2)], "text string, ids array<int>, n_pieces int")
    out = S.encode(rows, pieces)
    assert out.columns == ["text", "ids", "n_pieces", "ids_"] and S.encode(rows, pieces, digest=True).columns[:3] == ["ids", "n_pieces", "n_pieces_"]
    back = S.decode(out, pieces, ids_col="ids_")
    assert back.columns[-1] == "text_" and back.first()["text_"] == "a b"
