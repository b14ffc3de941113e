"""GIF, WARC, chat and embeddings."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from pipelens.llm import chat, gif, rabitq, warc

SAMPLE = bytes.fromhex("47494638396 10a000a00910000ffffffff00000000ff00000021f904000000000 02c000000000a000a0000021 68c2d99872a1cdc33a00275ec95faa8de608c04914c01003b".replace(" ", ""))


def test_gif_decodes_a_known_image():
    f = gif.decode(SAMPLE)[0]
    assert f.indices.shape == (10, 10)
    assert f.indices[0].tolist() == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2] and f.indices[4].tolist() == [1, 1, 1, 0, 0, 0, 0, 2, 2, 2] and f.indices[9].tolist() == [2, 2, 2, 2, 2, 1, 1, 1, 1, 1]
    assert f.canvas[0, 0].tolist() == [255, 0, 0, 255] and f.canvas[0, 9].tolist() == [0, 0, 255, 255]
    h = gif.histogram([f], 2)
    assert sum(h) == 100 and h[4] == int((f.indices == 1).sum()) and h[1] == int((f.indices == 2).sum())


@pytest.mark.parametrize("bits", [2, 8])
def test_lzw_round_trips(bits):
    rng = random.Random(bits)
    for n in (0, 1, 2, 300, 5000, 70_000):
        for data in (bytes(rng.randrange(1 << bits) for _ in range(n)), bytes(n), bytes(i * i // 7 % (1 << bits) for i in range(n))):
            assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data
    with pytest.raises(ValueError):
        gif.lzw_decode(gif._pack(np.array([256, 65, 400], np.uint32), np.array([9, 9, 9])), 8, 10)


def test_lzw_with_a_deferred_clear_code():
    """A writer may go on with a full table: 12 bits a code, and nothing is added."""
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(30_000))
    table, codes, w, size, width = {bytes([i]): i for i in range(256)}, [(256, 9)], b"", 258, 9
    for k in range(len(data)):
        x = data[k : k + 1]
        if w + x in table:
            w += x
            continue
        codes.append((table[w], width))
        if size < 4096:
            table[w + x] = size
            size += 1
            if size > 1 << width and width < 12:
                width += 1
        w = x
    codes += [(table[w], width), (257, width)]
    assert len(codes) > 3 * 8192
    stream = gif._pack(*(np.array(c, t) for c, t in zip(zip(*codes), (np.uint32, np.int64))))
    assert gif.lzw_decode(stream, 8, len(data)) == data


def test_headers_that_claim_too_much(spark):
    import struct

    wide = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    frame = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\0\x3b"
    rows = gif.decode_frames(spark.createDataFrame([(1, bytearray(wide)), (2, bytearray(frame))], "id int, media binary")).collect()
    assert [r["frame"] for r in rows] == [None, None] and all("65535" in r["error"] for r in rows)


def test_feature_is_that_of_the_colours_seen():
    from collections import Counter

    payload = bytes(i * i % 251 for i in range(64 * 5000))
    canvas, want, frames = {}, [], 0
    for at in range(0, len(payload), 64 * gif.ROWS):
        for k, x in enumerate(payload[at : at + 64 * gif.ROWS]):
            canvas[k] = x  # a shorter frame leaves what is below it
        cells = Counter(x // 16 * 0x111 for x in canvas.values())
        want.append(f"{frames * gif.DELAY}+{gif.DELAY}:" + ",".join(f"{c:03x}={n}" for c, n in sorted(cells.items())))
        frames += 1
    assert frames == 2 and gif._feature(gif.load_bytes(gif.store_bytes(payload))[1]) == "frames=2;" + ";".join(want)


def test_disposal_transparency_offsets_and_times():
    import struct

    def frame(px, left, top, dispose, clear, delay):
        flags = dispose << 2 | (clear is not None)
        return b"\x21\xf9\x04" + struct.pack("<BHB", flags, delay, clear or 0) + b"\0" + b"\x2c" + struct.pack("<HHHHB", left, top, px.shape[1], px.shape[0], 0) + b"\x08" + gif._blocks(gif.lzw_encode(px.tobytes(), 8))

    u = lambda *r: np.array(r, np.uint8)
    data = b"GIF89a" + struct.pack("<HHBBB", 3, 1, 0xF7, 0, 0) + gif.GREY
    data += frame(u([10, 20, 30]), 0, 0, 1, None, 5) + frame(u([99, 40]), 1, 0, 2, 99, 7) + frame(u([50]), 0, 0, 3, None, 1) + frame(u([60]), 2, 0, 0, None, 2) + b"\x3b"
    out = gif.decode(data)
    assert [(f.start, f.delay) for f in out] == [(0, 5), (5, 7), (12, 1), (13, 2)]
    assert [f.canvas[0, :, 0].tolist() for f in out] == [[10, 20, 30], [10, 20, 40], [50, 0, 0], [10, 0, 60]]
    assert out[2].canvas[0, :, 3].tolist() == [255, 0, 0]


def test_texts_as_media(spark):
    texts = ["", None, "x", "é" * 40, "ab" * 300_000, "x"]
    rows = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {(r["doc_id"]): r for r in gif.as_media(rows, keep_media=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[i if i != 3 else None]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert got[2]["media_sha256"] == got[5]["media_sha256"] and "frames=3" in got[4]["feature"]
    assert gif.as_media(rows.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None), (3, bytearray(SAMPLE))], "id int, media binary")
    frames = gif.decode_frames(bad).collect()
    assert [(r["id"], r["frame"]) for r in frames] == [(1, None), (2, None), (3, 0)] and frames[0]["error"]


def test_warc_ranges_own_each_record_once(tmp_path):
    rng = random.Random(4)
    recs = [warc.record(i, f"http://x/{i}\n ", rng.randbytes(rng.choice([0, 10, 5000, 200_000])) if i % 5 else warc.MAGIC * 50, warc.RESPONSE) for i in range(40)]
    data = b"".join(warc.member(r, i % 3 * 4) for i, r in enumerate(recs))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    assert gzip.decompress(data) == b"".join(recs)
    for step in (700, 9_973, 100_000, len(data)):
        got = [r for s in range(0, len(data), step) for _, r in warc.scan(str(path), s, min(s + step, len(data)), 4096)]
        assert got == recs
    path.write_bytes(data[:-1000])
    assert [r for _, r in warc.scan(str(path), 0, len(data))] == recs[:-1] or len(recs[-1]) < 5000


def test_warc_odd_pages(spark, tmp_path):
    html = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, None), (2, "", ""), (9, "u", "other"), (None, "n", "same"), (5, "http://b", "same")]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as same")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, pages).collect())
    assert got == [(0, "revisit", 5), (1, "revisit", 5), (2, "revisit", 3), (3, "response", None), (5, "response", None), (5, "response", None), (9, "response", None)]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    path = str(tmp_path / "few")
    warc.archive(pages, path, least=1)
    back = warc.parsed(warc.read(spark, path, 50)).collect()
    assert len(back) == 7 and {r["record_type"] for r in back if not r["payload_bytes"]} == {"response"}
    assert all(warc.digest_of(bytes(r["payload"])) == r["payload_digest"] for r in back if r["payload"] is not None)


def test_big_members_end_with_a_zero_byte():
    big = warc.member(b"\0" * (17 << 20))
    assert big[-1] == 0 and len(gzip.decompress(big)) == 17 << 20


def slow_windows(turns, b):
    n = [len([w for w in t.split()]) + b.overhead for _, t in turns]
    sys = 1 if turns[0][0] == "system" else 0
    out, start, old, used = [], 0, [], 0
    for i in range(len(turns)):
        if i and used + n[i] > b.window:
            out.append((old, start, i))
            k = max(k for k in range(b.turns + 1) if k <= max(i - sys, 0) and sum(n[i - k : i]) <= b.history)
            old = ([0] if sys else []) + list(range(i - k, i))
            start, used = i, sum(n[j] for j in old)
        used += n[i]
    return [*out, (old, start, len(turns))]


def test_chat_windows_masks_and_escapes(spark):
    rng = random.Random(6)
    words = ["hello", "### user: ", "</turn>", "\\", "\\h", "\\\\b", "<", "#", "a:b", "\n", "é🙂", " </turn>\n### assistant: "]
    convs = {c: [(["system", "user", "assistant", "tool:x"][rng.randrange(0 if not i else 1, 4)], " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(rng.randrange(1, 14))] for c in range(40)}
    rows = [(c, i, r, x, 0) for c, ts in convs.items() for i, (r, x) in enumerate(ts)]
    rng.shuffle(rows)
    b = chat.Budget(window=30, history=12, turns=2)
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int"), b)
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in chat.read_back(made).collect():
        ts = convs[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == ts
        assert list(r["targets"]) == [x for role, x in ts if role == "assistant"]
        assert [(w["repeated"], w["n_turns"]) for w in r["windows"]] == [(len(o), len(o) + e - s) for o, s, e in slow_windows(ts, b)]


def test_chat_odd_rows(spark):
    rows = [(None, 0, None, None), (None, 0, None, None), (1, 2, "assistant", ""), (1, 2, "assistant", "x " * 3000), (1, None, "user", "q")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", ""), ("", "")]
    assert list(got[1]["targets"]) == ["", "x " * 3000] and [t["role"] for t in got[1]["turns"]] == ["user", "assistant", "assistant"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rabitq_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    turn = rabitq.rotation(64)
    v = rng.normal(size=(400, 64)).astype("<f4")
    v[200:] = v[:200] * 0.9 + rng.normal(size=(200, 64)) * 0.4
    rows = np.zeros(400, rabitq.row_type(64, "<f4", len(turn)))
    rows["key"], rows["v"], rows["norm"] = np.arange(400), v, np.linalg.norm(v.astype(float), axis=1)
    rabitq.encode(v.astype(float), turn, rows)
    a, b = rows[:200], rows[200:]
    value, width = (rabitq.signs(a) * rabitq.levels(b)).sum(1), rabitq.width(a["fit"], b["step"], len(turn))
    true = (a["v"].astype(float) * b["v"]).sum(1) / a["norm"] / b["norm"]
    assert abs((value - true).mean()) < 0.02 and (abs(value - true) <= width).all() and width.mean() < 0.6


def test_rabitq_bounds_lose_no_pair():
    """Recall over many planted pairs just above the threshold: all of them are computed exactly."""
    rng = np.random.default_rng(5)
    turn, n = rabitq.rotation(64), 4000
    a = rng.normal(size=(n, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=(n, 64))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.9001, 0.93, (n, 1))
    rows = np.zeros(2 * n, rabitq.row_type(64, "<f8", len(turn)))
    rows["key"], rows["v"] = np.arange(2 * n), np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * side])
    rows["norm"] = np.linalg.norm(rabitq.scaled(rows["v"]), axis=1)
    rabitq.encode(rabitq.scaled(rows["v"]), turn, rows)
    i, j, exact = rabitq.tile_links(rows[:n], rows[n:], 0.9)
    assert {(k, k) for k in range(n)} <= set(zip(i.tolist(), j.tolist())) and exact < n * n / 50
    own = set(zip(*(x.tolist() for x in rabitq.tile_links(rows, None, 0.9)[:2])))
    assert {(k, n + k) for k in range(n)} <= own and all(x < y for x, y in own)


def test_embedding_sizes_of_components(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 20))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base * 1e200, base * 1e-200, base * 1e-310, -base]))]
    got = {r["vec_id"]: r for r in rabitq.near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(32)] == [(2, i % 8) for i in range(24)] + [(0, i) for i in range(24, 32)]


def test_embedding_tiles_lose_no_link(monkeypatch, spark):
    monkeypatch.setattr(rabitq, "TILE", 9)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 12))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.2, base[:20] * 3])
    got = {r["vec_id"]: r for r in rabitq.near_dups(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    x = v / np.linalg.norm(v, axis=1)[:, None]
    hit = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(hit, comp[None], 10**6).min(1))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(v))] == [(hit[i].sum(), comp[i]) for i in range(len(v))]


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    v = np.concatenate([base, base[:30] + rng.normal(size=(30, 16)) * 0.25, base[:10]]).astype("float32")
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [1.0] * 15 + [None], 1), (104, [1.0] * 3, 1), (None, [float(x) for x in v[0]], 1), (105, [float("inf")] * 16, 1)]
    got = {r["vec_id"]: r for r in rabitq.near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()}
    x = np.concatenate([v, v[:1]]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    comp[-1] = 10**6
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(hit, comp[None], 10**6).min(1))
    for i in range(len(v)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (hit[i].sum(), comp[i], comp[i] == i)
    assert got[None]["component_id"] == comp[-1] and not got[None]["kept"]
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(100, 106))
    assert rabitq.near_dups(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
