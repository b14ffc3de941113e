"""Media columns: GIF. LZW code streams, palettes, disposal and transparency rules, timed frames, colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm._shared import col, map_arrow

ROW = 64  # samples a row of a stored payload
ROWS = 4096  # rows a frame at most; a longer payload takes several frames
DELAY = 4  # hundredths of a second a frame
LARGEST = 1 << 26  # samples of a canvas or a frame that are decoded; a header may claim 4 GB
GREY = bytes(v for i in range(256) for v in (i, i, i))


def lzw_encode(data: bytes, bits: int) -> bytes:
    """A GIF code stream, without sub-blocks. Codes grow from bits + 1 to 12 bits; a full table is cleared."""
    clear, first = 1 << bits, (1 << bits) + 2
    codes, widths = [clear], [bits + 1]
    table: dict[int, int] = {}
    size, width, grow = first, bits + 1, 1 << (bits + 1)
    if data:
        it = iter(data)
        w = next(it)
        get = table.get
        for b in it:
            key = w << 8 | b
            n = get(key)
            if n is not None:
                w = n
                continue
            codes.append(w)
            widths.append(width)
            w = b
            if size < 4096:
                table[key] = size
                if size == grow:
                    width += 1
                    grow <<= 1
                size += 1
            else:
                codes.append(clear)
                widths.append(width)
                table.clear()
                size, width, grow = first, bits + 1, 1 << (bits + 1)
        codes.append(w)
        widths.append(width)
        if size == grow and width < 12:  # the reader has added its entry by now
            width += 1
    codes.append(clear + 1)
    widths.append(width)
    return _pack(np.array(codes, np.uint32), np.array(widths, np.int64))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    at = ends - widths
    out = np.zeros((int(ends[-1]) + 7) // 8 + 4, np.uint8)
    word = codes << (at & 7).astype(np.uint32)
    for k in range(3):  # 12 bits and a shift of 7 take three bytes
        np.bitwise_or.at(out, (at >> 3) + k, (word >> (8 * k) & 255).astype(np.uint8))
    return out[: (int(ends[-1]) + 7) // 8].tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """The samples of a code stream, `most` at most. A stream that ends early gives what it holds; an impossible code
    is an error."""
    clear, end = 1 << bits, (1 << bits) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    words = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
    words = words[:-3] | words[1:-2] << 8 | words[2:-1] << 16
    total, at, out, made = len(stream) * 8, 0, [], 0
    # Between two clear codes the widths depend on the number of codes alone: read up to a full table at once, and
    # after that, where the clear code is deferred, the same number of codes of 12 bits at a time.
    n = np.arange(1 << 13)
    width = np.minimum(12, np.maximum(bits + 1, np.ceil(np.log2(np.maximum(clear + 2 + n, 2))).astype(np.int64)))
    width[n + clear + 2 > (1 << 12)] = 12
    full = np.full(len(width), 12)
    growing, deferred = np.concatenate([[0], np.cumsum(width)]), np.concatenate([[0], np.cumsum(full)])
    table, last, offset = roots.copy(), None, growing
    while at + (bits + 1 if offset is growing else 12) <= total and made < most:
        k = int(np.searchsorted(offset, total - at, side="right")) - 1
        pos = at + offset[:k]
        codes = (words[pos >> 3] >> (pos & 7).astype(np.uint32)) & ((1 << (width if offset is growing else full)[:k]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stop[0]) if len(stop) else k
        first, append, emit = len(out), table.append, out.append
        for code in codes[:k].tolist():
            if last is None:
                last = table[code] if code < clear else _bad(code)
            elif code < len(table):
                entry = table[code]
                if len(table) < 4096:
                    append(last + entry[:1])
                last = entry
            elif code == len(table) < 4096:
                last = last + last[:1]
                append(last)
            else:
                _bad(code)
            emit(last)
        made += sum(map(len, out[first:]))
        if not len(stop):
            at += int(offset[k])
            if k < len(width):
                break
            offset = deferred
            continue
        at += int(offset[k + 1])
        if int(codes[k]) == end:
            break
        table, last, offset = roots.copy(), None, growing
    return b"".join(out)[:most]


def _bad(code: int):
    raise ValueError(f"code {code} isn't in the table")


@dataclass
class Frame:
    start: int  # hundredths of a second after the first frame
    delay: int
    indices: np.ndarray  # the frame's own samples (height, width)
    canvas: np.ndarray  # what is seen (height, width, 4)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(c)]) + c for c in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(frames: list[np.ndarray], palette: bytes = GREY, delay: int = DELAY) -> bytes:
    """An animated GIF of equally wide 8-bit index frames; all of them keep the global palette."""
    width, height = frames[0].shape[1], max(f.shape[0] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.ljust(768, b"\0")]
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08" + _blocks(lzw_encode(f.tobytes(), 8)))
    return b"".join([*out, b"\x3b"])


def decode(data: bytes, render: bool = True) -> list[Frame]:
    """The frames of a GIF with their times. Disposal: 0 and 1 leave a frame, 2 clears its area, 3 restores what was
    there before. Transparent samples leave what is below. Interlaced rows are put in order. A frame without a palette
    of its own takes the global one, and grey levels if there is none. A canvas or frame of over LARGEST samples is an
    error. render=False leaves the canvases out."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, globe = 13, None
    if width * height > LARGEST:
        raise ValueError(f"a canvas of {width} x {height}")
    if flags & 0x80:
        globe = data[at : at + 3 * (2 << (flags & 7))]
        at += len(globe)
    frames: list[Frame] = []
    canvas, start = np.zeros((height, width, 4), np.uint8) if render else np.zeros((0, 0, 4), np.uint8), 0
    dispose, delay, clear = 0, 0, None

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    while at < len(data) and data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label, at = data[at], at + 1
            body = sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                dispose, clear = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        if w * h > LARGEST:
            raise ValueError(f"a frame of {w} x {h}")
        own = globe
        if flags & 0x80:
            own = data[at : at + 3 * (2 << (flags & 7))]
            at += len(own)
        bits, at = data[at], at + 1
        samples = lzw_decode(sub_blocks(), bits, w * h)
        px = np.frombuffer(samples.ljust(w * h, bytes([clear or 0])), np.uint8).reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(px)
            straight[rows] = px
            px = straight
        seen = canvas
        if render:
            before = canvas.copy() if dispose == 3 else canvas
            rgb = np.zeros((256, 4), np.uint8)
            table = np.frombuffer(own or GREY, np.uint8).reshape(-1, 3)
            rgb[: len(table), :3], rgb[:, 3] = table, 255
            part = px[: max(0, height - top), : max(0, width - left)]
            shown = slice(top, top + part.shape[0]), slice(left, left + part.shape[1])
            canvas[shown] = np.where((part == clear)[:, :, None] if clear is not None else False, canvas[shown], rgb[part])
            seen = canvas.copy()
            if dispose == 2:
                canvas[shown] = 0
            elif dispose == 3:
                canvas = before
        frames.append(Frame(start, delay, px, seen))
        start += delay
        dispose, delay, clear = 0, 0, None
    return frames


def histogram(frames: list[Frame], bins: int = 4) -> list[int]:
    """Counts of seen colours over all frames, in bins ** 3 cells by red, green and blue; transparent samples don't count."""
    out = np.zeros(bins**3 + 1, np.int64)  # the last cell: transparent
    level = (np.arange(256) * bins // 256).astype(np.int32)
    cells = level * (bins * bins), level * bins, level
    for f in frames:
        at = cells[0][f.canvas[:, :, 0]] + cells[1][f.canvas[:, :, 1]] + cells[2][f.canvas[:, :, 2]]
        out += np.bincount(np.where(f.canvas[:, :, 3] > 0, at, bins**3).ravel(), minlength=bins**3 + 1)
    return out[:-1].tolist()


FRAMES = "frame int, start_cs int, delay_cs int, height int, width int, indices binary, histogram array<long>"


def decode_frames(media: DataFrame, id_col: str = "id", media_col: str = "media", bins: int = 4) -> DataFrame:
    """One row a frame of the GIFs in media_col: id_col and FRAMES; histogram is that of what is seen in the frame.
    Null or broken media have one row whose frame is null, and `error` says why."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    if not data.is_valid:
                        raise ValueError("null")
                    for k, f in enumerate(decode(data.as_py())):
                        rows.append({"id": i, "frame": k, "start_cs": f.start, "delay_cs": f.delay, "height": f.indices.shape[0], "width": f.indices.shape[1], "indices": f.indices.tobytes(), "histogram": histogram([f], bins), "error": None})
                except (ValueError, IndexError, struct.error) as e:
                    rows.append({"id": i, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=to_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    spec = f"id {kind}, {FRAMES}, error string"
    to_schema = to_arrow_schema(media.sparkSession.createDataFrame([], spec).schema)
    return map_arrow(media.select(col(id_col).alias("id"), col(media_col).alias("media")), run, spec)


def store_bytes(payload: bytes) -> bytes:
    """A payload of a multiple of ROW bytes as a GIF of 8-bit samples."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return encode([px[i : i + ROWS] for i in range(0, len(px), ROWS)])


def load_bytes(media: bytes) -> tuple[bytes, list[Frame]]:
    """The stored samples, and the frames as they are seen."""
    frames = decode(media)
    return b"".join(f.indices.tobytes() for f in frames), frames


def _feature(frames: list[Frame], bins: int = 16) -> str:
    """Every frame's time and the histogram of the colours seen in it, `bins` levels of each channel; empty cells are
    left out: start+delay:cell=count,... by frame."""
    rows = []
    for f in frames:
        counts = np.array(histogram([f], bins))
        rows.append(f"{f.start}+{f.delay}:" + ",".join(f"{c:03x}={counts[c]}" for c in np.flatnonzero(counts).tolist()))
    return f"frames={len(frames)};" + ";".join(rows)


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each whole text as a GIF and reads it back.

    The payload is the text's UTF-8 (null: empty) and zero bytes up to a positive multiple of ROW. Returns id_col,
    n_bytes (unpadded), payload_bytes, payload_sha256 and tail_crc32 (last ROW bytes) of what is read back, media_bytes
    and media_sha256 of the GIF, feature (of the rendered frames: times and colour histograms), and with keep_media the GIF
    itself, of which decode_frames makes a row a frame. Equal texts give equal values; rows are
    independent, so null ids and repeated rows are ordinary rows. A text takes memory in proportion to its own length.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode("utf-8", "replace")
                media = store_bytes(raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW)))
                back, frames = load_bytes(media)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), _feature(frames), *[media] * keep_media))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_media]
    spec = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    names = [x.strip().split(" ")[0] for x in spec.split(", ")]
    out = map_arrow(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), run, spec)
    return out.withColumnRenamed("id", id_col)
