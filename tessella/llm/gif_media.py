"""Media columns: GIF files as binary columns, their frames decoded, composed and timed, with colour-histogram columns.

Decoding follows the file format: blocks are walked, LZW code streams are expanded, local or global palettes applied,
interlaced rows put in order, transparent samples left as they were, and each frame's disposal done before the next.

LZW is expanded without a loop over codes. Between two clear codes the width of the k-th code is known, so all codes of a
width are cut from the bits at once; a code above the literals stands for the output of an earlier code and one sample
more, so lengths come from pointer jumping over codes and samples from pointer jumping over output places.

Writing uses literal codes with a clear code before the width would grow: lossless, valid for any decoder, 9 bits a sample.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

#: Samples in a row of a stored payload, and rows in a frame.
WIDTH, ROWS = 192, 256
#: Hundredths of a second that a stored frame is shown.
DELAY = 4
#: Literals between two clear codes when samples have 8 bits: the next code would need 10 bits.
LITERALS = 254
#: Bins of the colour histogram for each of red, green and blue.
BINS = 4

_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


class Frame(NamedTuple):
    """One shown frame: the composed canvas, where the frame was drawn, and when it is shown."""

    rgb: np.ndarray  # height x width x 3
    box: tuple[int, int, int, int]  # left, top, width, height
    start_ms: int
    delay_ms: int


# ---------------------------------------------------------------- writing


def _literal_stream(samples: np.ndarray) -> bytes:
    """8-bit samples as 9-bit codes: clear, up to LITERALS literals, clear, ..., end; in sub-blocks of up to 255 bytes."""
    n = len(samples)
    groups = -(-n // LITERALS)
    codes = np.zeros(n + groups + 1, np.uint16)
    codes[np.arange(groups) * (LITERALS + 1)] = 256
    spots = np.arange(n)
    codes[spots + spots // LITERALS + 1] = samples
    codes[-1] = 257
    octets = np.zeros((-(-len(codes) // 8), 8), np.uint16)
    octets.ravel()[: len(codes)] = codes
    packed = np.empty((len(octets), 9), np.uint8)
    packed[:, 0] = octets[:, 0] & 255
    for k in range(1, 8):
        packed[:, k] = (octets[:, k - 1] >> (9 - k)) | ((octets[:, k] << k) & 255)
    packed[:, 8] = octets[:, 7] >> 1
    data = packed.tobytes()[: -(-9 * len(codes) // 8)]
    return b"".join(bytes([len(part)]) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF whose frames hold the payload as grey samples; its length is a positive multiple of WIDTH."""
    samples = np.frombuffer(payload, np.uint8)
    rows = len(samples) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, ROWS):
        here = samples[top * WIDTH : (top + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(here) // WIDTH, 0), b"\x08", _literal_stream(here)]
    return b"".join([*out, b"\x3b"])


# ---------------------------------------------------------------- reading


def _cut(bits: np.ndarray, start: int, width: int, count: int) -> np.ndarray:
    """count codes of width bits from bit start on; bits is followed by three zero bytes at least."""
    count = max(0, min(count, ((len(bits) - 3) * 8 - start) // width))
    if width == 9 and start % 8 == 0 and count >= 8:
        octets = bits[start // 8 :][: -(-count // 8) * 9]
        octets = np.append(octets, np.zeros(-len(octets) % 9, np.uint8)).reshape(-1, 9).astype(np.uint16)
        codes = np.empty((len(octets), 8), np.int64)
        for k in range(8):
            codes[:, k] = (octets[:, k] >> k) | ((octets[:, k + 1] << (8 - k)) & 511)
        return codes.ravel()[:count]
    at = start + width * np.arange(count)
    byte = at >> 3
    word = bits[byte].astype(np.int64) | bits[byte + 1].astype(np.int64) << 8 | bits[byte + 2].astype(np.int64) << 16
    return word >> (at & 7) & ((1 << width) - 1)


def _segments(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a stream without clear codes, and for each where its segment (the codes after a clear) begins."""
    clear, stop = 1 << size, (1 << size) + 1
    bits = np.frombuffer(data + b"\0\0\0", np.uint8)
    first_wide = (1 << (size + 1)) - stop  # codes of a segment that have the first width
    codes = _cut(bits, 0, size + 1, 1 << 62)
    ends = np.flatnonzero(codes == stop)
    codes = codes[: ends[0]] if len(ends) else codes
    at = np.flatnonzero(codes == clear)
    edges = np.concatenate([[-1], at, [len(codes)]])
    if len(ends) and np.diff(edges).max() <= first_wide:  # no segment outgrows the first width
        owner = np.cumsum(codes == clear)
        keep = codes != clear
        begins = np.concatenate([[0], at + 1 - np.arange(1, len(at) + 1)])
        return codes[keep], begins[owner[keep]]
    out, begins, place, bit = [], [], 0, 0
    while True:
        got, width, over = [], size + 1, False
        while True:
            room = (first_wide if width == size + 1 else 1 << (width - 1)) if width < 12 else 1 << 62
            codes = _cut(bits, bit, width, min(room, 1 << 16) if width == 12 else room)
            mark = np.flatnonzero((codes == clear) | (codes == stop))
            if len(mark):
                got.append(codes[: mark[0]])
                bit += width * (int(mark[0]) + 1)
                over = codes[mark[0]] == stop
                break
            got.append(codes)
            bit += width * len(codes)
            if not len(codes) or (width == 12 and len(codes) < 1 << 16) or (width < 12 and len(codes) < room):
                over = True  # the stream ends without an end code
                break
            width = min(12, width + 1)
        codes = np.concatenate(got)
        out.append(codes)
        begins.append(np.full(len(codes), place, np.int64))
        place += len(codes)
        if over:
            return np.concatenate(out), np.concatenate(begins)


def expand(data: bytes, size: int) -> np.ndarray:
    """The samples of an LZW code stream whose literals have size bits."""
    codes, begins = _segments(data, size)
    literal = codes < (1 << size)
    if literal.all():
        return codes.astype(np.uint8)
    spots = np.arange(len(codes))
    from_ = np.where(literal, spots, begins + codes - (1 << size) - 2)
    if (from_[~literal] >= spots[~literal]).any() or (from_ < 0).any():
        raise ValueError("a code refers to one that has not come yet")
    length, parent = (~literal).astype(np.int64), from_.copy()
    while (parent != parent[parent]).any():  # each code's distance to its literal, doubling the steps
        length = length + length[parent]
        parent = parent[parent]
    length += 1
    start = np.concatenate([[0], np.cumsum(length)])
    code_of = np.repeat(spots, length)
    source = start[from_[code_of]] + np.arange(start[-1]) - start[code_of]
    source[start[:-1][literal]] = start[:-1][literal]
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return codes[code_of[source]].astype(np.uint8)


def frames(data: bytes) -> Iterator[Frame]:
    """The composed frames of a GIF in order; raises ValueError if it isn't one."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 128:
        shared = np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3)
        at += shared.size
    backdrop = np.zeros(3, np.uint8)
    canvas = np.zeros((high, wide, 3), np.uint8)
    canvas[:] = backdrop
    disposal, delay, clear_sample, now = 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, sample = struct.unpack_from("<BHB", data, at + 3)
                disposal, clear_sample = packed >> 2 & 7, sample if packed & 1 else None
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if flags & 128:
            palette = np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3)
            at += palette.size
        if palette is None:
            raise ValueError("no palette")
        size, at, parts = data[at], at + 1, []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        samples = expand(b"".join(parts), size)[: w * h]
        if len(samples) < w * h:
            raise ValueError("too few samples")
        samples = samples.reshape(h, w)
        if flags & 64:
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            ordered = np.empty_like(samples)
            ordered[rows] = samples
            samples = ordered
        before = canvas.copy() if disposal == 3 else None
        colours = palette[np.minimum(samples, len(palette) - 1)]
        here = canvas[top : top + h, left : left + w]
        shown = colours[: here.shape[0], : here.shape[1]]
        if clear_sample is None:
            here[:] = shown
        else:
            seen = samples[: here.shape[0], : here.shape[1]] != clear_sample
            here[seen] = shown[seen]
        yield Frame(canvas.copy(), (left, top, w, h), now, delay * 10)
        now += delay * 10
        if disposal == 2:
            canvas[top : top + h, left : left + w] = backdrop
        elif disposal == 3:
            canvas = before
        disposal, delay, clear_sample = 0, 0, None


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Samples in each of BINS ** 3 colour bins, red first."""
    levels = rgb.reshape(-1, 3) // (256 // BINS)
    return np.bincount((levels[:, 0].astype(np.int64) * BINS + levels[:, 1]) * BINS + levels[:, 2], minlength=BINS**3)


# ---------------------------------------------------------------- columns

_STORED = "doc_id long, n_bytes long, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, raw in common.steps(batch.column(0), batch.column(1)):
            media = [encode(b + b" " * ((-len(b) % WIDTH) or (0 if b else WIDTH))) for b in raw]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a GIF of grey frames, spaces up to a positive multiple of WIDTH bytes.

    Null texts are empty ones; repeated rows stay; other columns aren't read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, _STORED)


def _frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, media in zip(batch.column(0), batch.column(1), strict=True):
            out: dict[str, list] = {k: [] for k in ("doc_id", "frame", "start_ms", "delay_ms", "width", "height", "rgb", "histogram")}
            for k, f in enumerate(frames(media.as_py()) if media.is_valid else ()):
                for c, v in zip(out, (doc_id.as_py(), k, f.start_ms, f.delay_ms, f.rgb.shape[1], f.rgb.shape[0], f.rgb.tobytes(), histogram(f.rgb).tolist()), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int64()))]))


def decode_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each timed frame of each GIF: (doc_id, frame, start_ms, delay_ms, width, height, rgb, histogram).

    Null media have no frames; a file that isn't a GIF raises ValueError."""
    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(_frame_rows, "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, rgb binary, histogram array<long>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc_id, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = media.as_py()
            bins, parts, count, shown = np.zeros(BINS**3, np.int64), [], 0, 0
            for f in frames(data):
                left, top, w, h = f.box
                drawn = f.rgb[top : top + h, left : left + w]
                parts.append(drawn[:, :, 0].tobytes())
                grey = np.bincount(drawn[:, :, 0].ravel(), minlength=256).reshape(BINS, -1).sum(1)
                bins[np.arange(BINS) * (BINS * BINS + BINS + 1)] += grey  # of grey samples only these bins hold any
                count += 1
                shown += f.delay_ms
            payload = b"".join(parts)
            grey = bins[np.arange(BINS) * (BINS * BINS + BINS + 1)].tolist()
            row = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={count};ms={shown};grey={','.join(map(str, grey))}")
            for c, v in zip(out, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (3, 6, 7) else pa.int64()) for k, c in enumerate(out)], names=names)


def digests(stored: DataFrame) -> DataFrame:
    """What the stored GIFs of store_texts give when read back: lengths, digests and a colour feature, a row for each."""
    return stored.mapInArrow(_read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
