"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

``gif_frames`` decodes a binary column into one row a frame. A frame is what a viewer shows:
the canvas after the new image is drawn over what the previous frame's disposal left.

``store_texts`` keeps a text losslessly as an animated grey GIF: UTF-8 padded with bytes 0 to
a positive multiple of 64, 64 samples a row, at most ``ROWS`` rows a frame, so memory is
bounded by a frame and not by the text. Each frame is an LZW stream with codes that grow from
nine to twelve bits. Every frame is disposed of by clearing, and where a text has no byte 255
(no UTF-8 has), bytes 0 are stored as the transparent index 255: they show the cleared canvas.
``describe`` reads the stored bytes back through the same decoder.

Edge cases: a null or empty text is stored as 64 bytes 0; a null or broken GIF (no signature,
a truncated or impossible code stream, a code size outside 1 to 8, a canvas or image of more
than ``MAX_PIXELS``, which is a parameter) gives its frames before the fault and then one row with
``error`` set and no picture; an empty table gives an empty result; equal texts give
equal values; other columns are ignored by ``store_texts`` and kept out of ``gif_frames``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

WIDTH, ROWS, DELAY = 64, 1024, 10
#: A canvas of this many pixels takes 64 MB.
MAX_PIXELS = 1 << 24
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
BINS = 256
#: Fixed values of the format: codes have at most twelve bits; how a frame is disposed of.
LONGEST, CLEAR_FRAME, RESTORE_FRAME = 12, 2, 3


def _widths(first: int, last: int, min_size: int) -> np.ndarray:
    """Bits of the codes number ``first`` to ``last - 1`` after a clear code: one entry joins the table a code."""
    entries = np.arange(first, last) + (1 << min_size) + 1
    bits = np.frexp(entries.astype(float))[1]
    return np.clip(bits, min_size + 1, LONGEST).astype(np.int64)


def lzw_codes(samples: bytes) -> np.ndarray:
    """Codes of eight-bit samples; a clear code follows once the table is full."""
    # Codes are held eight bits up, so that a sample joins one by a single operation.
    table: dict[int, int] = {}
    first, full = 258 << 8, 1 << LONGEST + 8
    free, prefix = first, samples[0] << 8
    codes = [256 << 8]
    put = codes.append
    for sample in samples[1:]:
        key = prefix | sample
        if key in table:
            prefix = table[key]
            continue
        put(prefix)
        if free < full:
            table[key] = free
            free += 256
        else:
            put(256 << 8)
            table.clear()
            free = first
        prefix = sample << 8
    put(prefix)
    put(257 << 8)
    return np.array(codes, np.int64) >> 8


def lzw_encode(samples: bytes) -> bytes:
    """A code stream that any decoder reads: growing codes, lowest bit first."""
    codes = lzw_codes(samples)
    clears = np.flatnonzero(codes == 256)
    width = np.full(len(codes), 9)
    for start, stop in zip(clears + 1, np.append(clears[1:] + 1, len(codes))):
        width[start:stop] = _widths(0, stop - start, 8)
    ends = np.cumsum(width)
    at = ends - width
    shifted = codes << (at & 7)
    size = int(-(-ends[-1] // 8)) + 2
    out = np.zeros(size)
    for byte in range(3):  # the bits of different codes never overlap, so sums are unions
        out += np.bincount((at >> 3) + byte, shifted >> (8 * byte) & 255, minlength=size)
    return out[:-2].astype(np.uint8).tobytes()


class _Section:
    """What the codes since a clear code stand for. Entry ``j`` of the table is the string of code number ``j`` and the sample after it."""

    def __init__(self, clear: int):
        self.clear = clear
        self.seen = self.size = 0
        self.parts: list[np.ndarray] = []
        self.starts = self.lengths = np.zeros(0, np.int64)  # of the strings that can be entries
        self.samples = np.zeros(0, np.uint8)  # those that entries are copied from

    def add(self, codes: np.ndarray, room: int) -> None:
        """Appends the samples of further codes, up to the first that fills ``room``."""
        if (codes > self.clear + 1 + self.seen + np.arange(len(codes))).any():
            raise ValueError("a code before its string")
        entry = codes - (self.clear + 2)
        known = len(self.lengths)
        # A string is a sample longer than the one that its entry began with: lengths add up along the chain of entries.
        length = np.ones(len(codes), np.int64)
        old = (entry >= 0) & (entry < known)
        length[old] += self.lengths[entry[old]]
        above = np.where(entry >= known, entry - known, -1)
        while (inner := np.flatnonzero(above >= 0)).size:
            length[inner], above[inner] = length[inner] + length[above[inner]], above[above[inner]]
        ends = np.cumsum(length)
        kept = int(np.searchsorted(ends, room)) + 1
        entry, length, ends = entry[:kept], length[:kept], ends[:kept]
        before, n = self.size, int(ends[-1])
        starts = before + ends - length
        self.starts = np.append(self.starts, starts)[: 1 << LONGEST]
        self.lengths = np.append(self.lengths, length)[: 1 << LONGEST]
        # Every sample of a string is copied from an earlier one; the copies are followed to where they begin.
        root = entry < 0
        shift = np.where(root, 0, starts - self.starts[np.maximum(entry, 0)])
        source = np.arange(n) - np.repeat(shift, length)
        out = np.zeros(n, np.uint8)
        out[starts[root] - before] = codes[:kept][root]
        past = np.flatnonzero(source < 0)
        out[past] = self.samples[source[past] + before]
        source[past] = past
        while True:
            further = source[source]
            if np.array_equal(further, source):
                break
            source = further
        self.parts.append(out[source])
        if known < 1 << LONGEST:
            self.samples = np.append(self.samples, self.parts[-1])
        self.seen += len(codes)
        self.size += n


def lzw_decode(data: bytes, min_size: int, limit: int) -> np.ndarray:
    """The samples of an LZW code stream, at most ``limit``; a stream that just ends gives what it has."""
    if not 1 <= min_size <= 8:
        raise ValueError("a code size outside 1 to 8")
    clear, stop = 1 << min_size, (1 << min_size) + 1
    padded = np.zeros(len(data) + 4, np.int64)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    section, done, size, bit = _Section(clear), [], 0, 0
    if len(data) > 1 and (padded[0] | padded[1] << 8) & (1 << min_size + 1) - 1 == clear:
        bit = min_size + 1  # a stream begins with a clear code as a rule
    while size + section.size < limit:
        # The places of codes are known up to the next clear code.
        width = _widths(section.seen, section.seen + min(4096, (8 * len(data) - bit) // (min_size + 1)), min_size)
        ends = bit + np.cumsum(width)
        width, ends = width[ends <= 8 * len(data)], ends[ends <= 8 * len(data)]
        if not len(ends):
            break
        start = ends - width
        at = start >> 3
        word = padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16
        codes = word >> (start & 7) & (1 << width) - 1
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(marks[0]) if len(marks) else len(codes)
        if n:
            section.add(codes[:n], limit - size - section.size)
        bit = int(ends[min(n, len(codes) - 1)])
        if n < len(codes):
            if codes[n] == stop:
                break
            done += section.parts
            size += section.size
            section = _Section(clear)
    return np.concatenate([*done, *section.parts, np.zeros(0, np.uint8)])[:limit]


def encode(payload: bytes) -> bytes:
    """A grey GIF of 64 columns whose frames show the payload."""
    rows = len(payload) // WIDTH
    clear = b"\xff" not in payload
    shown = payload.replace(b"\0", b"\xff") if clear else payload
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREY]
    for top in range(0, rows, ROWS):
        part = shown[top * WIDTH : (top + ROWS) * WIDTH]
        stream = lzw_encode(part)
        whole = len(stream) // 255
        blocks = np.full((whole, 256), 255, np.uint8)
        blocks[:, 1:] = np.frombuffer(stream, np.uint8, whole * 255).reshape(whole, 255)
        rest = stream[whole * 255 :]
        parts += [b"\x21\xf9\x04", struct.pack("<BHBB", CLEAR_FRAME << 2 | clear, DELAY, 255 if clear else 0, 0)]
        parts += [b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        parts += [blocks.tobytes(), bytes([len(rest)]) + rest if rest else b"", b"\0"]
    return b"".join(parts) + b"\x3b"


@dataclass
class Frame:
    delay: int
    box: tuple[int, int, int, int]
    samples: np.ndarray  # of the image itself, rows by columns
    pixels: np.ndarray  # of the canvas shown: packed R, G, B, A from the low byte up


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(raw: bytes) -> np.ndarray:
    rgb = np.zeros((256, 4), np.uint8)
    rgb[:, 3] = 255
    rgb[: len(raw) // 3, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return rgb.view("<u4").ravel()


def _deinterlaced(image: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(image), 0
    for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)):
        n = len(range(first, len(image), step))
        out[first::step] = image[at : at + n]
        at += n
    return out


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """Frames in order, one held at a time."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height > max_pixels:
        raise ValueError("a canvas of too many pixels")
    at, shared = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = _palette(data[at : at + size]), at + size
    canvas = np.zeros((height, width), np.uint32)
    delay, disposal, through = 0, 0, -1
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                delay, disposal = struct.unpack("<H", body[1:3])[0], body[0] >> 2 & 7
                through = body[3] if body[0] & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, how = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        if w * h > max_pixels:
            raise ValueError("an image of too many pixels")
        colours = shared
        if how & 0x80:
            size = 3 << ((how & 7) + 1)
            colours, at = _palette(data[at : at + size]), at + size
        if colours is None:
            raise ValueError("no palette")
        stream, after = _sub_blocks(data, at + 1)
        found = lzw_decode(stream, data[at], w * h)
        at = after
        samples = found
        if len(found) < w * h:
            samples = np.zeros(w * h, np.uint8)
            samples[: len(found)] = found
        samples = samples.reshape(h, w)
        if how & 0x40:
            samples = _deinterlaced(samples)
        before = canvas.copy() if disposal == RESTORE_FRAME else None
        region = canvas[top : top + h, left : left + w]
        drawn = samples[: region.shape[0], : region.shape[1]]
        if through >= 0:
            opaque = drawn != through
            region[opaque] = colours[drawn[opaque]]
        else:
            region[:] = colours[drawn]
        yield Frame(delay, (left, top, w, h), samples, canvas)
        if disposal == CLEAR_FRAME:
            region[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, through = 0, 0, -1


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels by the top 3, 3 and 2 bits of red, green and blue."""
    p = pixels.ravel()
    code = (p >> 5 & 7) << 5 | (p >> 13 & 7) << 2 | (p >> 22 & 3)
    shown = (p >> 24) > 0
    return np.bincount(code if shown.all() else code[shown], minlength=BINS)


FRAMES = "id long, frame int, delay_cs int, width int, height int, rgba binary, histogram array<int>, error string"
_FRAMES = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("delay_cs", pa.int32()), ("width", pa.int32()),
    ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int32())), ("error", pa.string())])


def gif_frames(files: DataFrame, key: str = "id", content: str = "content", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row a frame: its time, canvas pixels and colour histogram; a bad file is one row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = -1
                try:
                    for k, f in enumerate(decode(data or b"", max_pixels)):
                        h, w = f.pixels.shape
                        row = {"id": ident, "frame": k, "delay_cs": f.delay, "width": w, "height": h,
                            "rgba": f.pixels.tobytes(), "histogram": histogram(f.pixels).tolist(), "error": None}
                        yield pa.RecordBatch.from_pylist([row], schema=_FRAMES)
                except (ValueError, IndexError, struct.error) as e:
                    row = dict.fromkeys(_FRAMES.names) | {"id": ident, "frame": k + 1,
                        "error": str(e) or type(e).__name__}
                    yield pa.RecordBatch.from_pylist([row], schema=_FRAMES)

    return files.select(files[key].cast("long").alias("id"), files[content].alias("content")).mapInArrow(run, FRAMES)


def read_back(media: bytes) -> tuple[bytes, list[int], np.ndarray]:
    """Payload (red of each frame's own box), frame delays and the histogram over all frames."""
    parts, delays, total = [], [], np.zeros(BINS, np.int64)
    for f in decode(media):
        left, top, w, h = f.box
        shown = f.pixels[top : top + h, left : left + w]
        parts.append((shown & 255).astype(np.uint8).tobytes())
        delays.append(f.delay)
        total += histogram(shown)
    return b"".join(parts), delays, total


def store_text(raw: bytes) -> bytes:
    """The stored form of a text's bytes."""
    return encode(raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.chunks(batches):
        raw, offs = K.text_bytes(batch.column(1))
        media = [store_text(raw[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(media, pa.binary())],
            names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text as a GIF."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


# Fixed columns of the query's result.
DESCRIBED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames int, duration_cs int, histogram array<long>"
)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DESCRIBED.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(),
        pa.list_(pa.int64())]
    for batch in K.chunks(batches, "media"):
        rows = []
        for doc_id, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
            payload, delays, hist = read_back(media)
            feature = f"frames={len(delays)};cs={sum(delays)};" + ",".join(f"{i}:{hist[i]}"
                for i in np.flatnonzero(hist))
            sums = [hashlib.sha256(x).hexdigest() for x in (payload, media)]
            rows.append((doc_id, n, len(payload), sums[0], zlib.crc32(payload[-64:]), len(media), sums[1], feature,
                len(delays), sum(delays), hist))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


def describe(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold when read back: sizes, digests, frame times and the colour histogram."""
    return stored.mapInArrow(_describe, DESCRIBED)


def op3_query(docs: DataFrame) -> DataFrame:
    return describe(store_texts(docs))
