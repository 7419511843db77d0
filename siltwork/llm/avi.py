"""AVI motion-JPEG: write payloads as frames, parse RIFF indexes, decode intra frames, detect shots, list clips.

A payload is stored without loss in the format's own unit, the quantised coefficient: byte ``b`` is coefficient
``b - 128`` of a baseline JPEG whose quantiser is one everywhere, so 576 bytes are the nine 8 x 8 blocks of a 24 x 24
frame and Huffman decoding gives the bytes back exactly. The decoder reads baseline frames of one component or of
several with sampling factors, and turns the first component into pixels for the shot detector. Frames that share
their headers are decoded side by side: a numpy step reads one symbol of every frame.

Shots: 32-bin histograms of pixels; a cut is where the difference to the frame before is over ``0.05`` and over mean
plus three deviations of the up to 12 differences before it. Pixels come from integer arithmetic, so equal texts give
equal features wherever they are computed.

Defined cases: a null text is the empty text (one frame of padding); whole texts of any length are stored, 1,024
frames at a time and read 4,096 at a time; repeated rows give repeated results; damaged media raise ``ValueError``; restart intervals,
progressive frames and frames without Huffman tables are refused by ``ValueError``; an empty table gives an empty
table; extra columns don't reach the result and may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.llm.common import map_texts, slices

UNIT, SIDE, RATE, GROUP = 576, 24, 25, 4096

#: Lengths of our Huffman codes; symbols of AC are run << 4 | size, with the sizes that text bytes need at the front.
DC_LENGTHS = {size: 4 for size in range(12)}
AC_LENGTHS = {0x05: 2, 0x04: 2, 0x07: 3, 0x06: 3, 0x03: 4, 0x08: 5, 0x02: 6, 0x01: 6, 0x00: 6, 0xF0: 12} | {run << 4 | size: 12 for run in range(1, 16) for size in range(1, 9)}


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in the order of storage."""
    places = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * r + c for r, c in places])


def _basis() -> np.ndarray:
    """Inverse transform of a block in storage order, as whole numbers of 1 / 4096; sums of them are exact in doubles."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.round(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()] * 4096)


def canonical(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """(code, length) by symbol, for symbols in order of code length."""
    out, code, before = {}, 0, 0
    for n, s in zip(lengths, symbols):
        code <<= n - before
        out[s] = (code, n)
        code, before = code + 1, n
    return out


def _own_table(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    codes = canonical([lengths[s] for s in symbols], symbols)
    code, size = np.zeros(256, np.uint32), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], size[s] = c, n
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return counts + bytes(symbols), code, size


DC_SEGMENT, DC_CODE, DC_SIZE = _own_table(DC_LENGTHS)
AC_SEGMENT, AC_CODE, AC_SIZE = _own_table(AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    + _segment(0xC4, b"\0" + DC_SEGMENT + b"\x10" + AC_SEGMENT)
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def _magnitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each value and its extra bits."""
    size = np.frexp(np.abs(values).astype(float))[1].astype(np.int64)
    return size, np.where(values < 0, values + (1 << size) - 1, values).astype(np.uint32)


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """A JPEG frame of each row of (n, 576) bytes."""
    blocks = payload.reshape(-1, UNIT // 64, 64).astype(np.int64) - 128
    dc = blocks[:, :, 0]
    dc_size, dc_bits = _magnitude(np.diff(dc, axis=1, prepend=0))
    ac = blocks[:, :, 1:]
    size, bits = _magnitude(ac)
    place = np.arange(1, 64)
    last = np.maximum.accumulate(np.where(ac != 0, place, 0), axis=2)
    before = np.concatenate([np.zeros((*dc.shape, 1), np.int64), last[:, :, :-1]], axis=2)
    zeros = place - before - 1  # since the last coefficient that isn't zero, before this place
    final = last[:, :, -1:]
    symbol = np.where(ac != 0, (zeros % 16) << 4 | size, np.where(place == final + 1, 0, 0xF0))
    sent = (ac != 0) | (place == final + 1) | ((zeros % 16 == 15) & (place < final))
    code = np.concatenate([(DC_CODE[dc_size] << dc_size.astype(np.uint32) | dc_bits)[:, :, None], AC_CODE[symbol] << size.astype(np.uint32) | bits], axis=2)
    length = np.concatenate([(DC_SIZE[dc_size] + dc_size)[:, :, None], np.where(sent, AC_SIZE[symbol] + size, 0)], axis=2)
    length = length.reshape(len(blocks), -1)
    totals = length.sum(1)
    room = -(-totals // 8)
    flat, ends = length.ravel(), np.cumsum(length.ravel())
    down = (np.repeat(ends, flat) - 1 - np.arange(ends[-1])).astype(np.uint32)
    stream = (np.repeat(code.ravel(), flat) >> down & 1).astype(np.uint8)
    padded = np.ones(int(room.sum()) * 8, np.uint8)
    shift = np.cumsum(room * 8) - room * 8 - (np.cumsum(totals) - totals)
    padded[np.arange(len(stream)) + np.repeat(shift, totals)] = stream
    packed = np.packbits(padded).tobytes()
    stops = np.cumsum(room).tolist()
    return [HEADER + packed[a:b].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for a, b in zip([0, *stops], stops)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], side: int = SIDE, rate: int = RATE) -> bytes:
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, side, side, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    picture = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movie = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + head + movie + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    rate: float
    width: int
    height: int
    frames: list[bytes] = field(default_factory=list)


def read_avi(data: bytes) -> Avi:
    """Frames by the file's index, or in the order of the movie list where there is no index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie = index = main = rate = None

    def chunks(at: int, end: int):
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            if at + 8 + size > len(data):
                raise ValueError("a chunk is cut off")
            yield name, at + 8, size
            at += 8 + size + size % 2

    for name, at, size in chunks(12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for name_, at_, size_ in chunks(at + 4, at + size):
                if name_ == b"avih":
                    main = struct.unpack_from("<14I", data, at_)
                elif name_ == b"LIST":
                    for n, a, _ in chunks(at_ + 4, at_ + size_):
                        if n == b"strh" and data[a : a + 4] == b"vids":
                            scale, per = struct.unpack_from("<II", data, a + 20)
                            rate = per / max(scale, 1)
        elif name == b"LIST" and kind == b"movi":
            movie = (at, size)
        elif name == b"idx1":
            index = data[at : at + size]
    if movie is None or main is None:
        raise ValueError("no header or movie list")
    out = Avi(rate or 1e6 / max(main[0], 1), main[8], main[9])
    if index is None:
        out.frames = [data[a : a + s] for n, a, s in chunks(movie[0] + 4, sum(movie)) if n[2:] in (b"dc", b"db")]
        return out
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            at = movie[0] + offset
            if data[at : at + 4] != name:
                at = offset  # some writers count from the file's start
            if data[at : at + 8] != name + struct.pack("<I", size):
                raise ValueError("the index points beside a frame")
            out.frames.append(data[at + 8 : at + 8 + size])
    return out


class Layout:
    """What the headers of a frame say: tables, components and the order of blocks in the scan."""

    def __init__(self, frame: bytes):
        quantisers, tables, at = {}, {}, 2
        self.parts: list[tuple[int, int, int, int]] = []
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            mark, kind, size = struct.unpack_from(">BBH", frame, at)
            body, at = frame[at + 4 : at + 2 + size], at + 2 + size
            if mark != 0xFF:
                raise ValueError("marker expected")
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif kind == 0xC0:
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            elif kind == 0xC4:
                while body:
                    counts = body[1:17]
                    lengths = [n for n, c in enumerate(counts, 1) for _ in range(c)]
                    tables[body[0]] = self._lookup(canonical(lengths, list(body[17 : 17 + len(lengths)])), body[0] < 16)
                    body = body[17 + len(lengths) :]
            elif kind == 0xDA:
                uses = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                break
            elif 0xC1 <= kind <= 0xCF or kind == 0xDD and body != b"\0\0":
                raise ValueError("only baseline frames without restart intervals are read")
        self.size, self.start = at, frame[:at]
        if len(uses) != len(self.parts) or not self.parts:
            raise ValueError("only frames of one scan are read")
        wide, high = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            wide = high = 1
        self.across, down = -(-self.width // (8 * wide)), -(-self.height // (8 * high))
        one = [k for k, p in enumerate(self.parts) for _ in range(p[1] * p[2] if len(self.parts) > 1 else 1)]
        self.owner = np.array(one * (self.across * down))
        self.first = (wide, high) if len(self.parts) == 1 else self.parts[0][1:3]
        self.quantiser = quantisers[self.parts[0][3]]
        try:
            rows = [(tables[uses[p[0]] >> 4], tables[16 + (uses[p[0]] & 15)]) for p in self.parts]
        except KeyError:
            raise ValueError("a Huffman table is missing") from None
        self.lookup = np.stack([t for pair in rows for t in pair])

    @staticmethod
    def _lookup(codes: dict[int, tuple[int, int]], first: bool) -> np.ndarray:
        """What each 16 coming bits say, as value << 16 | places to go << 8 | bits to go; an end of block goes 64 places.

        Where code and extra bits together are longer, bits are 0 and the rest is size << 8 and the code's length;
        -1 where no code fits.
        """
        out = np.full(1 << 16, -1, np.int64)
        for symbol, (code, n) in codes.items():
            run, size = (0, symbol) if first else (symbol >> 4, symbol & 15)
            go = 1 if first else 64 if symbol == 0 else run + 1
            start, end = code << (16 - n), (code + 1) << (16 - n)
            if n + size > 16:
                out[start:end] = (size << 8 | n) << 16 | go << 8
                continue
            extra = (np.arange(start, end) >> (16 - n - size)) & ((1 << size) - 1)
            value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
            out[start:end] = value << 16 | go << 8 | (n + size)
        return out

    def coefficients(self, frames: list[bytes]) -> np.ndarray:
        """(frames, blocks, 64) coefficients in storage order, of frames that start with these headers."""
        scans = []
        for f in frames:
            end = len(f) - 2 if f[-2:] == b"\xff\xd9" else len(f)
            scans.append(f[self.size : end].replace(b"\xff\0", b"\xff"))
        sizes = np.array([len(s) for s in scans], np.int64)
        data = np.frombuffer(b"".join(s + b"\xff" * 8 for s in scans), np.uint8).astype(np.int64)
        window = np.zeros(len(data) - 4, np.int64)  # 40 bits from each byte on
        for k in range(5):
            window = window << 8 | data[k : len(data) - 4 + k]
        blocks = len(self.owner)
        all_places = blocks * 64
        out = np.zeros(len(frames) * all_places, np.int32)
        ends = np.cumsum(sizes + 8)
        bit, limit = (ends - sizes - 8) * 8, (ends - 4) * 8
        base, at = np.arange(len(frames)) * all_places, np.zeros(len(frames), np.int64)  # at: block * 64 + coefficient
        flat = self.lookup.ravel()
        table = ((np.arange(all_places) & 63 > 0) + 2 * np.repeat(self.owner, 64)) << 16
        following = (np.arange(all_places) | 63) + 1
        while len(at):
            word, low = window[bit >> 3], bit & 7
            entry = flat[(word >> (24 - low) & 0xFFFF) + table[at]]
            go, n, value = entry >> 8 & 255, entry & 255, entry >> 16
            if not n.all():
                long = np.flatnonzero(n == 0)
                size, code = value[long] >> 8, value[long] & 255
                extra = word[long] >> (40 - low[long] - code - size) & ((1 << size) - 1)
                value[long] = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
                n[long] = code + size
            bit += n
            to = np.minimum(at + go, following[at])
            out[base + to - 1] = value  # zeros of runs and ends of blocks fall on places that are zero
            at = to
            if at.max() == all_places or (bit > limit).any():
                if (bit > limit).any():
                    raise ValueError("damaged scan")
                going = at < all_places
                bit, limit, base, at = bit[going], limit[going], base[going], at[going]
        out = out.reshape(len(frames), blocks, 64)
        for k in range(len(self.parts)):
            own = np.flatnonzero(self.owner == k)
            out[:, own, 0] = np.cumsum(out[:, own, 0], axis=1)
        return out

    def pixels(self, coefficients: np.ndarray) -> np.ndarray:
        """(frames, samples) of the first component, 0 to 255, block by block."""
        own = coefficients[:, self.owner == 0] * self.quantiser
        values = own.reshape(-1, 64).astype(float) @ BASIS
        return np.clip(np.floor((values + 2048) / 4096) + 128, 0, 255).astype(np.uint8).reshape(len(coefficients), -1)


BASIS = _basis()


def decode_frames(frames: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of frames with like headers: (their numbers, coefficients, pixels of the first component)."""
    groups: dict[bytes, tuple[Layout, list[int]]] = {}
    known: Layout | None = None
    for k, f in enumerate(frames):
        if known is None or not f.startswith(known.start):
            known = Layout(f)
            known = groups.setdefault(known.start, (known, []))[0]
        groups[known.start][1].append(k)
    for layout, rows in groups.values():
        for at in range(0, len(rows), GROUP):
            part = rows[at : at + GROUP]
            coefficients = layout.coefficients([frames[k] for k in part])
            yield part, coefficients, layout.pixels(coefficients)


def histograms(pixels: np.ndarray, bins: int = 32) -> np.ndarray:
    rows = np.arange(len(pixels))[:, None] * bins + pixels // (256 // bins)
    return np.bincount(rows.ravel(), minlength=len(pixels) * bins).reshape(-1, bins)


def cuts(counts: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.05) -> tuple[list[int], np.ndarray]:
    """Frames that start a shot, the first included, and the difference of each frame to the one before."""
    if len(counts) < 2:
        return [0] * len(counts), np.zeros(len(counts))
    change = np.append(0.0, np.abs(np.diff(counts, axis=0)).sum(1) / (2 * counts[1:].sum(1)))
    starts = [0]
    for k in range(1, len(change)):
        past = change[max(1, k - window, starts[-1] + 1) : k]
        if change[k] > least and (len(past) == 0 and change[k] > 0.5 or len(past) and change[k] > past.mean() + factor * past.std() + 1e-9):
            starts.append(k)
    return starts, change


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each padded payload; frames of all are encoded together."""
    frames: list[bytes] = []
    joined = b"".join(payloads)
    step = GROUP // 4 * UNIT
    for at in range(0, len(joined), step):
        frames += encode_frames(np.frombuffer(joined[at : at + step], np.uint8).reshape(-1, UNIT))
    out, at = [], 0
    for p in payloads:
        n = len(p) // UNIT
        out.append(write_avi(frames[at : at + n]))
        at += n
    return out


def load(files: list[bytes]) -> list[tuple[bytes, Avi, np.ndarray]]:
    """(payload of our own frames, file, histogram of each frame) of each file."""
    read = [read_avi(f) for f in files]
    frames = [f for a in read for f in a.frames]
    stored: list[bytes] = [b""] * len(frames)
    counts = np.zeros((len(frames), 32), np.int64)
    for rows, coefficients, pixels in decode_frames(frames):
        whole = (coefficients + 128).astype(np.uint8).reshape(len(rows), -1)
        for k, row in zip(rows, whole):
            stored[k] = row.tobytes()
        counts[rows] = histograms(pixels)
    out, at = [], 0
    for a in read:
        n = len(a.frames)
        out.append((b"".join(stored[at : at + n]), a, counts[at : at + n]))
        at += n
    return out


def clips(avi: Avi, counts: np.ndarray) -> list[tuple[int, int, int, float, float, float]]:
    """(clip, first frame, frames, start and end in seconds, difference at its start) of each shot."""
    starts, change = cuts(counts)
    ends = [*starts[1:], len(counts)]
    return [(k, a, b - a, a / avi.rate, b / avi.rate, float(change[a])) for k, (a, b) in enumerate(zip(starts, ends))]


def clip_rows(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """Timed clip rows of a column of AVI files; null media give none."""

    def make():
        def kernel(batch: pa.RecordBatch):
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if data.is_valid:
                    _, avi, counts = load([data.as_py()])[0]
                    yield from ((key, *c) for c in clips(avi, counts))

        return kernel

    kind = media.schema[id_column].dataType.simpleString()
    rows = media.select(F.col(id_column).alias("id"), F.col(media_column).alias("media"))
    return map_texts(rows, f"`{id_column}` {kind}, clip int, first_frame int, n_frames int, start_s double, end_s double, change double", make)


def feature(avi: Avi, counts: np.ndarray) -> str:
    found = clips(avi, counts)
    change = sum(c[5] for c in found)
    return f"frames={len(counts)} clips={len(found)} starts={','.join(str(c[1]) for c in found)} change={change:.6f}"


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_media: bool = True) -> DataFrame:
    """Texts stored as AVI and read back: digests, features, and the file where ``keep_media``."""

    def make():
        def kernel(batch: pa.RecordBatch):
            for part in slices(batch, 1, 2 << 20):
                raw = [(t.as_py() or "").encode() for t in part.column(1)]
                files = store([pad(r) for r in raw])
                for key, r, media, (payload, avi, counts) in zip(part.column(0).to_pylist(), raw, files, load(files)):
                    row = (key, len(r), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(avi, counts))
                    yield row + (media,) if keep_media else row

        return kernel

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return map_texts(rows, schema + (", media binary" if keep_media else ""), make)
