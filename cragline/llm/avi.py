"""AVI files with motion-JPEG video: writing, parsing, decoding and shot detection.

A file is RIFF: headers, a ``movi`` list of frames and an ``idx1`` index. Every frame is a JPEG picture of
its own. Lossless pictures (SOF3, one component of 8 bits, predictor 1) keep each sample exactly; baseline
pictures (SOF0) are decoded too, with the standard Huffman tables if a frame brings none.

In the lossless pictures written here a difference of category s has a Huffman code of 9 - s bits, followed
by s bits, so each takes nine bits, and numpy codes all frames of a batch at once. It is an ordinary
table in the file: any decoder of lossless JPEG reads the pictures, and the decoder here reads other tables.

Shots: a cut stands where the histogram difference of two frames is above the mean of the differences
around it by ``DEVIATIONS`` standard deviations, and above ``LEAST``.

Cases: a null payload is an empty one; an empty text is stored as one frame of padding; equal payloads give
equal files; a file without an index is read by walking its ``movi`` list; a frame of no bytes repeats the
one before; a file that isn't AVI, or a frame that can't be decoded, raises ``ValueError``; a file without frames has no clips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

SIDE, RATE = 24, 25
FRAME = SIDE * SIDE
#: Frames on each side that a cut's threshold comes from, its deviations, and the least difference of a cut (0 to 1).
AROUND, DEVIATIONS, LEAST = 8, 2.5, 0.12
BUCKETS = 16

# ---------------------------------------------------------------- lossless pictures


def nine_bits() -> tuple[np.ndarray, np.ndarray]:
    """Code of each difference -255 to 255 (at + 255), and the difference of each of 512 codes."""
    code, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        # codes are 0, 10, 110 and so on for s = 8, 7, 6 and so on; negative values are stored less one
        head = ((1 << (9 - s)) - 2) & ((1 << (9 - s)) - 1)
        code[d + 255] = c = (head << s) | ((d if d > 0 else d + (1 << s) - 1) if s else 0)
        back[c] = d
    return code, back


CODE, BACK = nine_bits()
#: Number of codes of each length, and their values: lengths 1 to 9 stand for categories 8 to 0.
HUFFMAN = (bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1)))


def marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


HEAD = b"\xff\xd8" + marker(0xC4, b"\x00" + HUFFMAN[0] + HUFFMAN[1]) + marker(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + marker(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def differences(frames: np.ndarray) -> np.ndarray:
    """Samples less their prediction: the one to the left, in the first column the one above, 128 at first."""
    x = frames.astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    return d


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """JPEG pictures of a run of samples, a multiple of FRAME."""
    c = CODE[differences(payload.reshape(-1, SIDE, SIDE)) + 255].reshape(-1, 8)
    out = np.empty((len(c), 9), np.uint8)  # eight codes of nine bits in nine bytes
    for k in range(9):
        high = (c[:, k - 1] & ((1 << k) - 1)) << (8 - k) if k else 0
        out[:, k] = high | (c[:, k] >> (k + 1)) if k < 8 else c[:, 7] & 255
    raw, size = out.tobytes(), FRAME * 9 // 8
    return [HEAD + raw[i : i + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(raw), size)]


def decode_own(scans: list[bytes], shape: tuple[int, int]) -> np.ndarray:
    """Samples of pictures with the nine-bit table, all of one shape."""
    n, size = shape[0] * shape[1], (shape[0] * shape[1] * 9 + 7) // 8
    raw = np.frombuffer(b"".join(s.replace(b"\xff\x00", b"\xff")[:size].ljust(size, b"\xff") for s in scans), np.uint8).reshape(len(scans), size)
    if n % 8 == 0:
        b = raw.reshape(-1, 9).astype(np.uint16)
        code = np.empty((len(b), 8), np.uint16)
        for k in range(8):
            code[:, k] = ((b[:, k] << (k + 1)) | (b[:, k + 1] >> (7 - k))) & 511
    else:
        bits = np.unpackbits(raw, axis=1)[:, : n * 9].reshape(-1, 9)
        code = bits @ (1 << np.arange(8, -1, -1))
    d = BACK[code.reshape(len(scans), *shape)]
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], 1)
    return np.cumsum(d, 2).astype(np.uint8)


# ---------------------------------------------------------------- any picture

#: The standard's zigzag order and its Huffman tables for luminance and chrominance, used when a frame has none.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
STANDARD = {
    (0, 0): ("00010501010101010100000000000000", "000102030405060708090a0b"),
    (0, 1): ("00030101010101010101010000000000", "000102030405060708090a0b"),
    (1, 0): ("0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
    (1, 1): ("00020102040403040705040400010277", "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")),
}


def codes(lengths: bytes, values: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> value of a Huffman table."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Bits:
    """Reads a scan bit by bit."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("a picture's data end too early")
        x = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end % 8)
        self.at = end
        return x & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("a picture has an unknown code")

    def signed(self, size: int) -> int:
        x = self.take(size) if size else 0
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


@dataclass
class Picture:
    """The parts of a JPEG picture."""

    kind: int
    height: int
    width: int
    parts: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantisation table
    tables: dict[tuple[int, int], tuple[bytes, bytes]]
    scales: dict[int, list[int]]
    picks: dict[int, tuple[int, int]]  # Huffman tables by part
    restart: int
    predictor: int
    scan: bytes


def parse_picture(data: bytes) -> Picture:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    p, at = Picture(0, 0, 0, [], {}, {}, {}, 0, 0, b""), 2
    try:
        while True:
            kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind in (0xC0, 0xC1, 0xC3):
                _, p.height, p.width, n = struct.unpack_from(">BHHB", body)
                p.kind, p.parts = kind, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    p.tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    p.scales[body[0] & 15] = list(struct.unpack_from(">64H" if wide else ">64B", body, 1))
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xDD:
                p.restart = struct.unpack(">H", body)[0]
            elif kind == 0xDA:
                n = body[0]
                p.picks = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)}
                p.predictor, end = body[1 + 2 * n], data.rfind(b"\xff\xd9")
                p.scan = data[at : end if end >= at else len(data)]
                return p
    except (IndexError, struct.error) as e:
        raise ValueError("a JPEG picture is cut off") from e


def intervals(scan: bytes, restart: int) -> list[bytes]:
    """A scan's data between restart markers, with stuffed bytes taken out."""
    if not restart:
        return [scan.replace(b"\xff\x00", b"\xff")]
    parts, start, i = [], 0, 0
    while (i := scan.find(b"\xff", i)) >= 0:
        if i + 1 < len(scan) and 0xD0 <= scan[i + 1] <= 0xD7:
            parts.append(scan[start:i])
            start = i + 2
        i += 2
    return [x.replace(b"\xff\x00", b"\xff") for x in [*parts, scan[start:]]]


def decode_lossless(p: Picture) -> np.ndarray:
    """Samples of a lossless picture of one component with any table and predictor."""
    if len(p.parts) != 1 or p.restart:
        raise ValueError("lossless pictures need one component and no restarts")
    table, bits = codes(*p.tables[0, p.picks[p.parts[0][0]][0]]), Bits(p.scan.replace(b"\xff\x00", b"\xff"))
    out = np.zeros((p.height, p.width), np.int64)
    guess = [None, lambda a, b, c: a, lambda a, b, c: b, lambda a, b, c: c, lambda a, b, c: a + b - c, lambda a, b, c: a + (b - c) // 2, lambda a, b, c: b + (a - c) // 2, lambda a, b, c: (a + b) // 2][p.predictor]
    for y in range(p.height):
        for x in range(p.width):
            left, up = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0)
            base = 128 if not (x or y) else left if not y else up if not x else guess(left, up, out[y - 1, x - 1])
            out[y, x] = (base + bits.signed(bits.symbol(table))) & 0xFFFF
    return out.astype(np.uint8)


def cosines() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) / 2
    c[:, 0] /= 2**0.5
    return c


def decode_baseline(p: Picture) -> np.ndarray:
    """The luminance of a baseline picture."""
    tables = {k: codes(*p.tables.get(k, tuple(map(bytes.fromhex, v)))) for k, v in STANDARD.items()} | {k: codes(*v) for k, v in p.tables.items()}
    wide, high = max(h for _, h, _, _ in p.parts), max(v for _, _, v, _ in p.parts)
    across, down = -(-p.width // (8 * wide)), -(-p.height // (8 * high))
    if len(p.parts) == 1:
        across, down, units = -(-p.width // 8), -(-p.height // 8), [(p.parts[0], 1, 1)]
    else:
        units = [(x, x[1], x[2]) for x in p.parts]
    h0, v0 = units[0][1:]
    blocks = np.zeros((down * v0, across * h0, 64))
    runs, c = intervals(p.scan, p.restart), cosines()
    step = p.restart or across * down
    for k, run in enumerate(runs):
        bits, last = Bits(run), [0] * len(units)
        for unit in range(k * step, min((k + 1) * step, across * down)):
            for i, (part, h, v) in enumerate(units):
                dc, ac = p.picks[part[0]]
                for j in range(h * v):
                    block = np.zeros(64)
                    last[i] += bits.signed(bits.symbol(tables[0, dc]))
                    block[0], at = last[i], 1
                    while at < 64:
                        s = bits.symbol(tables[1, ac])
                        if s == 0:
                            break
                        at += s >> 4
                        if s & 15 and at < 64:
                            block[ZIGZAG[at]] = bits.signed(s & 15)
                        at += 1
                    if i == 0:
                        blocks[unit // across * v + j // h, unit % across * h + j % h] = block
    scale = np.zeros(64)
    scale[ZIGZAG] = p.scales[p.parts[0][3]]
    pixels = np.einsum("yu,abuv,xv->aybx", c, (blocks * scale).reshape(*blocks.shape[:2], 8, 8), c)
    full = np.clip(np.rint(pixels.reshape(blocks.shape[0] * 8, -1) + 128), 0, 255).astype(np.uint8)
    return full[: p.height, : p.width]


def decode_frame(data: bytes) -> np.ndarray:
    p = parse_picture(data)
    if p.kind == 0xC3:
        return decode_own([p.scan], (p.height, p.width))[0] if is_own(p) else decode_lossless(p)
    if p.kind in (0xC0, 0xC1):
        return decode_baseline(p)
    raise ValueError("only baseline and lossless pictures are decoded")


def is_own(p: Picture) -> bool:
    return p.kind == 0xC3 and len(p.parts) == 1 and p.predictor == 1 and not p.restart and p.tables.get((0, p.picks[p.parts[0][0]][0])) == HUFFMAN


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Pictures in order. Those written by ``encode_frames`` are told by their headers and decoded together."""
    if all(f.startswith(HEAD) for f in frames):
        return list(decode_own([f[len(HEAD) : -2] for f in frames], (SIDE, SIDE))) if frames else []
    out: list[np.ndarray] = []
    for f in frames:
        if not f and not out:
            raise ValueError("the first frame is empty")
        out.append(decode_frame(f) if f else out[-1])
    return out


# ---------------------------------------------------------------- RIFF


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, rate: int = RATE) -> bytes:
    """A file of JPEG frames with one video stream and an index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    bodies, index, at = [b"movi"], [], 4
    for f in frames:
        bodies.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(bodies[-1])
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", head) + chunk(b"LIST", b"".join(bodies)) + chunk(b"idx1", b"".join(index)))


@dataclass
class Video:
    width: int
    height: int
    rate: float  # frames a second
    frames: list[bytes]


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in a stretch; the last may be cut off."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> Video:
    """The first video stream's frames, by the index where there is one, which may count from the file's start or the list's."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    width = height = 0
    rate, stream, seen, movi, index = float(RATE), 0, 0, None, None
    for name, a, b in chunks(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, d in chunks(data, a + 4, b):
                if inner == b"avih":
                    width, height = struct.unpack_from("<2I", data, c + 32)
                elif inner == b"LIST" and data[c : c + 4] == b"strl":
                    for x, e, _ in chunks(data, c + 4, d):
                        if x == b"strh":
                            if data[e : e + 4] == b"vids" and movi is None:
                                scale, per = struct.unpack_from("<2I", data, e + 20)
                                rate, stream, movi = per / scale if scale else rate, seen, ()
                            seen += 1
        elif name == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = data[a:b]
    if not movi:
        return Video(width, height, rate, [])
    own = (b"%02ddc" % stream, b"%02ddb" % stream)
    if index:
        rows = [x for x in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if x[0] in own]
        base = movi[0] if rows and data[movi[0] + rows[0][2] : movi[0] + rows[0][2] + 4] == rows[0][0] else 0
        return Video(width, height, rate, [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in rows])
    return Video(width, height, rate, [data[a:b] for name, a, b in chunks(data, movi[0] + 4, movi[1]) if name in own])


# ---------------------------------------------------------------- shots


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Shares of BUCKETS levels of brightness, a row a frame."""
    if not frames:
        return np.zeros((0, BUCKETS))
    if len({f.shape for f in frames}) == 1:
        x = np.stack(frames).reshape(len(frames), -1)
        flat = (x >> 4).astype(np.int64) + BUCKETS * np.arange(len(x))[:, None]
        return np.bincount(flat.ravel(), minlength=BUCKETS * len(x)).reshape(len(x), BUCKETS) / x.shape[1]
    return np.stack([np.bincount((f >> 4).ravel(), minlength=BUCKETS) / f.size for f in frames])


def cuts(shares: np.ndarray) -> list[tuple[int, float]]:
    """(first frame of a shot, difference) where the histogram jumps against its surroundings."""
    d = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    n = len(d)
    if n == 0 or d.max() < LEAST:
        return []
    # mean and deviation of the differences around each, itself left out
    one, two = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    lo, hi = np.maximum(np.arange(n) - AROUND, 0), np.minimum(np.arange(n) + AROUND + 1, n)
    k = np.maximum(hi - lo - 1, 1)
    mean = (one[hi] - one[lo] - d) / k
    spread = np.sqrt(np.maximum((two[hi] - two[lo] - d * d) / k - mean**2, 0))
    return [(int(i) + 1, float(d[i])) for i in np.flatnonzero((d >= LEAST) & (d > mean + DEVIATIONS * spread + 1e-9))]


def clips(video: Video, pictures: list[np.ndarray], shares: np.ndarray | None = None) -> list[dict]:
    """A row a shot: number, frames, seconds, the difference it begins with, mean brightness."""
    shares = histograms(pictures) if shares is None else shares
    found = cuts(shares)
    starts, n = [0, *(i for i, _ in found)], len(pictures)
    marks = [0.0, *(d for _, d in found)]
    return [{"shot": k, "first_frame": a, "end_frame": b, "start_s": a / video.rate, "end_s": b / video.rate, "difference": m, "brightness": float(np.mean([f.mean() for f in pictures[a:b]]))} for k, (a, b, m) in enumerate(zip(starts, [*starts[1:], n], marks, strict=True)) if n]


# ---------------------------------------------------------------- frames of Spark

CLIP = "shot int, first_frame int, end_frame int, start_s double, end_s double, difference double, brightness double"


def shot_rows(media: DataFrame, data: str = "media") -> DataFrame:
    """A row a shot of each file in column data; null files have none. Clip columns replace those of the same name."""
    added = T._parse_datatype_string(CLIP).fields
    kept = [f for f in media.schema if f.name not in {a.name for a in added} | {data}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, raw in enumerate(pdf[data]):
                if raw is not None:
                    video = parse_avi(bytes(raw))
                    rows = clips(video, decode_frames(video.frames))
                    if rows:
                        yield pd.concat([pdf.iloc[[i] * len(rows)][[f.name for f in kept]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return media.mapInPandas(run, T.StructType([*kept, *added]))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, padded with 255 to whole frames, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b"\xff"), len(raw)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media, an AVI file of the text's bytes as samples."""
    kept = [f for f in docs.schema if f.name not in ("n_bytes", "media")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text, 2_000_000):
                sized = [payload_of(t) for t in texts]
                pictures = encode_frames(np.frombuffer(b"".join(p for p, _ in sized), np.uint8))
                files, at = [], 0
                for p, _ in sized:
                    files.append(write_avi(pictures[at : at + len(p) // FRAME]))
                    at += len(p) // FRAME
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in sized], pa.int64()), pa.array(files, pa.binary())], [*(f.name for f in kept), "n_bytes", "media"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def feature(video: Video, pictures: list[np.ndarray]) -> str:
    """Frames and shots as text: count, size, and start, seconds and difference of each shot."""
    found = cuts(histograms(pictures))
    shots = [(0, 0.0), *found] if pictures else []
    return f"frames={len(pictures)};size={video.width}x{video.height};shots=" + ",".join(f"{i}@{i / video.rate:.2f}s:{d:.4f}" for i, d in shots)


def read_back(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digests of what is read from column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            columns: list[list] = [[] for _ in names[2:]]
            for raw in batch.column(batch.schema.get_field_index("media")).to_pylist():
                video = parse_avi(raw)
                pictures = decode_frames(video.frames)
                payload = b"".join(f.tobytes() for f in pictures)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(video, pictures))
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("n_bytes")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_table(docs: DataFrame) -> DataFrame:
    return read_back(store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "n_bytes", "media"))
