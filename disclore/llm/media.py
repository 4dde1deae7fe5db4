"""AVI motion-JPEG as a media column: writing, reading by the RIFF index, intra decoding, shots.

The store is a RIFF/AVI file of one MJPG stream; every frame is a baseline grey JPEG. Its unit is the
quantised DCT coefficient: a payload byte is the eight extra bits of a coefficient of size category 8,
which has exactly 256 values (-255..-128 and 128..255). All quantisers are 1, a block holds 64 bytes, each
block restarts the DC prediction, and the one Huffman code in use has eight bits, so streams of this writer
are read and written by array operations. ``decode_jpeg`` also reads other baseline grey frames, bit by bit.

Decoded frames are reconstructed with an integer inverse DCT whose sums are exact in single precision, so
that equal bytes give equal pixels on any machine. Shots are cut where the histogram difference of
neighbouring frames exceeds a threshold that follows the last differences (their mean and spread).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import _slices, _texts
from .common import small_batches

FPS = 25
BINS = 16
WINDOW = 8
FLOOR = 0.12
SPREAD = 3.0
FRAME_SIDE = 8  # blocks


def _zigzag() -> np.ndarray:
    """Natural index of the k-th coefficient in zigzag order."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in order])


def _basis() -> np.ndarray:
    """Row k: what the k-th zigzag coefficient adds to the 64 pixels, times 2048."""
    t = np.arange(8)
    cos = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) for x in t] for u in t])
    scale = np.where(t == 0, np.sqrt(0.5), 1.0)
    full = 0.25 * np.einsum("u,v,uy,vx->uvyx", scale, scale, cos, cos).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 2048).astype(np.float32)


ZIGZAG = _zigzag()
BASIS = _basis()
_HUFF = bytes(7) + b"\x01" + bytes(8) + b"\x08"  # one code of eight bits, for category 8
_TABLES = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def frame_shape(n_blocks: int) -> tuple[int, int]:
    """Blocks across and down, for a payload of so many blocks."""
    across = min(n_blocks, FRAME_SIDE)
    return across, min(FRAME_SIDE, -(-n_blocks // across))


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def write_avi(payload: bytes) -> bytes:
    """An AVI file that holds ``payload``, a positive multiple of 64 bytes."""
    n_blocks = len(payload) // 64
    if not n_blocks or len(payload) % 64:
        raise ValueError("a positive multiple of 64 bytes is needed")
    across, down = frame_shape(n_blocks)
    per = across * down
    frames = -(-n_blocks // per)
    coded = np.zeros((frames * per, 130), np.uint8)
    coded[:n_blocks, 1:128:2] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    within = np.arange(frames * per) % per
    coded[:, 128] = 0xFF
    coded[:, 129] = np.where(within == per - 1, 0xD9, 0xD0 + within % 8)
    head = b"\xff\xd8" + _TABLES + _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\x01\x11\x00")
    head += _segment(0xC4, b"\x00" + _HUFF) + _segment(0xC4, b"\x10" + _HUFF) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    movi, index, at = [b"movi"], [], 4
    for k in range(frames):
        # a data byte FF is followed by the next code (00) or by a marker (FF): stuff it in both cases
        scan = coded[k * per : (k + 1) * per].tobytes().replace(b"\xff\x00", b"\xff\x00\x00").replace(b"\xff\xff", b"\xff\x00\xff")
        chunk = _chunk(b"00dc", head + scan)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(head) + len(scan)))
        movi.append(chunk)
        at += len(chunk)
    width, height = across * 8, down * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)) + _chunk(b"plen", struct.pack("<Q", len(payload)))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk ends beyond its list")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """fps, payload length if the file tells it, and the frames' (offset, size) by the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"fps": float(FPS), "plen": None, "frames": []}
    movi = None
    todo = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    index = None
    while todo:
        for name, at, size in _chunks(data, *todo.pop(0)):
            if name == b"LIST":
                kind = data[at : at + 4]
                if kind == b"movi":
                    movi = at
                else:
                    todo.append((at + 4, at + size))
            elif name == b"avih":
                out["fps"] = 1e6 / (struct.unpack_from("<I", data, at)[0] or 1_000_000 // FPS)
            elif name == b"plen":
                out["plen"] = struct.unpack_from("<Q", data, at)[0]
            elif name == b"idx1":
                index = (at, size)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    for k in range(index[1] // 16):
        name, _, offset, size = struct.unpack_from("<4sIII", data, index[0] + 16 * k)
        if name[2:] == b"dc":
            base = movi if data[movi + offset : movi + offset + 4] == name else 0  # offsets count from movi, in some files from the start
            out["frames"].append((base + offset + 8, size))
    return out


def decode_jpeg(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(quantised coefficients in zigzag order by block, quantisers, blocks across, blocks down) of a baseline grey JPEG."""
    at, quant, huff, restart = 2, {}, {}, 0
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if data[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("grey frames only")
            table = body[8]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("baseline frames only")
        at += 2 + size
        if marker == 0xDA:
            tables = body[2]
            break
    across, down = -(-width // 8), -(-height // 8)
    scan = data[at:]
    dc, ac = huff[tables >> 4], huff[16 | tables & 15]
    if restart == 1 and dc[0] + dc[1] == _HUFF and ac[0] + ac[1] == _HUFF:
        raw = np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)[: 130 * across * down].reshape(-1, 130)
        bits = raw[:, 1:128:2].astype(np.int16)
        return np.where(bits >= 128, bits, bits - 255), quant[table], across, down
    return _decode_scan(scan, dc, ac, restart, across * down), quant[table], across, down


def _codes(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, count in enumerate(table[0], 1):
        for _ in range(count):
            out[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _decode_scan(scan: bytes, dc, ac, restart: int, n_blocks: int) -> np.ndarray:
    """The general way, bit by bit."""
    parts, at = [], 0
    for k in range(len(scan) - 1):
        if scan[k] == 0xFF and scan[k + 1] != 0:
            parts.append(scan[at:k])
            at = k + 2
            if scan[k + 1] == 0xD9:
                break
    dcs, acs, out, done = _codes(dc), _codes(ac), np.zeros((n_blocks, 64), np.int16), 0
    for part in parts:
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff"))
        pos, before = 0, 0

        def symbol(codes):
            nonlocal pos
            code = 0
            for length in range(1, 17):
                code = code << 1 | (bits[pos + length - 1] == "1")
                if (length, code) in codes:
                    pos += length
                    return codes[length, code]
            raise ValueError("no such Huffman code")

        def value(size):
            nonlocal pos
            if not size:
                return 0
            v = int(bits[pos : pos + size], 2)
            pos += size
            return v if v >> (size - 1) else v - (1 << size) + 1

        for _ in range(restart or n_blocks):
            if done == n_blocks:
                break
            before += value(symbol(dcs))
            out[done, 0] = before
            k = 1
            while k < 64:
                s = symbol(acs)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    out[done, k] = value(s & 15)
                k += 1
            done += 1
    return out


def coefficient_bytes(coefficients: np.ndarray) -> bytes:
    """The payload bytes that coefficients of category 8 stand for."""
    return np.where(coefficients > 0, coefficients, coefficients + 255).astype(np.uint8).tobytes()


def pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """The decoded samples, by block: exact integer sums, rounded and clamped to 0..255."""
    sums = (coefficients * quant).astype(np.float32) @ BASIS
    return np.clip(((sums.astype(np.int32) + 1024) >> 11) + 128, 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges [first, last] between cuts, for one histogram a frame (rows sum to the frame's pixels)."""
    n = len(histograms)
    if not n:
        return []
    d = np.abs(np.diff(histograms, axis=0)).sum(1) / (2 * np.maximum(histograms[1:].sum(1), 1))
    cuts, start = [0], 0
    for t in range(len(d)):
        past = d[max(start, t - WINDOW) : t]
        if d[t] > max(FLOOR, past.mean() + SPREAD * past.std() if len(past) else FLOOR):
            cuts.append(t + 1)
            start = t + 1
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], n])]


def read_avi(data: bytes) -> tuple[bytes, np.ndarray, float]:
    """(payload, one histogram a frame, fps) of a file of ``write_avi``."""
    info = parse_avi(data)
    payload, hist = [], np.zeros((len(info["frames"]), BINS), np.int64)
    for k, (at, size) in enumerate(info["frames"]):
        coefficients, quant, _, _ = decode_jpeg(data[at : at + size])
        payload.append(coefficient_bytes(coefficients))
        hist[k] = np.bincount(pixels(coefficients, quant).ravel() >> 4, minlength=BINS)
    return b"".join(payload)[: info["plen"]], hist, info["fps"]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media (an AVI file of the text's bytes). Null and empty texts: 64 bytes 0. No shuffle."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, 64):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write_avi(padded((t or "").encode("utf-8", "surrogatepass"))) for t in _texts(part.column(1))], pa.binary())], names=["doc_id", "media"])

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of AVI files: doc_id, clip, first_frame, last_frame, start_s, end_s, mean_level.

    A null or unreadable file gives no rows.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    _, hist, fps = read_avi(data) if data else (b"", np.zeros((0, BINS)), FPS)
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
                for k, (a, b) in enumerate(shots(hist)):
                    h = hist[a : b + 1].sum(0)
                    for column, v in zip(out, (i, k, a, b, a / fps, (b + 1) / fps, float((h * (np.arange(BINS) * 16 + 8)).sum() / h.sum()))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k > 3 else pa.int64()) for k, c in enumerate(out)], names=["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "mean_level"])

    return media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].alias("media")).mapInArrow(run, "doc_id bigint, clip bigint, first_frame bigint, last_frame bigint, start_s double, end_s double, mean_level double")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and keep digests and a feature string.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. The feature
    names the first frame of every shot but the first. All are functions of the text alone; null counts as
    empty. Null ids and repeated rows keep their rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                out = [[] for _ in names]
                for i, t in zip(part.column(0).to_pylist(), _texts(part.column(1))):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    media = write_avi(padded(raw))
                    payload, hist, fps = read_avi(media)
                    cut = shots(hist)
                    total = hist.sum(0)
                    feature = f"frames={len(hist)};fps={fps:g};shots={len(cut)};cuts={','.join(str(a) for a, _ in cut[1:])};hist={','.join(map(str, total))}"
                    for column, v in zip(out, (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)):
                        column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
