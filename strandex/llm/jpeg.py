"""Media columns: baseline JPEG in numpy.

`decode` reads baseline sequential files (8 bits, Huffman, any sampling, restart
intervals): markers are parsed, and the restart intervals of all files of a slice
that share tables and layout are Huffman-decoded in lockstep, one symbol of every
interval at a time. From the DC coefficients of the luminance comes a thumbnail of
one pixel per 8 x 8 block, and from it the hashes; no inverse transform is needed.

`encode_payload` stores bytes losslessly as quantised coefficients, the format's
unit: with quantisation by 1, byte b is the coefficient b - 128 (b < 128) or b - 127,
never 0; each MCU holds 192 bytes in three 8 x 8 blocks of a 4:4:4 image. The
payload's length is in a COM segment; the last row of MCUs is filled with blanks.

Null text counts as empty. Files that are not readable baseline JPEG get a null
feature and the reason in `problem`. Equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

from .flat import U8, map_texts, ranges, spread

UNIT = 192
_TAG = b"payload:"
_EVERY = 2  # MCUs of a restart interval
_RUN = 8192  # MCUs that are encoded at once, a multiple of _EVERY
_ROW = 64  # MCUs side by side at most, where 8191 rows are enough
_SOI, _EOI, _SOS, _DQT, _DHT, _SOF, _DRI, _COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC0, 0xDD, 0xFE


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: list[int]) -> bytes:
    """A Huffman table with one code of each length 1, 2, ... ."""
    return bytes([kind]) + bytes([1] * len(symbols) + [0] * (16 - len(symbols))) + bytes(symbols)


#: Longest magnitudes have the shortest codes, so every AC symbol takes 9 bits and every DC difference 10.
_TABLES = _segment(_DHT, _table(0x00, list(range(9, -1, -1))) + _table(0x10, list(range(8, 0, -1))))
_HEAD = b"\xff\xd8" + _segment(_DQT, b"\x00" + bytes([1] * 64))
_SCAN = _segment(_SOS, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0]))


def _bits(values: list[int], widest: int, total: int) -> np.ndarray:
    out = np.zeros((len(values), total), np.uint8)
    for row, v in zip(out, values, strict=True):
        size = abs(v).bit_length()
        code = [1] * (widest - size) + [0]
        mag = v if v > 0 else v + (1 << size) - 1
        row[:] = code + [(mag >> (size - 1 - i)) & 1 for i in range(size)]
    return out


_AC_BITS = _bits([b - 128 if b < 128 else b - 127 for b in range(256)], 8, 9)
_DC_BITS = _bits(list(range(-256, 257)), 9, 10)


def shape(units: int) -> tuple[int, int]:
    """MCUs side by side and below each other."""
    down = -(-units // max(_ROW, -(-units // 8191)))
    return -(-units // down), down


def encode_payload(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload, whose length is a positive multiple of 192.

    Files are encoded in runs of whole restart intervals, so a long payload needs no more memory than many short ones.
    """
    grid = [shape(len(p) // UNIT) for p in payloads]
    runs = [(i, lo, min(_RUN, a * d - lo)) for i, (a, d) in enumerate(grid) for lo in range(0, a * d, _RUN)]
    scans: list[list[bytes]] = [[] for _ in payloads]
    for lo, hi in ranges([n for _, _, n in runs], _RUN):
        part = runs[lo:hi]
        data = b"".join([payloads[i][at * UNIT : (at + n) * UNIT].ljust(n * UNIT, b" ") for i, at, n in part])
        ends = [at + n == grid[i][0] * grid[i][1] for i, at, n in part]
        for (i, _, _), scan in zip(part, _scans(data, np.array([n for _, _, n in part]), np.array([at // _EVERY for _, at, _ in part]), np.array(ends)), strict=True):
            scans[i].append(scan)
    files = []
    for p, (across, down), scan in zip(payloads, grid, scans, strict=True):
        frame = _segment(_SOF, struct.pack(">BHHB", 8, down * 8, across * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
        note = _segment(_COM, _TAG + str(len(p)).encode())
        files.append(_HEAD + note + frame + _TABLES + _segment(_DRI, struct.pack(">H", _EVERY)) + _SCAN + b"".join(scan) + b"\xff\xd9")
    return files


def _scans(payload: bytes, cells: np.ndarray, before: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Scan data of runs of `cells` MCUs, whose file has `before` intervals before them; a run that ends its file has no marker behind it."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, 3, 64)
    unit = np.arange(len(data)) - np.repeat(np.cumsum(cells) - cells, cells)
    dc = data[:, :, 0].astype(np.int16)
    dc = np.where(dc < 128, dc - 128, dc - 127)
    diff = dc.copy()
    follows = unit % _EVERY != 0
    diff[follows] -= dc[np.flatnonzero(follows) - 1]
    bits = np.empty((len(data), 3, 577), np.uint8)
    bits[:, :, :10] = _DC_BITS[diff + 256]
    bits[:, :, 10:] = _AC_BITS[data[:, :, 1:]].reshape(len(data), 3, 567)
    size = 3 * 577
    full = (size * _EVERY + 7) // 8
    runs = -(-cells // _EVERY)  # intervals of each run
    last = np.cumsum(runs) - 1
    held = np.full(int(runs.sum()), _EVERY, np.int64)
    held[last] = cells - (runs - 1) * _EVERY
    padded = np.ones((len(held), full * 8), np.uint8)
    row = np.repeat(np.arange(len(held)), held)
    col = unit % _EVERY
    for k in range(_EVERY):
        padded[row[col == k], k * size : (k + 1) * size] = bits[col == k].reshape(-1, size)
    packed = np.packbits(padded, axis=1)
    n = (held * size + 7) // 8
    flat = packed[np.arange(full)[None, :] < n[:, None]]
    ff = flat == 0xFF
    mark = np.full(len(held), 2, np.int64)
    mark[last[ends]] = 0
    stuffed = np.cumsum(ff) - ff
    out_at = np.arange(len(flat)) + stuffed + np.repeat(np.cumsum(mark) - mark, n)
    stop = np.cumsum(n)
    end_at = stop + np.append(stuffed, ff.sum())[stop] + np.cumsum(mark)  # after the interval's marker
    out = np.zeros(int(end_at[-1]), np.uint8)
    out[out_at] = flat
    order = np.arange(len(held)) - np.repeat(np.cumsum(runs) - runs - before, runs)
    has = mark > 0
    out[end_at[has] - 2], out[end_at[has] - 1] = 0xFF, 0xD0 + order[has] % 8
    scan, stops = out.tobytes(), [0, *end_at[last].tolist()]
    return [scan[x:y] for x, y in pairwise(stops)]


@lru_cache(maxsize=256)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """length << 8 | symbol for every 16 bits ahead; 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = (length << 8) | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class Header:
    """Markers of one file up to its scan, and where the scan's bytes are."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no SOI marker")
        at, tables, self.quant, self.every, self.note = 2, {}, {}, 0, b""
        frame = None
        while True:
            if data[at : at + 1] != b"\xff":
                raise ValueError("a marker is missing")
            while data[at + 1 : at + 2] == b"\xff":
                at += 1
            if at + 4 > len(data):
                raise ValueError("the file ends within its headers")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == _DQT:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    self.quant[body[0] & 15] = struct.unpack(">64H", body[1 : n + 1]) if wide else tuple(body[1 : n + 1])
                    body = body[n + 1 :]
            elif marker == _DHT:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == _SOF:
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not self.height or not self.width:
                    raise ValueError("not 8 bits deep, or without a size")
                frame = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC0 < marker <= 0xCF and marker not in (_DHT, 0xC8, 0xCC):
                raise ValueError("not a baseline file")
            elif marker == _DRI:
                self.every = struct.unpack(">H", body[:2])[0]
            elif marker == _COM:
                self.note = body
            elif marker == _SOS:
                break
            elif marker == _EOI:
                raise ValueError("no scan")
        if frame is None or body[0] != len(frame):
            raise ValueError("the scan does not hold all components")
        parts = [(frame[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
        if len(parts) == 1:
            parts = [((1, 1, parts[0][0][2]), parts[0][1])]
        self.y_h, self.y_v, y_q = parts[0][0]
        self.h, self.v = max(p[0][0] for p in parts), max(p[0][1] for p in parts)
        #: component, DC table, AC table of the blocks of an MCU
        self.layout = tuple((c, tables[t >> 4], tables[0x10 | (t & 15)]) for c, ((h, v, _), t) in enumerate(parts) for _ in range(h * v))
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.units, self.dc_step, self.scan = self.across * self.down, self.quant[y_q][0], at

    def intervals(self) -> list[int]:
        step = self.every or self.units
        return [min(step, self.units - i) for i in range(0, self.units, step)]


def _scan_bytes(data: bytes, at: int) -> list[bytes]:
    """The restart intervals without stuffed zeros."""
    end = len(data)
    i = at
    parts, lo = [], at
    while (i := data.find(b"\xff", i)) >= 0:
        nxt = data[i + 1] if i + 1 < end else _EOI
        if nxt == 0:
            i += 2
        elif 0xD0 <= nxt <= 0xD7:
            parts.append(data[lo:i])
            lo = i = i + 2
        elif nxt == 0xFF:
            i += 1
        else:
            end = i
            break
    parts.append(data[lo:end])
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def _lockstep(parts: list[bytes], held: np.ndarray, layout) -> np.ndarray:
    """Quantised coefficients in zigzag order, [interval, MCU, block, 64], of intervals with `held` MCUs each."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    buf = np.frombuffer(b"".join([p + b"\xff" * 12 for p in parts]), np.uint8)
    ahead = np.zeros(len(buf) - 7, U8)
    for k in range(8):
        ahead |= buf[k : k + len(ahead)].astype(U8) << U8(56 - 8 * k)
    start = (np.cumsum(size + 12) - size - 12) * 8
    pos, limit = start.copy(), start + size * 8 + 64
    out = np.zeros((len(parts), int(held.max()), len(layout), 64), np.int16)
    flat = out.reshape(-1)
    per = out[0].size
    luts = [(c, _lookup(*dc), _lookup(*ac)) for c, dc, ac in layout]
    pred = np.zeros((max(c for c, _, _ in luts) + 1, len(parts)), np.int64)

    def take(who, lut):
        p = pos[who] if who is not None else pos
        x = ahead[p >> 3] << (p & 7).astype(U8)
        hit = lut[(x >> U8(48)).astype(np.int64)]
        length, rs = hit >> 8, hit & 255
        s = (rs & 15).astype(np.int64)
        mag = ((x << length.astype(U8)) >> U8(1) >> (63 - s).astype(U8)).astype(np.int64)
        value = np.where(mag < (1 << s) >> 1, mag - (1 << s) + 1, mag)
        p = p + length + s
        if (length == 0).any() or (p > (limit[who] if who is not None else limit)).any():
            raise ValueError("broken Huffman data")
        if who is None:
            pos[:] = p
        else:
            pos[who] = p
        return rs, value

    for m in range(int(held.max())):
        live = np.flatnonzero(held > m)
        everyone = len(live) == len(parts)
        for j, (c, dc, ac) in enumerate(luts):
            at = live * per + (m * len(luts) + j) * 64
            rs, value = take(None if everyone else live, dc)
            pred[c, live] += np.where(rs == 0, 0, value)
            flat[at] = pred[c, live]
            k, who = np.ones(len(live), np.int64), live
            same = everyone
            while len(who):
                rs, value = take(None if same else who, ac)
                if rs.all() and not (rs >> 4).any():  # no run and no end: all move on by one
                    flat[at + k] = value
                    k += 1
                    if (k < 64).all():
                        continue
                    go = k < 64
                else:
                    stop, zrl = rs == 0, rs == 0xF0
                    k = k + (rs >> 4)
                    put = ~stop & ~zrl
                    if (k[put | zrl] > 63).any():
                        raise ValueError("a run leaves its block")
                    flat[(at + k)[put]] = value[put]
                    k += 1
                    go = ~stop & (k < 64)
                who, at, k, same = who[go], at[go], k[go], same and bool(go.all())
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: is a cell of the 8 x 9 means brighter than its right neighbour?"""
    rows = np.linspace(0, thumb.shape[0], 9)
    cols = np.linspace(0, thumb.shape[1], 10)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)

    def lower(e, n):  # whole cells of at least one pixel
        lo = np.minimum(np.floor(e[:-1]).astype(int), n - 1)
        return lo, np.maximum(np.ceil(e[1:]).astype(int), lo + 1)

    (r0, r1), (c0, c1) = lower(rows, thumb.shape[0]), lower(cols, thumb.shape[1])
    area = np.outer(r1 - r0, c1 - c0)
    mean = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / area
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


def decode(files: list[bytes]) -> list[dict]:
    """width, height, thumb (uint8 array), coefficients [MCU, block, 64] and header; or problem."""
    out: list[dict] = [{} for _ in files]
    groups: dict = {}
    for i, data in enumerate(files):
        try:
            h = Header(data)
            parts = _scan_bytes(data, h.scan)
            held = h.intervals()
            if len(parts) != len(held):
                raise ValueError("restart intervals are missing")
            out[i]["header"] = h
            groups.setdefault(h.layout, []).append((i, parts, held))
        except (ValueError, KeyError, IndexError, struct.error) as e:
            out[i] = {"problem": str(e) or type(e).__name__}
    for layout, members in groups.items():
        try:
            many = _lockstep([p for _, ps, _ in members for p in ps], np.array([n for _, _, hs in members for n in hs]), layout)
            at = 0
            for i, ps, held in members:
                _finish(out[i], many[at : at + len(ps)], held)
                at += len(ps)
        except ValueError:
            for i, ps, held in members:  # one of them is broken: find out which
                try:
                    _finish(out[i], _lockstep(ps, np.array(held), layout), held)
                except ValueError as e:
                    out[i] = {"problem": str(e)}
    return out


def _finish(row: dict, got: np.ndarray, held: list[int]) -> None:
    h: Header = row["header"]
    keep = np.arange(got.shape[1])[None, :] < np.array(held)[:, None]
    co = got[keep] if not keep.all() else got.reshape(-1, *got.shape[2:])
    n = h.y_h * h.y_v
    dc = co[:, :n, 0].astype(np.int32).reshape(h.down, h.across, h.y_v, h.y_h).transpose(0, 2, 1, 3).reshape(h.down * h.y_v, h.across * h.y_h)
    rows, cols = -(-h.height * h.y_v // (8 * h.v)), -(-h.width * h.y_h // (8 * h.h))
    thumb = np.clip((dc[:rows, :cols] * h.dc_step + 4) // 8 + 128, 0, 255).astype(np.uint8)
    row.update(width=h.width, height=h.height, thumb=thumb, coefficients=co)


def read_payload(row: dict) -> bytes:
    """The bytes that `encode_payload` stored."""
    c = row["coefficients"].reshape(-1)
    note = row["header"].note
    if not note.startswith(_TAG):
        raise ValueError("no payload in this file")
    return np.where(c < 0, c + 128, c + 127).astype(np.uint8).tobytes()[: int(note[len(_TAG) :])]


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each text, padded with blanks to a positive multiple of 192 bytes, as a JPEG column."""

    def run(keys, texts):
        raw = [(t or "").encode() for t in texts]
        return {"key": keys[key], "n_bytes": [len(r) for r in raw], "media": encode_payload([r.ljust(max(UNIT, -(-len(r) // UNIT) * UNIT)) for r in raw])}

    return map_texts(df, [key], text, run, "key long, n_bytes long, media binary").withColumnRenamed("key", key)


def media_features(df: DataFrame, key: str = "doc_id", media: str = "media", carry: str = "n_bytes") -> DataFrame:
    """key, carry, width, height, thumb_sha256, thumb_hash, problem and the digests of the payload read back (null without one)."""
    names = ["width", "height", "thumb_sha256", "thumb_hash", "problem", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def run(keys, files):
        out = {"key": keys[key], "carry": keys[carry]} | {n: [] for n in names}
        for data, row in zip(files, decode([f or b"" for f in files]), strict=True):
            got = dict.fromkeys(names) | {"media_bytes": len(data or b""), "media_sha256": hashlib.sha256(data or b"").hexdigest()}
            if "problem" in row:
                got["problem"] = row["problem"]
            else:
                got |= {"width": row["width"], "height": row["height"], "thumb_sha256": hashlib.sha256(row["thumb"].tobytes()).hexdigest(), "thumb_hash": thumbnail_hash(row["thumb"])}
                if row["header"].note.startswith(_TAG):
                    p = read_payload(row)
                    got |= {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-16:])}
            for n in names:
                out[n].append(got[n])
        return out

    kinds = "width long, height long, thumb_sha256 string, thumb_hash string, problem string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    return map_texts(df, [key, carry], media, run, f"key long, carry long, {kinds}", "binary").withColumnsRenamed({"key": key, "carry": carry})
