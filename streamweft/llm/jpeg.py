"""Baseline JPEG in numpy: a lossless coefficient container and a general decoder.

Encoding stores 64 bytes as the 64 quantised coefficients of one 8x8 block,
byte - 128 each, in zigzag order; entropy coding is lossless, so the bytes come
back exactly.  A restart marker after every block makes each block a segment of
its own, which lets the decoder advance all segments in step.

The decoder takes any baseline (SOF0, 8 bit) file: it parses the markers and
Huffman-decodes the scan segment by segment; with a restart interval the
segments of all files of a batch run side by side.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

_BLOCKS = 1 << 13  # blocks that are coded at a time


def _table(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body, and code and length of each symbol, of canonical codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(v == n for v in lengths.values()) for n in range(1, 17)]
    code, size, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    last = 0
    for s in order:
        at <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = at, last
        at += 1
    return bytes(counts) + bytes(order), code, size


_DC = _table({5: 1, 4: 2, 7: 3} | {s: 7 for s in (0, 1, 2, 3, 6, 8, 9, 10, 11)})
_AC = _table({0x05: 1, 0x04: 2, 0x07: 3, 0x06: 4, 0x03: 5} | {s: 12 for s in [0x00, 0xF0, *(r << 4 | z for r in range(16) for z in range(1, 9))] if s not in (3, 4, 5, 6, 7)})


def _sizes(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _code_blocks(coef: np.ndarray, marker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of the blocks in a row, each padded to a byte, stuffed, and followed
    by restart marker ``marker`` (none if negative); and each block's number of bytes."""
    n = len(coef)
    coef = coef.astype(np.int64)
    k = np.arange(64)
    nonzero = coef != 0
    nonzero[:, 0] = True
    last = np.maximum.accumulate(np.where(nonzero, k, 0), 1)
    row, col = np.nonzero(nonzero)
    v = coef[row, col]
    size = _sizes(v)
    run = np.where(col > 0, col - np.where(col > 0, last[row, np.maximum(col - 1, 0)], 0) - 1, 0)
    symbol = np.where(col > 0, (run % 16) << 4 | size, size)
    code = np.where(col > 0, _AC[1][symbol], _DC[1][size])
    bits = np.where(col > 0, _AC[2][symbol], _DC[2][size])
    value, width = code << size | np.where(v < 0, v + (1 << size) - 1, v), bits + size
    order = row * 256 + col * 4 + 3
    long_ = np.repeat(np.flatnonzero(run >= 16), run[run >= 16] // 16)
    end = np.flatnonzero(last[:, 63] < 63)
    if len(long_) or len(end):
        value = np.concatenate([value, np.full(len(long_), _AC[1][0xF0]), np.full(len(end), _AC[1][0])])
        width = np.concatenate([width, np.full(len(long_), _AC[2][0xF0]), np.full(len(end), _AC[2][0])])
        order = np.concatenate([order, row[long_] * 256 + col[long_] * 4, end * 256 + 255])
        row = np.concatenate([row, row[long_], end])
        at = np.argsort(order, kind="stable")
        value, width, row = value[at], width[at], row[at]
    total = np.bincount(row, width, n).astype(np.int64)
    nbytes = (total + 7) // 8
    first = np.cumsum(nbytes) - nbytes
    before = np.cumsum(width) - width
    start = before - (np.cumsum(total) - total)[row] + first[row] * 8
    out = np.ones(int(nbytes.sum()) * 8, np.uint8)
    step = np.arange(int(width.sum())) - np.repeat(before, width)
    out[np.repeat(start, width) + step] = (np.repeat(value, width) >> (np.repeat(width, width) - 1 - step)) & 1
    raw = np.packbits(out)
    full = raw == 255
    owner = np.repeat(np.arange(n), nbytes)
    mark = marker >= 0
    shift = np.cumsum(full) - full + 2 * (np.cumsum(mark) - mark)[owner]
    sizes = nbytes + np.bincount(owner[full], minlength=n) + 2 * mark
    done = np.zeros(int(sizes.sum()), np.uint8)
    done[np.arange(len(raw)) + shift] = raw
    ends = np.cumsum(sizes)[mark]
    done[ends - 2] = 0xFF
    done[ends - 1] = 0xD0 + marker[mark]
    return done, sizes


def shape_of(blocks: int) -> tuple[int, int]:
    """Blocks in a row and rows: near a square, and no side above 65,528 pixels."""
    wide = min(8191, max(1, int(np.ceil(np.sqrt(blocks)))))
    high = -(-blocks // wide)
    if high > 8191:
        raise ValueError("too large for one baseline image")
    return wide, high


def _head(wide: int, high: int, n: int) -> bytes:
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    return b"".join([
        b"\xff\xd8", seg(0xFE, struct.pack(">Q", n)), seg(0xDB, b"\x00" + b"\x08" + b"\x01" * 63),
        seg(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00"),
        seg(0xC4, b"\x00" + _DC[0]), seg(0xC4, b"\x10" + _AC[0]), seg(0xDD, struct.pack(">H", 1)), seg(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def encode_payloads(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """One JPEG for each payload; ``sizes`` are positive multiples of 64 that add up to the payload's."""
    shapes = [shape_of(s // 64) for s in sizes.tolist()]
    blocks = sizes // 64
    area = np.array([w * h for w, h in shapes], np.int64)
    to = np.cumsum(area) - area
    owner = np.repeat(np.arange(len(sizes)), blocks)
    image = np.zeros((int(area.sum()), 64), np.int16)  # what the payload doesn't fill is mid grey
    image[to[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)] = payload.reshape(-1, 64).astype(np.int16) - 128
    inner = np.arange(len(image)) - np.repeat(to, area)
    marker = np.where(inner == np.repeat(area, area) - 1, -1, inner % 8)
    coded, lengths = [], []
    for i in range(0, len(image), _BLOCKS):
        c, n = _code_blocks(image[i : i + _BLOCKS], marker[i : i + _BLOCKS])
        coded.append(c)
        lengths.append(n)
    data = np.concatenate(coded).tobytes()
    ends = np.cumsum(np.concatenate(lengths))
    cut = np.append(0, ends[to + area - 1]).tolist()
    return [_head(w, h, s) + data[cut[i] : cut[i + 1]] + b"\xff\xd9" for i, ((w, h), s) in enumerate(zip(shapes, sizes.tolist(), strict=True))]


@dataclass
class Frame:
    """What the markers say, and where the scan's bytes lie."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, bytes] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    comment: bytes = b""
    scan: list[tuple[int, int]] = field(default_factory=list)  # component id, tables
    start: int = 0
    end: int = 0

    def layout(self) -> list[tuple[int, int, int]]:
        """(component, DC table, AC table) of each block of an MCU."""
        tables = dict(self.scan)
        if len(self.components) == 1:
            c = self.components[0]
            return [(0, tables[c[0]] >> 4, 0x10 | tables[c[0]] & 15)]
        return [(i, tables[c[0]] >> 4, 0x10 | tables[c[0]] & 15) for i, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    def mcus(self) -> tuple[int, int]:
        h, v = (1, 1) if len(self.components) == 1 else (max(c[1] for c in self.components), max(c[2] for c in self.components))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Frame:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    f, at = Frame(), 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = 128 if body[0] >> 4 else 64
                f.quantisers[body[0] & 15] = body[1 : 1 + wide] if wide == 64 else bytes(min(255, x) for (x,) in struct.iter_unpack(">H", body[1:129]))
                body = body[1 + wide :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                f.tables[body[0]] = body[1:n]
                body = body[n:]
        elif kind == 0xC0:
            _, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= kind <= 0xCF and kind != 0xCC and kind != 0xC8:
            raise ValueError("only baseline files are decoded")
        elif kind == 0xDD:
            f.interval = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            f.comment = body
        elif kind == 0xDA:
            f.scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            if len(f.scan) != len(f.components):
                raise ValueError("only files of one scan are decoded")
            f.start, f.end = at, data.rfind(b"\xff\xd9")
            if f.end < at:
                raise ValueError("no end marker")
            return f


def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol, 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            low = code << (16 - n)
            out[low : low + (1 << (16 - n))] = n << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _run(words: np.ndarray, bit: np.ndarray, blocks: np.ndarray, layout: list, lookup: dict[int, np.ndarray], out: np.ndarray, to: np.ndarray) -> None:
    """Decode segments in step: segment i has ``blocks[i]`` blocks, the first at bit ``bit[i]``;
    they go to rows ``to[i]``... of ``out``, in zigzag order."""
    dc = np.zeros((len(bit), 1 + max(c for c, _, _ in layout)), np.int64)
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        component, d, a = layout[b % len(layout)]
        p, row = bit[live], to[live] + b

        def take(table: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, s = words[p >> 3], p & 7
            hit = table[(w >> (24 - s)) & 0xFFFF]
            n, symbol = hit >> 8, hit & 255
            if not n.all():
                raise ValueError("broken entropy-coded data")
            size = symbol & 15
            v = (w >> (40 - s - n - size)) & ((1 << size) - 1)
            return symbol, np.where((v >> np.maximum(size - 1, 0) == 0) & (size > 0), v - (1 << size) + 1, v), p + n + size

        symbol, v, p = take(lookup[d], p)
        dc[live, component] += v
        out[row, 0] = dc[live, component]
        k = np.zeros(len(live), np.int64)
        active = np.arange(len(live))
        while len(active):
            symbol, v, q = take(lookup[a], p[active])
            p[active] = q
            run, size = symbol >> 4, symbol & 15
            at = k[active] + run + 1
            some = size > 0
            if (at[some] > 63).any():
                raise ValueError("broken entropy-coded data")
            out[row[active[some]], at[some]] = v[some]
            k[active] = at
            more = (some | (symbol == 0xF0)) & (at < 63)
            if not more.all():
                active = active[more]
        bit[live] = p


def decode_batch(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """Each file's frame and its blocks' quantised coefficients in zigzag order, in scan order."""
    frames = [parse(f) for f in files]
    out: list[np.ndarray | None] = [None] * len(files)
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault((tuple(f.layout()), tuple(sorted(f.tables.items()))), []).append(i)
    for (layout, tables), members in groups.items():
        lookup = {k: _LOOKUPS.setdefault(body, _lookup(body)) for k, body in tables}
        per = np.array([np.prod(frames[i].mcus()) for i in members], np.int64)
        step = np.array([frames[i].interval or int(m) for i, m in zip(members, per, strict=True)], np.int64)
        segments = -(-per // step)
        data = np.frombuffer(b"".join(files[i][frames[i].start : frames[i].end] + b"\xff\xd0" for i in members), np.uint8)
        # cut at restart markers (one was put after each file) and drop stuffed zeros
        full = np.flatnonzero(data[:-1] == 0xFF)
        marks = full[(data[full + 1] & 0xF8) == 0xD0]
        if len(marks) != segments.sum():
            raise ValueError("restart markers don't fit the restart interval")
        keep = np.ones(len(data), bool)
        keep[full[data[full + 1] == 0] + 1] = False
        begins = np.append(0, marks[:-1] + 2)
        where = np.cumsum(keep) - keep
        clean = np.append(data[keep], np.zeros(8, np.uint8)).astype(np.int64)
        words = clean[:-4] << 32 | clean[1:-3] << 24 | clean[2:-2] << 16 | clean[3:-1] << 8 | clean[4:]
        nth = np.arange(segments.sum()) - np.repeat(np.cumsum(segments) - segments, segments)
        left = np.repeat(per, segments) - nth * np.repeat(step, segments)
        blocks = np.minimum(left, np.repeat(step, segments)) * len(layout)
        coef = np.zeros((int(blocks.sum()), 64), np.int16)
        _run(words, where[begins] * 8, blocks, list(layout), lookup, coef, np.cumsum(blocks) - blocks)
        ends = np.cumsum(per * len(layout))
        for i, a, b in zip(members, (ends - per * len(layout)).tolist(), ends.tolist(), strict=True):
            out[i] = coef[a:b]
    return list(zip(frames, out, strict=True))


def thumbnail(frame: Frame, coef: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size, from the DC coefficients alone."""
    wide, high = frame.mcus()
    component = frame.components[0]
    layout = frame.layout()
    h, v = (1, 1) if len(frame.components) == 1 else component[1:3]
    own = [i for i, (c, _, _) in enumerate(layout) if c == 0]
    dc = coef[:, 0].reshape(high, wide, len(layout))[:, :, own].reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    pixels = np.clip(np.rint(dc.astype(float) * frame.quantisers[component[3]][0] / 8 + 128), 0, 255).astype(np.uint8)
    return pixels[: -(-frame.height // 8), : -(-frame.width // 8)]


def thumbnail_hash(pixels: np.ndarray) -> str:
    """Difference hash: 64 bits say whether each cell of an 8x9 grid of means is darker than the next."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = pixels.astype(float).cumsum(0).cumsum(1)
    y = np.arange(9) * h / 8
    x = np.arange(10) * w / 9
    top, bottom = np.floor(y[:-1]).astype(int), np.maximum(np.ceil(y[1:]), np.floor(y[:-1]) + 1).astype(int)
    left, right = np.floor(x[:-1]).astype(int), np.maximum(np.ceil(x[1:]), np.floor(x[:-1]) + 1).astype(int)
    bottom, right = np.minimum(bottom, h), np.minimum(right, w)
    mean = (total[bottom][:, right] - total[top][:, right] - total[bottom][:, left] + total[top][:, left]) / np.outer(bottom - top, right - left)
    return np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes().hex()
