"""GIF in pure Python and numpy: LZW code streams, palettes, disposal and transparency, timed frames."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

CLEAR, END, FIRST, FULL = 256, 257, 258, 4096
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3


def _schedule(clear: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the k-th code after a clear code, and the bits before it; the first adds no table entry."""
    entries = np.minimum(clear + 2 + np.maximum(np.arange(n) - 1, 0), FULL - 1)
    widths = np.floor(np.log2(entries)).astype(np.int64) + 1
    return widths, np.concatenate([[0], np.cumsum(widths)])


_SCHEDULES = {2**bits: _schedule(2**bits, FULL + 8) for bits in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples as a GIF code stream; the table starts anew when it is full."""
    codes = [CLEAR]
    if data:
        table: dict[int, int] = {}
        get, add, free, held = table.get, codes.append, FIRST, data[0]
        for b in memoryview(data)[1:]:
            key = held << 8 | b
            code = get(key)
            if code is not None:
                held = code
                continue
            add(held)
            if free < FULL:
                table[key] = free
                free += 1
            else:
                add(CLEAR)
                table.clear()
                free = FIRST
            held = b
        add(held)
    codes.append(END)
    values = np.array(codes, dtype=np.int64)
    widths, _ = _SCHEDULES[CLEAR]
    at = np.arange(len(values))
    clears = np.flatnonzero(values == CLEAR)
    # Every code's place after the last clear code before it; the very first code is read at nine bits.
    place = at - 1 - clears[np.searchsorted(clears, at, side="left") - 1]
    place[0] = 0
    wide = widths[place]
    bits = (values[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12) < wide[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, min_bits: int, n: int) -> bytes:
    """At most n samples of a code stream; a stream that ends early or breaks off gives what came before."""
    clear, end, free0 = 1 << min_bits, (1 << min_bits) + 1, (1 << min_bits) + 2
    widths, before = _SCHEDULES.get(clear) or _schedule(clear, FULL + 8)
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    total, at, out, size = len(stream) * 8, 0, [], 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    k, table, held = 0, roots + [b""] * (FULL - free0), b""
    free = free0
    while size < n:
        if k >= len(widths) - 1:  # a full table that is never cleared stays at twelve bits
            places = at + 12 * np.arange(FULL)
            wide = np.full(FULL, 12)
        else:
            places, wide = at + before[k:-1] - before[k], widths[k:]
        fits = int(np.searchsorted(places + wide, total, side="right"))
        if not fits:
            break
        places, wide = places[:fits], wide[:fits]
        byte = places >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (places & 7)) & ((1 << wide) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else fits
        for code in codes[:stop].tolist():
            if not held:
                if code >= clear:
                    return b"".join(out)[:n]
                held = roots[code]
            else:
                if code < free:
                    entry = table[code]
                elif code == free:
                    entry = held + held[:1]
                else:
                    return b"".join(out)[:n]
                if free < FULL:
                    table[free] = held + entry[:1]
                    free += 1
                held = entry
            out.append(held)
            size += len(held)
        if stop == fits:
            at, k = int(places[-1] + wide[-1]), k + fits
        elif int(codes[stop]) == end:
            break
        else:
            at, k, free, held = int(places[stop] + wide[stop]), 0, free0, b""
    return b"".join(out)[:n]


@dataclass
class Frame:
    samples: bytes
    width: int
    height: int
    left: int = 0
    top: int = 0
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None
    palette: bytes | None = None


@dataclass
class Gif:
    width: int
    height: int
    palette: bytes | None
    background: int = 0
    frames: list[Frame] = field(default_factory=list)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part := data[i : i + 255])]) + part for i in range(0, len(data), 255)) + b"\0"


def encode(gif: Gif) -> bytes:
    """A GIF89a file with 256-colour tables, one graphic control extension a frame."""
    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, 0xF7, gif.background, 0), gif.palette]
    for f in gif.frames:
        packed = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", packed, f.delay_cs, f.transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0x87 if f.palette else 0) + (f.palette or b""))
        out.append(b"\x08" + _blocks(lzw_encode(f.samples)))
    return b"".join(out) + b"\x3b"


def decode(data: bytes) -> Gif:
    """Any GIF87a or GIF89a file. Raises ValueError when it isn't one or when it breaks off inside a header."""
    try:
        return _decode(data)
    except (IndexError, struct.error) as broken:
        raise ValueError("truncated GIF") from broken


def _decode(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if packed & 0x80:
        palette = data[at : at + 3 * (2 << (packed & 7))]
        at += len(palette)
    gif, control = Gif(width, height, palette, background), {}

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                bits, delay, clear = struct.unpack_from("<BHB", body)
                control = {"disposal": bits >> 2 & 7, "delay_cs": delay, "transparent": clear if bits & 1 else None}
        elif data[at] == 0x2C:
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
            at, local = at + 10, None
            if bits & 0x80:
                local = data[at : at + 3 * (2 << (bits & 7))]
                at += len(local)
            stream, after = sub_blocks(at + 1)
            samples = lzw_decode(stream, data[at], w * h)
            if bits & 0x40:
                samples = _deinterlaced(samples, w, h)
            gif.frames.append(Frame(samples, w, h, left, top, palette=local, **control))
            at, control = after, {}
        else:
            raise ValueError("unknown GIF block")
    return gif


def _deinterlaced(samples: bytes, w: int, h: int) -> bytes:
    rows = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
    out = np.empty_like(rows)
    out[order] = rows
    return out.tobytes()


def canvases(gif: Gif):
    """Yield each frame's whole picture as height x width x 4 bytes (RGBA), after disposal of the one before."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == PREVIOUS else None
        table = np.zeros((256, 4), np.uint8)
        colours = np.frombuffer(f.palette or gif.palette or b"", np.uint8).reshape(-1, 3)
        table[: len(colours), :3] = colours
        table[:, 3] = 255
        index = np.frombuffer(f.samples.ljust(f.width * f.height, b"\0"), np.uint8).reshape(f.height, f.width)
        y, x = slice(f.top, min(f.top + f.height, gif.height)), slice(f.left, min(f.left + f.width, gif.width))
        index = index[: max(0, y.stop - y.start), : max(0, x.stop - x.start)]
        drawn = table[index]
        if f.transparent is None:
            canvas[y, x] = drawn
        else:
            seen = index != f.transparent
            canvas[y, x][seen] = drawn[seen]
        yield canvas
        if f.disposal == BACKGROUND:
            canvas[y, x] = 0
        elif f.disposal == PREVIOUS:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by colour, two bits a channel: 64 counts, of opaque pixels only."""
    # A pixel is one 32-bit number here, which spares three strided passes.
    flat = np.ascontiguousarray(canvas).view("<u4").ravel()
    flat = flat[flat >= 0xFF000000]
    return np.bincount((flat >> 2 & 0x30) | (flat >> 12 & 0x0C) | (flat >> 22 & 0x03), minlength=64)
