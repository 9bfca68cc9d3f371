"""PNG in and out: 8-bit grey, grey with alpha, RGB and RGBA, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray, dpi: float | None = None) -> bytes:
    """(height, width) grey or (height, width, 3 or 4) bytes, alpha not premultiplied."""
    height, width = pixels.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    rows = np.zeros((height, 1 + pixels[0].size), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)
    parts = [_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))]
    if dpi:
        per_metre = round(dpi / 0.0254)
        parts.append(_chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)))
    return b"".join([*parts, _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)), _chunk(b"IEND", b"")])


def size(data: bytes) -> tuple[int, int]:
    """Width and height, from the header alone."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    return struct.unpack(">II", data[16:24])


def decode(data: bytes) -> np.ndarray:
    width, height = size(data)
    depth, kind, _, _, interlaced = struct.unpack(">BBBBB", data[24:29])
    if depth != 8 or interlaced or kind not in _CHANNELS:
        raise ValueError("only 8-bit PNGs without interlacing and palette are read")
    at, packed = 8, []
    while at < len(data):
        (length,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + length])
        at += 12 + length
    n = _CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.int64)
    above = np.zeros(width * n, np.int64)
    for y in range(height):
        line, how = raw[y, 1:].astype(np.int64), raw[y, 0]
        if how == 2:
            line = line + above & 255
        elif how == 1:
            line = line.reshape(width, n).cumsum(axis=0).reshape(-1) & 255
        elif how in (3, 4):
            line = line.copy()
            for x in range(width * n):
                left = line[x - n] if x >= n else 0
                up, corner = above[x], above[x - n] if x >= n else 0
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = line[x] + guess & 255
        out[y] = above = line
    pixels = out.astype(np.uint8).reshape(height, width, n)
    return pixels[:, :, 0] if n == 1 else pixels


def premultiplied(pixels: np.ndarray) -> np.ndarray:
    """RGBA bytes with colours times alpha, rounded; grey and RGB become opaque RGBA."""
    if pixels.ndim == 2:
        pixels = np.repeat(pixels[:, :, None], 3, axis=2)
    if pixels.shape[2] == 3:
        pixels = np.dstack([pixels, np.full(pixels.shape[:2], 255, np.uint8)])
    wide = pixels.astype(np.int64)
    wide[:, :, :3] = (wide[:, :, :3] * wide[:, :, 3:] + 127) // 255
    return wide.astype(np.uint8)


def straight(pixels: np.ndarray) -> np.ndarray:
    """The inverse, as near as bytes allow."""
    wide = pixels.astype(np.int64)
    a = np.maximum(wide[:, :, 3:], 1)
    wide[:, :, :3] = np.minimum(255, (wide[:, :, :3] * 255 + a // 2) // a) * (wide[:, :, 3:] > 0)
    return wide.astype(np.uint8)
