"""8-bit PNG images without interlace: decoding, encoding, and masking of areas."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """Array (height, width, channels); anything else than such an image raises ValueError."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("Could not decode image")
    at, packed, head = 8, b"", None
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" and size == 13 else head
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    if not head or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("Could not decode image")
    width, height, channels = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    except (zlib.error, ValueError):
        raise ValueError("Could not decode image") from None
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, channels)
    return out.reshape(height, width, channels)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    out = bytearray(line.tobytes())
    for i in range(len(out)):
        a, b, c = (out[i - step], int(above[i]), int(above[i - step])) if i >= step else (0, int(above[i]), 0)
        if kind == 3:
            out[i] = (out[i] + (a + b) // 2) & 255
        elif kind == 4:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[i] = (out[i] + (a if p <= q and p <= r else b if q <= r else c)) & 255
        else:
            raise ValueError("Could not decode image")
    return np.frombuffer(bytes(out), np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    color = {v: k for k, v in _CHANNELS.items()}[channels]
    raw = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def masked(data: bytes, boxes: list[tuple[int, int, int, int]]) -> bytes:
    """The image with boxes filled black, both corners included; without boxes the same bytes."""
    pixels = decode(data)
    if not boxes:
        return data
    pixels = pixels.copy()
    opaque = pixels.shape[2] in (2, 4)
    for x1, y1, x2, y2 in boxes:
        area = pixels[max(0, y1) : y2 + 1, max(0, x1) : x2 + 1]
        area[...] = 0
        if opaque:
            area[..., -1] = 255
    return encode(pixels)
