"""Gray PNG codec on zlib and numpy (no image library)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: channels of each colour type
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_gray(img: np.ndarray) -> bytes:
    """A 2-D uint8 array as an 8-bit gray PNG."""
    img = np.ascontiguousarray(img, np.uint8)
    if img.ndim != 2 or not img.size:
        raise ValueError("a gray image has two dimensions and some pixels")
    h, w = img.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), img], axis=1).tobytes()
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    if not kinds.any():
        return rows
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = rows[y]
        if kind == 0:
            cur = line
        elif kind == 1:
            cur = np.add.accumulate(line.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            cur = line + above
        elif kind in (3, 4):
            cur = line.copy()
            a_, c_ = cur.tolist(), above.tolist()
            for x in range(len(a_)):
                left = a_[x - bpp] if x >= bpp else 0
                up = c_[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = c_[x - bpp] if x >= bpp else 0
                    p = left + up - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                a_[x] = (a_[x] + guess) & 255
            cur = np.array(a_, np.uint8)
        else:
            raise ValueError("unknown PNG filter")
        out[y] = above = cur
    return out


def decode_gray(data: bytes) -> np.ndarray:
    """A PNG of 8 bits a channel, not interlaced, as a 2-D uint8 array; colours by the usual luma
    weights, alpha ignored. Anything else is a ValueError."""
    try:
        if data[:8] != _SIGNATURE:
            raise ValueError("not a PNG")
        at, idat, palette, head = 8, b"", None, None
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            if len(body) < n or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
                raise ValueError("damaged PNG")
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                idat += body
            elif kind == b"IEND":
                break
            at += 12 + n
        if head is None or head[2] != 8 or head[6] != 0 or head[3] not in _CHANNELS:
            raise ValueError("PNG form not supported")
        w, h, _, colour = head[:4]
        c = _CHANNELS[colour]
        flat = np.frombuffer(zlib.decompress(idat), np.uint8)
        rows = flat.reshape(h, 1 + w * c)
        px = _unfilter(rows[:, 1:].copy(), rows[:, 0], c).reshape(h, w, c)
    except (struct.error, zlib.error) as e:
        raise ValueError(f"damaged PNG: {e}") from None
    if colour == 3:
        px = palette[px[:, :, 0]]
    if px.shape[2] >= 3:
        rgb = px[:, :, :3].astype(np.uint32)
        return ((rgb[:, :, 0] * 19595 + rgb[:, :, 1] * 38470 + rgb[:, :, 2] * 7471 + 0x8000) >> 16).astype(np.uint8)
    return px[:, :, 0].copy()
