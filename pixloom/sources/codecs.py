"""PNG and BMP in the standard library, and the metadata of JPEG, PNG and WebP files.

Other codecs need native libraries that a cluster may not have: images.read_files leaves JPEG and GIF to Spark's own ``image``
source, and HEIC, AVIF and JPEG XL are refused with code 13.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np

from ..errors import GENERIC, ResampleError

PNG, JPEG, BMP = b"\x89PNG\r\n\x1a\n", b"\xff\xd8", b"BM"
#: Channels by PNG colour type.
_COLORS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_TYPES = {1: 0, 2: 4, 3: 2, 4: 6}


@dataclass(frozen=True)
class Metadata:
    icc: bytes | None = None
    exif: bytes | None = None
    xmp: bytes | None = None
    orientation: int = 1


def sniff(data: bytes) -> str:
    """The format of a file by its first bytes."""
    if data.startswith(PNG):
        return "png"
    if data.startswith(JPEG):
        return "jpeg"
    if data.startswith(BMP):
        return "bmp"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[4:8] == b"ftyp":
        return "avif" if data[8:12] in (b"avif", b"avis") else "heic"
    if data.startswith(b"\xff\x0a") or data[4:8] == b"JXL ":
        return "jxl"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return "gif" if data[:4] == b"GIF8" else "qoi" if data[:4] == b"qoif" else "unknown"


def png_chunks(data: bytes):
    at = len(PNG)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """([height, width, channels], bit depth); palettes become RGB, or RGBA if they have transparency. Interlaced files are refused."""
    body, palette, clear = [], None, b""
    for kind, chunk in png_chunks(data):
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
    if interlace:
        raise ResampleError(GENERIC, "interlaced PNG")
    n, bits = _COLORS[color], depth * _COLORS[color]
    line, step = (width * bits + 7) // 8, max(1, bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, line + 1)
    out = np.zeros((height, line), np.uint8)
    before = np.zeros(line, np.int64)
    for y in range(height):
        before = out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int64), before.astype(np.int64), step)
    if depth == 16:
        px = out.reshape(height, width, n, 2).astype(np.uint16)
        return px[..., 0] << 8 | px[..., 1], 16
    if depth < 8:
        all_bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        px = (all_bits * (1 << np.arange(depth)[::-1])).sum(-1)[:, :width].astype(np.uint8)
        px = px[..., None] if palette is not None else (px * (255 // ((1 << depth) - 1)))[..., None]
    else:
        px = out.reshape(height, width, n)
    if palette is not None:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        full = np.concatenate([palette, alpha[:, None]], 1) if clear else palette
        px = full[px[..., 0]]
    return px, 8


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row.astype(np.uint8)
    if kind == 2:
        return ((row + above) & 255).astype(np.uint8)
    if kind == 1:
        lanes = np.concatenate([row, np.zeros(-len(row) % step, np.int64)]).reshape(-1, step)
        return (np.cumsum(lanes, 0) & 255).astype(np.uint8).reshape(-1)[: len(row)]
    out = row.tolist()
    up = above.tolist()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
            guess = left if a <= b and a <= c else up[i] if b <= c else corner
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def encode_png(px: np.ndarray, depth: int = 8, meta: Metadata = Metadata()) -> bytes:
    """1 to 4 channels of 8 bits, or of up to 16 stored as 16."""
    height, width, n = px.shape
    wide = depth > 8
    rows = px.astype(">u2" if wide else np.uint8).tobytes()
    line = width * n * (2 if wide else 1)
    body = b"".join(b"\0" + rows[y * line : (y + 1) * line] for y in range(height))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16 if wide else 8, _TYPES[n], 0, 0, 0))
    head += chunk(b"iCCP", b"icc\0\0" + zlib.compress(meta.icc)) if meta.icc else b""
    head += chunk(b"eXIf", meta.exif) if meta.exif else b""
    return PNG + head + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def decode_bmp(data: bytes) -> tuple[np.ndarray, int]:
    """Uncompressed files of 24 or 32 bits."""
    start, size = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    width, height, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
    if size < 40 or bits not in (24, 32) or packing not in (0, 3):
        raise ResampleError(GENERIC, f"a BMP of {bits} bits, compression {packing}")
    n, line = bits // 8, (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * n]
    px = rows.reshape(abs(height), width, n)[..., [2, 1, 0, 3][:n]]
    return (px[::-1] if height > 0 else px).copy(), 8


def encode_bmp(px: np.ndarray) -> bytes:
    height, width, n = px.shape
    px = np.repeat(px, 3, 2) if n == 1 else px
    n = px.shape[2]
    line = (width * n + 3) // 4 * 4
    rows = np.zeros((height, line), np.uint8)
    rows[:, : width * n] = px[::-1][..., [2, 1, 0, 3][:n]].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, n * 8, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def decode(data: bytes) -> tuple[np.ndarray, int]:
    kind = sniff(data)
    if kind == "png":
        return decode_png(data)
    if kind == "bmp":
        return decode_bmp(data)
    raise ResampleError(GENERIC, f"no decoder for {kind} files here")


def encode(px: np.ndarray, kind: str, depth: int = 8, meta: Metadata = Metadata()) -> bytes:
    if kind == "png":
        return encode_png(px, depth, meta)
    if kind == "bmp" and depth == 8:
        return encode_bmp(px)
    raise ResampleError(GENERIC, f"no encoder for {kind} files of {depth} bits here")


# ---- metadata ----------------------------------------------------------------------------------------------------

_EXIF, _XMP, _ICC = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"ICC_PROFILE\0"


def _segments(data: bytes):
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield at, data[at + 1], data[at + 4 : at + 2 + size]
        at += 2 + size


def exif_orientation(exif: bytes | None) -> int:
    place = _orientation_place(exif)
    return struct.unpack(place[1] + "H", exif[place[0] : place[0] + 2])[0] if place else 1


def _orientation_place(exif: bytes | None) -> tuple[int, str] | None:
    if not exif or exif[:2] not in (b"II", b"MM"):
        return None
    order = "<" if exif[:2] == b"II" else ">"
    at = struct.unpack(order + "I", exif[4:8])[0]
    if at + 2 > len(exif):
        return None
    for i in range(struct.unpack(order + "H", exif[at : at + 2])[0]):
        entry = at + 2 + 12 * i
        if entry + 12 <= len(exif) and struct.unpack(order + "H", exif[entry : entry + 2])[0] == 0x0112:
            return entry + 8, order
    return None


def upright(exif: bytes | None) -> bytes | None:
    """The same block with orientation 1, for pixels that have been turned."""
    place = _orientation_place(exif)
    return exif if place is None else exif[: place[0]] + struct.pack(place[1] + "H", 1) + exif[place[0] + 2 :]


def extract(data: bytes) -> Metadata:
    """What a file carries beside its pixels; formats other than JPEG, PNG and WebP carry nothing here."""
    kind, found = sniff(data), Metadata()
    if kind == "jpeg":
        profile = {}
        for _, marker, body in _segments(data):
            if marker == 0xE1 and body.startswith(_EXIF):
                found = replace(found, exif=body[len(_EXIF) :])
            elif marker == 0xE1 and body.startswith(_XMP):
                found = replace(found, xmp=body[len(_XMP) :])
            elif marker == 0xE2 and body.startswith(_ICC):
                profile[body[len(_ICC)]] = body[len(_ICC) + 2 :]
        found = replace(found, icc=b"".join(profile[k] for k in sorted(profile)) or None)
    elif kind == "png":
        for name, body in png_chunks(data):
            if name == b"iCCP":
                found = replace(found, icc=zlib.decompress(body.split(b"\0", 1)[1][1:]))
            elif name == b"eXIf":
                found = replace(found, exif=body)
    elif kind == "webp":
        at = 12
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            body = data[at + 8 : at + 8 + size]
            found = replace(found, icc=body) if name == b"ICCP" else replace(found, exif=body) if name == b"EXIF" else found
            at += 8 + size + size % 2
    return replace(found, orientation=exif_orientation(found.exif))


def inject(data: bytes, meta: Metadata) -> bytes:
    """A JPEG or PNG file with ICC profile and EXIF put in as they are; other formats pass through. See ``upright`` for turned pixels."""
    exif, kind = meta.exif, sniff(data)
    if kind == "jpeg":
        parts = []
        if exif:
            parts.append((0xE1, _EXIF + exif))
        pieces = [meta.icc[i : i + 65000] for i in range(0, len(meta.icc), 65000)] if meta.icc else []
        parts += [(0xE2, _ICC + bytes([i + 1, len(pieces)]) + p) for i, p in enumerate(pieces)]
        return data[:2] + b"".join(struct.pack(">BBH", 0xFF, m, len(b) + 2) + b for m, b in parts) + data[2:]
    if kind == "png":
        end = len(PNG) + 25
        put = b""
        for name, body in ((b"iCCP", b"icc\0\0" + zlib.compress(meta.icc) if meta.icc else None), (b"eXIf", exif)):
            if body:
                put += struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        return data[:end] + put + data[end:]
    return data
