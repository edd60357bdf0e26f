"""Small files in the formats that the readers know, for queries and tests that write tables and read them back."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime

import numpy as np

UNDEFINED = 0xFFFFFFFFFFFFFFFF


def _pad(b: bytes, to: int = 8) -> bytes:
    return b + b"\0" * (-len(b) % to)


def _hdf_type(d: np.dtype) -> bytes:
    if d.kind == "S":
        return struct.pack("<B3sI", 0x13, b"\0\0\0", d.itemsize)
    if d.kind == "f":
        return struct.pack("<B3sI", 0x11, bytes([0x20, 31 if d.itemsize == 4 else 63, 0]), d.itemsize) + struct.pack("<HHBBBBI", 0, 8 * d.itemsize, *((23, 8, 0, 23, 127) if d.itemsize == 4 else (52, 11, 0, 52, 1023)))
    return struct.pack("<B3sIHH", 0x10, bytes([8 if d.kind == "i" else 0, 0, 0]), d.itemsize, 0, 8 * d.itemsize)


def _hdf_space(shape: tuple[int, ...]) -> bytes:
    return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)


def _hdf_message(kind: int, data: bytes) -> bytes:
    data = _pad(data)
    return struct.pack("<HHB3x", kind, len(data), 0) + data


def hdf5(datasets: dict[str, np.ndarray], attributes: dict[str, dict[str, float]] | None = None, chunks: dict[str, tuple[int, ...]] | None = None, deflate: bool = True) -> bytes:
    """An HDF5 file of the earliest version: datasets of the root group, contiguous, or chunked with shuffle and deflate."""
    out = bytearray(96)
    place = lambda data: (out.extend(b"\0" * (-len(out) % 8)), len(out), out.extend(data))[1]
    headers = {}
    for name, values in datasets.items():
        chunk, d = (chunks or {}).get(name), values.dtype
        messages = [_hdf_message(0x01, _hdf_space(values.shape)), _hdf_message(0x03, _hdf_type(d))]
        if chunk:
            entries = []
            for at in np.ndindex(*[-(-s // c) for s, c in zip(values.shape, chunk, strict=True)]):
                low = tuple(a * c for a, c in zip(at, chunk, strict=True))
                full = np.zeros(chunk, d)
                part = values[tuple(slice(a, a + c) for a, c in zip(low, chunk, strict=True))]
                full[tuple(slice(0, s) for s in part.shape)] = part
                data = full.tobytes()
                if deflate:
                    data = zlib.compress(np.frombuffer(data, np.uint8).reshape(-1, d.itemsize).T.tobytes())
                entries.append((low, len(data), place(data)))
            rank, end = len(chunk), (*[-(-s // c) * c for s, c in zip(values.shape, chunk, strict=True)], 0)
            key = lambda low, size: struct.pack(f"<II{rank + 1}Q", size, 0, *low)
            level, width = 0, 8
            while level == 0 or len(entries) > 1:
                above = []
                for k in range(0, len(entries), width):
                    part = entries[k : k + width]
                    last = entries[k + width][0] if k + width < len(entries) else end[:rank]
                    node = b"TREE" + struct.pack("<BBHQQ", 1, level, len(part), UNDEFINED, UNDEFINED)
                    node += b"".join(key((*low, 0), size) + struct.pack("<Q", where) for low, size, where in part) + key((*last, 0), 0)
                    above.append((part[0][0], part[0][1], place(node)))
                entries, level = above, level + 1
            messages.append(_hdf_message(0x08, struct.pack(f"<BBBQ{rank + 1}I", 3, 2, rank + 1, entries[0][2], *chunk, d.itemsize)))
            if deflate:
                messages.append(_hdf_message(0x0B, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", 2, 0, 1, 1, d.itemsize, 0) + struct.pack("<HHHHII", 1, 0, 1, 1, 4, 0)))
        else:
            messages.append(_hdf_message(0x08, struct.pack("<BBQQ", 3, 1, place(values.tobytes()), values.nbytes)))
        for label, value in (attributes or {}).get(name, {}).items():
            v, text = np.array([value], "<f8"), label.encode() + b"\0"
            kind, space = _hdf_type(v.dtype), _hdf_space((1,))
            messages.append(_hdf_message(0x0C, struct.pack("<BBHHH", 1, 0, len(text), len(kind), len(space)) + _pad(text) + _pad(kind) + _pad(space) + v.tobytes()))
        body = b"".join(messages)
        headers[name] = place(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)
    names = sorted(headers)
    heap, offsets = bytearray(8), {}
    for n in names:
        offsets[n] = len(heap)
        heap += _pad(n.encode() + b"\0")
    data = place(bytes(heap))
    heap_at = place(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, data))
    node = place(b"SNOD" + struct.pack("<BBH", 1, 0, len(names)) + b"".join(struct.pack("<QQI4x16x", offsets[n], headers[n], 0) for n in names))
    tree = place(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, node, offsets[names[-1]]))
    group = _hdf_message(0x11, struct.pack("<QQ", tree, heap_at))
    root = place(struct.pack("<BBHII4x", 1, 0, 1, 1, len(group)) + group)
    out[:96] = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, UNDEFINED, len(out), UNDEFINED) + struct.pack("<QQI4xQQ", 0, root, 1, tree, heap_at)
    return bytes(out)


def _signed(x: int, size: int) -> bytes:
    return (abs(x) | (x < 0) << (8 * size - 1)).to_bytes(size, "big")


#: Bits of a number that every reference value keeps, of either edition.
REFERENCE_BITS = 21


def _packed(values: np.ndarray, bits: int, decimal: int) -> tuple[bytes, float, np.ndarray, int]:
    """(data, reference, present, bits): whole numbers above the reference, in units of 10^-decimal.

    The reference is the smallest, or the next below that a message can hold without rounding; bits grow where the range needs more.
    """
    present = ~np.isnan(values)
    scaled = np.round(values[present] * 10**decimal)
    low = float(scaled.min()) if len(scaled) else 0.0
    unit = 1 << max(0, int(abs(low)).bit_length() - REFERENCE_BITS)
    low = float(low // unit * unit)
    flat = (scaled - low).astype(np.uint64)
    bits = max(bits, int(flat.max()).bit_length() if len(flat) else 0)
    on = (flat[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(on.ravel()).tobytes(), low, present, bits


def _ibm(x: float) -> bytes:
    if x == 0:
        return b"\0\0\0\0"
    e = 64
    m = abs(x)
    while m >= 1:
        m, e = m / 16, e + 1
    while m < 1 / 16:
        m, e = m * 16, e - 1
    return ((x < 0) << 31 | e << 24 | int(m * 2**24)).to_bytes(4, "big")


def grib1(values: np.ndarray, parameter: int, time: datetime, lat: float, lon: float, step: float, bits: int = 16, decimal: int = 2) -> bytes:
    """A message of edition 1: rows from the north, columns from the west; NaN by a bitmap."""
    nj, ni = values.shape
    data, low, present, bits = _packed(values.ravel(), bits, decimal)
    gaps = not present.all()
    century, year = (time.year - 1) // 100 + 1, (time.year - 1) % 100 + 1
    pds = bytes([0, 0, 28, 128, 98, 145, 255, 0xC0 if gaps else 0x80, parameter, 1, 0, 0, year, time.month, time.day, time.hour, time.minute, 1, 0, 0, 0, 0, 0, 0, century, 0]) + _signed(decimal, 2)
    m = lambda x: _signed(round(x * 1000), 3)
    gds = bytes([0, 0, 32, 0, 255, 0]) + struct.pack(">HH", ni, nj) + m(lat) + m(lon) + b"\x80" + m(lat - step * (nj - 1)) + m(lon + step * (ni - 1)) + struct.pack(">HH", round(step * 1000), round(step * 1000)) + bytes([0, 0, 0, 0, 0])
    bms = b""
    if gaps:
        bitmap = np.packbits(present).tobytes()
        bitmap += b"\0" * (len(bitmap) % 2)
        bms = (6 + len(bitmap)).to_bytes(3, "big") + bytes([8 * len(bitmap) - present.size, 0, 0]) + bitmap
    data += b"\0" * ((len(data) + 11) % 2)
    bds = (11 + len(data)).to_bytes(3, "big") + b"\0" + _signed(0, 2) + _ibm(low) + bytes([bits]) + data
    body = pds + gds + bms + bds + b"7777"
    return b"GRIB" + (8 + len(body)).to_bytes(3, "big") + b"\x01" + body


def grib2(values: np.ndarray, number: int, height: int, time: datetime, lat: float, lon: float, step: float, bits: int = 12, decimal: int = 2) -> bytes:
    """A message of edition 2 with a wind component (category 2)."""
    nj, ni = values.shape
    data, low, present, bits = _packed(values.ravel(), bits, decimal)
    section = lambda k, b: struct.pack(">IB", len(b) + 5, k) + b
    u = lambda x: _signed(round(x * 1e6), 4)
    s1 = section(1, struct.pack(">HHBBBHBBBBBBB", 98, 0, 5, 0, 1, time.year, time.month, time.day, time.hour, time.minute, time.second, 0, 0))
    s3 = section(3, struct.pack(">BIBBH", 0, ni * nj, 0, 0, 0) + b"\x06" + b"\xff" * 15 + struct.pack(">IIII", ni, nj, 0, 0xFFFFFFFF) + u(lat) + u(lon) + b"\x30" + u(lat - step * (nj - 1)) + u(lon + step * (ni - 1)) + u(step) + u(step) + b"\0")
    s4 = section(4, struct.pack(">HHBBBBBHBBIBBIBBI", 0, 0, 2, number, 0, 0, 0, 0, 0, 1, 0, 103, 0, height, 255, 255, 0xFFFFFFFF))
    s5 = section(5, struct.pack(">IHf", int(present.sum()), 0, low) + _signed(0, 2) + _signed(decimal, 2) + bytes([bits, 0]))
    s6 = section(6, b"\xff" if present.all() else b"\0" + np.packbits(present).tobytes())
    body = s1 + s3 + s4 + s5 + s6 + section(7, data) + b"7777"
    return b"GRIB\0\0\0\x02" + struct.pack(">Q", 16 + len(body)) + body


def tiff(values: np.ndarray, west: float, north: float, step: float, tile: int | None = 16, nodata: float | None = None, compression: int = 1, predictor: int = 1) -> bytes:
    """A GeoTIFF of one band: square tiles (sides in multiples of 16), or strips of four rows."""
    height, width = values.shape
    d = values.dtype.newbyteorder("<")
    th, tw = (tile, tile) if tile else (4, width)
    blocks = []
    for a in range(0, height, th):
        for b in range(0, width, tw):
            part = values[a : a + th, b : b + tw]
            full = np.zeros((th if tile else len(part), tw), d)
            full[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                full = np.diff(full, axis=1, prepend=np.zeros((len(full), 1), d)).astype(d)
            data = full.tobytes()
            if predictor == 3:
                rows = np.frombuffer(full.astype(d.newbyteorder(">")).tobytes(), np.uint8).reshape(len(full), tw, d.itemsize).transpose(0, 2, 1).reshape(len(full), -1)
                data = np.diff(rows, axis=1, prepend=np.zeros((len(full), 1), np.uint8)).astype(np.uint8).tobytes()
            blocks.append(zlib.compress(data) if compression == 8 else data)
    out = bytearray(8)
    offsets = []
    for b in blocks:
        offsets.append(len(out))
        out += b
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    tags = [(256, "I", (width,)), (257, "I", (height,)), (258, "H", (8 * d.itemsize,)), (259, "H", (compression,)), (262, "H", (1,)), (277, "H", (1,)), (317, "H", (predictor,)), (339, "H", ({"u": 1, "i": 2, "f": 3}[d.kind],)), (33550, "d", (step, step, 0.0)), (33922, "d", (0.0, 0.0, 0.0, west, north, 0.0))]
    tags += [(322, "I", (tw,)), (323, "I", (th,)), (324, "I", offsets), (325, "I", [len(b) for b in blocks])] if tile else [(278, "I", (th,)), (273, "I", offsets), (279, "I", [len(b) for b in blocks])]
    if nodata is not None:
        tags.append((42113, "s", f"{nodata:g}\0".encode()))
    entries = b""
    for tag, code, values_ in sorted(tags):
        data = values_ if code == "s" else struct.pack(f"<{len(values_)}{code}", *values_)
        if len(data) > 4:
            out += b"\0" * (len(out) % 2)
            where = struct.pack("<I", len(out))
            out += data
        else:
            where = data + b"\0" * (4 - len(data))
        entries += struct.pack("<HHI", tag, codes[code], len(values_)) + where
    out += b"\0" * (len(out) % 2)
    out[:8] = b"II*\0" + struct.pack("<I", len(out))
    return bytes(out + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0")
