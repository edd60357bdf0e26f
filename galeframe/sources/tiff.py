"""Sampling of GeoTIFF rasters at points.

The driver reads the raster's directory (size, places of the tiles, georeference), a few bytes for each tile. Each point
finds its tile by an expression; the points are laid in ranges of tile, a tile with many points in several, and a task
decodes each of its tiles once. So tiles without a point are never read. Tiled and striped files are read, classic and
BigTIFF, uncompressed, deflated or LZW, with predictors 1 to 3; of several bands the first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.sources.ranges import Ranges

#: Bytes of a value by TIFF type, and its struct code.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: What is no value, whatever the file says.
NOT_PHYSICAL = -1e20


@dataclass
class Raster:
    """What the directory of a raster tells. A cell's row and column come from north, west and the size of a cell."""

    path: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    offsets: np.ndarray
    counts: np.ndarray
    dtype: np.dtype
    bands: int
    compression: int
    predictor: int
    west: float
    north: float
    dx: float
    dy: float
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    def tile(self, source: Ranges, k: int) -> np.ndarray:
        """The values of tile k as doubles, missing ones NaN."""
        rows = min(self.tile_height, self.height - k // self.across * self.tile_height) if self.tile_width == self.width else self.tile_height
        n = rows * self.tile_width * self.bands
        if not self.counts[k]:
            return np.full((rows, self.tile_width), np.nan)
        data = source.read(int(self.offsets[k]), int(self.counts[k]))
        if self.compression in (8, 32946):
            data = zlib.decompress(data)
        elif self.compression == 5:
            data = lzw(data)
        elif self.compression != 1:
            raise ValueError(f"compression {self.compression} isn't read")
        if self.predictor == 3:
            flat = np.frombuffer(data, np.uint8, n * self.dtype.itemsize).reshape(rows, -1)
            flat = np.cumsum(flat.reshape(rows, -1, self.bands), axis=1, dtype=np.uint8).reshape(rows, self.dtype.itemsize, -1)
            values = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(rows, self.tile_width, self.bands)
        else:
            values = np.frombuffer(data, self.dtype, n).reshape(rows, self.tile_width, self.bands)
            if self.predictor == 2:
                values = np.cumsum(values, axis=1, dtype=self.dtype.newbyteorder("="))
        out = values[..., 0].astype(float)
        if self.nodata is not None:
            out[np.isclose(out, self.nodata)] = np.nan
        out[out <= NOT_PHYSICAL] = np.nan
        return out


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the first bit first."""
    out, table, width, buffer, have, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        buffer, have = (buffer << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = buffer >> have & (1 << width) - 1
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def directory(path: str) -> Raster:
    """The first directory of a file."""
    with Ranges(path) as f:
        head = f.read(0, 16)
        e = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(f"{e}H", head[2:4])[0] if e else 0
        if kind not in (42, 43):
            raise ValueError(f"{path} isn't a TIFF file")
        big = kind == 43
        at = struct.unpack(f"{e}Q", head[8:16])[0] if big else struct.unpack(f"{e}I", head[4:8])[0]
        counter, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
        n = struct.unpack(f"{e}{counter}", f.read(at, struct.calcsize(counter)))[0]
        block = f.read(at + struct.calcsize(counter), n * entry)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, form = struct.unpack_from(f"{e}HH", block, k * entry)
            count = struct.unpack_from(f"{e}{'Q' if big else 'I'}", block, k * entry + 4)[0]
            if form not in TYPES:
                continue
            size, code = TYPES[form]
            value = block[k * entry + entry - inline : (k + 1) * entry]
            if size * count > inline:
                value = f.read(struct.unpack(f"{e}{'Q' if big else 'I'}", value)[0], size * count)
            tags[tag] = (value[:count],) if code == "s" else struct.unpack_from(f"{e}{count}{code}", value)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height = one(256, 0), one(257, 0)
    bits, sample = one(258, 8), one(339, 1)
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    nodata = tags[42113][0].split(b"\0")[0].decode().strip() if 42113 in tags else ""
    tiled = 322 in tags
    return Raster(
        path=path,
        width=width,
        height=height,
        tile_width=one(322, width),
        tile_height=one(323, min(height, one(278, height))),
        offsets=np.array(tags[324 if tiled else 273], dtype=np.int64),
        counts=np.array(tags[325 if tiled else 279], dtype=np.int64),
        dtype=np.dtype(f"{e}{ {1: 'u', 2: 'i', 3: 'f'}[sample]}{bits // 8}"),
        bands=one(277, 1),
        compression=one(259, 1),
        predictor=one(317, 1),
        west=tie[3] - tie[0] * scale[0],
        north=tie[4] + tie[1] * scale[1],
        dx=scale[0],
        dy=scale[1],
        nodata=float(nodata) if nodata else None,
    )


def sample_raster(points: DataFrame, path: str | None, name: str = "sample", lat: str = "lat", lon: str = "lon", points_of_range: int = 200_000) -> DataFrame:
    """Adds the value of the cell that each point lies in: NULL for missing values, for points outside, and without a path."""
    if path is None:
        return points.withColumn(name, F.lit(None).cast("double"))
    r = directory(path)
    row, col = F.floor((F.lit(r.north) - F.col(lat)) / r.dy).cast("long"), F.floor((F.col(lon) - F.lit(r.west)) / r.dx).cast("long")
    placed = points.withColumns({"_row": row, "_col": col})
    inside = F.coalesce((F.col("_row") >= 0) & (F.col("_row") < r.height) & (F.col("_col") >= 0) & (F.col("_col") < r.width), F.lit(False))
    tile = F.expr(f"_row div {r.tile_height} * {r.across} + _col div {r.tile_width}")
    cell = F.expr(f"_row % {r.tile_height} * {r.tile_width} + _col % {r.tile_width}").cast("int")
    placed = placed.withColumns({"_tile": F.when(inside, tile), "_cell": F.when(inside, cell)}).drop("_row", "_col")
    rest = [f.name for f in points.schema]
    ranges = max(1, -(-placed.count() // points_of_range))
    # The cell tells points of a hot tile apart, so that several ranges share it.
    laid = placed.repartitionByRange(ranges, "_tile", "_cell", F.xxhash64(*[F.col(c) for c in (lat, lon)])).sortWithinPartitions("_tile")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, values = -1, np.zeros(0)
        with Ranges(r.path) as source:
            for b in batches:
                tiles, out = b["_tile"].fillna(-1).to_numpy(np.int64), np.full(len(b), np.nan)
                for k in np.unique(tiles[tiles >= 0]):
                    if k != known:
                        known, values = k, r.tile(source, int(k)).ravel()
                    at = tiles == k
                    out[at] = values[b["_cell"].to_numpy()[at].astype(int)]
                yield b.drop(columns=["_tile", "_cell"]).assign(**{name: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name != name)
    got = laid.mapInPandas(run, f"{schema}, `{name}` double") if name not in rest else laid.drop(name).mapInPandas(run, f"{schema}, `{name}` double")
    return got.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def sample_rasters(points: DataFrame, paths: dict[int, str | None], prefix: str = "gwa_", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds a column for each height's raster. Distinct places are sampled, and joined back."""
    places = points.select(lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).distinct()
    for height, path in paths.items():
        places = sample_raster(places, path, f"{prefix}{height}", lat, lon)
    return points.join(places, [lat, lon], "left")
