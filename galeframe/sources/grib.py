"""Gridded fields in GRIB files (editions 1 and 2, regular latitude-longitude grids, simple packing).

A message says its own length, so the driver walks from message to message and reads only their heads: variable, time,
place in the file. That index plans the partitions: all variables of a time go to one, from however many files they
come, so a row with all of them needs no shuffle. Filters on time and place are taken over by the source.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from galeframe.sources.ranges import Ranges

#: Wind components by parameter number of edition 1 (table 128), and by (category, number, height) of edition 2.
VARIABLES_1 = {165: "u10", 166: "v10", 246: "u100", 247: "v100"}
VARIABLES_2 = {(2, 2, 10): "u10", (2, 3, 10): "v10", (2, 2, 100): "u100", (2, 3, 100): "v100"}
#: Length of a time unit in seconds, by its code.
UNITS = {0: 60, 1: 3600, 2: 86400, 10: 3 * 3600, 11: 6 * 3600, 12: 12 * 3600, 13: 1}


def signed(data: bytes) -> int:
    """A whole number whose first bit is its sign."""
    x, top = int.from_bytes(data, "big"), 1 << (8 * len(data) - 1)
    return -(x - top) if x & top else x


def ibm_float(data: bytes) -> float:
    x = int.from_bytes(data, "big")
    return (-1.0 if x >> 31 else 1.0) * (x & 0xFFFFFF) / 2**24 * 16.0 ** ((x >> 24 & 127) - 64)


@dataclass(frozen=True)
class Message:
    path: str
    start: int
    size: int
    edition: int
    variable: str
    time: str


@dataclass(frozen=True)
class Grid:
    ni: int
    nj: int
    lat: float
    lon: float
    dlat: float
    dlon: float
    by_columns: bool

    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        lon = np.round(self.lon + self.dlon * np.arange(self.ni), 6)
        return np.round(self.lat + self.dlat * np.arange(self.nj), 6), np.where(lon > 180, lon - 360, lon)


def _told(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S")


def messages(source: Ranges) -> Iterator[Message]:
    """The messages of a file in their order; bytes between them are passed over."""
    at = 0
    while at + 16 <= source.size:
        head = source.read(at, min(512, source.size - at))
        skip = head.find(b"GRIB")
        if skip:
            at += len(head) - 3 if skip < 0 else skip
            continue
        edition = head[7]
        if edition == 1:
            size = int.from_bytes(head[4:7], "big")
            p = head[8:]
            year = (p[24] - 1) * 100 + p[12]
            time = datetime(year, p[13], p[14], p[15], p[16], tzinfo=UTC) + timedelta(seconds=UNITS[p[17]] * p[18])
            variable = VARIABLES_1.get(p[8], f"p{p[8]}")
        elif edition == 2:
            size, at_section, time, variable = int.from_bytes(head[8:16], "big"), 16, None, None
            while variable is None:
                s = source.read(at + at_section, 5)
                length, number = int.from_bytes(s[:4], "big"), s[4]
                if number in (1, 4):
                    s = source.read(at + at_section, length)
                    if number == 1:
                        time = datetime(int.from_bytes(s[12:14], "big"), *s[14:19], tzinfo=UTC)
                    else:
                        time += timedelta(seconds=UNITS[s[17]] * int.from_bytes(s[18:22], "big"))
                        height = int.from_bytes(s[24:28], "big") / 10.0 ** signed(s[23:24])
                        variable = VARIABLES_2.get((s[9], s[10], height), f"c{s[9]}n{s[10]}h{height:g}")
                at_section += length
        else:
            raise ValueError(f"GRIB edition {edition} isn't read")
        yield Message(source.path, at, size, edition, variable, _told(time))
        at += size


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    """n whole numbers of so many bits each."""
    if bits == 0:
        return np.zeros(n)
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(float)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return flat @ (2.0 ** np.arange(bits - 1, -1, -1))


def _values(packed: bytes, bits: int, reference: float, binary: int, decimal: int, present: np.ndarray | None, n: int) -> np.ndarray:
    count = n if present is None else int(present.sum())
    got = (reference + unpacked(packed, bits, count) * 2.0**binary) / 10.0**decimal
    if present is None:
        return got
    out = np.full(n, np.nan)
    out[present] = got
    return out


def _grid_1(g: bytes) -> Grid:
    if g[5] != 0:
        raise ValueError(f"grid type {g[5]} isn't read")
    ni, nj = struct.unpack(">HH", g[6:10])
    la, lo, la2, lo2 = signed(g[10:13]), signed(g[13:16]), signed(g[17:20]), signed(g[20:23])
    return _grid(ni, nj, la / 1e3, lo / 1e3, la2 / 1e3, lo2 / 1e3, g[27])


def _grid(ni: int, nj: int, la: float, lo: float, la2: float, lo2: float, scan: int) -> Grid:
    if scan & 0x10:
        raise ValueError("rows that turn around aren't read")
    span = (lo2 - lo) % 360 if not scan & 0x80 else -((lo - lo2) % 360)
    return Grid(ni, nj, la, lo, (la2 - la) / max(1, nj - 1), span / max(1, ni - 1), bool(scan & 0x20))


def field(source: Ranges, m: Message) -> tuple[Grid, np.ndarray]:
    """(grid, values by row of latitude and column of longitude) of a message; missing values are NaN."""
    data = source.read(m.start, m.size)
    grid, values = _field_1(data) if m.edition == 1 else _field_2(data)
    return grid, values.reshape(grid.ni, grid.nj).T if grid.by_columns else values.reshape(grid.nj, grid.ni)


def _field_1(data: bytes) -> tuple[Grid, np.ndarray]:
    length = lambda at: int.from_bytes(data[at : at + 3], "big")
    at, flags, decimal = 8, data[15], signed(data[34:36])
    at += length(at)
    if not flags & 0x80:
        raise ValueError("a message without a grid isn't read")
    grid = _grid_1(data[at : at + length(at)])
    at += length(at)
    present, n = None, grid.ni * grid.nj
    if flags & 0x40:
        present = np.unpackbits(np.frombuffer(data[at + 6 : at + length(at)], np.uint8), count=n).astype(bool)
        at += length(at)
    b = data[at : at + length(at)]
    if b[3] & 0xF0:
        raise ValueError("only simple packing is read")
    return grid, _values(b[11:], b[10], ibm_float(b[6:10]), signed(b[4:6]), decimal, present, n)


def _field_2(data: bytes) -> tuple[Grid, np.ndarray]:
    at, s = 16, {}
    while data[at : at + 4] != b"7777":
        size = int.from_bytes(data[at : at + 4], "big")
        s[data[at + 4]] = data[at : at + size]
        at += size
    g, p = s[3], s[5]
    if g[12:14] != b"\0\0" or p[9:11] != b"\0\0":
        raise ValueError("only regular grids and simple packing are read")
    ni, nj = struct.unpack(">II", g[30:38])
    grid = _grid(ni, nj, signed(g[46:50]) / 1e6, signed(g[50:54]) / 1e6, signed(g[55:59]) / 1e6, signed(g[59:63]) / 1e6, g[71])
    n = ni * nj
    present = np.unpackbits(np.frombuffer(s[6][6:], np.uint8), count=n).astype(bool) if s[6][5] == 0 else None
    return grid, _values(s[7][5:], p[19], struct.unpack(">f", p[11:15])[0], signed(p[15:17]), signed(p[17:19]), present, n)


class GribReader(DataSourceReader):
    """A partition for each time, or several, with its messages of all variables and files."""

    def __init__(self, options: dict):
        self.files, self.names = json.loads(options["files"]), options.get("variables", "u10,v10,u100,v100").split(",")
        self.per = int(options.get("messages", 16))
        self.times: set[str] | None = None
        self.bounds = {"time": ["", "~"], "lat": [-np.inf, np.inf], "lon": [-np.inf, np.inf]}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        left = []
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "time" and isinstance(f, (EqualTo, In)):
                got = set(f.value if isinstance(f, In) else [f.value])
                self.times = got if self.times is None else self.times & got
            elif name in self.bounds and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.bounds[name][0] = max(self.bounds[name][0], f.value)
                if isinstance(f, GreaterThan):
                    left.append(f)
            elif name in self.bounds and isinstance(f, (LessThan, LessThanOrEqual)):
                self.bounds[name][1] = min(self.bounds[name][1], f.value)
                if isinstance(f, LessThan):
                    left.append(f)
            else:
                left.append(f)
        return left

    def partitions(self) -> list[InputPartition]:
        by_time: dict[str, list[Message]] = {}
        for path in self.files:
            with Ranges(path) as source:
                for m in messages(source):
                    if m.variable in self.names and self.bounds["time"][0] <= m.time <= self.bounds["time"][1] and (self.times is None or m.time in self.times):
                        by_time.setdefault(m.time, []).append(m)
        out, now = [], []
        for time in sorted(by_time):
            now.append(by_time[time])
            if sum(map(len, now)) >= self.per:
                out.append(InputPartition(now))
                now = []
        return out + ([InputPartition(now)] if now else [])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        open_files: dict[str, Ranges] = {}
        for of_time in partition.value:
            grids: dict[Grid, dict[str, np.ndarray]] = {}
            for m in of_time:
                source = open_files.setdefault(m.path, None) or Ranges(m.path)
                open_files[m.path] = source
                grid, values = field(source, m)
                grids.setdefault(grid, {}).setdefault(m.variable, values)
            for grid, got in grids.items():
                lat, lon = grid.axes()
                i = np.flatnonzero((lat >= self.bounds["lat"][0]) & (lat <= self.bounds["lat"][1]))
                j = np.flatnonzero((lon >= self.bounds["lon"][0]) & (lon <= self.bounds["lon"][1]))
                n = len(i) * len(j)
                place = [pa.array(np.repeat(lat[i], len(j))), pa.array(np.tile(lon[j], len(i)))]
                columns = [pa.array(got[v][np.ix_(i, j)].ravel(), from_pandas=True) if v in got else pa.nulls(n, pa.float64()) for v in self.names]
                yield pa.RecordBatch.from_arrays([pa.array([of_time[0].time] * n, pa.string()), *place, *columns], ["time", "lat", "lon", *self.names])
        for source in open_files.values():
            source.close()


class GribSource(DataSource):
    """spark.read.format("grib").options(files=json list, variables="u10,v10").load() -> time, lat, lon and the variables.

    A variable that a time lacks is NULL; where two messages have the same variable and time, the first file's counts.
    """

    @classmethod
    def name(cls) -> str:
        return "grib"

    def schema(self) -> str:
        names = self.options.get("variables", "u10,v10,u100,v100").split(",")
        return "time string, lat double, lon double, " + ", ".join(f"`{n}` double" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return GribReader(dict(self.options))


def read_fields(spark: SparkSession, files: list[str], variables: list[str], **options) -> DataFrame:
    """Fields of several files as one table, a row for each time and place. Filters on time, lat and lon reach the files."""
    spark.dataSource.register(GribSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("grib").options(files=json.dumps(files), variables=",".join(variables), **{k: str(v) for k, v in options.items()}).load()
