"""Gridded series in HDF5 files (time x place), read by the executors in blocks that follow the files' chunks.

The driver reads a file's headers only: shapes, chunk shape, attributes and the time index. Filters on gid and time are
taken over by the source, so that only chunks with asked places and times are looked up, in the chunk tree, by the
task that needs them. What is understood is what h5py writes by default: superblock 0 to 3, old and new object headers,
contiguous, compact and B-tree chunked data, deflate and shuffle.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from galeframe.sources.ranges import Ranges

SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Values that a partition holds, about.
PARTITION_VALUES = 8_000_000
#: Values of an Arrow batch.
BATCH_VALUES = 500_000


def _numbers(form: str, data: bytes, at: int = 0) -> tuple:
    return struct.unpack_from("<" + form, data, at)


@dataclass
class Dataset:
    """Where a dataset's values are and how they are kept."""

    shape: tuple[int, ...] = ()
    dtype: np.dtype | None = None
    chunk: tuple[int, ...] | None = None
    address: int = -1
    inline: bytes | None = None
    filters: list[int] = field(default_factory=list)
    attributes: dict = field(default_factory=dict)
    links: dict[str, int] = field(default_factory=dict)
    groups: list[tuple[int, int]] = field(default_factory=list)

    def scale(self) -> tuple[float, float]:
        """(factor to divide by, offset to add); a factor of 0 is 1."""
        one = lambda name, default: float(np.ravel(self.attributes[name])[0]) if name in self.attributes else default
        return one("scale_factor", 1.0) or 1.0, one("add_offset", 0.0)


def _dtype(data: bytes) -> np.dtype:
    kind, bits, size = data[0] & 15, int.from_bytes(data[1:4], "little"), _numbers("I", data, 4)[0]
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    raise ValueError(f"datatype class {kind} isn't read")


def _shape(data: bytes) -> tuple[int, ...]:
    return _numbers(f"{data[1]}Q", data, 8 if data[0] == 1 else 4)


def _filters(data: bytes) -> list[int]:
    out, at = [], 8 if data[0] == 1 else 2
    for _ in range(data[1]):
        number = _numbers("H", data, at)[0]
        named = data[0] == 1 or number >= 256
        length, _, values = _numbers("HHH", data, at + 2) if named else (0, *_numbers("HH", data, at + 2))
        at += 8 if named else 6
        at += length + (-length % 8 if data[0] == 1 else 0) + 4 * values + (4 * (values % 2) if data[0] == 1 else 0)
        out.append(number)
    return out


def _attribute(data: bytes) -> tuple[str, np.ndarray]:
    version = data[0]
    names, types, spaces = _numbers("HHH", data, 2)
    pad = (lambda n: n + -n % 8) if version == 1 else (lambda n: n)
    at = 9 if version == 3 else 8
    name = data[at : at + names].split(b"\0")[0].decode()
    dtype = _dtype(data[at + pad(names) :])
    shape = _shape(data[at + pad(names) + pad(types) :])
    start = at + pad(names) + pad(types) + pad(spaces)
    return name, np.frombuffer(data, dtype, int(np.prod(shape, dtype=int)), start).reshape(shape)


def _link(data: bytes) -> tuple[str, int]:
    flags, at = data[1], 2
    at += (flags >> 3 & 1) + 8 * (flags >> 2 & 1) + (flags >> 4 & 1)
    width = 1 << (flags & 3)
    length = int.from_bytes(data[at : at + width], "little")
    at += width
    return data[at : at + length].decode(), _numbers("Q", data, at + length)[0]


class File:
    """The headers of an HDF5 file."""

    def __init__(self, source: Ranges):
        self.source = source
        head = source.read(0, min(96, source.size))
        if head[:8] != SIGNATURE:
            raise ValueError(f"{source.path} isn't an HDF5 file")
        if head[8] < 2:
            at = 56 if head[8] == 0 else 60
            self.root = self.header(_numbers("QQ", head, at)[1])
        else:
            self.root = self.header(_numbers("Q", head, 36)[0])

    def header(self, address: int) -> Dataset:
        out, read = Dataset(), self.source.read
        first = read(address, 16)
        if first[:4] == b"OHDR":
            flags, at = first[5], address + 6
            at += 16 * (flags >> 5 & 1) + 4 * (flags >> 4 & 1)
            width = 1 << (flags & 3)
            size = int.from_bytes(read(at, width), "little")
            todo, new, extra = [(at + width, size)], True, 2 * (flags >> 2 & 1)
        else:
            todo, new, extra = [(address + 16, _numbers("I", first, 8)[0])], False, 0
        while todo:
            start, size = todo.pop(0)
            block, at = read(start, size), 0
            while at + 4 <= size:
                kind, length = (block[at], _numbers("H", block, at + 1)[0]) if new else _numbers("HH", block, at)
                at += 4 + extra if new else 8
                self._message(kind, block[at : at + length], out, todo, new)
                at += length
        return out

    def _message(self, kind: int, data: bytes, out: Dataset, todo: list, new: bool) -> None:
        if kind == 0x01:
            out.shape = _shape(data)
        elif kind == 0x03:
            out.dtype = _dtype(data)
        elif kind == 0x06:
            out.links.update([_link(data)])
        elif kind == 0x08:
            self._layout(data, out)
        elif kind == 0x0B:
            out.filters = _filters(data)
        elif kind == 0x0C:
            out.attributes.update([_attribute(data)])
        elif kind == 0x10:
            start, size = _numbers("QQ", data)
            todo.append((start + 4, size - 8) if new else (start, size))
        elif kind == 0x11:
            out.groups.append(_numbers("QQ", data))

    def _layout(self, data: bytes, out: Dataset) -> None:
        if data[0] != 3:
            raise ValueError(f"layout version {data[0]} isn't read; write the file with the earliest library version")
        if data[1] == 0:
            out.inline = data[4 : 4 + _numbers("H", data, 2)[0]]
        elif data[1] == 1:
            out.address = _numbers("Q", data, 2)[0]
        else:
            out.address, out.chunk = _numbers("Q", data, 3)[0], _numbers(f"{data[2] - 1}I", data, 11)

    def dataset(self, name: str) -> Dataset:
        """The dataset of a path; KeyError where there is none."""
        now = self.root
        for part in name.strip("/").split("/"):
            links = dict(now.links)
            for tree, heap in now.groups:
                start = _numbers("Q", self.source.read(heap, 32), 24)[0]
                links |= {self._text(start + offset): address for offset, address in self._symbols(tree)}
            if part not in links:
                raise KeyError(f"{self.source.path} has no {name!r}")
            now = self.header(links[part])
        return now

    def _text(self, at: int) -> str:
        return self.source.read(at, min(256, self.source.size - at)).split(b"\0")[0].decode()

    def _symbols(self, address: int) -> Iterator[tuple[int, int]]:
        head = self.source.read(address, 24)
        if head[:4] == b"SNOD":
            n = _numbers("H", head, 6)[0]
            block = self.source.read(address + 8, 40 * n)
            yield from (_numbers("QQ", block, 40 * i) for i in range(n))
        else:
            n = _numbers("H", head, 6)[0]
            block = self.source.read(address + 24, 16 * n + 8)
            for i in range(n):
                yield from self._symbols(_numbers("Q", block, 16 * i + 8)[0])

    def chunks(self, d: Dataset, low: tuple[int, ...], high: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, address, bytes, filters left out) of the chunks that touch low..high, found by descending the chunk tree."""
        rank = len(d.shape)
        width = 8 + 8 * (rank + 1)

        def below(address: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
            head = self.source.read(address, 24)
            level, n = head[5], _numbers("H", head, 6)[0]
            block = self.source.read(address + 24, n * (width + 8) + width)
            keys = [_numbers(f"{rank}Q", block, i * (width + 8) + 8) for i in range(n + 1)]
            for i in range(n):
                child = _numbers("Q", block, i * (width + 8) + width)[0]
                if level:
                    # A subtree holds the chunks from its key up to the next one, in order of the first axis, then the others.
                    if keys[i][0] < high[0] and keys[i + 1][0] + d.chunk[0] > low[0]:
                        yield from below(child)
                elif all(o < h and o + c > a for o, c, a, h in zip(keys[i], d.chunk, low, high, strict=True)):
                    yield keys[i], child, *_numbers("II", block, i * (width + 8))

        if d.address != 0xFFFFFFFFFFFFFFFF:
            yield from below(d.address)

    def decoded(self, d: Dataset, address: int, size: int, left_out: int) -> np.ndarray:
        """A chunk's values."""
        data = self.source.read(address, size)
        for k in range(len(d.filters) - 1, -1, -1):
            if left_out >> k & 1:
                continue
            if d.filters[k] == 1:
                data = zlib.decompress(data)
            elif d.filters[k] == 2:
                data = np.frombuffer(data, np.uint8).reshape(d.dtype.itemsize, -1).T.tobytes()
            elif d.filters[k] == 3:
                data = data[:-4]
            else:
                raise ValueError(f"filter {d.filters[k]} isn't read")
        return np.frombuffer(data, d.dtype).reshape(d.chunk)

    def blocks(self, d: Dataset, low: tuple[int, ...], high: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], np.ndarray | Exception]]:
        """(offsets, values) of what lies in low..high, in pieces; an exception in place of values that can't be read."""
        if d.chunk:
            for offsets, *where in self.chunks(d, low, high):
                a = tuple(max(o, x) for o, x in zip(offsets, low, strict=True))
                b = tuple(min(o + c, s, x) for o, c, s, x in zip(offsets, d.chunk, d.shape, high, strict=True))
                try:
                    values = self.decoded(d, *where)[tuple(slice(x - o, y - o) for x, y, o in zip(a, b, offsets, strict=True))]
                except (zlib.error, EOFError, ValueError) as e:
                    values = e
                yield a, b, values
            return
        row = int(np.prod(d.shape[1:], dtype=int)) * d.dtype.itemsize
        step = max(1, BATCH_VALUES * 8 // max(1, row))
        for t in range(low[0], high[0], step):
            end, a = min(high[0], t + step), (t, *low[1:])
            try:
                data = d.inline[t * row : end * row] if d.inline is not None else self.source.read(d.address + t * row, (end - t) * row)
                values = np.frombuffer(data, d.dtype).reshape(end - t, *d.shape[1:])[(slice(None), *[slice(x, y) for x, y in zip(low[1:], high[1:], strict=True)])]
            except (EOFError, ValueError) as e:
                values = e
            yield a, (end, *high[1:]), values

    def whole(self, d: Dataset) -> np.ndarray:
        """All values of a small dataset."""
        out = np.zeros(d.shape, d.dtype)
        for a, b, values in self.blocks(d, (0,) * len(d.shape), d.shape):
            if isinstance(values, Exception):
                raise values
            out[tuple(slice(x, y) for x, y in zip(a, b, strict=True))] = values
        return out


def runs(sorted_ids: list[int]) -> list[tuple[int, int]]:
    """(start, end) of neighbouring ids, end excluded: what is read at once."""
    out: list[list[int]] = []
    for i in sorted_ids:
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [(a, b) for a, b in out]


@dataclass
class Asked:
    """What the filters leave of gid and time."""

    gids: set[int] | None = None
    gid_low: int = 0
    gid_high: int = 1 << 62
    low: str = ""
    high: str | None = None  # included

    def take(self, f: Filter) -> bool:
        """Takes a filter over, if it is one on gid or time."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "gid" and isinstance(f, (EqualTo, In)):
            got = {int(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
            self.gids = got if self.gids is None else self.gids & got
        elif name == "gid" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.gid_low = max(self.gid_low, int(f.value) + isinstance(f, GreaterThan))
        elif name == "gid" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.gid_high = min(self.gid_high, int(f.value) + isinstance(f, LessThanOrEqual))
        elif name == "time" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value)
            return isinstance(f, GreaterThanOrEqual)
        elif name == "time" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = f.value if self.high is None else min(self.high, f.value)
            return isinstance(f, LessThanOrEqual)
        else:
            return False
        return True

    def gid_runs(self, n: int) -> list[tuple[int, int]]:
        low, high = max(0, self.gid_low), min(n, self.gid_high)
        if self.gids is None:
            return [(low, high)] if low < high else []
        return runs(sorted(g for g in self.gids if low <= g < high))

    def times(self, index: np.ndarray) -> tuple[int, int]:
        """The range of the (ascending) time index that is asked for."""
        a = int(np.searchsorted(index, self.low.encode(), side="left")) if self.low else 0
        b = int(np.searchsorted(index, self.high.encode(), side="right")) if self.high is not None else len(index)
        return a, max(a, b)


class H5Reader(DataSourceReader):
    """A partition for each file and block of whole chunks with asked places, about PARTITION_VALUES values."""

    def __init__(self, options: dict):
        self.options, self.asked = options, Asked()
        if options.get("gids"):
            self.asked.gids = {int(g) for g in json.loads(options["gids"])}
        self.files = json.loads(options["files"])
        self.variable, self.step, self.lenient = options["variable"], int(options.get("step", 1)), options.get("unreadable", "error") == "null"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.asked.take(f)]

    def partitions(self) -> list[InputPartition]:
        out, size = [], int(self.options.get("values", PARTITION_VALUES))
        for path in self.files:
            with Ranges(path) as source:
                f = File(source)
                d = f.dataset(self.variable)
                a, b = self.asked.times(f.whole(f.dataset("time_index")))
            per_t, per_g = d.chunk or (b - a or 1, 1)
            times = max(per_t, size // per_g // per_t * per_t)
            for t in range(a // per_t * per_t, b, times):
                span = (max(a, t), min(b, t + times))
                columns = max(per_g, size // max(1, span[1] - span[0]) // per_g * per_g)
                wanted: dict[int, list[tuple[int, int]]] = {}
                for g, h in self.asked.gid_runs(d.shape[1]):
                    for k in range(g // columns, (h - 1) // columns + 1):
                        wanted.setdefault(k, []).append((max(g, k * columns), min(h, (k + 1) * columns)))
                out += [InputPartition((path, span, w)) for w in wanted.values()]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, (a, b), wanted = partition.value
        with Ranges(path) as source:
            f = File(source)
            d = f.dataset(self.variable)
            factor, offset = d.scale()
            index = f.whole(f.dataset("time_index"))
            for g, h in wanted:
                for (t, u), (t2, u2), values in f.blocks(d, (a, g), (b, h)):
                    yield from self._batches(path, index, t, t2, u, u2, values, factor, offset)

    def _batches(self, path: str, index: np.ndarray, t: int, t2: int, u: int, u2: int, values, factor: float, offset: float) -> Iterator[pa.RecordBatch]:
        if isinstance(values, Exception):
            if not self.lenient:
                raise values
            values = np.full((t2 - t, u2 - u), np.nan)
        rows = np.arange(t, t2)
        rows = rows[rows % self.step == 0]
        values = values[rows - t].astype(np.float32).astype(float) / factor + offset
        for k in range(0, len(rows), max(1, BATCH_VALUES // max(1, u2 - u))):
            part = slice(k, k + max(1, BATCH_VALUES // max(1, u2 - u)))
            v, n = values[part], len(rows[part])
            gid = np.tile(np.arange(u, u2), n)
            time = pa.array([x.decode() for x in index[rows[part]]], pa.string()).take(pa.array(np.repeat(np.arange(n), u2 - u)))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(gid), pa.string()), pa.array(gid), time, pa.array(v.ravel(), pa.float64(), from_pandas=True)], ["file", "gid", "time", "value"])


class H5Source(DataSource):
    """spark.read.format("h5wind").options(files=json list, variable=name).load() -> file, gid, time, value.

    Options: gids (json list), step (every so many times), unreadable (error, or null for blocks that can't be decoded),
    values (of a partition). Values are raw / scale_factor + add_offset.
    """

    @classmethod
    def name(cls) -> str:
        return "h5wind"

    def schema(self) -> str:
        return "file string, gid long, time string, value double"

    def reader(self, schema) -> DataSourceReader:
        return H5Reader(dict(self.options))


class H5PlacesReader(DataSourceReader):
    """A partition for each block of places."""

    def __init__(self, options: dict):
        self.path, self.size = options["file"], int(options.get("places", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        with Ranges(self.path) as source:
            n = File(source).dataset("coordinates").shape[0]
        return [InputPartition((a, min(n, a + self.size))) for a in range(0, n, self.size)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        a, b = partition.value
        with Ranges(self.path) as source:
            f = File(source)
            for (t, _), (t2, _), values in f.blocks(f.dataset("coordinates"), (a, 0), (b, 2)):
                if isinstance(values, Exception):
                    raise values
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(t, t2)), *[pa.array(values[:, k].astype(float), from_pandas=True) for k in (0, 1)]], ["gid", "lat", "lon"])


class H5PlacesSource(DataSource):
    """spark.read.format("h5places").option("file", path).load() -> gid, lat, lon."""

    @classmethod
    def name(cls) -> str:
        return "h5places"

    def schema(self) -> str:
        return "gid long, lat double, lon double"

    def reader(self, schema) -> DataSourceReader:
        return H5PlacesReader(dict(self.options))


def read_series(spark: SparkSession, files: list[str], variable: str, **options) -> DataFrame:
    """The series of several files (years, or years and heights) as one table. Filters on gid and time reach the files."""
    spark.dataSource.register(H5Source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("h5wind").options(files=json.dumps(files), variable=variable, **{k: str(v) for k, v in options.items()}).load()


def read_places(spark: SparkSession, file: str, **options) -> DataFrame:
    spark.dataSource.register(H5PlacesSource)
    return spark.read.format("h5places").options(file=file, **{k: str(v) for k, v in options.items()}).load()
