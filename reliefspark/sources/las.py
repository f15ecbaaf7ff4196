"""LAS point clouds (uncompressed) as a Spark data source: ``spark.read.format("las").load(path)``.

Files are found and read through the file system that the path names (``file:``, ``hdfs:``, ``s3:``, ``gs:``...), never
as local files of the driver.  Range and equality filters on ``x, y, z`` and ``cloud_id`` are pushed down: the box in
a file's header decides whether any of it is read, and records outside are left out before they reach the JVM.

One partition per ``pointsPerPartition`` records of a file, so a large cloud is read by many tasks;
each task reads the byte range of its records and decodes it as one structured array per chunk.
"""

from __future__ import annotations

import fnmatch
import math
import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual)

SCHEMA = "cloud_id string, x double, y double, z double, cls int, withheld boolean"
HEADER_BYTES = 375
CHUNK = 200_000
#: headers that the planning process reads at the same time
READERS = 32


@dataclass
class LasHeader:
    point_format: int
    record_bytes: int
    data_offset: int
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    minimum: tuple[float, float, float]
    maximum: tuple[float, float, float]


def parse_header(head: bytes, name: str = "") -> LasHeader:
    if len(head) < 227 or head[:4] != b"LASF":
        raise ValueError(f"{name}: no LAS header")
    minor = head[25]
    data_offset, = struct.unpack_from("<I", head, 96)
    point_format, record_bytes, count = struct.unpack_from("<BHI", head, 104)
    if point_format & 0x80:
        raise ValueError(f"{name}: compressed cloud, decompress it first")
    numbers = struct.unpack_from("<12d", head, 131)
    if minor >= 4 and len(head) >= 255:
        count = struct.unpack_from("<Q", head, 247)[0] or count
    box = numbers[6:]
    return LasHeader(point_format, record_bytes, data_offset, count, numbers[:3], numbers[3:6], box[1::2], box[0::2])


def record_type(point_format: int, record_bytes: int) -> np.dtype:
    """Only the fields used: coordinates, class and flags at their offsets."""
    extended = point_format >= 6
    return np.dtype({
        "names": ["x", "y", "z", "flags", "cls"], "formats": ["<i4", "<i4", "<i4", "u1", "u1"],
        "offsets": [0, 4, 8, 15, 16 if extended else 15], "itemsize": record_bytes})


def file_system(path: str) -> tuple:
    """The file system of a path or uri, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(pattern: str) -> tuple:
    """(file system, sorted paths) of a folder (all ``.las`` below it), one file, or a pattern for the last part of the path."""
    from pyarrow import fs

    system, path = file_system(pattern)
    if any(c in path for c in "*?["):
        folder, _, name = path.rpartition("/")
        found = system.get_file_info(fs.FileSelector(folder))
        return system, sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, name))
    info = system.get_file_info(path)
    if info.is_file:
        return system, [path]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return system, sorted(f.path for f in found if f.is_file and f.extension.lower() == "las")


def read_header(system, path: str) -> LasHeader:
    with system.open_input_file(path) as f:
        return parse_header(f.read_at(min(HEADER_BYTES, f.size()), 0), path)


@dataclass
class LasSplit(InputPartition):
    path: str
    first: int
    count: int
    header: LasHeader


class LasReader(DataSourceReader):
    """``planned`` holds (files found, files kept) once the partitions are known."""

    def __init__(self, options):
        self.pattern = options["path"]
        self.per_split = int(options.get("pointsPerPartition", 2_000_000))
        self.low, self.high, self.cloud = dict.fromkeys("xyz", -math.inf), dict.fromkeys("xyz", math.inf), None
        self.planned = (0, 0)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes bounds for whole files and records; Spark applies every filter again, so open bounds may count as closed."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name == "cloud_id" and isinstance(f, EqualTo):
                self.cloud = f.value
            elif name in self.low and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low[name] = max(self.low[name], f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high[name] = min(self.high[name], f.value)
            yield f

    def _meets(self, header: LasHeader) -> bool:
        # a header rounds: one step of the scale on both sides
        return all(low - s <= self.high[a] and high + s >= self.low[a] for a, low, high, s in zip("xyz", header.minimum, header.maximum, header.scale))

    def partitions(self):
        system, files = list_files(self.pattern)
        found = len(files)
        if self.cloud is not None:
            files = [f for f in files if f.rsplit("/", 1)[-1] == self.cloud]
        with ThreadPoolExecutor(READERS) as pool:
            headers = [(f, h) for f, h in zip(files, pool.map(lambda f: read_header(system, f), files)) if h.count and self._meets(h)]
        self.planned = (found, len(headers))
        return [LasSplit(path, first, min(self.per_split, h.count - first), h) for path, h in headers for first in range(0, h.count, self.per_split)]

    def read(self, partition: LasSplit) -> Iterator[pa.RecordBatch]:
        header, (system, _) = partition.header, file_system(self.pattern)
        kind = record_type(header.point_format, header.record_bytes)
        extended = header.point_format >= 6
        name = partition.path.rsplit("/", 1)[-1]
        with system.open_input_file(partition.path) as f:
            for first in range(partition.first, partition.first + partition.count, CHUNK):
                n = min(partition.first + partition.count - first, CHUNK)
                data = f.read_at(n * header.record_bytes, header.data_offset + first * header.record_bytes)
                if len(data) < n * header.record_bytes:
                    raise ValueError(f"{partition.path}: fewer records than the header announces")
                records = np.frombuffer(data, dtype=kind)
                axes = [records[a] * header.scale[i] + header.offset[i] for i, a in enumerate("xyz")]
                inside = np.logical_and.reduce([(v >= self.low[a]) & (v <= self.high[a]) for a, v in zip("xyz", axes)])
                if not inside.all():
                    records, axes = records[inside], [v[inside] for v in axes]
                # classic formats keep class (5 bits) and flags in one byte
                cls = records["cls"] if extended else records["cls"] & 0x1F
                withheld = (records["flags"] & (0x04 if extended else 0x80)) > 0
                if len(records):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(records)), *[pa.array(a) for a in axes], pa.array(cls.astype(np.int32)), pa.array(withheld)],
                        names=["cloud_id", "x", "y", "z", "cls", "withheld"])


class LasDataSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LasReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasDataSource)


def read_las(spark: SparkSession, path: str, box=None, points_per_partition: int = 2_000_000) -> DataFrame:
    """Points of all clouds below ``path``, only those of a closed box ``(x0, y0, x1, y1)`` when one is given."""
    register(spark)
    points = spark.read.format("las").option("pointsPerPartition", points_per_partition).load(path)
    if box is None:
        return points
    x0, y0, x1, y1 = (float(v) for v in box)
    return points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def las_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header facts per file (name, count, bounds); tasks read the header bytes of their files and nothing else."""
    schema = "cloud_id string, n_points bigint, min_x double, min_y double, max_x double, max_y double"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            heads = [read_header(*file_system(n)) for n in names]
            yield pa.RecordBatch.from_arrays([
                pa.array([n.rsplit("/", 1)[-1] for n in names]), pa.array([h.count for h in heads], pa.int64()),
                pa.array([h.minimum[0] for h in heads]), pa.array([h.minimum[1] for h in heads]),
                pa.array([h.maximum[0] for h in heads]), pa.array([h.maximum[1] for h in heads])],
                names=["cloud_id", "n_points", "min_x", "min_y", "max_x", "max_y"])

    # only the paths: Spark lists, the content column is never read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.las").load(path).select("path")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(width, "path").mapInArrow(parse, schema)


def write_las(points: DataFrame, folder: str, tile_m: float = 1000.0, scale: float = 0.01, per_file: int = 1_000_000) -> DataFrame:
    """Writes points (``cloud_id, x, y, z, cls, withheld``) as LAS 1.4 files of one strip of a cloud each.

    A strip is ``tile_m`` high and goes on in further files after ``per_file`` points, so no file, task or memory grows
    with a crowded cloud.  Names and content follow from the points alone: a repeated task writes the same files again.
    Returns file names, counts and boxes, as stored in ``<folder>/written``.
    """
    record = np.dtype({"names": ["x", "y", "z", "flags", "cls"], "formats": ["<i4", "<i4", "<i4", "u1", "u1"], "offsets": [0, 4, 8, 15, 16], "itemsize": 30})

    def las_bytes(axes: list[np.ndarray], cls: np.ndarray, withheld: np.ndarray) -> tuple[bytes, list[float]]:
        offset = [math.floor(a.min()) for a in axes]
        out = np.zeros(len(cls), record)
        box = []
        for name, values, o in zip("xyz", axes, offset):
            out[name] = np.rint((values - o) / scale)
            box += [int(out[name].max()) * scale + o, int(out[name].min()) * scale + o]
        out["cls"], out["flags"] = cls, np.where(withheld, 0x04, 0)
        head = bytearray(HEADER_BYTES)
        head[:4], head[24:26], head[90:94] = b"LASF", b"\x01\x04", struct.pack("<HH", 1, 2000)
        struct.pack_into("<HII", head, 94, HEADER_BYTES, HEADER_BYTES, 0)
        struct.pack_into("<BH", head, 104, 6, record.itemsize)
        struct.pack_into("<12d", head, 131, scale, scale, scale, *offset, *box)
        struct.pack_into("<Q", head, 247, len(out))
        return bytes(head) + out.tobytes(), [box[1], box[3], box[0], box[2]]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base)
        now, part, held, size = None, 0, [], 0

        def flush():
            table = pa.Table.from_batches(held)
            axes = [table.column(a).to_numpy() for a in "xyz"]
            data, box = las_bytes(axes, table.column("cls").to_numpy(), table.column("withheld").to_numpy())
            name = f"{now[0]}_{now[1]}_{part}.las"
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([table.num_rows], pa.int64()), *[pa.array([v]) for v in box]],
                                              ["cloud_id", "n_points", "min_x", "min_y", "max_x", "max_y"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            start = 0
            while start < len(keys):
                if keys[start] != now:
                    if size:
                        yield flush()
                    now, part, held, size = keys[start], 0, [], 0
                stop = start
                while stop < len(keys) and keys[stop] == now and size + stop - start < per_file:
                    stop += 1
                held.append(batch.slice(start, stop - start))
                size += stop - start
                start = stop
                if size >= per_file:
                    yield flush()
                    part, held, size = part + 1, [], 0
        if size:
            yield flush()

    spark = points.sparkSession
    strips = points.select(
        F.col("cloud_id").cast("string"), F.floor(F.col("y") / float(tile_m)).alias("strip"), "x", "y", "z", F.col("cls").cast("int"), F.coalesce("withheld", F.lit(False)).alias("withheld"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strips = strips.repartition(width, "cloud_id", "strip").sortWithinPartitions("cloud_id", "strip", "y", "x", "z", "cls", "withheld")
    schema = "cloud_id string, n_points bigint, min_x double, min_y double, max_x double, max_y double"
    strips.mapInArrow(write, schema).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/written")
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/written")
