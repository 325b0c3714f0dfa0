"""SEG-Y files as a Spark data source: reading by ranges of traces, and writing one file per partition.

``spark.read.format("segy")`` reads every file that a path or glob names. A trace's headers are columns, its samples the array
``data``; only headers asked for by the option ``headers`` are decoded, and the samples only unless the option ``data`` is false, and of
these only the ones within the option ``limits`` (start:stop or start:stop:step, as slices in Python): other bytes are not looked at.
Files are opened by the tasks, by path where it is local and else by ranges through Arrow's file systems (``s3://``, ``gs://``, ``hdfs://``).

``spark.read.format("segy_files")`` gives a row for each file instead: its size, its text headers, decoded, and its binary and extended ones
as they are. The writer's option ``parent`` names a file whose headers new files get, byte for byte but for the numbers of samples,
their interval and format, which are those of the traces written; ``text`` and ``extended`` give text headers themselves.
"""

from __future__ import annotations

import fnmatch
import glob
import os
import struct
import time
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format: the trace headers in the order of their bytes, and which of them are four bytes wide; the others have two.
NAMES = (
    "TRACE_SEQUENCE_LINE TRACE_SEQUENCE_FILE FieldRecord TraceNumber EnergySourcePoint CDP CDP_TRACE TraceIdentificationCode NSummedTraces NStackedTraces DataUse offset "
    "ReceiverGroupElevation SourceSurfaceElevation SourceDepth ReceiverDatumElevation SourceDatumElevation SourceWaterDepth GroupWaterDepth ElevationScalar SourceGroupScalar "
    "SourceX SourceY GroupX GroupY CoordinateUnits WeatheringVelocity SubWeatheringVelocity SourceUpholeTime GroupUpholeTime SourceStaticCorrection GroupStaticCorrection "
    "TotalStaticApplied LagTimeA LagTimeB DelayRecordingTime MuteTimeStart MuteTimeEND TRACE_SAMPLE_COUNT TRACE_SAMPLE_INTERVAL GainType InstrumentGainConstant InstrumentInitialGain "
    "Correlated SweepFrequencyStart SweepFrequencyEnd SweepLength SweepType SweepTraceTaperLengthStart SweepTraceTaperLengthEnd TaperType AliasFilterFrequency AliasFilterSlope "
    "NotchFilterFrequency NotchFilterSlope LowCutFrequency HighCutFrequency LowCutSlope HighCutSlope YearDataRecorded DayOfYear HourOfDay MinuteOfHour SecondOfMinute TimeBaseCode "
    "TraceWeightingFactor GeophoneGroupNumberRoll1 GeophoneGroupNumberFirstTraceOrigField GeophoneGroupNumberLastTraceOrigField GapSize OverTravel CDP_X CDP_Y INLINE_3D CROSSLINE_3D "
    "ShotPoint ShotPointScalar TraceValueMeasurementUnit TransductionConstantMantissa TransductionConstantPower TransductionUnit TraceIdentifier ScalarTraceHeader SourceType "
    "SourceEnergyDirectionMantissa SourceEnergyDirectionExponent SourceMeasurementMantissa SourceMeasurementExponent SourceMeasurementUnit UnassignedInt1 UnassignedInt2"
).split()
WIDE = set(
    "TRACE_SEQUENCE_LINE TRACE_SEQUENCE_FILE FieldRecord TraceNumber EnergySourcePoint CDP CDP_TRACE offset ReceiverGroupElevation SourceSurfaceElevation SourceDepth ReceiverDatumElevation "
    "SourceDatumElevation SourceWaterDepth GroupWaterDepth SourceX SourceY GroupX GroupY CDP_X CDP_Y INLINE_3D CROSSLINE_3D ShotPoint TransductionConstantMantissa "
    "SourceEnergyDirectionMantissa SourceMeasurementMantissa UnassignedInt1 UnassignedInt2".split()
)
#: First byte (from 1) and width of every header.
HEADERS = {name: (1 + sum(4 if other in WIDE else 2 for other in NAMES[:i]), 4 if name in WIDE else 2) for i, name in enumerate(NAMES)}
#: What the reader and the writer number themselves.
NUMBERED = ("TRACE_SEQUENCE_LINE", "TRACE_SEQUENCE_FILE")
HEAD, TRACE_HEAD = 3600, 240
WIDTH = {1: 4, 2: 4, 3: 2, 5: 4, 8: 1}


def ibm_to_ieee(raw: np.ndarray) -> np.ndarray:
    """Big-endian IBM floats (as uint32) to float32: sign, exponent of 16 from 64, 24 bits of fraction."""
    raw = raw.astype(np.uint32)
    fraction = (raw & 0x00FFFFFF).astype(np.float64) / (1 << 24)
    return (np.where(raw >> 31, -1.0, 1.0) * fraction * 16.0 ** (((raw >> 24) & 0x7F).astype(np.int64) - 64)).astype(np.float32)


def ieee_to_ibm(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    size = np.abs(x)
    with np.errstate(divide="ignore"):
        exponent = np.where(size > 0, np.floor(np.log2(np.where(size > 0, size, 1)) / 4) + 1, 0).astype(np.int64)
    fraction = np.rint(size / 16.0**exponent * (1 << 24)).astype(np.int64)
    over = fraction >= 1 << 24
    fraction, exponent = np.where(over, fraction >> 4, fraction), np.where(over, exponent + 1, exponent)
    out = ((x < 0).astype(np.uint32) << 31) | ((exponent + 64).astype(np.uint32) << 24) | fraction.astype(np.uint32)
    return np.where(size > 0, out, 0).astype(np.uint32)


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file://")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path in it."""
    return (fs.LocalFileSystem(), path.removeprefix("file://")) if is_local(path) else fs.FileSystem.from_uri(path)


def ranged(path: str, first: int, size: int, opened=file_system) -> bytes:
    """Bytes of a file from ``first`` on, fewer at its end."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        return f.read_at(size, first)


def named(pattern: str, opened=file_system) -> list[str]:
    """The files of a path or a glob; beyond local ones wildcards may be in the name only."""
    if is_local(pattern):
        return sorted(glob.glob(pattern.removeprefix("file://")))
    folder, _, name = pattern.rpartition("/")
    system, at = opened(folder)
    return sorted(f"{folder}/{i.base_name}" for i in system.get_file_info(fs.FileSelector(at)) if i.is_file and fnmatch.fnmatch(i.base_name, name))


def layout(path: str, order: str, opened=file_system) -> tuple[int, int, int, int, int]:
    """Number of traces, samples of a trace, interval in microseconds, sample format, and bytes before the first trace of a file."""
    head = ranged(path, 3200, 400, opened)
    interval, n, fmt = struct.unpack(order + "h", head[16:18])[0], struct.unpack(order + "H", head[20:22])[0], struct.unpack(order + "h", head[24:26])[0]
    extended = struct.unpack(order + "h", head[304:306])[0]
    if extended < 0:
        raise ValueError(f"{path} doesn't tell how many extended text headers it has")
    system, at = opened(path)
    first = HEAD + 3200 * extended
    return (system.get_file_info(at).size - first) // (TRACE_HEAD + n * WIDTH[fmt]), n, interval, fmt, first


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class SegyReader(DataSourceReader):
    def __init__(self, options: dict, headers: list[str], data: bool):
        self.paths = sorted(p for part in options["path"].split(",") for p in named(part))
        self.order = "<" if options.get("endian", "big") == "little" else ">"
        self.chunk, self.headers, self.data = int(options.get("chunk_size", 25000)), headers, data
        self.limits = slice(*(int(v) if v.strip() else None for v in options.get("limits", ":").split(":")))

    def partitions(self):
        return [_Range(p, a, min(a + self.chunk, n)) for p in self.paths for n in [layout(p, self.order)[0]] for a in range(0, max(n, 1), self.chunk)]

    def read(self, part, opened=file_system):
        _, n, _, fmt, head = layout(part.path, self.order, opened)
        size, block, width = TRACE_HEAD + n * WIDTH[fmt], 2000, WIDTH[fmt]
        kept = range(n)[self.limits]
        if self.data and not len(kept):
            raise ValueError("no samples are left within the limits")
        for at in range(part.first, part.last, block):
            count = min(block, part.last - at)
            if is_local(part.path):
                raw = np.memmap(part.path.removeprefix("file://"), np.uint8, "r", head + at * size, (count, size))
            else:
                raw = np.frombuffer(ranged(part.path, head + at * size, count * size, opened), np.uint8).reshape(count, size)
            columns = [pa.array([part.path] * count, pa.string()), pa.array(np.arange(at + 1, at + 1 + count), pa.int64())]
            for h in self.headers:
                first, wide = HEADERS[h]
                columns.append(pa.array(np.ascontiguousarray(raw[:, first - 1 : first - 1 + wide]).view(f"{self.order}i{wide}").ravel().astype(np.int32)))
            if self.data:
                low, high = min(kept[0], kept[-1]), max(kept[0], kept[-1]) + 1
                x = decoded(raw[:, TRACE_HEAD + low * width : TRACE_HEAD + high * width], fmt, self.order)[:, [i - low for i in kept] if abs(kept.step) > 1 or kept.step < 0 else slice(None)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel())))
            yield pa.RecordBatch.from_arrays(columns, ["file", "TRACE_SEQUENCE_FILE", *self.headers, *(["data"] if self.data else [])])


def decoded(raw: np.ndarray, fmt: int, order: str) -> np.ndarray:
    """Bytes of samples (traces by bytes) as float32."""
    x = np.ascontiguousarray(raw).view(order + {1: "u4", 2: "i4", 3: "i2", 5: "f4", 8: "i1"}[fmt])
    return ibm_to_ieee(x.astype(np.uint32)) if fmt == 1 else x.astype(np.float32)


def encoded(x: np.ndarray, fmt: int) -> bytes:
    return (ieee_to_ibm(x).astype(">u4") if fmt == 1 else np.asarray(x).astype(">f4")).tobytes()


def file_head(n: int, interval: int, fmt: int, old: bytes | None = None) -> bytes:
    """A file's headers: those of another file, or blank ones, in EBCDIC, with the given numbers."""
    head = bytearray(old or b"\x40" * 3200 + bytes(400))
    for at, value in ((16, interval), (20, n), (24, fmt)):
        struct.pack_into(">H", head, 3200 + at, value)
    return bytes(head)


def text_heads(text: str, extended: list[str]) -> bytes:
    """Headers with the given texts, each 3200 characters at most."""
    pages = [t.ljust(3200)[:3200].encode("cp500", "replace") for t in (text, *extended)]
    binary = bytearray(400)
    struct.pack_into(">h", binary, 304, len(extended))
    return pages[0] + bytes(binary) + b"".join(pages[1:])


def packed_heads(batch: pa.RecordBatch, first: int, n: int, interval: int) -> np.ndarray:
    """The trace headers of a batch (traces by bytes), numbered from ``first``."""
    rows = batch.num_rows
    heads, number = np.zeros((rows, TRACE_HEAD), np.uint8), np.arange(first, first + rows)
    own = {"TRACE_SEQUENCE_LINE": number, "TRACE_SEQUENCE_FILE": number, "TRACE_SAMPLE_COUNT": np.full(rows, n), "TRACE_SAMPLE_INTERVAL": np.full(rows, interval)}
    for h, (at, width) in HEADERS.items():
        if h not in own and h not in batch.schema.names:
            continue
        values = own[h] if h in own else np.trunc(batch.column(h).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        kind = ">i4" if width == 4 else ">u2" if "SAMPLE" in h else ">i2"
        bounds = np.iinfo(np.dtype(kind))
        if len(values) and (values.min() < bounds.min or values.max() > bounds.max):
            raise ValueError(f"{h} holds numbers that don't fit into {width} bytes")
        heads[:, at - 1 : at - 1 + width] = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(rows, width)
    return heads


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class SegyWriter(DataSourceArrowWriter):
    """Writes each partition as ``<name>-<time of the job>-<number>.sgy``, so that appended files come after those before them; traces
    are numbered from 1 in every file. Overwriting removes the files of that name that were there, once the new ones are complete.
    Files are written where all tasks mount the path."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.interval, self.format = int(float(options.get("sample_interval", 2.0)) * 1000), int(options.get("sample_format", 5))
        self.name, self.job, self.overwrite, self.began = options.get("name", "part"), uuid.uuid4().hex, overwrite, time.time_ns()
        self.old = text_heads(options.get("text", ""), [t for t in options.get("extended", "").split("\f") if t]) if "text" in options or "extended" in options else None
        if "parent" in options:
            parent = named(options["parent"])
            if not parent:
                raise ValueError(f"no such parent: {options['parent']}")
            self.old = ranged(parent[0], 0, layout(parent[0], ">")[4])
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches):
        path, out, n, number = os.path.join(self.path, f".{self.name}-{uuid.uuid4().hex}.{self.job}"), None, 0, 1
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column("data")
            lengths = np.diff(data.offsets.to_numpy())
            if out is None:
                out, n = open(path, "wb"), int(lengths[0])
                out.write(file_head(n, self.interval, self.format, self.old))
            if (lengths != n).any() or data.null_count:
                raise ValueError("traces of one file are of equal length")
            x = data.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, n)
            bodies = np.frombuffer(encoded(x, self.format), np.uint8).reshape(batch.num_rows, -1)
            out.write(np.concatenate([packed_heads(batch, number, n, self.interval), bodies], 1).tobytes())
            number += batch.num_rows
        if out:
            out.close()
        return _Written(path if out else None)

    def commit(self, messages):
        old = glob.glob(os.path.join(glob.escape(self.path), f"{glob.escape(self.name)}-*.sgy")) if self.overwrite else []
        for i, m in enumerate(m for m in messages if m and m.path):
            os.rename(m.path, os.path.join(self.path, f"{self.name}-{self.began:020}-{i:05}.sgy"))
        for path in old:
            os.remove(path)

    def abort(self, messages):
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class SegySource(DataSource):
    @classmethod
    def name(cls):
        return "segy"

    def _headers(self):
        asked = self.options.get("headers", "all")
        names = [h for h in HEADERS if h not in NUMBERED] if asked == "all" else [h.strip() for h in asked.split(",")]
        if missing := set(names) - set(HEADERS):
            raise ValueError(f"no such headers: {sorted(missing)}")
        return names

    def _data(self):
        return self.options.get("data", "true").lower() == "true"

    def schema(self):
        return "file string, TRACE_SEQUENCE_FILE long" + "".join(f", {h} int" for h in self._headers()) + (", data array<float>" if self._data() else "")

    def reader(self, schema):
        return SegyReader(self.options, self._headers(), self._data())

    def writer(self, schema, overwrite):
        return SegyWriter(self.options, schema, overwrite)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SegyFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(p for part in options["path"].split(",") for p in named(part))
        self.order = "<" if options.get("endian", "big") == "little" else ">"

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, part):
        traces, n, interval, fmt, first = layout(part.path, self.order)
        head = ranged(part.path, 0, first)
        yield part.path, traces, n, interval / 1000, fmt, head[:3200].decode("cp500"), bytes(head[3200:3600]), [bytes(head[at : at + 3200]) for at in range(HEAD, first, 3200)], [head[at : at + 3200].decode("cp500") for at in range(HEAD, first, 3200)]


class SegyFiles(DataSource):
    """A row for each file: what it holds, and its headers."""

    @classmethod
    def name(cls):
        return "segy_files"

    def schema(self):
        return "file string, n_traces long, n_samples int, sample_interval double, sample_format int, text string, binary binary, extended array<binary>, extended_text array<string>"

    def reader(self, schema):
        return SegyFilesReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(SegySource)
    spark.dataSource.register(SegyFiles)


#: Traces that one task copies when files are aggregated.
COPIED = 25_000


def aggregate(spark, path: str, out: str, name: str = "part", sample_format: int | None = None) -> None:
    """All files of a glob as one below ``out``, traces numbered through; files have to agree on interval and length. Inputs are kept.

    Every trace has its place in the new file from the start, so tasks copy ranges of traces to their places side by side, with
    headers as they are; a range that is copied again is written over with the same bytes. The file gets its name at the end.
    """
    paths = sorted(glob.glob(path.removeprefix("file://")))
    kinds = [layout(p, ">") for p in paths]
    if len({k[1:3] for k in kinds}) != 1:
        raise ValueError(f"files differ in number of samples or interval: {sorted({k[1:3] for k in kinds})}")
    n, interval, fmt = kinds[0][1], kinds[0][2], sample_format or kinds[0][3]
    out = out.removeprefix("file://")
    os.makedirs(out, exist_ok=True)
    part, made, size = os.path.join(out, f".{name}-{uuid.uuid4().hex}"), os.path.join(out, f"{name}-{time.time_ns():020}-00000.sgy"), TRACE_HEAD + n * WIDTH[fmt]
    with open(part, "wb") as f:
        f.write(file_head(n, interval, fmt))
        f.truncate(HEAD + size * sum(k[0] for k in kinds))
    ranges, before = [], 0
    for p, (count, _, _, kind, head) in zip(paths, kinds):
        ranges += [(p, kind, a, min(a + COPIED, count), before + a, head) for a in range(0, count, COPIED)]
        before += count

    def copy(batches):
        for batch in batches:
            for source, kind, first, last, place, head in zip(*(batch.column(i).to_pylist() for i in range(6))):
                old = TRACE_HEAD + n * WIDTH[kind]
                with open(part, "r+b") as f:
                    f.seek(HEAD + place * size)
                    for at in range(first, last, 2000):
                        raw = np.memmap(source, np.uint8, "r", head + at * old, (min(2000, last - at), old))
                        heads = raw[:, :TRACE_HEAD].copy()
                        numbers = np.arange(place + at - first + 1, place + at - first + 1 + len(raw)).astype(">i4").view(np.uint8).reshape(-1, 4)
                        heads[:, :4] = heads[:, 4:8] = numbers
                        bodies = raw[:, TRACE_HEAD:] if kind == fmt else np.frombuffer(encoded(decoded(raw[:, TRACE_HEAD:], kind, ">"), fmt), np.uint8).reshape(len(raw), -1)
                        f.write(np.concatenate([heads, bodies], 1).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([last - first], pa.int64())], ["copied"])

    if ranges:
        asked = spark.createDataFrame(ranges, "path string, kind int, first long, last long, place long, head long").repartition(len(ranges))
        copied = asked.mapInArrow(copy, "copied long").groupBy().sum("copied").first()[0]
        if copied != before:
            raise RuntimeError(f"{copied} of {before} traces were copied")
    os.rename(part, made)
