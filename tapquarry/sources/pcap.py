"""Classic capture files as a Spark data source, `spark.read.format("pcap").load(path)`.

Paths are local or URIs that Arrow's file systems open (file, hdfs, s3, gs). A capture is named by its path. Records have
no index, so files over `split_bytes` are cut at record starts that a pass over the record headers finds. Options:
mode=tolerant (a partial last record ends the file and sets the flag) or strict (it is an error);
view=frames or captures (a row per file with its facts); ts_source=replay, kernel or hardware, where the stamps were
made; require_hardware=true refuses captures whose stamps do not come from hardware.
"""

from __future__ import annotations

import io
import struct

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Magic numbers as read little-endian -> (byte order, ns per unit of the fraction).
MAGICS = {0xA1B2C3D4: ("<", 1000), 0xD4C3B2A1: (">", 1000), 0xA1B23C4D: ("<", 1), 0x4D3CB2A1: (">", 1)}
NG_MAGIC = 0x0A0D0D0A
MAX_FRAME = 262_144
READ = 1 << 20
SPLIT = 256 << 20
SOURCES = ("replay", "kernel", "hardware")

FRAMES = "capture_id string, frame_no long, tap_ts_ns long, incl_len int, orig_len int, raw binary, ts_source string"
CAPTURES = "capture_id string, byte_order string, nanoseconds boolean, frames long, truncated_frames long, ended_mid_record boolean, format_error string, record_error string"
FRAMES_ARROW = pa.schema([("capture_id", pa.string()), ("frame_no", pa.int64()), ("tap_ts_ns", pa.int64()), ("incl_len", pa.int32()), ("orig_len", pa.int32()), ("raw", pa.binary()), ("ts_source", pa.string())])


class CaptureError(ValueError):
    """kind: format (not a capture that can be read), io or truncated (a file header cut short, tolerant or strict),
    truncated (a record cut short, strict), length, or policy."""

    def __init__(self, kind: str, detail: str):
        super().__init__(f"{kind}: {detail}")
        self.kind, self.detail = kind, detail


class CaptureFile:
    """Iterates (ts_ns, incl, orig, bytes); facts are complete when it ends. Memory: a buffer and one frame.

    With a size, `hops` goes over the record headers alone.
    """

    def __init__(self, stream, mode: str = "tolerant", size: int | None = None):
        self.stream, self.strict, self.size = stream, mode == "strict", size
        self.frames = self.truncated = 0
        self.ended_mid_record, self.offset = False, 24
        head = self.stream.read(24)
        if len(head) < 24:
            raise CaptureError("truncated" if self.strict else "io", f"{len(head)} bytes are no file header")
        magic = struct.unpack("<I", head[:4])[0]
        if magic == NG_MAGIC:
            raise CaptureError("format", "next-generation captures are not read")
        if magic not in MAGICS:
            raise CaptureError("format", f"magic {magic:#010x}")
        self.order, self.unit = MAGICS[magic]

    def start_at(self, offset: int):
        self.stream.seek(offset)
        self.offset = offset

    def __iter__(self):
        return self.records()

    def records(self, stop: int | None = None, bodies: bool = True):
        """Records that start before `stop`."""
        while stop is None or self.offset < stop:
            head = self.stream.read(16)
            if not head:
                return
            if len(head) < 16:
                return self._partial(f"record header cut at {self.offset}")
            sec, frac, incl, orig = struct.unpack(self.order + "IIII", head)
            if incl > MAX_FRAME:
                raise CaptureError("length", f"record of {incl} bytes at {self.offset}")
            raw = self.stream.read(incl) if bodies else None
            there = len(raw) if bodies else min(incl, self.size - self.offset - 16)
            if there < incl:
                return self._partial(f"record claims {incl} bytes, {there} are there")
            if not bodies:
                self.stream.seek(incl, 1)
            self.offset += 16 + incl
            self.frames += 1
            self.truncated += incl < orig
            yield sec * 1_000_000_000 + frac * self.unit, incl, orig, raw

    def hops(self):
        for _ in self.records(bodies=False):
            yield self.offset

    def _partial(self, why):
        if self.strict:
            raise CaptureError("truncated", why)
        self.ended_mid_record = True


def located(path: str):
    """The file system of a path or URI, and the path there."""
    return filesystems.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (filesystems.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int, int]]:
    """(path, size, modified ns) of a file, of a folder's files, or of those that a pattern in the last part of the path names."""
    import fnmatch

    fs, at = located(path)
    folder, _, last = at.rstrip("/").rpartition("/")
    info = fs.get_file_info(at)
    if info.type == filesystems.FileType.File:
        found = [info]
    elif info.type == filesystems.FileType.Directory:
        found = fs.get_file_info(filesystems.FileSelector(at))
    else:
        found = [x for x in fs.get_file_info(filesystems.FileSelector(folder or ".", allow_not_found=True)) if fnmatch.fnmatch(x.base_name, last)]
        if not found and not any(c in last for c in "*?["):
            raise FileNotFoundError(path)
    lead = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((lead + x.path, x.size, x.mtime_ns or 0) for x in found if x.type == filesystems.FileType.File and not x.base_name.startswith((".", "_")))


def opened(path: str):
    fs, at = located(path)
    return io.BufferedReader(fs.open_input_file(at), READ)


class FilePartition(InputPartition):
    """Records of a file that start in [start, stop), numbered from `first`."""

    def __init__(self, path, start=24, stop=None, first=0, size=0):
        self.path, self.start, self.stop, self.first, self.size = path, start, stop, first, size


def parts_of(path: str, size: int, split: int) -> list[FilePartition]:
    if size <= split:
        return [FilePartition(path, size=size)]
    cuts, next_cut, number = [(24, 0)], split, 0
    with opened(path) as f:
        try:
            for offset in CaptureFile(f, size=size).hops():
                number += 1
                if offset >= next_cut:
                    cuts.append((offset, number))
                    next_cut = offset + split
        except CaptureError:
            pass  # the task that meets it says so
    stops = [c[0] for c in cuts[1:]] + [None]
    return [FilePartition(path, start, stop, first, size) for (start, first), stop in zip(cuts, stops, strict=True)]


def frame_batches(part: FilePartition, mode: str, source: str):
    """Arrow batches of some MB. A record that cannot be read ends the file; what came before stays, unless strict."""
    rows, size = [], 0
    with opened(part.path) as f:
        try:
            capture = CaptureFile(f, mode)
            if part.start != 24:
                capture.start_at(part.start)
            for i, (ts, incl, orig, raw) in enumerate(capture.records(part.stop), part.first):
                rows.append((part.path, i, ts, incl, orig, raw, source))
                size += incl
                if size > 4 * READ or len(rows) >= 50_000:
                    yield to_batch(rows)
                    rows, size = [], 0
        except CaptureError:
            if mode == "strict":
                raise
    if rows:
        yield to_batch(rows)


def to_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FRAMES_ARROW.types, strict=True)], schema=FRAMES_ARROW)


def capture_row(part: FilePartition, mode: str):
    with opened(part.path) as f:
        try:
            c = CaptureFile(f, mode, part.size)
        except CaptureError as e:
            return (part.path, None, None, 0, 0, False, e.detail, None)
        error = None
        try:
            for _ in c.hops():
                pass
        except CaptureError as e:
            error = e.detail
        return (part.path, "little" if c.order == "<" else "big", c.unit == 1, c.frames, c.truncated, c.ended_mid_record, None, error)


class PcapReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode, self.view = options["path"], options.get("mode", "tolerant"), options.get("view", "frames")
        self.split, self.source = int(options.get("split_bytes", SPLIT)), source_of(options)

    def partitions(self):
        if self.view == "captures":
            return [FilePartition(path, size=size) for path, size, _ in files_of(self.path)]
        return [x for path, size, _ in files_of(self.path) for x in parts_of(path, size, self.split)]

    def read(self, partition):
        if self.view == "captures":
            yield capture_row(partition, self.mode)
        else:
            yield from frame_batches(partition, self.mode, self.source)


class PcapStreamReader(DataSourceStreamReader):
    """Files that land in a folder; a micro-batch takes those that are new, whatever their names.

    The offset holds the latest time of modification taken, and the files of just that time.
    """

    def __init__(self, options):
        self.path, self.mode, self.source = options["path"], options.get("mode", "tolerant"), source_of(options)

    def initialOffset(self):
        return {"time": -1, "paths": []}

    def latestOffset(self):
        found = files_of(self.path)
        time = max([t for *_, t in found], default=-1)
        return {"time": time, "paths": [p for p, _, t in found if t == time]}

    def partitions(self, start, end):
        new = [x for x in files_of(self.path) if x[2] > start["time"] or (x[2] == start["time"] and x[0] not in start["paths"])]
        return [FilePartition(p, size=size) for p, size, t in new if t < end["time"] or (t == end["time"] and p in end["paths"])]

    def read(self, partition):
        yield from frame_batches(partition, self.mode, self.source)


class PcapSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return CAPTURES if self.options.get("view") == "captures" else FRAMES

    def reader(self, schema):
        return PcapReader(self.options)

    def streamReader(self, schema):
        return PcapStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def write_capture(path: str, records, big_endian: bool = False, nanoseconds: bool = False) -> None:
    """records: (ts_ns, frame bytes, original length or None)."""
    order, magic = (">" if big_endian else "<"), 0xA1B23C4D if nanoseconds else 0xA1B2C3D4
    fs, at = located(path)
    with fs.open_output_stream(at) as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, MAX_FRAME, 1))
        for ts, raw, orig in records:
            sec, rest = divmod(ts, 1_000_000_000)
            f.write(struct.pack(order + "IIII", sec, rest if nanoseconds else rest // 1000, len(raw), len(raw) if orig is None else orig) + raw)


def write_captures(frames, folder: str) -> None:
    """A file capture-<capture_id>.pcap in a folder all executors share for each capture, its frames in order.

    Rows of a capture stream through one sorted task, so its memory is one batch."""
    schema = pa.schema([("path", pa.string())])

    def write(batches):
        held, out = None, None
        for batch in batches:
            for capture, ts, raw, orig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if capture != held:
                    if out is not None:
                        out.close()
                    fs, at = located(f"{folder}/capture-{capture}.pcap")
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    held, out = capture, fs.open_output_stream(at, buffer_size=READ)
                    out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, MAX_FRAME, 1))
                sec, rest = divmod(ts, 1_000_000_000)
                out.write(struct.pack("<IIII", sec, rest // 1000, len(raw), orig) + raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([held])], schema=schema)

    rows = frames.select("capture_id", "frame_no", "tap_ts_ns", "raw", "orig_len").repartition("capture_id").sortWithinPartitions("capture_id", "frame_no")
    rows.select("capture_id", "tap_ts_ns", "raw", "orig_len").mapInArrow(write, "path string").count()


def source_of(options) -> str:
    """Where the stamps come from; refused where hardware is required and they do not."""
    source = options.get("ts_source", "replay")
    if source not in SOURCES:
        raise CaptureError("policy", f"unknown source of timestamps {source}")
    if str(options.get("require_hardware", "false")).lower() == "true" and source != "hardware":
        raise CaptureError("policy", f"timestamps come from {source}, not from hardware")
    return source
