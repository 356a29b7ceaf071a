"""EDF / EDF+ as a Spark data source (SRC2-SRC4, FLT11).

``spark.read.format("edf").option("mode", ...).load(path)`` with modes

* ``signal``: one row per block of data records of ``option("channel")``, in
  micro-volts: ``path, channel, block_idx, start_sample, samples``;
* ``moments``: one row per few megabytes of ``option("channel")``, the partial statistics
  ``path, channel, n, mean, m2`` (sum of squared deviations), so that statistics over whole
  files need no samples outside the scan;
* ``header``: one row per channel: ``path, channel, sfreq, n_samples, block_len``;
* ``annotations``: one row per annotation: ``path, ann_no, onset, duration, description``.

The format has fixed-size data records behind a header, so a file is read in
independent byte ranges: planning only lists files and sizes, ranges of large
files become separate partitions and small files share one. A task reads the
header of its file, then just the records that begin in its range.

With ``option("pushFilters", "true")`` filters are taken over from Spark: on ``path`` no other file is
opened, on ``block_idx`` and ``start_sample`` no other record is read, on ``channel`` other rows of the
header are left out. It is off by default, as Spark keeps what was pushed with the loaded table: load
such a frame anew for each filter, and do not use it in two branches of a plan.

Options: ``channel``; ``recordsPerBlock`` (data records per block row, 1);
``splitBytes`` (largest partition, 64 MB); ``minPartitions``; ``glob`` (file name pattern, ``*.edf``).

:func:`read_listed` reads the files that a table names, in the same modes. It
lists nothing: sizes and byte ranges are found by tasks, a missing file is an
error, and a file that the table does not name is not touched.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

# --- fixed values: layout published with the format ------------------------
MAIN_HEADER = [
    ("version", 8),
    ("patient", 80),
    ("recording", 80),
    ("date", 8),
    ("time", 8),
    ("header_bytes", 8),
    ("reserved", 44),
    ("n_records", 8),
    ("record_sec", 8),
    ("n_signals", 4),
]
SIGNAL_HEADER = [
    ("label", 16),
    ("transducer", 80),
    ("unit", 8),
    ("physical_min", 8),
    ("physical_max", 8),
    ("digital_min", 8),
    ("digital_max", 8),
    ("prefilter", 80),
    ("samples", 8),
    ("reserved", 32),
]
ANNOTATION_LABEL = "EDF Annotations"
# micro-volts per unit; other units are passed through unscaled
MICROVOLTS = {"uV": 1.0, "µV": 1.0, "mV": 1e3, "V": 1e6}

_MAIN_BYTES = sum(width for _, width in MAIN_HEADER)
_RECORDS_AT = slice(236, 244)  # where the main header declares the number of data records
_SIGNAL_BYTES = sum(width for _, width in SIGNAL_HEADER)
_LEAST_SPLIT = 1024 * 1024
_READ_BYTES = 4 * 1024 * 1024  # one read, and one Arrow batch, of a file
_ANN_PER_RECORD_BITS = 32  # ann_no = record << 32 | position; a record has fewer bytes than that

SCHEMAS = {
    "signal": "path string, channel string, block_idx bigint, start_sample bigint, "
    "samples array<double>",
    "moments": "path string, channel string, n bigint, mean double, m2 double",
    "header": "path string, channel string, sfreq double, n_samples bigint, block_len bigint",
    "annotations": "path string, ann_no bigint, onset double, duration double, "
    "description string",
}


@dataclass(frozen=True)
class Header:
    offset: int
    n_records: int
    record_sec: float
    signals: list[dict]

    @property
    def record_samples(self) -> int:
        return sum(s["samples"] for s in self.signals)

    def position(self, index: int) -> slice:
        """Where one signal's samples lie within a record of 16-bit values."""
        start = sum(s["samples"] for s in self.signals[:index])
        return slice(start, start + self.signals[index]["samples"])


def read_header(handle, size: int) -> Header:
    """Parse the fixed-width text header at the start of an open file."""
    raw = handle.read(_MAIN_BYTES)
    main, at = {}, 0
    for name, width in MAIN_HEADER:
        main[name] = raw[at : at + width].decode("latin-1").strip()
        at += width
    count = int(main["n_signals"])
    raw = handle.read(_SIGNAL_BYTES * count)
    columns, at = {}, 0
    for name, width in SIGNAL_HEADER:
        columns[name] = [
            raw[at + i * width : at + (i + 1) * width].decode("latin-1").strip()
            for i in range(count)
        ]
        at += width * count
    signals = [
        {
            "label": columns["label"][i],
            "unit": columns["unit"][i],
            "samples": int(columns["samples"][i]),
            "scale": [
                float(columns[f][i] or 0)
                for f in ("physical_min", "physical_max", "digital_min", "digital_max")
            ],
        }
        for i in range(count)
    ]
    offset = int(main["header_bytes"])
    record_bytes = 2 * sum(s["samples"] for s in signals)
    whole = (size - offset) // record_bytes if record_bytes else 0
    declared = int(main["n_records"])
    return Header(
        offset, whole if declared < 0 else min(declared, whole), float(main["record_sec"]), signals
    )


def to_microvolts(digital: np.ndarray, signal: dict) -> np.ndarray:
    """FN3: the linear digital-to-physical map, in micro-volts."""
    physical_min, physical_max, digital_min, digital_max = signal["scale"]
    gain = (physical_max - physical_min) / (digital_max - digital_min)
    physical = (digital.astype(float) - digital_min) * gain + physical_min
    return physical * MICROVOLTS.get(signal["unit"], 1.0)


def parse_annotations(raw: bytes):
    """(onset, duration, text) of every non-empty text in one record's annotation bytes."""
    for entry in raw.split(b"\x00"):
        stamp, *texts = entry.split(b"\x14")
        onset, _, duration = stamp.partition(b"\x15")
        for text in texts:
            if text:
                yield float(onset), float(duration or 0), text.decode("utf-8", "replace")


@dataclass
class FileRanges(InputPartition):
    """Byte ranges ``(path, size, begin, end)`` one task reads."""

    ranges: list


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it.

    ``file:`` in any form and paths without a scheme are local; the names that
    Hadoop gives to S3 are those of one store.
    """
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, found, rest = path.partition("://")
    if not found:
        return fs.LocalFileSystem(), path
    if scheme in ("s3a", "s3n"):
        path = f"s3://{rest}"
    return fs.FileSystem.from_uri(path)


def _list_files(path: str, pattern: str) -> list[tuple[str, int]]:
    filesystem, root = resolve(path)
    info = filesystem.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {path}")
    if info.type == fs.FileType.Directory:
        found = filesystem.get_file_info(fs.FileSelector(root, recursive=True))
    else:
        found, pattern = [info], "*"
    files = [
        (f.path, f.size)
        for f in found
        if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)
    ]
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file") else ""
    return sorted((prefix + name, size) for name, size in files)


def _open(path: str):
    filesystem, name = resolve(path)
    return filesystem.open_input_file(name)


# what a filter asks of a text, and which bounds it sets for a whole number
_TEXT_TESTS = {
    EqualTo: lambda text, wanted: text == wanted,
    EqualNullSafe: lambda text, wanted: text == wanted,
    In: lambda text, wanted: text in wanted,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: lambda text, wanted: wanted in text,
}
_LOWEST = {EqualTo: 0, EqualNullSafe: 0, GreaterThanOrEqual: 0, GreaterThan: 1}
_HIGHEST = {EqualTo: 0, EqualNullSafe: 0, LessThanOrEqual: 0, LessThan: -1}
_NO_BOUNDS = (0, 2**62)


class EdfReader(DataSourceReader):
    def __init__(self, options: dict, mode: str):
        self.mode = mode
        self.path = options["path"]
        self.pattern = options.get("glob", "*.edf")
        self.channel = options.get("channel")
        self.per_block = int(options.get("recordsperblock", 1))
        self.split_bytes = int(options.get("splitbytes", 64 * 1024 * 1024))
        self.min_partitions = int(options.get("minpartitions", 1))
        self.push = options.get("pushfilters", "false").lower() == "true"
        self.text_tests: list[tuple[str, type, object]] = []
        self.bounds = {"block_idx": _NO_BOUNDS, "start_sample": _NO_BOUNDS}
        if mode in ("signal", "moments") and not self.channel:
            raise ValueError(f"mode {mode!r} needs option 'channel'")

    def pushFilters(self, filters):
        """Takes what names of files and channels and places of samples decide; the rest is Spark's."""
        if not self.push:
            yield from filters
            return
        for each in filters:
            column, value = each.attribute[0] if hasattr(each, "attribute") else None, getattr(each, "value", None)
            if column in ("path", "channel") and type(each) in _TEXT_TESTS:
                self.text_tests.append((column, type(each), value))
            elif column in self.bounds and type(each) in _LOWEST | _HIGHEST and type(value) is int:
                low, high = self.bounds[column]
                if type(each) in _LOWEST:
                    low = max(low, value + _LOWEST[type(each)])
                if type(each) in _HIGHEST:
                    high = min(high, value + _HIGHEST[type(each)])
                self.bounds[column] = (low, high)
            elif not (column in ("path", "channel", *self.bounds) and isinstance(each, IsNotNull)):
                yield each

    def _wanted(self, column: str, text: str) -> bool:
        return all(_TEXT_TESTS[kind](text, value) for of, kind, value in self.text_tests if of == column)

    def partitions(self):
        if self.mode in ("signal", "moments") and not self._wanted("channel", self.channel):
            return [FileRanges([])]
        files = [f for f in _list_files(self.path, self.pattern) if self._wanted("path", f[0])]
        # small inputs are still spread over the cores, down to _LEAST_SPLIT
        even = sum(size for _, size in files) // self.min_partitions
        split_bytes = min(self.split_bytes, max(even, _LEAST_SPLIT))
        packed, room = [], 0
        for path, size in files:
            step = size if self.mode == "header" else split_bytes
            for begin in range(0, max(size, 1), max(step, 1)):
                end = min(begin + step, size)
                cost = 64 * 1024 if self.mode == "header" else end - begin
                if not packed or cost > room:
                    packed.append(FileRanges([]))
                    room = split_bytes
                packed[-1].ranges.append((path, size, begin, end))
                room -= cost
        return packed or [FileRanges([])]

    def read(self, partition):
        rows = {
            "signal": self._signal,
            "moments": self._moments,
            "header": self._header,
            "annotations": self._annotations,
        }[self.mode]
        for path, size, begin, end in partition.ranges:
            with _open(path) as handle:
                try:
                    header = read_header(handle, size)
                except (ValueError, IndexError) as error:
                    raise ValueError(f"could not read {path} as EDF: {error}") from error
                yield from rows(path, handle, header, begin, end)

    def _header(self, path, handle, header, begin, end):
        for signal in header.signals:
            if signal["label"] != ANNOTATION_LABEL and self._wanted("channel", signal["label"]):
                rate = signal["samples"] / header.record_sec if header.record_sec else 0.0
                yield (
                    path,
                    signal["label"],
                    rate,
                    signal["samples"] * header.n_records,
                    signal["samples"] * self.per_block,
                )

    def _owned(self, header: Header, begin: int, end: int, per_block: int) -> range:
        """Blocks whose first byte lies in this range of the file."""
        block_bytes = 2 * header.record_samples * per_block
        total = -(-header.n_records // per_block)
        if not block_bytes:
            return range(0)

        def first_at(byte: int) -> int:
            return min(total, max(0, -(-(byte - header.offset) // block_bytes)))

        return range(first_at(begin), first_at(end))

    def _signal(self, path, handle, header, begin, end):
        for blocks, width, samples in self._chunks(path, handle, header, begin, end):
            # the last block of a file may be shorter
            offsets = np.minimum(np.arange(len(blocks) + 1) * width, len(samples))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * len(blocks)),
                    pa.array([self.channel] * len(blocks)),
                    pa.array(blocks, pa.int64()),
                    pa.array(np.asarray(blocks, dtype=np.int64) * width),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(samples)),
                ],
                names=["path", "channel", "block_idx", "start_sample", "samples"],
            )

    def _moments(self, path, handle, header, begin, end):
        for _, _, samples in self._chunks(path, handle, header, begin, end):
            mean = samples.mean()
            spread = np.square(samples - mean).sum()
            yield (path, self.channel, len(samples), float(mean), float(spread))

    def _chunks(self, path, handle, header, begin, end):
        """(block numbers, samples per block, samples) of the wanted channel, read by read."""
        labels = [s["label"] for s in header.signals]
        if self.channel not in labels:
            raise ValueError(f"channel {self.channel!r} not found in {path}; available: {labels}")
        index = labels.index(self.channel)
        signal, place = header.signals[index], header.position(index)
        owned = self._owned(header, begin, end, self.per_block)
        width = max(1, self.per_block * signal["samples"])
        (low, high), (first, last) = self.bounds["block_idx"], self.bounds["start_sample"]
        owned = range(max(owned.start, low, -(-first // width)), min(owned.stop, high + 1, last // width + 1))
        at_once = max(1, _READ_BYTES // (2 * header.record_samples * self.per_block))
        for start in range(owned.start, owned.stop, at_once):
            blocks = range(start, min(start + at_once, owned.stop))
            first = start * self.per_block
            count = min(len(blocks) * self.per_block, header.n_records - first)
            digital = self._records(handle, header, first, count)[:, place].reshape(-1)
            yield blocks, self.per_block * signal["samples"], to_microvolts(digital, signal)

    def _annotations(self, path, handle, header, begin, end):
        places = [
            header.position(i)
            for i, s in enumerate(header.signals)
            if s["label"] == ANNOTATION_LABEL
        ]
        owned = self._owned(header, begin, end, 1)
        at_once = max(1, _READ_BYTES // max(1, 2 * header.record_samples))
        for start in range(owned.start, owned.stop, at_once):
            count = min(at_once, owned.stop - start)
            for at, values in enumerate(self._records(handle, header, start, count)):
                number = (start + at) << _ANN_PER_RECORD_BITS
                for place in places:
                    for onset, duration, text in parse_annotations(values[place].tobytes()):
                        yield (path, number, onset, duration, text)
                        number += 1

    @staticmethod
    def _records(handle, header: Header, first: int, count: int) -> np.ndarray:
        handle.seek(header.offset + 2 * header.record_samples * first)
        raw = handle.read(2 * header.record_samples * count)
        return np.frombuffer(raw, dtype="<i2").reshape(count, header.record_samples)


_EPOCHS_PER_READ = 64
_SLICE_BYTES = 128 * 1024 * 1024  # of samples produced per task


def _runs(paths: list[str], starts: list[int], length: int):
    """Row ranges of one file whose epochs follow each other closely enough for one read."""
    begin = 0
    for row in range(1, len(paths) + 1):
        if (
            row == len(paths)
            or row - begin == _EPOCHS_PER_READ
            or paths[row] != paths[begin]
            or starts[row] > starts[row - 1] + 2 * length
        ):
            yield begin, row
            begin = row


def _read_epochs(handle, header: Header, channel: str, starts: np.ndarray, length: int):
    """The epochs at ``starts`` (ascending) as a matrix, from one read of whole records."""
    index = [s["label"] for s in header.signals].index(channel)
    signal, place = header.signals[index], header.position(index)
    first = int(starts[0]) // signal["samples"]
    stop = -(-(int(starts[-1]) + length) // signal["samples"])
    digital = EdfReader._records(handle, header, first, stop - first)[:, place].reshape(-1)
    rows = (starts - first * signal["samples"])[:, None] + np.arange(length)
    return to_microvolts(digital, signal)[rows]


def read_slices(plan: DataFrame, channel: str, length: int) -> DataFrame:
    """J3 at the source: ``plan`` rows (``path``, ``start_sample``) with their ``samples``.

    Tasks read the byte ranges their plan rows ask for, so the small plan is
    shuffled and the signal is not. Rows of a file are spread over tasks by
    position; the number of tasks follows from the volume of samples, as plan
    rows say nothing about it to Spark. Every row must lie within its file.
    ``plan`` should be a written table: it is counted first.
    """
    spark = plan.sparkSession
    volume = plan.count() * length * 8
    tasks = max(spark.sparkContext.defaultParallelism, -(-volume // _SLICE_BYTES))
    stretch = F.floor(F.col("start_sample") / (length * _EPOCHS_PER_READ))
    placed = plan.repartition(tasks, "path", stretch).sortWithinPartitions("path", "start_sample")
    names = plan.columns

    def read(batches):
        path, handle, header = None, None, None
        for batch in batches:
            paths = batch.column(names.index("path")).to_pylist()
            starts = batch.column(names.index("start_sample")).to_pylist()
            for begin, end in _runs(paths, starts, length):
                if paths[begin] != path:
                    if handle:
                        handle.close()
                    path = paths[begin]
                    handle = _open(path)
                    header = read_header(handle, handle.size())
                wanted = np.asarray(starts[begin:end], dtype=np.int64)
                samples = _read_epochs(handle, header, channel, wanted, length)
                offsets = pa.array(np.arange(end - begin + 1, dtype=np.int32) * length)
                lists = pa.ListArray.from_arrays(offsets, pa.array(samples.reshape(-1)))
                rows = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*names, "samples"])
        if handle:
            handle.close()

    schema = T.StructType([*plan.schema, T.StructField("samples", T.ArrayType(T.DoubleType()))])
    return placed.mapInArrow(read, schema)


class EdfDataSource(DataSource):
    @classmethod
    def name(cls):
        return "edf"

    def _mode(self) -> str:
        mode = self.options.get("mode", "signal")
        if mode not in SCHEMAS:
            raise ValueError(f"unknown mode {mode!r}; expected one of {sorted(SCHEMAS)}")
        return mode

    def schema(self):
        return SCHEMAS[self._mode()]

    def reader(self, schema):
        return EdfReader(dict(self.options), self._mode())


def read_listed(paths: DataFrame, mode: str, **options) -> DataFrame:
    """The files that ``paths`` (column ``path``) names, in one of the modes above.

    Tasks find the sizes and split them into byte ranges; the ranges are dealt
    out to tasks, so a long file is read by many. Paths come out as they went
    in. A file that cannot be opened or read raises an error naming it.
    """
    reader = EdfReader({"path": "", **{k.lower(): str(v) for k, v in options.items()}}, mode)
    whole = mode == "header"

    def ranges(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with _open(path) as handle:
                    size = handle.size()
                step = size if whole else reader.split_bytes
                rows += [
                    {"path": path, "size": size, "begin": begin, "end": min(begin + step, size)}
                    for begin in range(0, max(size, 1), max(step, 1))
                ]
            yield pa.RecordBatch.from_pylist(rows, schema=_RANGES)

    names = [field.strip().split()[0] for field in SCHEMAS[mode].split(",")]

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = FileRanges([(row["path"], row["size"], row["begin"], row["end"])])
                rows = []
                for item in reader.read(part):
                    if isinstance(item, pa.RecordBatch):
                        yield item
                    else:
                        rows.append(item)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    spread = paths.select("path").distinct().mapInArrow(
        ranges, "path string, size bigint, begin bigint, end bigint"
    )
    if not whole:
        spread = spread.repartition("path", "begin")
    return spread.mapInArrow(read, SCHEMAS[mode])


def file_facts(paths: DataFrame) -> DataFrame:
    """``path, size, modified`` of the files that ``paths`` names, null where there is none; none is opened."""

    def look(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                info = _info(path)
                rows.append(
                    {"path": path, "size": info.size if info else None, "modified": info.mtime_ns if info else None}
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_FACTS)

    return paths.select("path").distinct().mapInArrow(look, "path string, size bigint, modified bigint")


def _info(path: str | None):
    """Facts about a file, or None if there is no such file."""
    if path is None:
        return None
    filesystem, name = resolve(path)
    info = filesystem.get_file_info(name)
    return info if info.type == fs.FileType.File else None


def _fault(path: str | None, channel: str | None, sample_rate: int | None) -> tuple[str, str] | None:
    """Why a file cannot be used: (reason, detail), or None if it can."""
    info = _info(path)
    if info is None:
        return "missing", "no such file"
    try:
        with _open(path) as handle:
            main = handle.read(_MAIN_BYTES)
            handle.seek(0)
            header = read_header(handle, info.size)
        declared = int(main[_RECORDS_AT])
    except (ValueError, IndexError, OSError) as error:
        return "unreadable", str(error)
    needed = header.offset + declared * 2 * header.record_samples
    if declared >= 0 and needed > info.size:
        return "truncated", f"{info.size} of {needed} bytes"
    labels = [s["label"] for s in header.signals]
    if channel is not None and channel not in labels:
        return "channel", f"available: {', '.join(labels)}"
    if channel is not None and sample_rate is not None:
        samples = header.signals[labels.index(channel)]["samples"]
        rate = int(np.rint(samples / header.record_sec)) if header.record_sec else 0
        if rate != sample_rate:
            return "rate", f"{rate} Hz, expected {sample_rate}"
    return None


def file_rejects(paths: DataFrame, channel: str | None = None, sample_rate: int | None = None) -> DataFrame:
    """SRC4, FLT7, FLT15, FLT16: ``path, reason, detail`` of the files named that cannot be used.

    Reasons: missing, unreadable, truncated, channel, rate. Only headers are
    read, by tasks; a bad file is a row here, not an error.
    """

    def judge(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                fault = _fault(path, channel, sample_rate)
                if fault:
                    rows.append({"path": path, "reason": fault[0], "detail": fault[1]})
            yield pa.RecordBatch.from_pylist(rows, schema=_REJECTS)

    return paths.select("path").distinct().mapInArrow(judge, "path string, reason string, detail string")


_FACTS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])
_REJECTS = pa.schema([("path", pa.string()), ("reason", pa.string()), ("detail", pa.string())])
_RANGES = pa.schema([("path", pa.string()), ("size", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def read_edf(spark: SparkSession, path: str, mode: str, **options):
    """``path`` (file or folder) in one of the modes above."""
    spark.dataSource.register(EdfDataSource)
    # a source that takes filters over is refused without this setting
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("edf").option("mode", mode)
    reader = reader.option("minPartitions", spark.sparkContext.defaultParallelism)
    return reader.options(**options).load(path)
