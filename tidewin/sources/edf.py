"""EDF recordings as a Spark data source: header views, byte ranges of records as splits, pushed-down selections.

    edf(spark, folder)                              one row for each chunk of each channel
    edf(spark, folder, view="headers")              one row for each file, from its header's bytes alone
    edf(spark, folder, view="digests")              one row for each file with the SHA-256 of its bytes
    rows.write.format("edf").mode("append").save(folder)     rows of (patient, file, content)

A folder holds patients' folders of files. Splits are planned from file sizes alone; a task reads its file's
header, 256 bytes and 256 for each signal, and then only the records of the chunks that begin in its range. Filters on
patient and file leave out splits before anything is opened, and filters on channel leave out the decoding. A chunk
holds a fixed number of records, so no row grows with the recording, and a chunk's place follows from its number. Splits
of small files are packed into partitions, and their rows into batches, so neither tasks nor batches count files.
Files are opened by pyarrow's file systems (local, s3, gcs, hdfs), never through the driver; `recordings.edf_files`
reads those that only Spark can open, whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .recordings import UNITS, base_names, decode_header

SPLIT_BYTES = 32 << 20
#: What opening a file costs, in bytes read, when splits are packed; rows of a batch hold about BATCH_BYTES.
OPEN_BYTES, BATCH_BYTES = 1 << 16, 4 << 20
CHUNK_SEC = 256.0
DIGEST_BYTES = 4 << 20
VIEWS = {
    "signals": "patient string, file string, channel string, sfreq double, n_samples long, chunk long, first_sample long, samples array<double>",
    "headers": "patient string, file string, path string, bytes long, sfreq double, n_samples long, channels array<string>",
    "digests": "patient string, file string, path string, bytes long, sha256 string",
}
ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
#: What a filter can be pushed down for.
PUSHED = ("patient", "file", "channel")


def edf(spark: SparkSession, path: str, view: str = "signals", channels: list[str] | None = None, split_bytes: int = SPLIT_BYTES, chunk_sec: float = CHUNK_SEC, whole_sec: float | None = None) -> DataFrame:
    """The files below `path`. `channels` are final names: of channels named base-1, base-2 .. the first counts as the
    base, and a file without one of them is an error. A chunk lasts about `chunk_sec`, in whole records and, if
    `whole_sec` is given, in whole multiples of that."""
    register(spark)
    rows = spark.read.format("edf").option("view", view).option("split_bytes", split_bytes).option("chunk_sec", chunk_sec).option("parallelism", spark.sparkContext.defaultParallelism)
    rows = rows.option("whole_sec", whole_sec) if whole_sec is not None else rows
    return (rows.option("channels", json.dumps(channels)) if channels is not None else rows).load(qualified(spark, path))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters of Python sources pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark would read it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "signals")]

    def reader(self, schema: StructType) -> EdfReader:
        return EdfReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> EdfWriter:
        if sorted(schema.names) != ["content", "file", "patient"]:
            raise ValueError("rows of patient, file and content are needed")
        return EdfWriter(self.options["path"], overwrite)


class EdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.view = options["path"], options.get("view", "signals")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.seconds = float(options.get("chunk_sec", CHUNK_SEC))
        self.whole = Fraction(options["whole_sec"]) if "whole_sec" in options else None
        self.channels = json.loads(options["channels"]) if "channels" in options else None
        self.parallelism = int(options.get("parallelism", 8))
        self.only: dict[str, list[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | EqualNullSafe | In) and len(f.attribute) == 1 else None
            if name in PUSHED and (name != "channel" or self.view == "signals"):
                values = list(f.value) if isinstance(f, In) else [f.value]
                self.only[name] = [v for v in values if name not in self.only or v in self.only[name]]
            else:
                yield f

    def _wanted(self, name: str, value: str) -> bool:
        return name not in self.only or value in self.only[name]

    def partitions(self) -> Sequence[InputPartition]:
        """(path, patient, file, bytes, first byte, end, further splits of the same form) by the files' sizes; no file is
        opened. Splits stand together up to SPLIT_BYTES, or less, so that there are some partitions for each core."""
        store, root = arrow_fs.FileSystem.from_uri(self.path)
        splits = []
        for info in store.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=False)):
            parts = info.path.split("/")
            if not info.is_file or not info.path.endswith(".edf") or parts[-1].startswith("_"):
                continue
            patient, file = parts[-2], parts[-1]
            if self._wanted("patient", patient) and self._wanted("file", file):
                step = self.split if self.view == "signals" else max(info.size, 1)
                splits += [(info.path, patient, file, info.size, a, min(a + step, info.size)) for a in range(0, max(info.size, 1), step)]
        # A header's view reads a header, whatever the file's size.
        cost = [OPEN_BYTES + (0 if self.view == "headers" else end - begin) for *_, begin, end in splits]
        most, out, held = min(SPLIT_BYTES, sum(cost) // (4 * self.parallelism)), [], 0
        for split, size in zip(splits, cost, strict=True):
            if not out or held + size > most:
                out.append([])
                held = 0
            out[-1].append(split)
            held += size
        return [InputPartition((*first, further)) for first, *further in out]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = arrow_fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        *first, further = partition.value
        for path, patient, file, size, begin, end in (first, *further):
            with store.open_input_file(path) as handle:
                for row in self._rows(handle, path, patient, file, size, begin, end):
                    rows.append(row)
                    held += OPEN_BYTES // 64 + (row[-1].nbytes if self.view == "signals" else 0)
                    if held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _rows(self, handle: pa.NativeFile, path: str, patient: str, file: str, size: int, begin: int, end: int) -> Iterator[list]:
        if self.view == "digests":
            digest = hashlib.sha256()
            for at in range(0, size, DIGEST_BYTES):
                digest.update(handle.read_at(min(DIGEST_BYTES, size - at), at))
            yield [patient, file, path, size, digest.hexdigest()]
            return
        head = header(handle)
        records = self._records(head, size, file)
        if self.view == "headers":
            yield [patient, file, path, size, head["sfreq"][0], records * int(head["signal_samples"][0]), head["signal_label"]]
        else:
            yield from self._chunks(handle, head, records, patient, file, begin, end)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        fields = [x.rsplit(" ", 1) for x in VIEWS[self.view].split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    @staticmethod
    def _records(head: dict, size: int, file: str) -> int:
        width = 2 * sum(map(int, head["signal_samples"]))
        there = (size - int(head["header_bytes"])) // width
        declared = int(head["records"])
        if declared > there:
            raise ValueError(f"{file}: the data are cut off")
        return there if declared < 0 else declared

    def _signals(self, head: dict, file: str) -> list[tuple[str, int]]:
        """(name, position) of the signals to decode."""
        labels = head["signal_label"]
        if self.channels is None:
            found = list(zip(labels, range(len(labels)), strict=True))
        else:
            at = base_names(labels)
            if missing := [c for c in self.channels if c not in at]:
                raise ValueError(f"{file} has no channel {missing}")
            found = [(c, at[c]) for c in self.channels]
        return [(c, k) for c, k in found if self._wanted("channel", c)]

    def _records_in_chunk(self, record: Fraction) -> int:
        least = (record / self.whole).denominator if self.whole else 1
        return least * max(1, round(Fraction(self.seconds) / record / least))

    def _chunks(self, handle: pa.NativeFile, head: dict, records: int, patient: str, file: str, begin: int, end: int) -> Iterator[list]:
        sizes = [int(s) for s in head["signal_samples"]]
        width, first, places = 2 * sum(sizes), int(head["header_bytes"]), np.cumsum([0, *sizes])
        each = self._records_in_chunk(Fraction(head["record_sec"]))
        signals = self._signals(head, file)
        # The chunks whose first byte lies in the range; one at the header's place belongs to the first split.
        low = 0 if begin <= first else -(-(begin - first) // (width * each))
        for chunk in range(low, -(-records // each)):
            at = first + chunk * each * width
            if at >= end:
                return
            n = min(each, records - chunk * each)
            body = np.frombuffer(handle.read_at(n * width, at), "<i2").reshape(n, sum(sizes))
            for name, k in signals:
                x = volts(body[:, places[k] : places[k + 1]].ravel(), head, k)
                yield [patient, file, name, head["sfreq"][k], records * sizes[k], chunk, chunk * each * sizes[k], x]


def header(handle: pa.NativeFile) -> dict:
    """The fields of exactly the header's bytes."""
    raw = handle.read_at(256, 0)
    if len(raw) < 256:
        raise ValueError("the header is cut off")
    return decode_header(raw + handle.read_at(256 * int(raw[252:256]), 256))


def volts(digital: np.ndarray, head: dict, k: int) -> np.ndarray:
    """A signal's samples in volts (or its own unit, if that is none of volts)."""
    low, high, a, b = (float(head[f"signal_{f}"][k]) for f in ("digital_min", "digital_max", "physical_min", "physical_max"))
    return ((digital - low) * (b - a) / (high - low) + a) * UNITS.get(head["signal_unit"][k], 1.0)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class EdfWriter(DataSourceArrowWriter):
    """Files appear under their names when all tasks are done; a task that fails, or a run that stops, leaves none."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = arrow_fs.FileSystem.from_uri(self.path)
        done = []
        for batch in iterator:
            for patient, file, content in zip(*(batch.column(c).to_pylist() for c in ("patient", "file", "content")), strict=True):
                store.create_dir(f"{root}/{patient}", recursive=True)
                held = f"{root}/{patient}/_{uuid.uuid4().hex}.part"
                done.append((held, f"{root}/{patient}/{file}"))
                with store.open_output_stream(held) as out:
                    out.write(content)
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = arrow_fs.FileSystem.from_uri(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite:
            there = [i.path for i in store.get_file_info([to for _, to in files]) if i.type != arrow_fs.FileType.NotFound]
            if there:
                self.abort(messages)
                raise FileExistsError(f"[PATH_ALREADY_EXISTS] {there[:3]}")
        for held, to in files:
            store.move(held, to)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = arrow_fs.FileSystem.from_uri(self.path)
        for message in messages:
            for held, _ in message.files if message is not None else ():
                store.delete_file(held)
