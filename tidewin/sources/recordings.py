"""Sources: EDF recordings, annotation summaries, tables and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: EDF's fixed header (public specification): field widths in bytes, for the file and for each signal.
FILE_FIELDS = (("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("header_bytes", 8), ("reserved", 44), ("records", 8), ("record_sec", 8), ("signals", 4))
SIGNAL_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32))
#: Volts in one unit of the recording's physical dimension.
UNITS = {"V": 1.0, "mV": 1e-3, "uV": 1e-6, "µV": 1e-6, "nV": 1e-9}


def decode_header(raw: bytes) -> dict:
    """The file's and the signals' fields; an error if the bytes end before the header does."""
    at, out = 0, {}
    for name, width in FILE_FIELDS:
        out[name] = raw[at : at + width].decode("latin-1").strip()
        at += width
    n = int(out["signals"])
    if len(raw) < 256 * (n + 1):
        raise ValueError("the header is cut off")
    for name, width in SIGNAL_FIELDS:
        out[f"signal_{name}"] = [raw[at + k * width : at + (k + 1) * width].decode("latin-1").strip() for k in range(n)]
        at += n * width
    out["sfreq"] = [int(s) / float(out["record_sec"]) for s in out["signal_samples"]]
    return out


def decode_samples(raw: bytes) -> tuple[dict, list[np.ndarray]]:
    """The header and each signal in volts (or its own unit, if that is none of volts)."""
    h = decode_header(raw)
    sizes = [int(s) for s in h["signal_samples"]]
    body = np.frombuffer(raw, "<i2", offset=int(h["header_bytes"]))
    records = int(h["records"]) if int(h["records"]) >= 0 else len(body) // sum(sizes)
    if len(body) < records * sum(sizes):
        raise ValueError("the data are cut off")
    body = body[: records * sum(sizes)].reshape(records, sum(sizes))
    out, at = [], 0
    for k, size in enumerate(sizes):
        low, high, a, b = (float(h[f"signal_{f}"][k]) for f in ("digital_min", "digital_max", "physical_min", "physical_max"))
        out.append(((body[:, at : at + size].ravel() - low) * (b - a) / (high - low) + a) * UNITS.get(h["signal_unit"][k], 1.0))
        at += size
    return h, out


def encode(signals: dict[str, np.ndarray], sfreq: int, record_sec: int = 1, unit: str = "uV") -> bytes:
    """EDF bytes of whole records of signals in volts; what does not fill a record is left out."""
    n, size = len(signals), sfreq * record_sec
    records = min(len(x) for x in signals.values()) // size
    scaled = [np.asarray(x[: records * size]) / UNITS[unit] for x in signals.values()]
    # Limits are written with eight characters, so they are rounded outwards first.
    most = [float(f"{np.ceil(max(np.abs(x).max(initial=0), 1e-3) * 10) / 10 + 0.1:.1f}") for x in scaled]
    head = {"version": 0, "patient": "X", "recording": "X", "date": "01.01.00", "time": "00.00.00", "header_bytes": 256 * (n + 1), "reserved": "", "records": records, "record_sec": record_sec, "signals": n}
    each = {"label": list(signals), "transducer": [""] * n, "unit": [unit] * n, "physical_min": [-m for m in most], "physical_max": most, "digital_min": [-32767] * n, "digital_max": [32767] * n, "prefilter": [""] * n, "samples": [size] * n, "reserved": [""] * n}
    text = "".join(f"{head[f]!s:<{w}}"[:w] for f, w in FILE_FIELDS) + "".join(f"{v!s:<{w}}"[:w] for f, w in SIGNAL_FIELDS for v in each[f])
    digital = [np.round(x / m * 32767).astype("<i2").reshape(records, size) for x, m in zip(scaled, most, strict=True)]
    return text.encode("latin-1") + np.concatenate(digital, axis=1).tobytes()


def edf_files(spark: SparkSession, path: str) -> DataFrame:
    """All EDF files below a folder of patients' folders: patient, file, path, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.edf").option("recursiveFileLookup", "true").load(path)
    part = F.split("path", "/")
    return files.select(F.element_at(part, -2).alias("patient"), F.element_at(part, -1).alias("file"), "path", "content")


def edf_headers(files: DataFrame) -> DataFrame:
    """patient, file, sfreq, n_samples and channels, from exactly the header's bytes of each file: the file's own field
    says how many they are, so any number of signals is read. (Spark's binary source itself reads whole files.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [decode_header(raw.as_py()) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h["sfreq"][0] for h in heads], pa.float64()), pa.array([int(h["records"]) * int(h["signal_samples"][0]) for h in heads], pa.int64()), pa.array([h["signal_label"] for h in heads], pa.list_(pa.string()))],
                ["patient", "file", "sfreq", "n_samples", "channels"],
            )

    at = sum(width for _, width in FILE_FIELDS[: [name for name, _ in FILE_FIELDS].index("header_bytes")])
    size = F.trim(F.decode(F.substring("content", at + 1, 8), "ISO-8859-1")).cast("int")
    heads = files.select("patient", "file", F.expr("content").substr(F.lit(1), size).alias("head"))
    return heads.mapInArrow(run, "patient string, file string, sfreq double, n_samples long, channels array<string>")


def edf_signals(files: DataFrame) -> DataFrame:
    """patient, file, channel, sfreq and samples: one row for each channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for patient, file, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, signals = decode_samples(raw)
                n = len(signals)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([patient] * n), pa.array([file] * n), pa.array(h["signal_label"]), pa.array(h["sfreq"], pa.float64()), pa.array(signals, pa.list_(pa.float64()))],
                    ["patient", "file", "channel", "sfreq", "samples"],
                )

    return files.select("patient", "file", "content").mapInArrow(run, "patient string, file string, channel string, sfreq double, samples array<double>")


def edf_recordings(files: DataFrame, channels: list[str]) -> DataFrame:
    """patient, file, sfreq and signals: the named channels' signals in volts, one row for each file. Of channels named
    base-1, base-2 .. the first counts as the base. A channel that is missing is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for patient, file, raw in zip(*batch.columns, strict=True):
                h, signals = decode_samples(raw.as_py())
                at = base_names(h["signal_label"])
                if missing := [c for c in channels if c not in at]:
                    raise ValueError(f"{file.as_py()} has no channel {missing}")
                rates = {h["sfreq"][at[c]] for c in channels}
                if len(rates) != 1:
                    raise ValueError(f"{file.as_py()}: the channels' rates differ: {sorted(rates)}")
                held = pa.array([[signals[at[c]] for c in channels]], pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([pa.array([patient.as_py()]), pa.array([file.as_py()]), pa.array([rates.pop()]), held], ["patient", "file", "sfreq", "signals"])

    return files.select("patient", "file", "content").mapInArrow(run, "patient string, file string, sfreq double, signals array<array<double>>")


def base_names(labels: list[str]) -> dict[str, int]:
    """Final channel name -> position; of twins base-1, base-2 .. the first (as text) is the base."""
    twins: dict[str, list[str]] = {}
    for label in labels:
        base, _, number = label.rpartition("-")
        if base and number.isdigit():
            twins.setdefault(base, []).append(label)
    out = {}
    for k, label in enumerate(labels):
        base = label.rpartition("-")[0]
        several = len(twins.get(base, [])) > 1 and label in twins[base]
        if not several:
            out.setdefault(label, k)
        elif label == min(twins[base]):
            out[base] = k
    return out


def parse_summaries(texts: DataFrame, text: str = "text") -> DataFrame:
    """Annotated intervals of summary texts: file, start_sec and end_sec, one row with NULL times for a file without any.

    A text is a list of entries, each opened by its file's name, and an entry is a list of `field: value` lines. An
    entry whose declared number differs from its starts or ends, or a file named twice, is an error at run time.
    """
    blank = " \t\r"
    entry = texts.select(F.explode(F.slice(F.split(text, "File Name:"), 2, 1 << 30)).alias("e"))
    line = F.split("e", "\n")
    # What stands before the first colon names the field; the value's first word is the value.
    word = lambda x: F.substring_index(F.btrim(x, F.lit(blank)), " ", 1)
    fields = F.transform(F.filter(line, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1), F.lit(blank)).alias("name"), word(F.substring_index(x, ":", -1)).alias("value")))
    rows = entry.select(word(line[0]).alias("file"), fields.alias("fields")).where("file <> ''")
    times = lambda which: F.transform(F.filter("fields", lambda x: x["name"].startswith("Seizure") & x["name"].endswith(which)), lambda x: x["value"].cast("int"))
    declared = F.filter("fields", lambda x: x["name"] == "Number of Seizures in File")
    rows = rows.select("file", times("Start Time").alias("starts"), times("End Time").alias("ends"), F.get(declared, F.lit(0))["value"].cast("int").alias("declared"))
    whole = F.coalesce((F.size("starts") == F.col("declared")) & (F.size("ends") == F.col("declared")), F.lit(False))
    fault = lambda text: F.raise_error(F.concat(F.lit(text), F.col("file")))
    once = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.first("starts").alias("starts"), F.first("ends").alias("ends"), F.bool_and(whole).alias("whole"))
    ok = F.when(~F.col("whole"), fault("incomplete annotations for ")).when(F.col("n") > 1, fault("repeated entry for ")).otherwise(F.lit(True))
    return once.where(ok).select("file", F.explode_outer(F.arrays_zip("starts", "ends")).alias("z")).select("file", F.col("z.starts").alias("start_sec"), F.col("z.ends").alias("end_sec"))


def table(spark: SparkSession, path: str, schema: StructType | str, columns: list[str] | None = None) -> DataFrame:
    """A CSV table by a stated schema, read in full precision; a wrong header is an error."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(*columns) if columns else rows


def documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents over several lines, such as manifests."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def test_counts(spark: SparkSession, path: str) -> DataFrame:
    """tests, failures, errors and skipped of JUnit reports."""
    suites = spark.read.format("xml").option("rowTag", "testsuite").schema("_tests int, _failures int, _errors int, _skipped int").load(path)
    return suites.agg(*[F.sum(f"_{c}").alias(c) for c in ("tests", "failures", "errors", "skipped")])
