import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from tidewin.sources import edf as E
from tidewin.sources import recordings as R


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(0)
    root = tmp_path_factory.mktemp("edf")
    signals = {}
    for patient, seconds in (("p1", 37), ("p2", 10)):
        (root / patient).mkdir()
        for name in ("a.edf", "b.edf"):
            x = {"A": rng.normal(0, 2e-5, 64 * seconds), "B-1": rng.normal(0, 1e-4, 64 * seconds), "B-2": rng.normal(0, 1e-4, 64 * seconds)}
            (root / patient / name).write_bytes(R.encode(x, 64))
            signals[patient, name] = x
    (root / "p1" / "notes.txt").write_text("x")
    return root, signals


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.chunk):
        key = (r.patient, r.file, r.channel)
        assert r.first_sample == sum(map(len, out.get(key, [])))
        out.setdefault(key, []).append(r.samples)
    return {k: np.concatenate(v) for k, v in out.items()}


def test_signals_of_many_splits_are_the_files(spark, folder):
    root, signals = folder
    rows = E.edf(spark, str(root), split_bytes=2000, chunk_sec=3.0)
    assert rows.rdd.getNumPartitions() > 8
    got = whole(rows.collect())
    assert set(got) == {(*f, c) for f, x in signals.items() for c in x}
    for (patient, file, channel), x in got.items():
        raw = (root / patient / file).read_bytes()
        h, want = R.decode_samples(raw)
        assert (x == want[h["signal_label"].index(channel)]).all()
    assert rows.agg(F.max(F.size("samples"))).first()[0] == 3 * 64
    for split in (97, 700, 1 << 20):  # records lie in exactly one split, however it cuts them
        assert {k: len(v) for k, v in whole(E.edf(spark, str(root / "p2"), split_bytes=split, chunk_sec=2.0).collect()).items()} == {(p, f, c): 640 for p, f, c in got if p == "p2"}


class Counting:
    def __init__(self, handle, log):
        self.handle, self.log = handle, log

    def read_at(self, n, offset):
        got = self.handle.read_at(n, offset)
        self.log.append(len(got))
        return got

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.handle.close()


@pytest.fixture
def bytes_read(monkeypatch):
    log, real = [], fs.FileSystem.from_uri

    class Store:
        def __init__(self, store):
            self.store = store

        def get_file_info(self, x):
            return self.store.get_file_info(x)

        def open_input_file(self, path):
            return Counting(self.store.open_input_file(path), log)

    class Systems:
        FileSelector, FileType = fs.FileSelector, fs.FileType

        class FileSystem:
            @staticmethod
            def from_uri(uri):
                store, path = real(uri)
                return Store(store), path

    monkeypatch.setattr(E, "arrow_fs", Systems)
    return log


def test_headers_take_their_own_bytes(folder, bytes_read):
    reader = E.EdfReader({"path": f"file://{folder[0]}", "view": "headers"})
    plan = reader.partitions()
    assert len(plan) == 4 and bytes_read == []  # planning opens no file
    rows = [b.to_pylist()[0] for p in plan for b in reader.read(p)]
    assert sum(bytes_read) == 4 * 256 * (3 + 1)
    assert {(r["patient"], r["n_samples"], r["sfreq"], tuple(r["channels"])) for r in rows} == {("p1", 37 * 64, 64.0, ("A", "B-1", "B-2")), ("p2", 640, 64.0, ("A", "B-1", "B-2"))}


def test_splits_read_their_own_records_and_filters_are_pushed(folder, bytes_read):
    reader = E.EdfReader({"path": f"file://{folder[0]}", "split_bytes": "3000", "chunk_sec": "1"})
    left = list(reader.pushFilters([EqualTo(("patient",), "p1"), In(("file",), ("a.edf", "z.edf")), EqualTo(("channel",), "A"), GreaterThan(("chunk",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    plan = reader.partitions()
    size = (folder[0] / "p1" / "a.edf").stat().st_size
    assert len(plan) == -(-size // 3000) and {p.value[1:3] for p in plan} == {("p1", "a.edf")}
    rows = [r for p in plan for b in reader.read(p) for r in b.to_pylist()]
    assert [r["chunk"] for r in rows] == list(range(37)) and {r["channel"] for r in rows} == {"A"}
    assert sum(bytes_read) == len(plan) * 1024 + (size - 1024)  # each split its header, each record once


def test_filters_and_channels_through_spark(spark, folder):
    rows = E.edf(spark, str(folder[0]), channels=["B", "A"], chunk_sec=5.0)
    assert {r.channel for r in rows.select("channel").distinct().collect()} == {"A", "B"}
    one = rows.where("patient = 'p2' and channel = 'B' and file in ('a.edf')")
    assert one.rdd.getNumPartitions() == 1 and one.agg(F.sum(F.size("samples"))).first()[0] == 640
    assert (np.concatenate([r.samples for r in one.orderBy("chunk").collect()]) - folder[1]["p2", "a.edf"]["B-1"] < 1e-7).all()
    with pytest.raises(Exception, match="has no channel"):
        E.edf(spark, str(folder[0]), channels=["C"]).collect()


def test_splits_of_many_small_files_stand_together(tmp_path, folder, bytes_read):
    raw = (folder[0] / "p2" / "a.edf").read_bytes()
    (tmp_path / "p").mkdir()
    for k in range(100):
        (tmp_path / "p" / f"{k}.edf").write_bytes(raw)
    reader = E.EdfReader({"path": f"file://{tmp_path}", "chunk_sec": "1", "split_bytes": "1000", "parallelism": "2"})
    plan = reader.partitions()
    assert len(plan) <= 10 and bytes_read == []
    batches = [b for p in plan for b in reader.read(p)]
    assert len(batches) == len(plan)  # not one for each row
    rows = [(r["file"], r["channel"], r["chunk"]) for b in batches for r in b.to_pylist()]
    assert len(rows) == len(set(rows)) == 100 * 3 * 10


def test_digests_and_bad_files(spark, folder, tmp_path):
    import hashlib

    got = {(r.patient, r.file): (r.sha256, r.bytes) for r in E.edf(spark, str(folder[0]), "digests").collect()}
    assert got == {k: (hashlib.sha256((folder[0] / k[0] / k[1]).read_bytes()).hexdigest(), (folder[0] / k[0] / k[1]).stat().st_size) for k in folder[1]}
    (tmp_path / "p").mkdir()
    raw = (folder[0] / "p2" / "a.edf").read_bytes()
    (tmp_path / "p" / "x.edf").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="cut off"):
        E.edf(spark, str(tmp_path)).collect()
    (tmp_path / "p" / "x.edf").write_bytes(raw[:100])
    with pytest.raises(Exception, match="cut off"):
        E.edf(spark, str(tmp_path), "headers").collect()
    (tmp_path / "p" / "x.edf").write_bytes(raw[:236] + b"-1      " + raw[244:])  # the number of records unknown
    assert E.edf(spark, str(tmp_path), "headers").first().n_samples == 640


def test_written_files_appear_whole_or_not_at_all(spark, folder, tmp_path):
    E.register(spark)
    raw = (folder[0] / "p2" / "a.edf").read_bytes()
    rows = spark.createDataFrame([(f"p{k % 2}", f"{k}.edf", raw) for k in range(6)], "patient string, file string, content binary").repartition(3)
    out = f"file://{tmp_path}/out"
    rows.write.format("edf").mode("append").save(out)
    assert E.edf(spark, out, "headers").count() == 6 and not list((tmp_path / "out").glob("*/_*"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        rows.write.format("edf").mode("append").save(out)
    broken = rows.withColumn("content", F.when(F.col("file") == "5.edf", F.expr("cast(raise_error('stop') as binary)")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("edf").mode("append").save(f"file://{tmp_path}/none")
    assert not list((tmp_path / "none").glob("*/*.edf"))
