import threading

import pytest
from pyspark.sql import functions as F

from letterloom.operators import messages as ops
from letterloom.plans import rebuild
from letterloom.sources import sinks
from letterloom.sources.shared import Versions
from letterloom.streaming import accumulate as streaming
from letterloom.streaming.accumulate import accumulate_packets, accumulated


def rows(spark, *keys):
    return spark.createDataFrame([("facebook", "a", k) for k in keys], "source_kind string, export_account string, source_thread_key string")


def kept(spark, path, versions=None):
    return sorted(r.source_thread_key for r in sinks.read_canonical(spark, path, "messages", versions=versions).collect())


def folders(path, name="messages"):
    return {p.name.removeprefix("version=") for p in (path / name).glob("version=*")}


def test_of_writers_at_once_one_publishes(spark, tmp_path):
    path = str(tmp_path / "canon")
    sinks.write_canonical({"messages": rows(spark, "old")}, path, {"facebook": ["a"]})
    start, said = threading.Barrier(6), []

    def write(n):
        versions = Versions(spark, path)
        start.wait()
        try:
            sinks.write_canonical({"messages": rows(spark, f"new {n}")}, path, {"facebook": ["a"]}, versions)
            said.append(n)
        except RuntimeError as error:
            assert "another writer" in str(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(said) == 1 and kept(spark, path) == [f"new {said[0]}"]
    sinks.write_canonical({"messages": rows(spark, "last")}, path, {"facebook": ["a"]})
    assert kept(spark, path) == ["last"] and len(folders(tmp_path / "canon")) == 2 and not list((tmp_path / "canon" / "_writing").glob("[!.]*"))


def test_a_number_is_taken_once(spark, tmp_path):
    versions, won = [Versions(spark, str(tmp_path / "v")) for _ in range(12)], []
    start = threading.Barrier(len(versions))

    def publish(v, n):
        start.wait()
        try:
            v.publish({"p": str(n)})
            won.append(n)
        except RuntimeError:
            pass

    threads = [threading.Thread(target=publish, args=(v, n)) for n, v in enumerate(versions)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and Versions(spark, str(tmp_path / "v")).parts == {"p": str(won[0])}


def test_versions_go_when_nothing_names_them(spark, tmp_path):
    path, top = str(tmp_path / "canon"), tmp_path / "canon"
    for n in range(5):
        sinks.write_canonical({"messages": rows(spark, f"t{n}")}, path, {"facebook": ["a"]})
    assert len(folders(top)) == 2 and kept(spark, path) == ["t4"] and len(list((top / "_states").glob("*.json"))) == 2
    held = Versions(spark, path)
    with held.reading():
        for n in range(5, 8):
            sinks.write_canonical({"messages": rows(spark, f"t{n}")}, path, {"facebook": ["a"]})
        assert kept(spark, path, held) == ["t4"] and kept(spark, path) == ["t7"] and len(folders(top)) == 3
    sinks.write_canonical({"messages": rows(spark, "t8")}, path, {"facebook": ["a"]})
    assert len(folders(top)) == 2


def test_a_sweep_leaves_what_is_being_written(spark, tmp_path, monkeypatch):
    path, top = str(tmp_path / "canon"), tmp_path / "canon"
    sinks.write_canonical({"messages": rows(spark, "t")}, path, {"facebook": ["a"]})
    writer = Versions(spark, path)
    new = writer.new()
    rows(spark, "half").write.parquet(f"{path}/messages/version={new}")
    Versions(spark, path).sweep([f"{path}/messages"], keep=1)
    assert new in folders(top)
    monkeypatch.setattr(Versions, "LEASE", -1)  # its writer is long dead
    Versions(spark, path).sweep([f"{path}/messages"], keep=1)
    assert new not in folders(top) and kept(spark, path) == ["t"]


def test_the_gate_and_the_publish_see_one_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "canon")
    rebuild.rebuild_projection(spark, path, {"messages": rows(spark, "t")}, "facebook", ["a"], ["a"])
    plain = rebuild.write_canonical

    def late(*args):
        plain({"messages": rows(spark, "other")}, path, {"facebook": ["a"]})  # between the gate and the publish
        plain(*args)

    monkeypatch.setattr(rebuild, "write_canonical", late)
    with pytest.raises(RuntimeError, match="another writer"):
        rebuild.rebuild_projection(spark, path, {"messages": rows(spark, "mine")}, "facebook", ["a"], ["a"])
    assert kept(spark, path) == ["other"]


class Stream:
    """Packets p0, p1, ... of ``n`` messages each, of which every other one is in the packet before too."""

    def __init__(self, spark, folder, n=40, **options):
        self.spark, self.folder, self.options = spark, folder, options
        each = spark.range(12).select(F.col("id").cast("int").alias("p")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        fp = F.sha2(F.concat_ws("-", F.when(F.col("i") % 2 == 0, F.floor(F.col("p") / 2)).otherwise(F.col("p")).cast("string"), F.col("i").cast("string")), 256)
        self.rows = each.select(F.lit("k").alias("source_kind"), F.concat(F.lit("t"), (F.col("i") % 7).cast("string")).alias("source_thread_key"), F.concat(F.lit("p"), "p").alias("export_root"), fp.alias("fp"), F.lit(5).cast("long").alias("ts_ms"), F.struct("p", "i").alias("import_seq"))

    def fold(self, *packets):
        for p in packets:
            self.spark.createDataFrame([(p,)], "packet string").write.mode("append").parquet(f"{self.folder}/m")
        read = lambda batch: self.rows.join(batch.select(F.col("packet").alias("export_root")), "export_root", "left_semi")
        accumulate_packets(self.spark, f"{self.folder}/m", "packet string", read, f"{self.folder}/out", f"{self.folder}/c", **self.options).awaitTermination()

    def got(self):
        return sorted(map(tuple, accumulated(self.spark, f"{self.folder}/out").select("source_thread_key", "source_message_key", "export_root").collect()))

    def want(self, *packets):
        return sorted(map(tuple, ops.merge_exports(self.rows.where(F.col("export_root").isin(*packets))).select("source_thread_key", "source_message_key", "export_root").collect()))


def test_a_batch_writes_its_own_rows_and_deltas_are_merged_by_size(spark, tmp_path, monkeypatch):
    stream, sizes, plain = Stream(spark, str(tmp_path), buckets=2), [], streaming._write
    monkeypatch.setattr(streaming, "_write", lambda df, path, version: (sizes.append(df.count()), plain(df, path, version))[1])
    for p in range(6):
        before = len(sizes)
        stream.fold(f"p{p}")
        assert sizes[before] == 40  # whatever there is already
    assert stream.got() == stream.want(*(f"p{p}" for p in range(6)))
    parts = Versions(spark, str(tmp_path / "out")).parts
    deltas = [[n for _, n in streaming._deltas(v)] for k, v in parts.items() if k.startswith("bucket=")]
    assert all(a > sum(d[i + 1 :]) for d in deltas for i, a in enumerate(d[:-1])) and len(sizes) > 6
    named = {v for k, value in parts.items() if k.startswith("bucket=") for v, _ in streaming._deltas(value)}
    assert named <= folders(tmp_path, "out") and len(folders(tmp_path, "out")) <= len(named) + 3


def test_buckets_split_when_they_are_large(spark, tmp_path):
    stream = Stream(spark, str(tmp_path), buckets=1, split=1)
    stream.fold("p0")
    stream.fold("p2")
    stream.fold("p1", "p3")
    parts = Versions(spark, str(tmp_path / "out")).parts
    assert max(streaming._leaf(k)[0] for k in parts if k.startswith("bucket=")) > 1
    assert stream.got() == stream.want("p0", "p1", "p2", "p3")


def test_a_published_batch_that_runs_again_does_nothing(spark, tmp_path):
    stream = Stream(spark, str(tmp_path), buckets=2)
    stream.fold("p0")
    stream.fold("p1")
    before = Versions(spark, str(tmp_path / "out"))
    for f in (tmp_path / "c" / "commits").glob("*1*"):
        f.unlink()  # the stream forgets that its last batch ended
    stream.fold()
    assert Versions(spark, str(tmp_path / "out")).parts == before.parts
    assert stream.got() == stream.want("p0", "p1")


def test_where_deltas_are_merged():
    assert streaming._due([100]) == 1 and streaming._due([100, 60]) == 2 and streaming._due([100, 60, 40]) == 0
    assert streaming._due([100, 40, 40]) == 1 and streaming._due([100, 50, 30, 10]) == 4 and streaming._due([5, 5]) == 0
