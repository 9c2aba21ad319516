"""The shared folder: tables that several jobs read are written there once, and versions of tables are switched there."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _path(spark, path)
    return system.exists(p)


def subfolders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names of what lies in a folder and begins with ``prefix``."""
    p, system = _path(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(p) if f.getPath().getName().startswith(prefix))


def folder_bytes(spark: SparkSession, path: str) -> int:
    p, system = _path(spark, path)
    return int(system.getContentSummary(p).getLength())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir`` or that was set by ``setCheckpointDir``; on several
    machines no local folder can stand in for it, so that its lack is an error but in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if not found:
        spark.sparkContext.setCheckpointDir(f"file:///tmp/letterloom-{uuid.uuid4().hex}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/letterloom/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read again, so that what follows from it several times is computed once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    """Which version of each part of a data set is the current one.

    Writers put new data into folders of their own and then publish them all by one small numbered file, which appears
    whole and only if no other writer has taken the number: readers see all parts of the old state or all of the new,
    whenever a writer dies, and of writers that start from one state one publishes and the others get an error. A writer
    announces a version before it writes it, and a reader may hold a state (``reading``); ``sweep`` takes neither, nor
    what the last states name. An announcement or hold that is older than ``LEASE`` seconds is that of a dead process.
    """

    LEASE = 24 * 3600

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.number, self.parts = self._read()

    def _names(self, folder: str) -> dict[str, float]:
        """The files of a folder that are no drafts, and how many seconds ago they were made."""
        p, system = _path(self.spark, f"{self.path}/{folder}")
        if not system.exists(p):
            return {}
        now = time.time()
        return {f.getPath().getName(): now - f.getModificationTime() / 1000 for f in system.listStatus(p) if not f.getPath().getName().startswith(".")}

    def _states(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("_states") if n.endswith(".json"))

    def _state(self, number: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.path}/_states/{number:08d}.json", wholetext=True).first()[0])

    def _read(self) -> tuple[int, dict[str, str]]:
        states = self._states()
        return (states[-1], self._state(states[-1])) if states else (0, {})

    def _put(self, name: str, text: str) -> bool:
        """Make a file with ``text`` at once; false if there is one. Local files are linked, as renaming replaces; where
        renaming is atomic and does not replace, drafts are renamed; object stores get one conditional put."""
        target, system = _path(self.spark, f"{self.path}/{name}")
        scheme = system.getUri().getScheme()
        put = scheme not in ("file", "hdfs", "viewfs", "webhdfs", "abfs", "abfss")
        draft = target if put else _path(self.spark, f"{self.path}/{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")[0]
        try:
            out = system.create(draft, False)
            out.write(bytearray(text.encode()))
            out.close()
        except Exception as error:  # a store that refuses the put raises its own kind
            if put and system.exists(target):
                return False
            raise error
        if put:
            return True
        try:
            if scheme == "file":
                local = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self.spark._jvm.java.nio.file.Files.createLink(local(target), local(draft))
                except Exception as error:
                    if "FileAlreadyExists" in str(error):
                        return False
                    raise error
                return True
            return bool(system.rename(draft, target))
        finally:
            if system.exists(draft):
                system.delete(draft, False)

    def new(self) -> str:
        """The name of a version that this writer is going to write; it is announced, so that no sweep takes it."""
        version = uuid.uuid4().hex
        self._put(f"_writing/{version}", str(self.number))
        return version

    def _forget(self, folder: str, name: str) -> None:
        p, system = _path(self.spark, f"{self.path}/{folder}/{name}")
        system.delete(p, False)

    def publish(self, changes: dict[str, str | None]) -> None:
        """Make the versions in ``changes`` the current ones of their parts; None takes a part out."""
        parts = {k: v for k, v in (self.parts | changes).items() if v is not None}
        if not self._put(f"_states/{self.number + 1:08d}.json", json.dumps(parts, sort_keys=True)):
            raise RuntimeError(f"another writer has changed {self.path} meanwhile")
        self.number, self.parts = self.number + 1, parts

    def done(self, version: str) -> None:
        """``version`` is published, or given up."""
        self._forget("_writing", version)

    @contextmanager
    def reading(self) -> Iterator[Versions]:
        """Hold this state: what it names is not swept meanwhile, whatever is published."""
        name = f"{self.number:08d}-{uuid.uuid4().hex}"
        self._put(f"_reading/{name}", "")
        try:
            yield self
        finally:
            self._forget("_reading", name)

    def sweep(self, folders: Iterable[str], keep: int = 2) -> None:
        """Delete versions below ``folders`` (named ``version=...``) that none of the last ``keep`` states, no held state
        and no writer names, and states that are older than all of these."""
        # Writers are listed before versions: what is announced later is not yet among the versions that are listed.
        held = {int(n.partition("-")[0]) for n, age in self._names("_reading").items() if age < self.LEASE}
        used = {n for n, age in self._names("_writing").items() if age < self.LEASE}
        states = self._states()
        kept = sorted({*states[-keep:], *(held & set(states))})
        for n in kept:
            used |= {v.partition(":")[0] for value in self._state(n).values() for v in value.split(",")}
        for folder in folders:
            p, system = _path(self.spark, folder)
            for f in system.listStatus(p) if system.exists(p) else []:
                name = f.getPath().getName()
                if name.startswith("version=") and name.removeprefix("version=") not in used:
                    system.delete(f.getPath(), True)
        for n in states:
            if kept and n < kept[0]:
                self._forget("_states", f"{n:08d}.json")
