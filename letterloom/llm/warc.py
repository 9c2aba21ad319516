"""WARC archives whose records are compressed one by one with a Zstandard dictionary that the archive carries itself."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .kernels import parts_of
from .scratch import new_path, written
from .sieve import sieve_of, sifted

#: Fixed values of the format: the magic number of the leading skippable frame, and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Uncompressed bytes of an archive after which a new one begins; bytes of its records that train its dictionary, and
#: bytes of the dictionary; bytes of payloads that are worked on at once.
ARCHIVE, SAMPLE, DICTIONARY, BLOCK = 64 << 20, 2 << 20, 64 << 10, 1 << 20
_ROW, _NULL = 0x6C6574746572 << 80, 0x6E756C6C6964 << 80


def _record_id(page: int | None) -> str:
    """A UUID that holds the page's 64-bit id."""
    value = _NULL if page is None else _ROW | 1 << 64 | page & (1 << 64) - 1
    h = f"{value:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _page_of(record_id: str) -> int | None:
    value = int(record_id[len("<urn:uuid:") : -1].replace("-", ""), 16)
    low = value & (1 << 64) - 1
    return None if value == _NULL else low - (1 << 64) if low >> 63 else low


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if refers is not None:
        lines.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.insert(3, f"WARC-Refers-To: {_record_id(refers)}")
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]):
    """A dictionary trained on the records; where they are too few or too short for that, their own bytes serve."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, records, k=200, d=8, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    """One file: records wait until there are enough to train the dictionary, then go out one frame each."""

    def __init__(self, folder: str, name: str) -> None:
        self.path = f"{folder}/{name}"
        self.waiting, self.size, self.count, self.compressor = [], 0, 0, None
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.out = system.open_output_stream(f"{path}/{name}", compression=None)

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.count += 1
        if self.compressor:
            self.out.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        if self.size >= SAMPLE:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        dictionary = _dictionary(self.waiting)
        data = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if not self.compressor:
            self._begin()
        self.out.close()
        return self.path, self.count, self.size


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shortest: int = 100,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row of ``pages`` into archives below ``folder``; ``path``, ``records``, ``bytes`` of each.

    ``folder`` is a URI that all executors see. The payload is ``payload_col`` in UTF-8. Of the rows with an equal
    payload of ``shortest`` bytes or more, those with the smallest id are responses and the others revisit it. Digests
    are counted first; only rows whose digest may have come twice (a fixed-size filter tells) are then shuffled with
    their payloads, the others are written where they were read. Names hold the task and attempt, and only files that are returned count, so a task
    that runs twice leaves a file that nothing reads.

    A null payload is empty; a null url leaves out the target; a row without id is a response unless a smaller
    identified row has its payload. Equal rows are responses both. An empty table gives no archives; other columns
    are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= shortest, F.sha2("payload", 256)))
    firsts = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = written(firsts, "firsts")
    sieve, long = sieve_of(firsts, "digest"), rows.where("digest is not null")
    alone = rows.where("digest is null").union(sifted(long, sieve, "digest", wanted=False)).withColumn("first", F.lit(None).cast("long"))
    rows = sifted(long, sieve, "digest").join(firsts, "digest", "left").select(*alone.columns).union(alone)
    rows = rows.select("id", "url", "payload", "first")

    def run(batches):
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        archive, done = None, []
        for batch in batches:
            for part in parts_of(batch, 2, BLOCK):
                for page, url, data, first in zip(*(c.to_pylist() for c in part.columns)):
                    if not archive:
                        archive = _Archive(folder, f"{name}-{len(done):04d}.warc.zst")
                    refers = None if first is None or first == page else first
                    archive.add(_record(page, url, data, hashlib.sha256(data).hexdigest(), refers, date))
                    if archive.size >= ARCHIVE:
                        done.append(archive.close())
                        archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, read in order with its own dictionary. An archive without records
    gives none; one that does not begin with a dictionary or ends within a record is an error."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with its dictionary")
    data = zstandard.ZstdDecompressor().decompress(stream.read(size))
    trained = data[:4] == struct.pack("<I", 0xEC30A437)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind))
    plain = reader.stream_reader(stream, read_size=1 << 18, read_across_frames=True)
    held = b""
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = plain.read(1 << 18)
            if not more:
                if held:
                    raise ValueError("an archive ends within a record")
                return
            held += more
        lines = held[:end].decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        need = end + 4 + int(headers["Content-Length"]) + 4
        parts, have = [held], len(held)
        while have < need:
            more = plain.read(max(1 << 18, need - have))
            if not more:
                raise ValueError("an archive ends within a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        yield headers, held[end + 4 : need - 4]
        held = held[need:]


def read_archives(archives: DataFrame) -> DataFrame:
    """``id``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to`` and ``payload`` (null for a revisit)
    of every record in the archives whose ``path`` is given. A payload that does not have its digest is an error."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                out, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for headers, block in records_of(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        refers = headers.get("WARC-Refers-To")
                        if refers is None and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"a payload in {uri} differs from its digest")
                        out.append((_page_of(headers["WARC-Record-ID"]), headers["WARC-Type"], length, digest, refers and _page_of(refers), payload if refers is None else None))
                        size += len(payload)
                        if size > BLOCK:
                            yield batch_of(out)
                            out, size = [], 0
                if out:
                    yield batch_of(out)

    def batch_of(rows):
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    paths = archives.select("path")
    layout = "id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return paths.repartition(max(1, archives.count()), "path").mapInArrow(run, layout)


def resolved(records: DataFrame) -> DataFrame:
    """``id``, ``record_type``, ``payload_bytes``, ``payload_digest`` and ``refers_to`` of every record of
    ``read_archives``; of a revisit, length and digest are those of the response that it refers to. A revisit without
    such a response, or of another digest, is an error. Null ids are those of responses; no records give no rows."""
    narrow = written(records.select("id", "record_type", "payload_bytes", "payload_digest", "refers_to"), "records")
    revisit = F.col("record_type") == "revisit"
    known = narrow.where(~revisit).groupBy(F.col("id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("found"))
    met = narrow.where(revisit).join(known, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))
    met = met.withColumn("payload_bytes", F.coalesce("found", lost.cast("long")))
    return narrow.where(~revisit).union(met.select(*narrow.columns))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives beside the other shared tables."""
    found = new_path(spark, "warc")
    return found if "://" in found else "file://" + found.removeprefix("file:")
