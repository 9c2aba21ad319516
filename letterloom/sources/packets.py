"""Export packets: inventories that never read a body, and the message files themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.canonical import parse_payload
from ..functions.keys import export_account_key, export_root, is_message_file, relative_thread_key
from ..functions.payloads import packet_kind, packet_title, participant_names
from .ranges import RANGE, read_ranges


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` relative to ``root``, ``modificationTime``, ``content``, ``length`` and ``place`` (the file's URI) of all
    message files below it; the content is only read by queries that ask for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "message*.json").load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    scheme = lambda c: F.regexp_replace(c, "^[a-z0-9+.-]+:/*", "/")
    return files.withColumn("place", F.col("path")).withColumn("path", F.substr(scheme(plain), F.length(scheme(F.lit(full))) + 2)).select("path", "modificationTime", "content", "length", "place")


def _located(files: DataFrame, provider: str) -> DataFrame:
    found = files.where(is_message_file(F.col("path"), provider)).select("path", "modificationTime")
    return found.select(export_root(F.col("path"), provider).alias("export_root"), F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), "modificationTime")


def scan_packets(files: DataFrame, provider: str) -> DataFrame:
    """Body-free inventory: per export its name, number of message files and of thread folders, and newest
    modification. The folders themselves are rows of ``packet_folders``."""
    per_folder = _located(files, provider).groupBy("export_root", "folder").agg(F.count("*").alias("n"), F.max("modificationTime").alias("latest"))
    return (
        per_folder.groupBy("export_root")
        .agg(F.sum("n").alias("message_files"), F.count("*").alias("folders"), F.max("latest").alias("latest"))
        .withColumn("name", F.element_at(F.split("export_root", "/"), -1))
    )


def packet_folders(files: DataFrame, provider: str) -> DataFrame:
    """Distinct thread folders of every export, in order."""
    return _located(files, provider).select("export_root", "folder").distinct().orderBy("export_root", "folder")


def named_packets(files: DataFrame, provider: str) -> DataFrame:
    """``source_kind``, ``export_root`` and ``export_account`` of every message file, from paths alone, readable or not."""
    root = export_root(F.col("path"), provider)
    found = files.where(is_message_file(F.col("path"), provider))
    return found.select(F.lit(provider).alias("source_kind"), root.alias("export_root"), export_account_key(F.element_at(F.split(root, "/"), -1), provider).alias("export_account"))


def _described(found: DataFrame, provider: str, source_seq: int | str, *more: Column | str) -> DataFrame:
    """What the path of a message file tells: its export, thread and place in the import order (``source_seq``, a number
    or a column, then the path's parts)."""
    root = export_root(F.col("path"), provider)
    return found.select(
        "path",
        F.lit(provider).alias("source_kind"),
        root.alias("export_root"),
        export_account_key(F.element_at(F.split(root, "/"), -1), provider).alias("export_account"),
        relative_thread_key(F.col("path"), provider).alias("thread_path"),
        (F.col(source_seq) if isinstance(source_seq, str) else F.lit(source_seq)).cast("int").alias("source_seq"),
        F.split("path", "/").alias("path_parts"),
        *more,
    )


def read_message_files(files: DataFrame, provider: str, source_seq: int | str = 0) -> DataFrame:
    """One row per message file: text as UTF-8 or else Latin-1, parsed as VARIANT (null if it is no JSON), with what its
    path tells."""
    found = files.where(is_message_file(F.col("path"), provider))
    utf8 = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode("content", "ISO-8859-1"))
    return _described(found, provider, source_seq, parse_payload(text).alias("file"))


def told_by_large_files(files: DataFrame, provider: str, source_seq: int | str, least: int, scoped: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """What ``told_by_files`` tells, of files longer than ``least`` bytes, read by ranges of that size; None without any.
    ``files`` must have ``length`` and ``place``. Their list is on the driver, as that of any scan is."""
    long = files.where(is_message_file(F.col("path"), provider) & (F.col("length") > least))
    where = [r[0] for r in long.select("place").collect()]
    if not where:
        return None
    whole, payloads = read_ranges(files.sparkSession, where, least)
    listed = long.select("path", F.col("place"), *([source_seq] if isinstance(source_seq, str) else []))
    both = listed.join(whole.select(F.col("path").alias("place"), "file"), "place")
    facts = told_by_files(scoped(_described(both, provider, source_seq, "file", "place")), "place").drop("pos", "payload")
    each = payloads.select(F.col("path").alias("place"), "pos", "payload")
    each = facts.join(each, "place", "left").drop("place")
    return each.withColumn("import_seq", F.struct("source_seq", "path_parts", F.coalesce(F.col("pos"), F.lit(0)).cast("long").alias("pos")))


def file_warning() -> Column:
    """What is wrong with a parsed ``file``, null if nothing is. Messages that are missing, null or empty of any kind are
    no messages; messages that are something else make the file a reject."""
    kind = F.coalesce(F.schema_of_variant("file"), F.lit("NONE"))
    held = F.try_variant_get("file", "$.messages", "variant")
    nothing = F.coalesce(F.to_json(held), F.lit("null")).isin("null", "false", "0", "0.0", '""', "{}")
    listed = F.coalesce(F.schema_of_variant(held), F.lit("NONE")).startswith("ARRAY")
    return F.when(kind == "NONE", "not JSON").when(~kind.startswith("OBJECT"), "not an object").when(~listed & ~nothing, "messages is no list")


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are objects, and (path, warning) of the others."""
    marked = parsed if "warning" in parsed.columns else parsed.withColumn("warning", file_warning())
    return marked.where("warning is null").drop("warning"), marked.where("warning is not null").select("path", "warning")


def is_message(payload: Column) -> Column:
    return F.coalesce(F.schema_of_variant(payload), F.lit("")).startswith("OBJECT")


def dropped_elements(told: DataFrame) -> DataFrame:
    """(path, warning) of files with elements of ``messages`` that are no objects; these are left out."""
    odd = told.where(F.col("payload").isNotNull() & ~is_message(F.col("payload"))).groupBy("path").agg(F.count("*").alias("n"))
    return odd.select("path", F.concat(F.col("n").cast("string"), F.lit(" messages are no objects")).alias("warning"))


def other_accounts(parsed: DataFrame, account: str) -> DataFrame:
    """Packets that name another account than ``account``."""
    return parsed.where(F.col("export_account") != account.lower()).select("export_root", "export_account").distinct()


def check_account(parsed: DataFrame, account: str) -> None:
    """An error if a packet names another account than ``account``."""
    if other := other_accounts(parsed, account).limit(1).collect():
        raise ValueError(f"packet {other[0][0]!r} belongs to account {other[0][1]!r}, not {account!r}")


def scoped_threads(parsed: DataFrame, account: str | None = None, named: DataFrame | None = None) -> DataFrame:
    """``parsed`` with ``source_thread_key``. It begins with the account where one is given, for Facebook always, and
    for Instagram where the packets name more than one. ``named`` tells the packets (``named_packets``), so that counting
    accounts reads no file; without it they are those of ``parsed``."""
    named = parsed if named is None else named
    if account is not None:
        check_account(named, account)
        name = F.lit(account.lower())
        return parsed.withColumn("export_account", name).withColumn("source_thread_key", F.concat(name, F.lit(":"), "thread_path"))
    accounts = named.agg(F.count_distinct("export_account").alias("accounts"))
    scope = (F.col("source_kind") == "facebook") | (F.col("accounts") > 1)
    key = F.when(scope & F.col("export_account").isNotNull(), F.concat("export_account", F.lit(":"), "thread_path"))
    return parsed.crossJoin(F.broadcast(accounts)).withColumn("source_thread_key", F.coalesce(key, "thread_path")).drop("accounts")


def told_by_files(files: DataFrame, *more: str) -> DataFrame:
    """One row per element of the files' messages, and one without ``payload`` for a file that has none, with what the
    file says of its thread (names of participants, title and kind) and ``warning``, what is wrong with it. A file is read
    and parsed once for all of it."""
    held = F.try_variant_get("file", "$.messages", "array<variant>")
    folder = F.element_at(F.split("thread_path", "/"), -1)
    named = files.withColumn("warning", file_warning()).withColumn("names", participant_names(F.col("file"))).select(
        "path", "source_kind", "export_account", "export_root", "source_thread_key", "source_seq", "path_parts", "names",
        packet_title(F.try_variant_get("file", "$.title", "string"), F.col("names"), folder).alias("title"),
        packet_kind(F.col("names")).alias("thread_kind"), F.when(F.col("warning").isNull(), held).alias("held"), "warning", *more,
    )
    each = named.select("*", F.posexplode_outer("held").alias("pos", "payload")).drop("held")
    return each.withColumn("import_seq", F.struct("source_seq", "path_parts", F.coalesce(F.col("pos"), F.lit(0)).cast("long").alias("pos")))


def file_threads(told: DataFrame) -> DataFrame:
    """What each file says of its thread, one row per file."""
    first = told.where(F.coalesce("pos", F.lit(0)) == 0)
    return first.select("source_kind", "export_account", "export_root", "source_thread_key", "names", "title", "thread_kind", "import_seq")
