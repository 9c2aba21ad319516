"""The relations of a chat database, exported as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns of each relation; the first three relations are required, of the others and of columns any may be missing.
TABLES = {
    "chat": "ROWID bigint, guid string, chat_identifier string, display_name string, service_name string",
    "message": "ROWID bigint, guid string, text string, attributedBody binary, date bigint, is_from_me int, handle_id bigint, service string",
    "chat_message_join": "chat_id bigint, message_id bigint",
    "handle": "ROWID bigint, id string, service string",
    "chat_handle_join": "chat_id bigint, handle_id bigint",
    "attachment": "ROWID bigint, guid string, filename string, mime_type string, uti string, total_bytes bigint",
    "message_attachment_join": "message_id bigint, attachment_id bigint",
}
REQUIRED = ("chat", "message", "chat_message_join")


def conform(spark: SparkSession, found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All relations with all columns: what is missing is empty or null; a missing required relation is an error."""
    if missing := [t for t in REQUIRED if t not in found]:
        raise ValueError(f"required chat tables are missing: {', '.join(missing)}")
    out = {}
    for name, layout in TABLES.items():
        columns = [c.split() for c in layout.split(", ")]
        df = found.get(name)
        if df is None:
            out[name] = spark.createDataFrame([], layout)
            continue
        own = {c.lower(): c for c in df.columns}
        out[name] = df.select(*((F.col(own[c.lower()]) if c.lower() in own else F.lit(None)).cast(t).alias(c) for c, t in columns))
    return out


def read_chat_tables(spark: SparkSession, root: str, source_format: str = "parquet", **options) -> dict[str, DataFrame]:
    """The relations below ``root``, each a file or folder ``<name>.<format>``."""
    found = {}
    for name in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.{source_format}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found[name] = spark.read.format(source_format).options(**options).load(path.toString())
    return conform(spark, found)


def _columns(spark: SparkSession, url: str, properties: dict[str, str]) -> dict[str, dict[str, str]]:
    """Of every relation that the database has, by lower-cased names: its own name (under "") and those of its columns."""
    told = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        told.setProperty(k, v)
    if "driver" in properties:
        spark._jvm.org.apache.spark.util.Utils.classForName(properties["driver"], True, False)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, told)
    try:
        found, rows = {}, connection.getMetaData().getColumns(None, None, None, None)
        while rows.next():
            table, column = rows.getString("TABLE_NAME"), rows.getString("COLUMN_NAME")
            if table.lower() in TABLES:
                found.setdefault(table.lower(), {"": table})[column.lower()] = column
        return found
    finally:
        connection.close()


def read_chat_database(spark: SparkSession, url: str, partitions: int = 8, quote: str = '"', **properties: str) -> dict[str, DataFrame]:
    """The relations of a database that JDBC reaches, each scanned in ``partitions`` ranges of its first column (rows
    without it are in the first), with the columns that are needed and there. ``properties`` go to the driver."""
    named = lambda n: f"{quote}{n}{quote}"
    reader = lambda: spark.read.format("jdbc").option("url", url).options(**properties)
    found = {}
    for name, own in _columns(spark, url, properties).items():
        wanted = [own[c.split()[0].lower()] for c in TABLES[name].split(", ") if c.split()[0].lower() in own]
        if not wanted:
            continue
        key = wanted[0]
        low, high = reader().option("query", f"SELECT MIN({named(key)}) AS low, MAX({named(key)}) AS high FROM {named(own[''])}").load().first()
        scan = reader().option("dbtable", f"(SELECT {', '.join(map(named, wanted))} FROM {named(own[''])}) told")
        if low is not None and high > low:
            scan = scan.options(partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=partitions)
        found[name] = scan.load()
    return conform(spark, found)
