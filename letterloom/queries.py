"""The registered queries: each operator on the driver's tables, mapped to message archives, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import canonical, keys, payloads, text, times
from .operators import identity, messages as ops, pulls, rollups, views
from .plans import imports, rebuild, reports
from .sources import chat, packets, sinks
from .sources.shared import new_folder, once
from .streaming.accumulate import accumulate_packets as accumulate, accumulated

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Mappings of the driver's tables -----------------------------------------------------------------------------------

TS = "1700000000000 + conv_id * 3600000 + turn * 1000"
CONV = f"""conv AS (SELECT conv_id, turn, role, text, 'messages/inbox/conv_' || conv_id AS thread, {TS} AS ts_ms,
  conv_id % 3 = 0 AS grp FROM conversations)"""


def exports(spark: SparkSession, d: str) -> DataFrame:
    """Messages of two overlapping exports of ``conversations``: all turns, and all but each first."""
    rows = table(spark, d, "conversations").select(
        F.lit("instagram").alias("source_kind"), F.lit(None).cast("string").alias("export_account"),
        F.concat(F.lit("messages/inbox/conv_"), "conv_id").alias("source_thread_key"), "conv_id", "turn",
        F.col("role").alias("sender_name"), F.expr(TS).alias("ts_ms"), F.col("text").alias("body_text"),
    )
    each = rows.withColumn("export_root", F.explode(F.when(F.col("turn") >= 1, F.array(F.lit("e1"), F.lit("e2"))).otherwise(F.array(F.lit("e1")))))
    seq = F.when(F.col("export_root") == "e1", 1).otherwise(2)
    each = each.withColumn("import_seq", F.struct(seq.alias("source_seq"), F.array("source_thread_key").alias("path_parts"), F.col("turn").cast("int").alias("pos")))
    fp = F.sha2(F.concat_ws("|", "sender_name", F.col("ts_ms").cast("string"), "body_text"), 256)
    return each.withColumn("fp", fp)


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return ops.merge_exports(exports(spark, d)).withColumn("sent_at", F.timestamp_millis("ts_ms"))


def graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Canonical tables of ``conversations``: every third is a group with a third member who never writes. Merged
    messages and people are written once and the rest follows from these."""
    m = once(conversations(spark, d), "messages")
    names = F.when(F.col("grp"), F.array(F.lit("user"), F.lit("assistant"), F.lit("José Ñandú"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    facts = m.select(*rollups.THREAD, "export_account", (F.col("conv_id") % 3 == 0).alias("grp"), "conv_id").distinct()
    seq = F.struct(F.lit(0).alias("source_seq"), F.array("source_thread_key").alias("path_parts"), F.lit(0).alias("pos"))
    facts = facts.select(*rollups.THREAD, "export_account", names.alias("names"), F.concat(F.lit("Conversation "), "conv_id").alias("title"), payloads.packet_kind(names).alias("thread_kind"), seq.alias("import_seq"))
    people = once(identity.thread_people(facts, m), "people")
    members = identity.participants(people)
    sender = people.select(*rollups.THREAD, F.col("name").alias("sender_name"), F.col("identity_key").alias("sender_identity_key"), F.col("account_source_kind").alias("sender_account_source_kind"), F.col("account_key").alias("sender_account_key"))
    rows = m.join(sender, [*rollups.THREAD, "sender_name"], "left")
    media = rows.where("turn % 2 = 1").select(F.concat(F.lit("instagram:"), F.substring(F.sha2(F.concat_ws(":", "source_thread_key", "source_message_key"), 256), 1, 24)).alias("object_key"), *rollups.THREAD, "source_message_key", F.concat(F.lit("photos/"), F.col("ts_ms").cast("string"), F.lit(".jpg")).alias("source_uri"), F.concat(F.lit("e1/photos/"), F.col("ts_ms").cast("string"), F.lit(".jpg")).alias("local_path"), F.lit("image/jpeg").alias("mime_type"))
    grouped = facts.where("thread_kind = 'group'").select(*rollups.THREAD)
    threads = facts.drop("names", "import_seq").join(rollups.thread_bounds(rows), rollups.THREAD, "left")
    return {
        "messages": rows, "threads": threads, "thread_participants": members, "media_objects": media, "accounts": identity.accounts(people),
        "identities": identity.identities(people).unionByName(identity.group_identities(facts.where("thread_kind = 'group'"))),
        "graph_edges": identity.graph_edges(members, grouped), "people": people,
    }


PEOPLE = """people AS (SELECT DISTINCT conv_id, thread, grp, name, 'person:instagram:' || CASE name WHEN 'José Ñandú' THEN 'jose-nandu' ELSE name END AS person FROM (
    SELECT conv_id, thread, grp, role AS name FROM conv UNION SELECT conv_id, thread, grp, unnest(['user','assistant']) FROM conv
    UNION SELECT conv_id, thread, grp, 'José Ñandú' FROM conv WHERE grp))"""
GRAPH = f"WITH {CONV}, {PEOPLE}, per AS (SELECT thread, any_value(conv_id) AS conv_id, any_value(grp) AS grp, count(*) AS n, sum((turn % 2)::INT) AS media, min(ts_ms) AS lo, max(ts_ms) AS hi FROM conv GROUP BY thread)"


def packet_files(spark: SparkSession, d: str) -> DataFrame:
    """Message files of two dated packets of ``conversations``: one file per thread, the later without first turns."""
    rows = table(spark, d, "conversations")
    both = rows.withColumn("day", F.explode(F.when(F.col("turn") >= 1, F.array(F.lit("2026-01-01"), F.lit("2026-02-01"))).otherwise(F.array(F.lit("2026-01-01")))))
    photo = F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.concat(F.lit("photos/"), "conv_id", F.lit("_"), "turn", F.lit(".jpg")).alias("uri"))))
    message = F.struct("turn", F.struct(F.col("role").alias("sender_name"), F.expr(TS).alias("timestamp_ms"), F.col("text").alias("content"), photo.alias("photos")).alias("m"))
    files = both.groupBy("day", "conv_id").agg(F.transform(F.sort_array(F.collect_list(message)), lambda x: x.m).alias("messages"))
    names = F.when(F.col("conv_id") % 3 == 0, F.array(*(F.struct(F.lit(n).alias("name")) for n in ("user", "assistant", "José Ñandú")))).otherwise(F.array(*(F.struct(F.lit(n).alias("name")) for n in ("user", "assistant"))))
    body = F.to_json(F.struct(names.alias("participants"), F.concat(F.lit("Conversation "), "conv_id").alias("title"), "messages"))
    path = F.concat(F.lit("meta-2026/instagram-ann-"), "day", F.lit("-x/your_instagram_activity/messages/inbox/conv_"), "conv_id", F.lit("/message_1.json"))
    return files.select(path.alias("path"), F.to_timestamp("day").alias("modificationTime"), F.encode(body, "UTF-8").alias("content"), F.month(F.to_date("day")).alias("seq"))


# Scalars -----------------------------------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text,''), '\s+', ' ', 'g')) AS t, text FROM documents)
SELECT doc_id, sha256(t) AS cleaned_sha256, substr(sha256(coalesce(text,'')),1,10) AS short_hash,
  CASE WHEN length(t) > 180 THEN substr(t,1,177) || '...' ELSE t END AS snippet FROM c""")
def text_scalars(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(text.clean_text(c), 256).alias("cleaned_sha256"), text.stable_hash(c).alias("short_hash"), text.snippet(text.clean_text(c)).alias("snippet"))


@query(r"""WITH n AS (SELECT c_custkey, c_name || ' & ' || n_name || '!' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT *, trim(regexp_replace(replace(lower(label), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM n)
SELECT c_custkey, slug, slug || '--' || substr(sha256(label),1,8) AS view_name, 'people/' || slug || '--' || substr(sha256(label),1,8) AS view_path,
  regexp_replace(lower(label), '\s+', '', 'g') AS handle FROM s""")
def name_keys(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).select("c_custkey", F.concat("c_name", F.lit(" & "), "n_name", F.lit("!")).alias("label"))
    rows, s, k = text.with_slug(rows, "label", "slug"), F.col("slug"), F.col("label")
    return rows.select("c_custkey", "slug", text.view_name(s, k).alias("view_name"), text.view_path(F.lit("person"), s, k).alias("view_path"), text.handle_key(k).alias("handle"))


@query(r"""SELECT doc_id, sha256(CASE WHEN s = '' THEN 'untitled' ELSE s END) AS slug_sha256 FROM (SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(coalesce(text,''))),'&',' and '),'[^a-z0-9]+','-','g'),'-') AS s FROM documents)""")
def accented_slugs(spark, d):
    return text.with_slug(table(spark, d, "documents"), "text", "slug").select("doc_id", F.sha2("slug", 256).alias("slug_sha256"))


@query(r"""WITH p AS (SELECT c_custkey, 'Instagram-@User' || c_custkey || '-20' || lpad((20 + c_custkey % 6)::VARCHAR,2,'0') || '-0' || (1 + c_custkey % 9) || '-1' || (c_custkey % 10) || '-part' AS name FROM customer)
SELECT c_custkey, 'user' || c_custkey AS account, (2020 + c_custkey % 6) * 10000 + (1 + c_custkey % 9) * 100 + 10 + c_custkey % 10 AS date_key, 'user' || c_custkey AS normal,
  (2020 + c_custkey % 6) * 10000 + (1 + c_custkey % 9) * 100 + 10 + c_custkey % 10 AS fresh FROM p""")
def packet_names(spark, d):
    k = F.col("c_custkey")
    day = F.concat(F.lit("-20"), F.lpad((20 + k % 6).cast("string"), 2, "0"), F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-1"), (k % 10).cast("string"), F.lit("-part"))
    name = F.concat(F.lit("Instagram-@User"), k, day)
    path = F.concat(F.lit("drive/"), F.lower(name), F.lit("/messages"))
    return table(spark, d, "customer").select(
        "c_custkey", keys.export_account_key(name, "instagram").alias("account"), keys.export_date_key(name).cast("long").alias("date_key"),
        text.normalize_account_key(F.concat(F.lit(" @User"), k)).alias("normal"), keys.freshness_key(path, F.lit(None).cast("timestamp")).alias("fresh"),
    )


@query("""SELECT o_orderkey, 1600000000000000 + o_orderkey * 1000 AS meta_us, 978307200000000 + o_orderkey * 1000000 AS apple_s_us, (1500000001 + o_orderkey) * 1000000 AS unix_us,
  978307200000000 + 700000000000000 + o_orderkey AS apple_ns_us, CAST(0 AS BIGINT) AS missing_us FROM orders""")
def source_times(spark, d):
    k, us = F.col("o_orderkey"), lambda c, n: F.unix_micros(c).alias(n)
    return table(spark, d, "orders").select(
        "o_orderkey", us(times.epoch_ms_to_ts(1600000000000 + k), "meta_us"), us(times.apple_date_to_ts(k), "apple_s_us"), us(times.apple_date_to_ts(1500000001 + k), "unix_us"),
        us(times.apple_date_to_ts(700000000000000000 + k * 1000), "apple_ns_us"), us(times.epoch_ms_to_ts(F.lit(None).cast("string")), "missing_us"),
    )


@query("""SELECT event_id, 'thread:facebook:a:' || event_type AS thread_key, 'group:facebook:' || substr(sha256('a:' || event_type),1,16) AS group_key,
  'v2:' || CASE WHEN event_id = 0 THEN '' ELSE event_id::VARCHAR END || ':' || substr(sha256(props),1,24) || ':' || (event_id % 3) AS message_key FROM events""")
def archive_keys(spark, d):
    t = F.concat(F.lit("a:"), "event_type")
    return table(spark, d, "events").select(
        "event_id", keys.thread_key(F.lit("facebook"), t).alias("thread_key"), keys.group_key(F.lit("facebook"), t).alias("group_key"),
        keys.message_key(F.col("event_id"), F.sha2("props", 256), F.col("event_id") % 3).alias("message_key"),
    )


@query("""SELECT props, count(*) AS n, count(DISTINCT props) AS same FROM events GROUP BY props""")
def payload_fingerprints(spark, d):
    """Payloads that differ in the order of keys only have one fingerprint, others have their own."""
    rows = table(spark, d, "events").select("props", F.get_json_object("props", "$.k").alias("k"))
    a, b = (F.parse_json(F.concat(*(F.lit(x) if x != "k" else F.col("k") for x in t))) for t in (('{"a":1,"k":', "k", "}"), ('{"k":', "k", ',"a":1}')))
    marked = rows.select("props", F.array_distinct(F.array(keys.message_fingerprint(a), keys.message_fingerprint(b))).alias("fps"))
    each = marked.select("props", F.explode("fps").alias("fp"))
    return each.groupBy("fp").agg(F.count("*").alias("n"), F.count_distinct("props").alias("same"), F.min("props").alias("props")).drop("fp")


@query(r"""SELECT event_id, sha256('{"content": "café \"' || event_type || '\"\n", "share": {"link": "x/' || user_id || '", "score": ' || (event_id % 1000 + event_id % 100 / 100.0)::DOUBLE::VARCHAR || ', "tags": [1, ' || event_id % 7 || '.0, true, null, {}]}, "timestamp_ms": '
  || event_id || '}') AS fingerprint, 'v2:' || CASE WHEN event_id = 0 THEN '' ELSE event_id::VARCHAR END || ':' || substr(fingerprint, 1, 24) || ':0' AS message_key FROM events""")
def message_fingerprints(spark, d):
    """Fingerprints and keys of payloads, written with other spaces, order of keys and escapes than the canonical text."""
    k = F.col("event_id")
    score = F.concat((k % 1000).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    body = F.concat(
        F.lit('{"timestamp_ms":'), k.cast("string"), F.lit(', "share":{ "tags":[1,'), (k % 7).cast("string"), F.lit('.00,true , null,{}],"score":'), score,
        F.lit(',"link":"x\\/'), F.col("user_id").cast("string"), F.lit('"},"content":"caf\\u00e9 \\"'), "event_type", F.lit('\\"\\n"}'),
    )
    rows = table(spark, d, "events").select("event_id", keys.message_fingerprint(canonical.parse_payload(body)).alias("fingerprint"))
    return rows.select("event_id", "fingerprint", keys.message_key(k, F.col("fingerprint"), F.lit(0)).alias("message_key"))


@query(r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || chr(10) || 'http://x/' || user_id WHEN 2 THEN 'http://x/' || user_id END AS body,
  'Ann, user ' || user_id || CASE WHEN event_id % 5 = 0 THEN ', B, C...' ELSE '' END AS title, CASE WHEN event_id % 5 = 0 THEN 'group' ELSE 'direct' END AS kind,
  CASE WHEN event_id % 5 = 0 THEN 5 ELSE 2 END AS people FROM events""")
def payload_facts(spark, d):
    rows = table(spark, d, "events")
    link = F.concat(F.lit("http://x/"), "user_id")
    e = F.col("event_id") % 4
    share = F.when(e.isin(1, 2), F.struct(F.when(e == 1, F.col("event_type")).alias("share_text"), link.alias("link")))
    person = lambda c: F.struct(c.alias("name"))
    few = F.array(person(F.lit(" Ann ")), person(F.concat(F.lit("user "), "user_id")), person(F.lit("Ann")))
    many = F.concat(few, F.array(*(person(F.lit(n)) for n in "BCD")))
    body = F.struct(F.when(e == 0, F.concat(F.lit("  "), "event_type")).alias("content"), share.alias("share"), F.when(F.col("event_id") % 5 == 0, many).otherwise(few).alias("participants"))
    p = F.parse_json(F.to_json(body))
    names = F.col("names")
    return rows.select("event_id", p.alias("p")).withColumn("names", payloads.participant_names(F.col("p"))).select(
        "event_id", payloads.message_body(F.col("p")).alias("body"), payloads.packet_title(F.lit(""), names, F.lit("folder")).alias("title"),
        payloads.packet_kind(names).alias("kind"), F.size(names).alias("people"),
    )


@query(r"""SELECT page_id, 'x/instagram-a-2026-01-01' AS root, 'your_instagram_activity/messages/inbox/p' || page_id AS thread, page_id % 2 = 0 AS is_file FROM pages""")
def packet_paths(spark, d):
    path = F.concat(F.lit("x/instagram-a-2026-01-01/your_instagram_activity/messages/inbox/p"), "page_id", F.when(F.col("page_id") % 2 == 0, "/message_12.json").otherwise("/messages.json"))
    return table(spark, d, "pages").select("page_id", keys.export_root(path, "instagram").alias("root"), keys.relative_thread_key(path, "instagram").alias("thread"), keys.is_message_file(path, "instagram").alias("is_file"))


# Merging, bounds and counts ----------------------------------------------------------------------------------------


@query(f"""WITH {CONV}, e AS (SELECT 'e1' AS x, * FROM conv UNION ALL SELECT 'e2', * FROM conv WHERE turn >= 1),
n AS (SELECT x, thread, role, ts_ms, text, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT thread, ts_ms, max(n) AS n FROM n GROUP BY thread, role, ts_ms, text)
SELECT thread AS source_thread_key, sum(n)::BIGINT AS message_count, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM k GROUP BY thread""")
def merge_exports(spark, d):
    m = conversations(spark, d)
    bounds = rollups.thread_counts(m).join(rollups.thread_bounds(m), rollups.THREAD)
    return bounds.select("source_thread_key", "message_count", F.unix_millis("first_message_at").alias("first_ms"), F.unix_millis("last_message_at").alias("last_ms"))


@query("""WITH e AS (SELECT 'e1' AS x, source, lang, text FROM documents UNION ALL SELECT 'e2', source, lang, text FROM documents WHERE n_chars > 500
  UNION ALL SELECT 'e2', source, lang, text FROM documents WHERE doc_id % 7 = 0),
n AS (SELECT x, source, lang, text, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT source, max(n) AS n FROM n GROUP BY source, lang, text)
SELECT source AS thread, sum(n)::BIGINT AS messages, max(n)::BIGINT AS most FROM k GROUP BY source""")
def merge_multiplicity(spark, d):
    """Equal documents of a source are equal messages; the merge keeps each as often as one export has it."""
    docs = table(spark, d, "documents")
    one = docs.withColumn("export_root", F.lit("e1"))
    two = docs.where("n_chars > 500").union(docs.where("doc_id % 7 = 0")).withColumn("export_root", F.lit("e2"))
    rows = one.union(two).select(
        F.lit("facebook").alias("source_kind"), F.col("source").alias("source_thread_key"), "export_root", F.lit(0).cast("long").alias("ts_ms"),
        F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("fp"), F.struct(F.col("export_root").alias("x"), "doc_id").alias("import_seq"),
    )
    merged = ops.merge_exports(rows)
    each = merged.groupBy(F.col("source_thread_key").alias("thread"), "fp").agg(F.count("*").alias("n"))
    return each.groupBy("thread").agg(F.sum("n").alias("messages"), F.max("n").alias("most"))


@query("""WITH e AS (SELECT 'e1' AS x, source, lang, text FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT 'e2', source, lang, text FROM documents UNION ALL SELECT 'e2', source, lang, text FROM documents WHERE doc_id % 7 = 0),
n AS (SELECT source, lang, text, count(*) FILTER (x = 'e1') AS a, count(*) FILTER (x = 'e2') AS b FROM e GROUP BY ALL)
SELECT source AS thread, sum(a)::BIGINT AS before, sum(greatest(b - a, 0))::BIGINT AS added FROM n GROUP BY source""")
def merge_increment(spark, d):
    """Equal documents of a source are equal messages; a second, cumulative export adds what the first has less often."""
    docs = table(spark, d, "documents")
    told = lambda df, root: df.select(
        F.lit("facebook").alias("source_kind"), F.col("source").alias("source_thread_key"), F.lit(root).alias("export_root"), F.lit(0).cast("long").alias("ts_ms"),
        F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("fp"), F.struct(F.lit(root).alias("x"), "doc_id").alias("import_seq"),
    )
    index = once(ops.merged_counts(ops.merge_exports(told(docs.where("doc_id % 5 > 0"), "e1"))), "index")
    new = ops.merge_new(index, told(docs.union(docs.where("doc_id % 7 = 0")), "e2"))
    before = index.groupBy(F.col("source_thread_key").alias("thread")).agg(F.sum("most").alias("before"))
    added = new.groupBy(F.col("source_thread_key").alias("thread")).agg(F.count("*").alias("added"))
    return before.join(added, "thread", "full").select("thread", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("added", F.lit(0)).alias("added"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_by_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("import_seq"))
    return ops.latest_by_key(rows, ["user_id"]).drop("import_seq")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id""")
def last_and_first_writer(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("import_seq"))
    last = ops.latest_small(rows, ["user_id"]).select("user_id", F.col("event_type").alias("last_type"))
    return last.join(ops.first_by_key(rows, ["user_id"]).select("user_id", F.col("event_type").alias("first_type")), "user_id")


@query(GRAPH + """ SELECT DISTINCT person AS identity_key, name AS display_name FROM people""")
def identities(spark, d):
    return graph(spark, d)["identities"].where("kind = 'person'").select(F.col("stable_key").alias("identity_key"), "display_name")


@query(r"""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'organization:facebook:acct' || c_nationkey ELSE 'person:facebook:' || lower(replace(c_name, '#', '-')) END AS identity_key,
  CASE WHEN c_custkey % 10 = 0 THEN 'acct' || c_nationkey ELSE lower(replace(c_name, '#', '-')) END AS account_key FROM customer""")
def owners(spark, d):
    """Every tenth customer is the owner of its nation's account, by its own name."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("acct"), "c_nationkey").alias("export_account"), F.lit("facebook").alias("source_kind"))
    own = rows.where("c_custkey % 10 = 0").groupBy(F.col("export_account").alias("account_key")).agg(F.collect_list("name").alias("self_names"))
    registry = own.select("account_key", F.concat(F.lit("organization:facebook:"), "account_key").alias("owner_identity_key"), F.lit("organization").alias("owner_kind"), F.col("account_key").alias("display_name"), "self_names")
    return identity.resolve_people(rows, registry).select("c_custkey", "identity_key", "account_key")


@query(GRAPH + """ SELECT 'thread:instagram:' || thread AS from_key, 'has_participant' AS edge_kind, person AS to_key FROM people
UNION SELECT 'thread:instagram:' || thread, 'represents_group', 'group:instagram:' || substr(sha256(thread),1,16) FROM per WHERE grp
UNION SELECT 'group:instagram:' || substr(sha256(thread),1,16), 'has_participant', person FROM people WHERE grp""")
def graph_edges(spark, d):
    return graph(spark, d)["graph_edges"].select("from_key", "edge_kind", "to_key")


@query(GRAPH + """ SELECT person AS identity_key, 1::BIGINT AS accounts, sum((NOT per.grp)::INT)::BIGINT AS direct_threads, sum(per.grp::INT)::BIGINT AS group_threads, sum(n)::BIGINT AS messages,
  sum(media)::BIGINT AS media, min(lo) AS first_ms, max(hi) AS last_ms FROM people JOIN per USING (thread) GROUP BY person""")
def person_summary(spark, d):
    g = graph(spark, d)
    found = rollups.person_summary(g["identities"], g["thread_participants"], g["threads"], g["messages"], g["media_objects"])
    return found.select("identity_key", "accounts", "direct_threads", "group_threads", "messages", "media", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"))


@query(GRAPH + """, t AS (SELECT DISTINCT person, conv_id, ts_ms, role, text FROM conv JOIN (SELECT DISTINCT person, thread FROM people) USING (thread)),
r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ts_ms DESC, conv_id DESC) AS rank FROM t)
SELECT person AS identity_key, rank, 'Conversation ' || conv_id AS title, CASE WHEN conv_id % 3 = 0 THEN 'group' ELSE 'direct' END AS thread_kind, ts_ms, role AS sender,
  CASE WHEN length(s) > 180 THEN substr(s,1,177) || '...' ELSE s END AS snippet
FROM (SELECT *, trim(regexp_replace(CASE WHEN coalesce(text, '') = '' THEN '[no text]' ELSE text END, '\\s+', ' ', 'g')) AS s FROM r WHERE rank <= 40)""")
def person_timeline(spark, d):
    g = graph(spark, d)
    sent = views.messages_with_sender(g["messages"], g["identities"], g["accounts"])
    found = views.person_timeline(sent, g["thread_participants"], g["threads"])
    return found.select("identity_key", F.col("rank").cast("long").alias("rank"), "title", "thread_kind", F.unix_millis("sent_at").alias("ts_ms"), "sender", "snippet")


@query(GRAPH + """, r AS (SELECT person, ts_ms, row_number() OVER (PARTITION BY person ORDER BY ts_ms DESC) AS rank FROM conv JOIN (SELECT DISTINCT person, thread FROM people) USING (thread) WHERE turn % 2 = 1)
SELECT person AS identity_key, rank, 'photos/' || ts_ms || '.jpg' AS source_uri FROM r WHERE rank <= 100""")
def person_media(spark, d):
    g = graph(spark, d)
    found = views.person_media(g["media_objects"], g["messages"], g["thread_participants"], g["threads"])
    return found.select("identity_key", F.col("rank").cast("long").alias("rank"), "source_uri")


@query(f"""WITH {CONV}, o AS (SELECT *, make_timestamp(ts_ms * 1000) AS t, row_number() OVER (PARTITION BY thread ORDER BY ts_ms) AS no, lag(strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d')) OVER (PARTITION BY thread ORDER BY ts_ms) AS old FROM conv)
SELECT thread AS source_thread_key, no AS message_no, sha256(CASE WHEN old IS NULL OR old <> strftime(t, '%Y-%m-%d') THEN '## ' || strftime(t, '%Y-%m-%d') || chr(10) ELSE '' END
  || strftime(t, '%H:%M:%S') || ' ' || role || ': ' || CASE WHEN regexp_replace(coalesce(text,''), '\\s+', '', 'g') = '' THEN '[no text]' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END || CASE WHEN turn % 2 = 1 THEN chr(10) || '[1 media attachment]' ELSE '' END) AS lines_sha256 FROM o""")
def transcript_lines(spark, d):
    g = graph(spark, d)
    sent = views.messages_with_sender(g["messages"], g["identities"], g["accounts"])
    lines = views.transcript_lines(sent, rollups.media_per_message(g["media_objects"]))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_no", "line"))), lambda x: x.line), "\n")
    return lines.groupBy("source_thread_key", F.col("message_no").cast("long").alias("message_no")).agg(F.sha2(told, 256).alias("lines_sha256"))


@query(GRAPH + """ SELECT person AS identity_key, thread AS source_thread_key, n AS message_count FROM (SELECT DISTINCT person, thread FROM people) JOIN per USING (thread)""")
def person_threads(spark, d):
    g = graph(spark, d)
    return views.person_threads(g["identities"], g["thread_participants"], g["threads"], g["messages"]).select("identity_key", "source_thread_key", "message_count")


@query(GRAPH + """ SELECT DISTINCT 'group:instagram:' || substr(sha256(thread),1,16) AS group_key, person AS stable_key, name AS display_name FROM people WHERE grp""")
def group_members(spark, d):
    g = graph(spark, d)
    return views.group_members(g["graph_edges"], g["identities"])


@query(GRAPH + """ SELECT 'group:instagram:' || substr(sha256(thread),1,16) AS group_key, thread AS source_thread_key, 'Conversation ' || conv_id AS title FROM per WHERE grp""")
def group_threads(spark, d):
    g = graph(spark, d)
    return views.group_threads(g["graph_edges"], g["threads"]).select("group_key", "source_thread_key", "title")


@query(GRAPH + """ SELECT thread AS source_thread_key, ts_ms, role AS sender, sha256(text) AS body_sha256 FROM conv""")
def messages_with_sender(spark, d):
    g = graph(spark, d)
    sent = views.messages_with_sender(g["messages"], g["identities"], g["accounts"])
    return sent.select("source_thread_key", F.unix_millis("sent_at").alias("ts_ms"), "sender", F.sha2("body_text", 256).alias("body_sha256"))


@query(GRAPH + """ SELECT person AS identity_key, thread AS source_thread_key, 'photos/' || ts_ms || '.jpg' AS source_uri FROM (SELECT DISTINCT person, thread FROM people) JOIN conv USING (thread) WHERE turn % 2 = 1""")
def media_in_threads(spark, d):
    g = graph(spark, d)
    return views.media_in_threads(g["media_objects"], g["thread_participants"]).select("identity_key", "source_thread_key", "source_uri")


@query(GRAPH + """ SELECT thread AS source_thread_key, name AS label FROM people""")
def thread_roster(spark, d):
    g = graph(spark, d)
    return views.thread_roster(g["thread_participants"], g["identities"], g["accounts"]).select("source_thread_key", "label")


@query(GRAPH + """ SELECT count(DISTINCT person) AS people, (SELECT count(*) FROM per WHERE grp) AS groups, (SELECT count(*) FROM per) AS threads, (SELECT count(*) FROM conv) AS messages FROM people""")
def graph_counts(spark, d):
    g = graph(spark, d)
    return rollups.graph_counts(g["identities"], g["threads"], g["messages"])


# Chat relations ----------------------------------------------------------------------------------------------------


def chat_tables(spark: SparkSession, d: str, attached: bool = False) -> dict[str, DataFrame]:
    """Orders are messages of the chat of their customer's nation, sent by a supplier; line items are attachments, which
    are told apart and written once if they are ``attached``, as two relations are made of them. Dates begin anew after
    nine million keys, as they are nanoseconds in 64 bits."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    items = once(lines.repartition(ops.parts_for(lines), "l_orderkey").distinct(), "items") if attached else lines.distinct()
    suppliers, nations = table(spark, d, "supplier"), table(spark, d, "nation")
    many = suppliers.agg(F.count("*").alias("many"))
    sent = orders.crossJoin(F.broadcast(many))
    return chat.conform(spark, {
        "chat": nations.select(F.col("n_nationkey").alias("ROWID"), F.concat(F.lit("chat"), "n_nationkey").alias("guid"), F.col("n_name").alias("chat_identifier"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("display_name")),
        "handle": suppliers.select(F.col("s_suppkey").alias("ROWID"), F.col("s_name").alias("id")),
        "message": sent.select(F.col("o_orderkey").alias("ROWID"), F.concat(F.lit("m"), "o_orderkey").alias("guid"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 9000000 * 1000000000000 + 1000000000000).alias("date"), (F.col("o_orderkey") % 4 == 0).cast("int").alias("is_from_me"), (F.col("o_orderkey") % F.col("many")).alias("handle_id")),
        "chat_message_join": orders.join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).select(F.col("c_nationkey").alias("chat_id"), F.col("o_orderkey").alias("message_id")),
        "chat_handle_join": suppliers.select(F.col("s_nationkey").alias("chat_id"), F.col("s_suppkey").alias("handle_id")),
        "attachment": items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ROWID"), F.concat(F.lit("a"), "l_orderkey", F.lit("_"), "l_linenumber").alias("guid"), F.lit("f").alias("filename"), F.when(F.col("l_linenumber") == 1, "image/png").alias("mime_type"), F.lit("public.data").alias("uti")),
        "message_attachment_join": items.select(F.col("l_orderkey").alias("message_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attachment_id")),
    })


@query("""SELECT o_orderkey AS message_id, 'chat' || c_nationkey AS chat_guid, s_name AS handle, o_orderpriority AS text FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier)""")
def chat_messages(spark, d):
    return ops.chat_messages(chat_tables(spark, d)).select("message_id", "chat_guid", "handle", "text")


@query("""SELECT 'chat' || c_nationkey AS chat_guid, count(*) AS messages, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def chat_tables_from_files(spark, d):
    """The required relations as files, with fewer columns than there can be; what is missing is empty or null."""
    folder = new_folder(spark, "chat")
    for name, df in chat_tables(spark, d).items():
        if name in chat.REQUIRED:
            df.drop("attributedBody", "display_name", "service").write.parquet(f"{folder}/{name}.parquet")
    found = ops.chat_messages(chat.read_chat_tables(spark, folder))
    return found.where("handle is null and attributedBody is null").groupBy("chat_guid").agg(F.count("*").alias("messages"), F.count_if(F.col("text") == "1-URGENT").alias("urgent"))


@query("""SELECT event_id, event_type || ' no. ' || event_id AS body, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","kind":null}' AS raw FROM events""")
def binary_bodies(spark, d):
    """Bodies that are only in a binary column, between the archiver's bookkeeping; and what is told of their source."""
    said = F.concat("event_type", F.lit(" no. "), "event_id")
    blob = F.encode(F.concat(F.lit("\0NSString\0"), said, F.lit("\0NSNumber and much longer bookkeeping\0")), "UTF-8")
    rows = table(spark, d, "events").select("event_id", "event_type", F.lit(None).cast("string").alias("kind"), blob.alias("blob"))
    rows = payloads.with_bodies(rows, "kind", "blob", "body")
    return rows.select("event_id", "body", payloads.provenance_json("kind", "event_type", "event_id").alias("raw"))


@query("""SELECT source_kind, count(*) AS rows, count(doc_id) AS documents FROM (SELECT 'orders' AS source_kind, NULL AS doc_id FROM orders UNION ALL SELECT source, doc_id FROM documents) GROUP BY source_kind""")
def union_sources(spark, d):
    orders, docs = table(spark, d, "orders"), table(spark, d, "documents")
    found = ops.union_sources(orders.select(F.lit("orders").alias("source_kind"), "o_orderkey"), docs.select("doc_id", F.col("source").alias("source_kind")))
    return found.groupBy("source_kind").agg(F.count("*").alias("rows"), F.count("doc_id").alias("documents"))


@query("""SELECT s_nationkey::BIGINT AS chat_id, array_to_string(list(s_name ORDER BY s_suppkey), ',') AS handles FROM supplier GROUP BY s_nationkey""")
def chat_participants(spark, d):
    return ops.chat_participants(chat_tables(spark, d)).select("chat_id", F.array_join("handles", ",").alias("handles"))


@query("""SELECT l_orderkey AS message_id, count(*) AS n, sum((l_linenumber = 1)::INT)::BIGINT AS images FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey""")
def message_attachments(spark, d):
    found = ops.message_attachments(chat_tables(spark, d, attached=True))
    return found.groupBy("message_id").agg(F.count("*").alias("n"), F.count_if(F.col("mime_type") == "image/png").alias("images"))


@query("""WITH m AS (SELECT c_nationkey AS n, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT s_nationkey AS n, count(*) AS hs, list(s_name ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1),
a AS (SELECT n, count(*) AS media FROM m JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON k = l_orderkey GROUP BY n)
SELECT 'chat' || m.n AS source_thread_key, CASE WHEN m.n % 2 = 0 THEN n_name WHEN hs > 0 THEN array_to_string(names[1:4], ', ') || CASE WHEN hs > 4 THEN '...' ELSE '' END ELSE n_name END AS title,
  CASE WHEN m.n % 2 = 0 OR coalesce(hs,0) > 1 THEN 'group' ELSE 'direct' END AS thread_kind, count(*) AS message_count, any_value(coalesce(media,0)) AS media
FROM m JOIN nation ON n_nationkey = m.n LEFT JOIN h ON h.n = m.n LEFT JOIN a ON a.n = m.n GROUP BY m.n, n_name, hs, names""")
def import_chat(spark, d):
    out = imports.import_chat(chat_tables(spark, d, attached=True))
    media = out["media_objects"].groupBy(*rollups.THREAD).agg(F.count("*").alias("media"))
    found = out["threads"].join(rollups.thread_counts(out["messages"]), rollups.THREAD).join(media, rollups.THREAD, "left")
    return found.select("source_thread_key", "title", "thread_kind", "message_count", F.coalesce("media", F.lit(0)).alias("media"))


# Packets -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'meta-2026/instagram-ann-' || day || '-x' AS export_root, 'instagram-ann-' || day || '-x' AS name, count(DISTINCT conv_id) AS message_files, count(DISTINCT conv_id) AS folders
FROM (SELECT conv_id, unnest(CASE WHEN turn >= 1 THEN ['2026-01-01','2026-02-01'] ELSE ['2026-01-01'] END) AS day FROM conversations) GROUP BY day""")
def scan_packets(spark, d):
    found = packets.scan_packets(packet_files(spark, d), "instagram")
    return found.select("export_root", "name", "message_files", "folders")


@query("""WITH f AS (SELECT DISTINCT conv_id, unnest(CASE WHEN turn >= 1 THEN [1, 2] ELSE [1] END) AS seq FROM conversations)
SELECT 'conv_' || conv_id AS folder, seq AS source_seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS place FROM f""")
def import_order(spark, d):
    """The place of every message file among those of its thread: the source's number first, then the path's parts."""
    found = packets.read_message_files(packet_files(spark, d), "instagram", "seq")
    order = Window.partitionBy("thread_path").orderBy(F.struct("source_seq", "path_parts"))
    folder = F.element_at(F.split("thread_path", "/"), -1)
    return found.select(folder.alias("folder"), "source_seq", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {CONV} SELECT 'your_instagram_activity/' || thread AS source_thread_key, CASE WHEN any_value(grp) THEN 'group' ELSE 'direct' END AS thread_kind, 'Conversation ' || any_value(conv_id) AS title,
count(*) AS message_count, sum((turn % 2)::INT)::BIGINT AS media, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM conv GROUP BY thread""")
def import_packets(spark, d):
    out = imports.import_packets(packet_files(spark, d), "instagram", source_seq="seq")
    media = out["media_objects"].groupBy(*rollups.THREAD).agg(F.count("*").alias("media"))
    found = out["threads"].join(rollups.thread_counts(out["messages"]), rollups.THREAD).join(media, rollups.THREAD, "left")
    return found.select("source_thread_key", "thread_kind", "title", "message_count", F.coalesce("media", F.lit(0)).alias("media"), F.unix_millis("first_message_at").alias("first_ms"), F.unix_millis("last_message_at").alias("last_ms"))


@query("""SELECT 'file' || page_id AS path, CASE page_id % 4 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' ELSE 'messages is no list' END AS warning FROM pages WHERE page_id % 4 < 3""")
def rejected_files(spark, d):
    k = F.col("page_id") % 4
    body = F.when(k == 0, "{broken").when(k == 1, "[1]").when(k == 2, '{"messages": 1}').otherwise('{"messages": []}')
    files = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id", F.lit("/message_1.json")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.encode(body, "UTF-8").alias("content"))
    _, rejects = packets.split_valid(packets.read_message_files(files, "instagram"))
    return rejects.select(F.concat(F.lit("file"), F.regexp_extract("path", r"p(\d+)", 1)).alias("path"), "warning")


@query("""SELECT page_id, 'facebook:' || substr(sha256('t:m' || page_id || ':' || kind || ':' || i || ':' || url), 1, 24) AS object_key, kind AS media_kind, i AS media_index, 'root/' || url AS local_path
FROM pages, (VALUES ('photos', 1), ('sticker', 0)) AS k(kind, i)""")
def explode_media(spark, d):
    """A photo list whose first item has no uri, and a sticker that is an object."""
    item = lambda u: F.struct(u.alias("uri"))
    body = F.struct(F.array(item(F.lit(None).cast("string")), item(F.col("url"))).alias("photos"), item(F.col("url")).alias("sticker"))
    rows = table(spark, d, "pages").select("page_id", F.parse_json(F.to_json(body)).alias("payload"), F.lit("root").alias("export_root"), F.lit("t").alias("source_thread_key"), F.concat(F.lit("m"), "page_id").alias("source_message_key"))
    found = payloads.explode_media(rows, "facebook")
    return found.select(F.substr("source_message_key", F.lit(2)).cast("long").alias("page_id"), "object_key", "media_kind", "media_index", "local_path")


@query("""SELECT split_part(split_part(url,'//',2),'/',1) AS source_thread_key, page_id::VARCHAR AS source_message_key, count(*) AS media_count FROM pages GROUP BY ALL""")
def media_per_message(spark, d):
    rows = table(spark, d, "pages").select(F.lit("instagram").alias("source_kind"), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("source_thread_key"), F.col("page_id").cast("string").alias("source_message_key"))
    return rollups.media_per_message(rows).drop("source_kind")


# Reports and plans -------------------------------------------------------------------------------------------------


@query(f"""WITH {CONV}, e AS (SELECT 'p1' AS p, * FROM conv UNION ALL SELECT 'p2', * FROM conv WHERE turn >= 1),
s AS (SELECT p, 1 AS imports, count(DISTINCT thread) AS threads, count(DISTINCT CASE WHEN grp THEN thread END) AS groups, count(DISTINCT role) AS accounts, count(DISTINCT (thread, turn)) AS messages, count(DISTINCT CASE WHEN turn % 2 = 1 THEN (thread, turn) END) AS media FROM e GROUP BY p)
SELECT p AS source_path, imports::BIGINT AS imports, threads, groups, accounts, messages, media FROM s UNION ALL SELECT NULL, sum(imports)::BIGINT, sum(threads)::BIGINT, sum(groups)::BIGINT, sum(accounts)::BIGINT, sum(messages)::BIGINT, sum(media)::BIGINT FROM s""")
def import_summary(spark, d):
    rows = table(spark, d, "conversations").withColumn("source_path", F.explode(F.when(F.col("turn") >= 1, F.array(F.lit("p1"), F.lit("p2"))).otherwise(F.array(F.lit("p1")))))
    rows = rows.select(F.lit("instagram").alias("source_kind"), "source_path", F.col("conv_id").cast("string").alias("source_thread_key"), F.col("turn").cast("string").alias("source_message_key"), F.when(F.col("conv_id") % 3 == 0, "group").otherwise("direct").alias("thread_kind"), F.lit("instagram").alias("account_source_kind"), F.col("role").alias("account_key"), F.concat_ws(":", "conv_id", "turn").alias("object_key"), "turn")
    found = rollups.import_summary(rows, rows, rows, rows.where("turn % 2 = 1"))
    return found.where("source_path is not null or source_kind is null").drop("source_kind")


@query("""SELECT 'threads' AS "table", count(DISTINCT event_type) AS rows FROM events WHERE user_id % 2 = 0 UNION ALL SELECT 'messages', count(*) FROM events WHERE user_id % 2 = 0""")
def projection_counts(spark, d):
    rows = table(spark, d, "events").withColumn("source_kind", F.when(F.col("user_id") % 2 == 0, "facebook").otherwise("instagram"))
    return rollups.projection_counts({"threads": rows.select("source_kind", "event_type").distinct(), "messages": rows}, "facebook")


@query("""SELECT 'acct' || o_custkey % 5 AS export_account, count(*) AS threads FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1""")
def account_thread_counts(spark, d):
    path = F.when(F.col("o_orderkey") % 3 == 0, "other/").when(F.col("o_orderkey") % 3 == 1, "messages/inbox/").otherwise("your_facebook_activity/messages/")
    rows = table(spark, d, "orders").select(F.lit("facebook").alias("source_kind"), F.concat(F.lit("acct"), F.col("o_custkey") % 5, F.lit(":"), path, "o_orderkey").alias("source_thread_key"))
    return rollups.account_thread_counts(rows, "facebook")


def _reports(spark, d):
    nations, customers = table(spark, d, "nation"), table(spark, d, "customer")
    origin = F.element_at(F.array(*map(F.lit, ("provider-current", "last-known-good", "local", "other"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    accounts = nations.select(F.col("n_name").alias("account_key"), F.concat(F.lit("export-"), F.col("n_nationkey") % 3).alias("baseline_export_name"), origin.alias("origin"))
    found = customers.join(nations, F.expr("c_nationkey = n_nationkey and n_nationkey % 7 <> 6")).select(F.col("n_name").alias("account_key"), F.concat(F.lit("export-"), F.col("c_custkey") % 5).alias("name"), F.lit(2).alias("message_files"))
    previous = nations.select(F.col("n_name").alias("account_key"), F.lit("before").alias("last_success_at"))
    return rollups.freshness_report(accounts, found, previous, "now")


_FRESH = """WITH p AS (SELECT n_name AS a, count(*) * 2 AS files, count(DISTINCT c_custkey % 5) AS exports, bool_or(c_custkey % 5 = n_nationkey % 3) AS covered FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 7 <> 6 GROUP BY n_name),
r AS (SELECT n_name AS account_key, CASE WHEN coalesce(exports,0) = 0 THEN 'pending' ELSE ['current','degraded','local-current','local-fallback'][n_nationkey % 4 + 1] END AS status, coalesce(files,0) AS message_files, coalesce(exports,0) AS completed_exports,
  CASE WHEN coalesce(covered,false) THEN 'complete-through-latest-export' ELSE 'baseline-required' END AS history_coverage FROM nation LEFT JOIN p ON a = n_name)"""


@query(_FRESH + """ SELECT *, CASE WHEN status IN ('current','local-current') THEN 'now' ELSE 'before' END AS last_success_at FROM r""")
def freshness_report(spark, d):
    return _reports(spark, d)


@query(_FRESH + """ SELECT CASE WHEN bool_or(status = 'pending') THEN 'pending' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'current' END AS status, count(*) AS accounts, count(*) FILTER (status <> 'pending') AS accounts_ready FROM r""")
def aggregate_status(spark, d):
    return rollups.aggregate_status(_reports(spark, d))


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def active_accounts(spark, d):
    key = F.concat(F.lit("user"), F.col("c_custkey"))
    registry = table(spark, d, "customer").select("c_custkey", key.alias("account_key"), (F.col("c_acctbal") > 0).alias("enabled"))
    excluded = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("user"), "o_custkey").alias("account_key"))
    return pulls.active_accounts(registry, excluded).select("c_custkey")


def _listing(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("instagram-ann"), F.when(k % 3 == 0, "-").when(k % 3 == 1, "ie-").otherwise("-x-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 2 == 0, "-a").otherwise(""))
    return table(spark, d, "orders").select(k.cast("string").alias("id"), name.alias("name"), F.concat(F.lit("drive/"), name).alias("path"), k.alias("seq"), F.col("o_orderdate").cast("string").alias("modified"), F.col("o_totalprice").cast("string").alias("size"), F.md5(F.col("o_orderpriority")).alias("md5"))


_LISTED = """l AS (SELECT o_orderkey, 'instagram-ann-' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN '-a' ELSE '' END AS name, strftime(o_orderdate, '%Y%m%d')::INT AS date_key FROM orders WHERE o_orderkey % 3 = 0 AND year(o_orderdate) >= 2000)"""


@query(f"""WITH {_LISTED.replace(' AND year(o_orderdate) >= 2000', " AND strftime(o_orderdate, '%Y') LIKE '20%'")} SELECT o_orderkey::VARCHAR AS id, name, date_key FROM l""")
def select_packets(spark, d):
    return pulls.select_packets(_listing(spark, d), "instagram-ann-").select("id", "name", "date_key")


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders) SELECT o_orderkey::VARCHAR AS id FROM p WHERE NOT (o_orderstatus IN ('F','P') AND o_custkey % 2 = 0)""")
def plan_pulls(spark, d):
    rows = table(spark, d, "orders")
    found = rows.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("x/"), "o_orderkey").alias("path"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "no-message-files").otherwise("running")
    path = F.concat(F.when(F.col("o_custkey") % 2 == 0, "x/").otherwise("y/"), "o_orderkey")
    return pulls.plan_pulls(found, rows.select(F.col("o_orderkey").cast("string").alias("id"), path.alias("path"), status.alias("status"))).select("id")


@query("""SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 5 = 1 OR (o_orderkey % 5 = 2 AND o_orderpriority IS NOT NULL)""")
def changed_files(spark, d):
    """Of five files one is new, one has another size, one another checksum."""
    now, n = _listing(spark, d), F.col("seq") % 5
    then = now.where(n != 0).withColumn("size", F.when(n == 1, "0").otherwise(F.col("size"))).withColumn("md5", F.when(n == 2, F.lit(None)).otherwise(F.col("md5")))
    return pulls.changed_files(now, then).select("id")


@query("""SELECT page_id::VARCHAR AS id FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 0""")
def message_subtree_only(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(k.cast("string").alias("id"), F.concat(F.when(k % 3 == 0, "a/messages/").otherwise("a/messages_old/"), k).alias("path"), F.when(k % 2 == 1, "application/vnd.google-apps.document").alias("mime_type"))
    return pulls.message_subtree_only(rows, ["a/messages"]).select("id")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, unnest([0, 1]) AS again, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS owner FROM orders)
SELECT o_orderkey::VARCHAR AS id, again, CASE WHEN o_orderkey <> owner THEN 'm/f' || o_custkey || '--' || substr(o_orderkey::VARCHAR || 'abcdefghij',1,8) || '.json' ELSE 'm/f' || o_custkey || '.json' END AS target FROM l""")
def unique_targets(spark, d):
    """Every file is listed twice: what has a path keeps it."""
    rows = table(spark, d, "orders").withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("abcdefghij")).alias("id"), F.concat(F.lit("m/f"), "o_custkey", F.lit(".json")).alias("path"), (F.col("again") * 10**9 + F.col("o_orderkey")).alias("seq"), "again", "o_orderkey")
    return pulls.unique_targets(rows).select(F.col("o_orderkey").cast("string").alias("id"), "again", "target")


@query("""SELECT export_root, account FROM (SELECT 'p' || c_custkey AS export_root, 'acct' || c_nationkey AS account FROM customer) WHERE account <> 'acct3'""")
def account_checks(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("export_root"), F.concat(F.lit("acct"), "c_nationkey").alias("export_account"))
    return packets.other_accounts(rows, "Acct3").withColumnRenamed("export_account", "account")


@query("""WITH l AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN '-a' ELSE '' END AS more FROM orders WHERE o_orderkey % 3 = 0 AND strftime(o_orderdate, '%Y') LIKE '20%')
SELECT DISTINCT 'instagram-ann-' || day || more AS name FROM l QUALIFY row_number() OVER (ORDER BY day DESC, more DESC) = 1""")
def latest_packet(spark, d):
    return pulls.select_packets(_listing(spark, d), "instagram-ann-", latest_only=True).select("name")


@query("""WITH p AS (SELECT c_custkey, 'instagram-ann-2024-01-01-' || c_custkey AS name FROM customer WHERE c_nationkey % 2 = 0 AND c_mktsegment <> 'BUILDING'),
f AS (SELECT p.name, o_orderkey, o_orderkey % 5 AS kind, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 ORDER BY o_orderkey) AS no FROM orders JOIN p ON c_custkey = o_custkey)
SELECT o_orderkey::VARCHAR AS id, 'drive/' || name || CASE WHEN kind IN (0, 1) THEN '/messages/m' || kind || CASE WHEN no > 1 THEN '--' || substr(o_orderkey::VARCHAR, 1, 8) ELSE '' END || '.json' WHEN kind = 3 THEN '/messages/doc' ELSE '/other/m' END AS path,
  CASE WHEN kind IN (0, 1) THEN 'fetch' WHEN kind = 3 THEN 'provider document' ELSE 'outside' END AS what FROM f WHERE kind <> 1 OR o_orderkey % 2 = 0""")
def fetch_plan(spark, d):
    """Packets of customers whose segment is not complete yet; of five files two are messages (half of one kind is there
    already), one is a provider's document and two lie elsewhere."""
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    name = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "instagram-ann-2024-01-01-").otherwise("instagram-annie-"), "c_custkey")
    listing = customers.select(F.col("c_custkey").cast("string").alias("id"), name.alias("name"), F.concat(F.lit("drive/"), name).alias("path"), F.lit(pulls.FOLDER).alias("mime_type"), "c_mktsegment")
    done = listing.where("c_mktsegment = 'BUILDING'").select("id", "path", F.lit("completed").alias("status"))
    k = F.col("o_orderkey") % 5
    path = F.when(k < 2, F.concat(F.lit("messages/m"), k, F.lit(".json"))).when(k == 3, "messages/doc").otherwise("other/m")
    mime = F.when(k == 3, "application/vnd.google-apps.document").otherwise("application/json")
    files = orders.select(F.col("o_custkey").cast("string").alias("packet_id"), F.col("o_orderkey").cast("string").alias("id"), path.alias("path"), mime.alias("mime_type"), F.lit("t").alias("modified"), F.lit("1").alias("size"), F.lit("c").alias("md5"), F.lit(True).alias("can_download"), F.col("o_orderkey").alias("seq"))
    there = files.where("seq % 5 = 1 and seq % 2 = 1").select("id", "modified", "size", "md5")
    plan = reports.plan_fetch(listing, files, done, there, "instagram-ann-", ["messages"])
    fetched = plan["files"].select("id", F.col("target").alias("path"), F.lit("fetch").alias("what"))
    return fetched.union(plan["skipped"].select("id", "path", F.col("reason").alias("what")))


@query("""WITH n AS (SELECT 'n' || n_nationkey AS account_key, n_nationkey FROM nation), s AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS files FROM customer GROUP BY 1)
SELECT account_key, CASE WHEN files IS NULL THEN 'pending' ELSE 'current' END AS status, coalesce(files, 0) * 2 AS message_files, (files IS NOT NULL)::BIGINT * 2 AS completed_exports,
  CASE WHEN files IS NOT NULL AND n_nationkey % 2 = 0 THEN 'complete-through-latest-export' ELSE 'baseline-required' END AS history_coverage, CASE WHEN files IS NULL THEN 'before' ELSE 'now' END AS last_success_at, 'now' AS checked_at FROM n LEFT JOIN s ON c_nationkey = n_nationkey""")
def freshness_job(spark, d):
    """Two packets per account are scanned, and the report is read back from the run log."""
    day = F.explode(F.array(F.lit("2026-01-01"), F.lit("2026-02-01")))
    files = table(spark, d, "customer").withColumn("day", day).select(
        F.concat(F.lit("instagram-n"), "c_nationkey", F.lit("-"), "day", F.lit("/your_instagram_activity/messages/inbox/t"), "c_custkey", F.lit("/message_1.json")).alias("path"),
        F.to_timestamp("day").alias("modificationTime"),
    )
    key = F.concat(F.lit("n"), "n_nationkey")
    base = F.concat(F.lit("instagram-"), key, F.when(F.col("n_nationkey") % 2 == 0, "-2026-01-01").otherwise("-2025-01-01"))
    accounts = table(spark, d, "nation").select(key.alias("account_key"), base.alias("baseline_export_name"), F.lit("provider-current").alias("origin"))
    log = new_folder(spark, "log")
    reports.check_freshness(files, "instagram", accounts, accounts.select("account_key", F.lit("before").alias("last_success_at")), "now", log)
    return spark.read.json(log)


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def stale_views(spark, d):
    """Views of customers without a pending order are stale."""
    existing = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("v--"), "c_custkey").alias("view_name"))
    return views.stale_views(existing, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("v--"), "o_custkey").alias("view_name"))).select("c_custkey")


_RENDERED = """, mine AS (SELECT DISTINCT person, thread FROM people), seen AS (SELECT person, count(*) AS n, sum((turn % 2)::INT) AS media FROM mine JOIN conv USING (thread) GROUP BY person),
days AS (SELECT count(DISTINCT (thread, ts_ms // 86400000)) AS n FROM conv)
SELECT unnest(['people', 'person_threads', 'timelines', 'media', 'group_members', 'group_threads', 'rosters', 'transcripts', 'manifest']) AS "view", unnest([(SELECT count(DISTINCT person) FROM people), (SELECT count(*) FROM mine),
  (SELECT sum(least(n, 40)) FROM seen), (SELECT sum(least(media, 100)) FROM seen), (SELECT count(*) FROM people WHERE grp), (SELECT count(*) FROM per WHERE grp), (SELECT count(*) FROM people),
  (SELECT count(*) + sum((turn % 2)::INT) FROM conv) + (SELECT n FROM days), 1])::BIGINT AS rows"""


@query(GRAPH + _RENDERED)
def render_graph(spark, d):
    """Every view is rendered, written, and read back."""
    folder = new_folder(spark, "views")
    out = rebuild.render_graph(graph(spark, d), folder)
    counts = [sinks.read_view(spark, folder, name).agg(F.lit(name).alias("view"), F.count("*").alias("rows")) for name in out]
    return reduce(DataFrame.union, counts)


@query("""SELECT source_kind, sum(n)::BIGINT AS n, count(*) AS runs FROM (SELECT event_type AS source_kind, count(*) AS n, unnest([1, 2]) AS run FROM events GROUP BY event_type) GROUP BY source_kind""")
def run_log(spark, d):
    folder, summary = new_folder(spark, "log"), table(spark, d, "events").groupBy(F.col("event_type").alias("source_kind")).agg(F.count("*").alias("n"))
    for _ in range(2):
        sinks.append_run_log(summary, folder)
    return spark.read.json(folder).groupBy("source_kind").agg(F.sum("n").alias("n"), F.count("*").alias("runs"))


@query(f"""WITH {CONV} SELECT thread AS source_thread_key, count(*) AS message_count, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM conv GROUP BY thread""")
def accumulate_packets(spark, d):
    """Both exports of the merge, the later first, folded in by a stream of complete packets; the first comes twice."""
    both = exports(spark, d)
    folder = new_folder(spark, "stream")
    read = lambda batch: both.join(batch.select(F.col("packet").alias("export_root")).distinct(), "export_root", "left_semi")
    for packet in ("e2", "e1", "e1"):
        both.where(F.col("export_root") == packet).select(F.col("export_root").alias("packet")).limit(1).write.mode("append").parquet(f"{folder}/manifest")
        accumulate(spark, f"{folder}/manifest", "packet string", read, f"{folder}/messages", f"{folder}/checkpoint").awaitTermination()
    m = accumulated(spark, f"{folder}/messages")
    return m.groupBy("source_thread_key").agg(F.count("*").alias("message_count"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query("""SELECT export_account, count(*) AS messages FROM (SELECT '00' || user_id % 4 AS export_account, user_id % 4 = 1 AS ready, event_id FROM events) WHERE NOT ready OR event_id % 2 = 0 GROUP BY 1""")
def rebuild_projection(spark, d):
    """All accounts are written; then the only one that is ready advances to a candidate that has lost messages."""
    rows = table(spark, d, "events").select(F.lit("facebook").alias("source_kind"), F.concat(F.lit("00"), F.col("user_id") % 4).alias("export_account"), "event_id")
    path, names = new_folder(spark, "canonical"), [f"00{i}" for i in range(4)]
    rebuild.rebuild_projection(spark, path, {"messages": rows}, "facebook", names, names)
    rebuild.rebuild_projection(spark, path, {"messages": rows.where("event_id % 2 = 0")}, "facebook", names, ["001"], independent=True)
    return sinks.read_canonical(spark, path, "messages").groupBy("export_account").agg(F.count("*").alias("messages"))
