import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from letterloom import queries
from letterloom.functions import payloads
from letterloom.operators import messages as ops, rollups, views
from letterloom.plans import imports, rebuild
from letterloom.queries import conversations
from letterloom.sources import chat, packets, sinks
from letterloom.sources.shared import Versions
from letterloom.streaming import accumulate as streaming
from letterloom.streaming.accumulate import accumulate_packets, accumulated
from conftest import SF


def put(root: Path, path: str, value) -> None:
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(value if isinstance(value, bytes) else json.dumps(value, ensure_ascii=False).encode())


def told(people, *said, title=""):
    return {"participants": [{"name": p} for p in people], "title": title, "messages": [{"sender_name": s, "timestamp_ms": t, "content": c, **more} for s, t, c, more in said]}


def test_packets_from_disk(spark, tmp_path):
    inbox = "instagram-ann-2026-01-01-x/your_instagram_activity/messages/inbox"
    put(tmp_path, f"{inbox}/a b/message_1.json", told(["Ann", "Bob"], ("Ann", 1000, "hi", {"photos": [{"uri": "p/1.jpg"}]}), ("Bob", 2000, "yo", {})))
    put(tmp_path, f"{inbox}/c/message_1.json", told(["Ann", "Bob", "Cy"], ("Dee", 3000, "new", {})))
    put(tmp_path, f"{inbox}/d/message_1.json", b"{broken")
    put(tmp_path, f"{inbox}/e/message_1.json", {"messages": [], "participants": [], "x": "\xe9"})
    put(tmp_path, f"{inbox}/f/other.json", {"messages": []})
    files = packets.list_files(spark, str(tmp_path))
    scan = packets.scan_packets(files, "instagram").collect()
    assert [(r.name, r.message_files, r.folders) for r in scan] == [("instagram-ann-2026-01-01-x", 4, 4)]
    assert [r.folder.rpartition("/")[2] for r in packets.packet_folders(files, "instagram").collect()] == ["a b", "c", "d", "e"]
    plan = packets.scan_packets(files, "instagram")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    out = imports.import_packets(files, "instagram")
    threads = {r.source_thread_key.rpartition("/")[2]: r for r in out["threads"].collect()}
    assert set(threads) == {"a b", "c", "e"} and threads["c"].thread_kind == "group" and threads["a b"].title == "Ann, Bob"
    assert out["messages"].count() == 3 and out["media_objects"].count() == 1
    assert {r.stable_key for r in out["identities"].where("kind = 'person'").collect()} == {"person:instagram:" + n for n in ("ann", "bob", "cy", "dee")}
    assert out["identities"].where("kind = 'group'").count() == 1
    assert [r.warning for r in out["rejects"].collect()] == ["not JSON"]
    with pytest.raises(ValueError, match="not JSON"):
        imports.import_packets(files, "instagram", fail_fast=True)
    with pytest.raises(ValueError, match="belongs to account"):
        imports.import_packets(files, "instagram", account="bob")
    assert all(r.source_thread_key.startswith("ann:") for r in imports.import_packets(files, "instagram", account="ann")["threads"].collect())


def test_owner_and_latin1(spark, tmp_path):
    put(tmp_path, "facebook-ann-2026-01-01-x/your_facebook_activity/messages/inbox/t/message_1.json", json.dumps(told(["Ann Me", "José"], ("Ann Me", 5, "olé", {"sticker": {"uri": "s.png"}}), ("", 6, None, {})), ensure_ascii=False).encode("latin-1"))
    registry = spark.createDataFrame([("ann", "Ann", "person", "person:self", ["Ann Me"])], "account_key string, display_name string, owner_kind string, owner_identity_key string, self_names array<string>")
    out = imports.import_packets(packets.list_files(spark, str(tmp_path)), "facebook", registry=registry)
    senders = {r.body_text: (r.sender_identity_key, r.sender_account_key) for r in out["messages"].collect()}
    assert senders == {"olé": ("person:self", "ann"), None: ("person:facebook:unknown-facebook-sender", "unknown-facebook-sender")}
    assert out["media_objects"].first().local_path == "facebook-ann-2026-01-01-x/s.png"
    assert "person:facebook:jose" in {r.stable_key for r in out["identities"].collect()}


def test_merge_keeps_the_largest_multiplicity_in_any_order(spark):
    rows = [("e1", 1, "x"), ("e1", 2, "x"), ("e2", 1, "x"), ("e2", 5, "y"), ("e3", 9, "x")]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "export_root string, pos int, fp string").repartition(parts)
        df = df.select(F.lit("k").alias("source_kind"), F.lit("t").alias("source_thread_key"), "export_root", "fp", F.lit(5).cast("long").alias("ts_ms"), F.struct("export_root", "pos").alias("import_seq"))
        got = sorted((r.fp, r.occurrence, r.import_seq.export_root) for r in ops.merge_exports(df).collect())
        assert got == [("x", 0, "e3"), ("x", 1, "e1"), ("y", 0, "e2")]
        merged = ops.merge_exports(df)
        assert sorted(r.source_message_key for r in merged.collect()) == sorted({f"v2:5:{f}:{o}" for f, o, _ in got})


@pytest.mark.parametrize("small", [1 << 17, 0])
def test_exports_one_by_one_are_all_exports_at_once(spark, small):
    import random

    rng = random.Random(3)
    rows = [(f"e{e}", i, f"t{rng.randrange(3)}", f"p{rng.randrange(6)}") for e in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "export_root string, pos int, source_thread_key string, fp string").repartition(5)
    df = df.withColumn("source_kind", F.lit("k")).withColumn("ts_ms", F.lit(5).cast("long")).withColumn("import_seq", F.struct("export_root", "pos"))
    told = lambda merged: sorted(r[0] + r[1] for r in merged.select("source_thread_key", "source_message_key").collect())
    want = told(ops.merge_exports(df))
    for order in ("0123", "3102"):
        held = ops.merge_exports(df.where("false"))
        for e in order:
            new = ops.merge_new(ops.merged_counts(held), df.where(F.col("export_root") == f"e{e}"), small)
            held = imports.once(held.unionByName(new), "held")
        assert told(held) == want
    again = ops.merge_new(ops.merged_counts(held), df, small)
    assert again.count() == 0


def chat_rows(spark, with_third=True):
    third = [(3, "m3", None, b"\x00NSString\x00from blob\x00", 700000002000000000, 0, 2)] if with_third else []
    make = spark.createDataFrame
    return chat.conform(spark, {
        "handle": make([(1, "+1 555"), (2, "Bob@x.org")], "ROWID long, id string"),
        "chat": make([(1, "c1", "+1 555", None), (2, "c2", None, "Team")], "ROWID long, guid string, chat_identifier string, display_name string"),
        "message": make([(1, "m1", "hi", None, 700000000000000000, 0, 1), (2, None, "me", None, 700000001000000000, 1, None), *third], "ROWID long, guid string, text string, attributedBody binary, date long, is_from_me int, handle_id long"),
        "chat_message_join": make([(1, 1), (1, 2), *([(2, 3)] if with_third else [])], "chat_id long, message_id long"),
        "chat_handle_join": make([(1, 1), (2, 1), (2, 2)], "chat_id long, handle_id long"),
        "attachment": make([(9, "a9", "f.png", None, "public.png")], "ROWID long, guid string, filename string, mime_type string, uti string"),
        "message_attachment_join": make([(3, 9)], "message_id long, attachment_id long"),
    })


def test_chat_import_and_deletion(spark):
    out = imports.import_chat(chat_rows(spark))
    counts = {n: out[n].count() for n in ("threads", "messages", "media_objects", "accounts")}
    assert counts == {"threads": 2, "messages": 3, "media_objects": 1, "accounts": 3}
    assert {r.body_text for r in out["messages"].collect()} == {"hi", "me", "from blob"}
    assert {(r.title, r.thread_kind) for r in out["threads"].collect()} == {("+1 555", "direct"), ("Team", "group")}
    less = imports.import_chat(chat_rows(spark, False))
    assert less["messages"].count() == 2 and "person:imessage:bob@x.org" not in {r.stable_key for r in less["identities"].collect()}
    with pytest.raises(ValueError, match="required chat tables"):
        chat.conform(spark, {"chat": spark.range(1)})


def test_chat_people_are_as_many_as_members_and_senders(spark, monkeypatch):
    """Many messages in a chat of many, chats that share a thread, and only rows with a property list go to Python."""
    make, written = spark.createDataFrame, {}
    messages = [(i, f"m{i}", "hi", None, 700000000000000000 + i, int(i % 5 == 0), 1 + i % 7) for i in range(400)]
    tables = chat.conform(spark, {
        "handle": make([(i, f"P{i}@x.org") for i in range(1, 31)], "ROWID long, id string"),
        "chat": make([(1, "c1", None, "Team"), (2, "c2", None, None), (3, "c2", None, "Same thread")], "ROWID long, guid string, chat_identifier string, display_name string"),
        "message": make(messages, "ROWID long, guid string, text string, attributedBody binary, date long, is_from_me int, handle_id long"),
        "chat_message_join": make([(1 + i % 3, i) for i in range(400)], "chat_id long, message_id long"),
        "chat_handle_join": make([(1, i) for i in range(1, 31)] + [(2, 1), (3, 2)], "chat_id long, handle_id long"),
    })
    plain = imports.once
    monkeypatch.setattr(imports, "once", lambda df, name: written.setdefault(name, plain(df, name)))
    out = imports.import_chat(tables)
    assert out["people"].count() == (30 + 1) + (2 + 1) + 7 - 2  # members and owner per thread, senders of the second that it does not list
    assert {(r.source_thread_key, r.title, r.thread_kind) for r in out["threads"].collect()} == {("c1", "Team", "group"), ("c2", "Same thread", "group")}
    shown = {r.stable_key: r.display_name for r in out["identities"].where("kind = 'person'").collect()}
    assert shown["person:self"] == "Me" and shown["person:imessage:p30@x.org"] == "P30@x.org" and len(shown) == 31
    plan = payloads.with_bodies(tables["message"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" in plan
    below = plan[plan.index("ArrowEvalPython") :]
    assert "Filter" in below and "hex(substring(attributedBody" in below


def test_chat_relations_are_dealt_out_by_their_rows(spark, monkeypatch):
    """A task joins and sorts so many messages or attachments, whatever their number and that of Spark's partitions."""
    make, written = spark.createDataFrame, {}
    tables = chat.conform(spark, {
        "chat": make([(1, "c1", None, "Team")], "ROWID long, guid string, chat_identifier string, display_name string"),
        "message": make([(i, f"m{i}", "hi", 700000000000000000 + i, 1) for i in range(1200)], "ROWID long, guid string, text string, date long, is_from_me int"),
        "chat_message_join": make([(1, i) for i in range(1200)], "chat_id long, message_id long"),
        "attachment": make([(i, f"a{i}", "f.png") for i in range(2400)], "ROWID long, guid string, filename string"),
        "message_attachment_join": make([(i // 2, i) for i in range(2400)], "message_id long, attachment_id long"),
    })
    plain = imports.once
    monkeypatch.setattr(imports, "once", lambda df, name: written.setdefault(name, plain(df, name)))
    monkeypatch.setattr("letterloom.operators.messages.TASK_ROWS", 200, raising=False)
    out = imports.import_chat(tables)
    in_task = lambda df: [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(written["messages"].inputFiles()) == 6 and written["messages"].count() == 1200
    held = in_task(out["media_objects"])
    assert sum(held) == 2400 and len(held) == 12 and max(held) < 300


def test_chat_mapping_takes_large_order_keys(spark, tmp_path):
    """Dates of the mapping are nanoseconds, which keys of over nine millions would exceed."""
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("customer", None), ("supplier", None), ("nation", None)):
        df = queries.table(spark, SF, name)
        (df.withColumn(key, F.col(key) + 20_000_000) if key else df).write.parquet(f"{tmp_path}/{name}.parquet")
    seen = [sorted(map(tuple, queries.import_chat(spark, str(d)).collect())) for d in (SF, tmp_path)]
    assert seen[0] == seen[1] and len(seen[0]) > 5


def test_chat_relations_from_a_database(spark, tmp_path):
    """The Derby that Spark ships: ranges of the key, columns and relations that are missing, rows without a key."""
    url = f"jdbc:derby:{tmp_path}/chats"
    connection = spark._jvm.java.sql.DriverManager.getConnection(f"{url};create=true")
    said = connection.createStatement()
    said.execute("CREATE TABLE chat (rowid BIGINT, guid VARCHAR(9), chat_identifier VARCHAR(9), display_name VARCHAR(9))")
    said.execute("CREATE TABLE message (text VARCHAR(20), rowid BIGINT, guid VARCHAR(9), date BIGINT, is_from_me INT, handle_id BIGINT, extra INT)")
    said.execute("CREATE TABLE chat_message_join (chat_id BIGINT, message_id BIGINT)")
    said.execute("CREATE TABLE handle (rowid BIGINT, id VARCHAR(9))")
    said.execute("INSERT INTO chat VALUES (1, 'c1', 'Ann', NULL)")
    said.execute("INSERT INTO handle VALUES (1, 'Ann')")
    for i in range(40):
        said.execute(f"INSERT INTO message VALUES ('text {i}', {i}, 'm{i}', {700000000000000000 + i}, 0, 1, 5)")
        said.execute(f"INSERT INTO chat_message_join VALUES (1, {i})")
    said.execute("INSERT INTO message VALUES ('no key', NULL, 'x', 0, 0, 1, 5)")
    connection.close()
    tables = chat.read_chat_database(spark, url, partitions=4)
    message = tables["message"]
    assert message.count() == 41 and message.columns == [c.split()[0] for c in chat.TABLES["message"].split(", ")] and message.where("attributedBody is not null").count() == 0
    assert message.rdd.getNumPartitions() == 4 and len({r[0] for r in message.select(F.spark_partition_id()).distinct().collect()}) == 4
    plan = message.where("ROWID = 7").select("text")._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan.lower() and "guid" not in plan.split("ReadSchema")[1].lower()
    assert tables["attachment"].count() == 0
    out = imports.import_chat(tables)
    assert out["messages"].count() == 40 and out["threads"].first().title == "Ann"


def test_a_source_is_parsed_once_and_accounts_are_counted_on_paths(spark, tmp_path, monkeypatch):
    folder = "instagram-{}-2026-01-01-x/your_instagram_activity/messages/inbox/t/message_1.json"
    put(tmp_path, folder.format("ann"), told(["Ann", "Bob"], ("Ann", 1000, "hi", {})))
    put(tmp_path, folder.format("bob"), b"{broken")
    seen, plain = [], imports.once
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(imports, "once", lambda df, name: (seen.append((name, plan(df))), plain(df, name))[1])
    files = packets.list_files(spark, str(tmp_path))
    out = imports.import_packets(files, "instagram")
    assert [r.source_thread_key for r in out["threads"].collect()] == ["ann:your_instagram_activity/messages/inbox/t"]  # two accounts, one unreadable
    assert [r.warning for r in out["rejects"].collect()] == ["not JSON"]
    scans = [line for line in dict(seen)["parsed"].splitlines() if "FileScan binaryFile" in line]
    assert sum("content#" in line for line in scans) == 1 and len(scans) == 2
    assert "content#" not in plan(packets.named_packets(files, "instagram").agg(F.count_distinct("export_account")))
    for name in ("rejects", "warnings", "threads", "messages"):
        assert "binaryFile" not in plan(out[name]) and "parse_json" not in plan(out[name])


def test_gates_and_replacement(spark, tmp_path):
    path = str(tmp_path / "canon")
    rows = spark.createDataFrame([("facebook", "a", "t1"), ("facebook", "a", "t2"), ("facebook", "b", "t3"), ("imessage", None, "t4")], "source_kind string, export_account string, source_thread_key string")
    tables = {"messages": rows, "rejects": rows}
    rebuild.rebuild_projection(spark, path, tables, "facebook", ["a", "b"], ["a", "b"])
    rebuild.rebuild_projection(spark, path, tables, "imessage", [None], [None])
    kept = lambda: sorted(r.source_thread_key for r in sinks.read_canonical(spark, path, "messages").collect())
    assert kept() == ["t1", "t2", "t3", "t4"]
    with pytest.raises(rebuild.Held, match="pending"):
        rebuild.rebuild_projection(spark, path, tables, "facebook", ["a", "b"], ["a"])
    less = {"messages": rows.where("source_thread_key not in ('t2', 't3')")}
    assert rebuild.rebuild_projection(spark, path, less, "facebook", ["a", "b"], ["a"], independent=True) == ["a"]
    assert kept() == ["t1", "t3", "t4"]
    with pytest.raises(rebuild.Held, match="empty"):
        rebuild.rebuild_projection(spark, path, less, "facebook", ["a", "b"], ["a", "b"])
    assert kept() == ["t1", "t3", "t4"]


def test_stream_is_the_batch_whatever_the_order(spark, tmp_path):
    rows = spark.createDataFrame([(p, s, t, i, f) for p, s in (("e1", 1), ("e2", 2), ("e3", 3)) for t in ("a", "b") for i, f in enumerate(["x", "x", "y"][: s + (t == "a")])], "export_root string, seq int, t string, pos int, f string")
    each = rows.select(F.lit("k").alias("source_kind"), F.col("t").alias("source_thread_key"), "export_root", F.col("f").alias("fp"), F.lit(5).cast("long").alias("ts_ms"), F.struct("seq", "pos").alias("import_seq"))
    want = sorted(map(tuple, ops.merge_exports(each).select("source_thread_key", "source_message_key", "export_root").collect()))

    def read(batch):
        return each.join(batch.select(F.col("packet").alias("export_root")), "export_root", "left_semi")

    for n, order in enumerate((("e1", "e2", "e3"), ("e3", "e1", "e2", "e1"))):
        manifest, path = str(tmp_path / f"m{n}"), str(tmp_path / f"out{n}")
        for packet in order:
            spark.createDataFrame([(packet,)], "packet string").write.mode("append").parquet(manifest)
            accumulate_packets(spark, manifest, "packet string", read, path, str(tmp_path / f"c{n}")).awaitTermination()
        got = accumulated(spark, path)
        assert sorted(map(tuple, got.select("source_thread_key", "source_message_key", "export_root").collect())) == want


def test_views_and_log_are_written(spark, tmp_path):
    from letterloom.queries import graph

    out = rebuild.render_graph(graph(spark, SF), str(tmp_path / "views"))
    assert sinks.read_view(spark, str(tmp_path / "views"), "people").count() == out["people"].count()
    lines = [r.line for f in sorted((tmp_path / "views" / "transcripts").glob("version=*/bucket=*/part-*")) for r in spark.read.json(str(f)).collect()]
    assert lines[0].startswith("## 20") and len(lines) == out["transcripts"].count()
    for _ in range(2):
        sinks.append_run_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    counted = rollups.thread_counts(conversations(spark, SF)).agg(F.sum("message_count")).first()[0]
    assert counted == spark.read.parquet(f"{SF}/conversations.parquet").count()


def test_only_views_that_changed_are_written(spark, tmp_path, monkeypatch):
    path, top = str(tmp_path / "views"), tmp_path / "views"
    rows = lambda *told: spark.createDataFrame([(f"p{p}", r, t) for p, r, t in told], "identity_key string, rank int, title string").repartition(3)
    first = [(p, r, "é" if p % 2 else None) for p in range(40) for r in range(3)]
    views = lambda told: {"timelines": rows(*told), "people": spark.range(3).select(F.col("id").alias("display_name"))}
    files = lambda: {p: p.stat().st_mtime_ns for p in top.rglob("part-*")}
    got = lambda: sorted(tuple(r) for r in sinks.read_view(spark, path, "timelines", "identity_key string, rank int, title string").collect())
    want = lambda told: sorted((f"p{p}", r, t) for p, r, t in told)
    wrote = sinks.write_views(views(first), path, 16)
    assert len(wrote["timelines"]) > 8 and wrote["people"] == [0]
    before, number = files(), Versions(spark, path).number
    assert sinks.write_views(views(first[::-1]), path, 16) == {"timelines": [], "people": []}
    assert files() == before and Versions(spark, path).number == number and not list((top / "_writing").glob("[!.]*"))
    changed = [(p, r, "new" if (p, r) == (7, 1) else t) for p, r, t in first if p != 11]
    monkeypatch.setattr(Versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        sinks.write_views(views(changed), path, 16)
    monkeypatch.undo()
    assert got() == want(first)
    wrote = sinks.write_views(views(changed), path, 16)
    assert 1 <= len(wrote["timelines"]) <= 2 and wrote["people"] == [] and got() == want(changed)
    assert set(before) & set(files()) and [r["rank"] for r in sinks.read_view(spark, path, "timelines").where("identity_key = 'p7'").collect()] == [0, 1, 2]
    sinks.write_views(views([]), path, 16)
    assert got() == [] and sinks.read_view(spark, path, "people").count() == 3


def test_sources_share_one_graph(spark, tmp_path):
    folder = "facebook-{}-2026-01-01-x/your_facebook_activity/messages/inbox/t/message_1.json"
    for account, friend in (("ann", "Bob"), ("cy", "Dee")):
        put(tmp_path / "in", folder.format(account), told([account, friend, "Eve"], (friend, 1000, f"from {friend}", {"photos": [{"uri": "p.jpg"}]})))
    path = str(tmp_path / "canon")
    both = imports.import_packets(packets.list_files(spark, str(tmp_path / "in")), "facebook")
    rebuild.rebuild_projection(spark, path, both, "facebook", ["ann", "cy"], ["ann", "cy"])
    rebuild.rebuild_projection(spark, path, imports.import_chat(chat_rows(spark)), "imessage", [None], [None])
    names = lambda: {r.stable_key for r in rebuild.canonical_graph(spark, path)["identities"].where("kind = 'person'").collect()}
    everyone = {f"person:facebook:{n}" for n in ("ann", "bob", "cy", "dee", "eve")} | {"person:imessage:+1555", "person:imessage:bob@x.org", "person:self"}
    assert names() == everyone
    put(tmp_path / "in", folder.format("cy"), told(["cy", "Fay", "Eve"], ("Fay", 1000, "now from Fay", {})))
    again = imports.import_packets(packets.list_files(spark, str(tmp_path / "in")), "facebook")
    rebuild.rebuild_projection(spark, path, again, "facebook", ["ann", "cy"], ["cy"], independent=True)
    rebuild.rebuild_projection(spark, path, imports.import_chat(chat_rows(spark, False)), "imessage", [None], [None])
    assert names() == everyone - {"person:facebook:dee", "person:imessage:bob@x.org"} | {"person:facebook:fay"}
    graph = rebuild.canonical_graph(spark, path)
    assert graph["messages"].count() == 4 and graph["media_objects"].count() == 1
    people = {r.identity_key: (r.messages, r.group_threads) for r in rebuild.render_graph(graph)["people"].collect()}
    assert people["person:facebook:eve"] == (2, 2) and people["person:self"] == (2, 0)


def test_accounts_are_text_and_gates_hold_for_them(spark, tmp_path):
    path = str(tmp_path / "canon")
    rows = spark.createDataFrame([("facebook", "007", "t1"), ("facebook", "012", "t2"), ("facebook", "a/b=c %", "t3")], "source_kind string, export_account string, source_thread_key string")
    names = ["007", "012", "a/b=c %"]
    rebuild.rebuild_projection(spark, path, {"messages": rows}, "facebook", names, names)
    kept = lambda: sorted((r.export_account, r.source_thread_key) for r in sinks.read_canonical(spark, path, "messages").collect())
    assert kept() == [("007", "t1"), ("012", "t2"), ("a/b=c %", "t3")]
    with pytest.raises(rebuild.Held, match="007 is empty"):
        rebuild.rebuild_projection(spark, path, {"messages": rows.where("export_account <> '007'")}, "facebook", names, names)
    assert len(kept()) == 3 and sinks.read_canonical(spark, str(tmp_path / "none"), "messages").count() == 0


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "canon")
    rows = spark.createDataFrame([("facebook", "a", "old")], "source_kind string, export_account string, source_thread_key string")
    new = rows.withColumn("source_thread_key", F.lit("new"))
    both = lambda df: {"messages": df, "threads": df}
    kept = lambda: [sinks.read_canonical(spark, path, n).first().source_thread_key for n in ("messages", "threads")]
    sinks.write_canonical(both(rows), path, {"facebook": ["a"]})
    broken = new.withColumn("source_thread_key", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        sinks.write_canonical({"messages": new, "threads": broken}, path, {"facebook": ["a"]})
    assert kept() == ["old", "old"]
    monkeypatch.setattr(Versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        sinks.write_canonical(both(new), path, {"facebook": ["a"]})
    monkeypatch.undo()
    assert kept() == ["old", "old"]
    late = Versions(spark, path)
    sinks.write_canonical(both(new), path, {"facebook": ["a"]})
    assert kept() == ["new", "new"]
    with pytest.raises(RuntimeError, match="another writer"):
        late.publish({"facebook/a": "other"})
    Versions(spark, path).sweep([f"{path}/messages"], keep=1)
    assert kept() == ["new", "new"] and len(list((tmp_path / "canon" / "messages").glob("version=*"))) == 1


def test_a_fold_that_dies_is_folded_again(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(p, t, i) for p in ("e1", "e2") for t in "ab" for i in range(2)], "export_root string, t string, pos int")
    each = rows.select(F.lit("k").alias("source_kind"), F.col("t").alias("source_thread_key"), "export_root", F.concat("export_root", "pos").alias("fp"), F.lit(5).cast("long").alias("ts_ms"), F.struct("export_root", "pos").alias("import_seq"))
    read = lambda batch: each.join(batch.select(F.col("packet").alias("export_root")), "export_root", "left_semi")
    manifest, path, seen = str(tmp_path / "m"), str(tmp_path / "out"), str(tmp_path / "c")

    def fold(packet):
        spark.createDataFrame([(packet,)], "packet string").write.mode("append").parquet(manifest)
        accumulate_packets(spark, manifest, "packet string", read, path, seen, buckets=2).awaitTermination()

    fold("e1")
    with monkeypatch.context() as m:
        m.setattr(streaming.Versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            fold("e2")
    assert accumulated(spark, path).count() == 4
    accumulate_packets(spark, manifest, "packet string", read, path, seen, buckets=2).awaitTermination()
    assert accumulated(spark, path).count() == 8
    with pytest.raises(Exception, match="2 buckets"):
        spark.createDataFrame([("e1",)], "packet string").write.mode("append").parquet(manifest)
        accumulate_packets(spark, manifest, "packet string", read, path, seen, buckets=3).awaitTermination()


def test_what_files_leave_out(spark, tmp_path):
    inbox = "instagram-ann-2026-01-01-x/your_instagram_activity/messages/inbox"
    put(tmp_path, f"{inbox}/a/message_1.json", {"participants": [{"name": "Ann"}], "messages": ["odd", {"sender_name": "Ann", "timestamp_ms": 5, "content": "  hi "}, None, 3]})
    put(tmp_path, f"{inbox}/b/message_1.json", {"participants": [{"name": "Bob"}]})
    put(tmp_path, f"{inbox}/c/message_1.json", {"messages": None})
    put(tmp_path, f"{inbox}/d/message_1.json", {"messages": "no"})
    out = imports.import_packets(packets.list_files(spark, str(tmp_path)), "instagram")
    assert sorted(r.source_thread_key[-1] for r in out["threads"].collect()) == ["a", "b", "c"] and out["messages"].count() == 1
    assert sorted((r.path.split("/")[-2], r.warning) for r in out["warnings"].collect()) == [("a", "3 messages are no objects"), ("d", "messages is no list")]


def test_views_of_odd_bodies(spark):
    from datetime import datetime

    at = lambda h, m: datetime(2026, 1, 1 + h // 24, h % 24, m)
    said = [(0, "a", "  x\n"), (1, "b", " \u00a0\n"), (2, "c", None), (25, "d", ""), (25, "e", "y")]
    m = spark.createDataFrame([("k", "t", key, at(h, n), body, "Ann", n) for n, (h, key, body) in enumerate(said)], "source_kind string, source_thread_key string, source_message_key string, sent_at timestamp, body_text string, sender string, import_seq int")
    lines = [r.line for r in views.transcript_lines(m).orderBy("message_no", "part_no").collect()]
    assert lines == ["## 2026-01-01", "00:00:00 Ann: x", "01:01:00 Ann: [no text]", "02:02:00 Ann: [no text]", "## 2026-01-02", "01:03:00 Ann: [no text]", "01:04:00 Ann: y"]
    members = spark.createDataFrame([("p", "k", "t"), ("p", "k", "u")], "identity_key string, source_kind string, source_thread_key string")
    threads = spark.createDataFrame([("k", "t", "T", "group"), ("k", "u", "T", "direct")], "source_kind string, source_thread_key string, title string, thread_kind string")
    twin = m.where("source_message_key = 'e'").withColumn("source_thread_key", F.lit("u"))
    told = [(r.thread_kind, r.snippet) for r in views.person_timeline(m.union(twin), members, threads).orderBy("rank").collect()]
    assert sorted(told[:2]) == [("direct", "y"), ("group", "y")] and told[2:] == [("group", "[no text]")] * 2 + [("group", ""), ("group", "x")]


def test_a_thread_without_times_is_numbered_in_many_ranges(spark):
    """Headings and numbers are those of one sorted list, however many ranges there are; none holds most of the thread."""
    from datetime import datetime, timedelta

    start = datetime(1970, 1, 1)
    told = [("k", "long", f"m{i:04}", start, f"b{i}", "Ann", i) for i in range(600)] + [("k", f"t{i % 3}", f"n{i:03}", start + timedelta(hours=7 * i), None, "Bob", i) for i in range(90)]
    m = spark.createDataFrame(told, "source_kind string, source_thread_key string, source_message_key string, sent_at timestamp, body_text string, sender string, import_seq int").repartition(7)
    media = spark.createDataFrame([("k", "long", "m0003", 2)], "source_kind string, source_thread_key string, source_message_key string, media_count long")
    want = []
    for thread in sorted({r[1] for r in told}):
        own, last = sorted((r for r in told if r[1] == thread), key=lambda r: (r[3], r[6], r[2])), None
        for no, r in enumerate(own, 1):
            lines = ([f"## {r[3]:%Y-%m-%d}"] if last != r[3].date() else []) + [f"{r[3]:%H:%M:%S} {r[5]}: {r[4] or '[no text]'}"] + (["[2 media attachments]"] if r[2] == "m0003" else [])
            want += [(thread, no, k, line) for k, line in enumerate(lines)]
            last = r[3].date()
    for ranges in (1, 9):
        got = views.transcript_lines(m, media, ranges).select("source_thread_key", "message_no", "part_no", "line").collect()
        assert sorted(map(tuple, got)) == want
    dealt = m.repartitionByRange(9, "source_kind", "source_thread_key", "sent_at", "import_seq", "source_message_key").where("source_thread_key = 'long'")
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 200


def test_views_are_ordered_with_missing_times_first(spark):
    rows = spark.createDataFrame([("p", "2026", "a"), ("p", None, "b"), ("p", "2025", "c")], "identity_key string, last_message_at string, title string").withColumn("source_kind", F.lit("k"))
    assert [r.title for r in sinks.in_order("person_threads", rows).collect()] == ["b", "c", "a"]


def test_a_plan_without_packets_is_an_error(spark):
    from letterloom.operators.pulls import FOLDER
    from letterloom.plans.reports import plan_fetch

    listing = spark.createDataFrame([("1", "instagram-annie-2024-01-01", "p", FOLDER), ("2", "instagram-ann-2024-01-01", "q", "text/plain")], "id string, name string, path string, mime_type string")
    with pytest.raises(ValueError, match="no packet folder"):
        plan_fetch(listing, listing, listing, listing, "instagram-ann-", ["messages"])
