import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from letterloom.llm import queries, turn_trie

ROWS = "conv_id long, turn long, role string, text string"


def by_hand(convs):
    """``convs``: conv_id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = lambda x: sum(len(y) == len(x) + 1 and y[:-1] == x for y in members)  # noqa: B023, E731
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        told = ",".join(map(str, sorted(ends[node])))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children(node), sum(not children(x) for x in below), saved, hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CONVS = {
    **{c: [("user", "same"), ("assistant", "copy")] for c in range(100, 140)},
    **{c: [("user", "same"), ("assistant", "copy"), ("user", f"own {c % 3}")] for c in range(200, 212)},
    1: [], 2: [], 3: [("user", "")], 4: [("", "user")], 5: [("user", "same")], 6: [("user", "é" * 5)] * 40, 7: [("user", "é" * 5)] * 39,
}


@pytest.fixture(scope="module")
def paths(spark):
    rows = [(c, k, r, t) for c, turns in CONVS.items() for k, (r, t) in enumerate(turns)]
    found = turn_trie.conversations(spark.createDataFrame(rows, ROWS).repartition(5))
    none = spark.createDataFrame([(1, []), (2, []), (None, [])], found.schema)
    return found.union(none).withColumn("boundary", F.lit("clash")).withColumn("path", F.lit("clash"))


@pytest.mark.parametrize("shard, least", [(1 << 16, 1), (1 << 16, 3), (7, 1), (1, 1)])
def test_any_number_of_shards_gives_the_trie(paths, shard, least):
    assert told(turn_trie.trie(paths, shard, least)) == by_hand(CONVS.items())


def test_few_names_suffice_without_a_broadcast(paths, monkeypatch):
    monkeypatch.setattr(turn_trie, "SMALL", 0)
    assert told(turn_trie.trie(paths, 5, 1)) == by_hand(CONVS.items())


def test_no_conversations(spark, paths):
    assert turn_trie.trie(paths.limit(0)).count() == 0
    assert told(turn_trie.trie(paths.where("conv_id = 1"))) == by_hand([(1, [])])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=4), min_size=1, max_size=25), st.data())
def test_shards_agree_wherever_they_are_cut(words, data):
    """Shards of sorted paths, cut anywhere, in plain Python: complete rows and summed partial rows are the trie."""
    rows = sorted((b"".join(c.encode() * turn_trie.WIDTH for c in w), i, [len(c) for c in w]) for i, w in enumerate(words))
    cuts = sorted({0, *data.draw(st.lists(st.integers(0, len(rows)), max_size=4)), len(rows)})
    shards = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    agreements = [(k, turn_trie._shared(s[0][0], s[-1][0]), turn_trie._shared(s[-1][0], shards[k + 1][0][0]) if k + 1 < len(shards) else -1) for k, s in enumerate(shards)]
    sides, out = turn_trie.skeleton(agreements), []
    for k, s in enumerate(shards):
        run = turn_trie._Shard(k, *sides[k], out)
        for row in s:
            run.add(*row)
        run.end()
    parts = defaultdict(list)
    for r in out:
        if r[0] is not None:
            parts[r[0], r[2]].append(r)
    name = {key: min(r[3] for r in own) for key, own in parts.items()}
    above = lambda r: name[r[4], r[2] - 1] if r[4] is not None else r[5]
    got = [(r[3], r[2], above(r), *r[6:10], r[11]) for r in out if r[0] is None]
    for (_, depth), own in parts.items():
        ends = b",".join(r[10] for r in sorted(own, key=lambda r: r[1]) if r[10])
        assert len({r[4] for r in own}) == 1
        got.append((min(r[3] for r in own), depth, above(own[0]), *(sum(r[i] for r in own) for i in range(6, 10)), hashlib.sha256(ends).hexdigest()))
    assert sorted(got, key=str) == by_hand([(i, [("", c) for c in w]) for i, w in enumerate(words)])


def test_turns_nulls_ties_and_repeats(spark):
    rows = [(1, 2, "b", "x"), (1, None, None, "first"), (1, 2, "a", "y"), (1, 2, "a", "y"), (1, 10, "z", None), (None, 1, "a", "lost"), (2, None, "", "first")]
    found = turn_trie.conversations(spark.createDataFrame(rows, ROWS).withColumn("told", F.lit(1)).withColumn("key", F.lit(1)))
    got = {r.conv_id: [(t.key, t.bytes) for t in r.turns] for r in found.collect()}
    key = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
    assert got == {1: [(key(r, t), len(t)) for r, t in [("", "first"), ("a", "y"), ("a", "y"), ("b", "x"), ("z", "")]], 2: [(key("", "first"), 5)]}


def test_conversations_take_the_head_of_their_group(spark):
    rows = [(c, k, "u", f"{c} {k}") for c, n in ((0, 4), (1, 1), (2, 12), (3, 3), (7, 5), (8, 2), (11, 9)) for k in range(n)]
    got = {r.conv_id: [t.key for t in r.turns] for r in queries.rebuilt_conversations(spark.createDataFrame(rows, ROWS)).collect()}
    own, want = defaultdict(list), {}
    for c, _, role, text in rows:
        own[c].append(hashlib.sha256(f"1:{role}{text}".encode()).hexdigest()[:32])
    for c in list(own):
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    assert got == want


def test_rebuilding_and_grouping_share_one_exchange(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = queries.rebuilt_conversations(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
