import json

import pytest
from hypothesis import Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from letterloom.functions.canonical import canonical_json, parse_payload
from letterloom.plans import imports
from letterloom.sources import packets, ranges

BODY = {"participants": [{"name": "A\\\"[{"}, {"name": "é"}], "title": "x]}", "messages": [
    {"content": 'quote " and \\ and \\\\" ], }', "n": 1.0}, {"content": "漢字" * 9, "deep": [[1, {"messages": [1, 2]}], "a,b"]}, {}, "odd", None, 3, [], {"content": "\\" * 7}], "after": {"messages": [5]}}
FILES = {
    "a": json.dumps(BODY), "b": json.dumps(BODY, ensure_ascii=False, indent=2), "empty": '{"messages": [ ]}', "none": '{"title": "messages"}', "one": '{"messages" :\n [{"a":1}] }',
    "nested": '{"x": {"messages": [1, 2]}, "messages": [3]}', "string": '{"messages": "[1, 2]"}', "list": "[1, 2]", "open": '{"messages": [1, 2}', "cut": '{"messages": [1, "2]}', "broken": '{"messages": [{"a":1}, {b}]}', "rest": '{"messages": [1], x}',
    "gap": '{"messages": [1,,2]}', "tail": '{"messages": [1,]}', "nothing": "",
}


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, text in FILES.items():
        (folder / name).write_bytes(text.encode())
    (folder / "latin").write_bytes(json.dumps({"title": "é", "messages": ["é", {"a": "ü"}]}, ensure_ascii=False).encode("latin-1"))
    return sorted(str(p) for p in folder.iterdir())


def by_whole(spark, paths):
    """Files without messages, and messages, of parsing each file in one piece."""
    out, said = {}, []
    for p in paths:
        raw = open(p, "rb").read()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        try:
            told = json.loads(text)
        except ValueError:
            out[p] = None
            continue
        if isinstance(told, dict) and isinstance(told.get("messages"), list):
            said += [(p, i, json.dumps(m, sort_keys=True, ensure_ascii=False)) for i, m in enumerate(told["messages"])]
            told = told | {"messages": []}
        out[p] = json.dumps(told, sort_keys=True, ensure_ascii=False)
    return out, sorted(said)


def by_ranges(spark, paths, size):
    files, said = ranges.read_ranges(spark, paths, size)
    return {r.path: r.told for r in files.select("path", canonical_json(F.col("file")).alias("told")).collect()}, sorted(tuple(r) for r in said.select("path", "pos", canonical_json(F.col("payload"))).collect())


@pytest.mark.parametrize("size", [1 << 20, 37, 5])
def test_ranges_of_any_size_give_what_the_whole_gives(spark, paths, size):
    assert by_ranges(spark, paths, size) == by_whole(spark, paths)


def test_a_file_is_many_tasks(spark, tmp_path):
    path = tmp_path / "big"
    path.write_text(json.dumps({"messages": [{"i": i, "text": "x" * 50} for i in range(2000)], "title": "t"}))
    _, said = ranges.read_ranges(spark, [str(path)], 10_000)
    assert len([f for f in said.inputFiles() if "elements" in f]) > 5 and said.count() == 2000  # a task writes a file
    assert [r.pos for r in said.orderBy(F.try_variant_get("payload", "$.i", "long")).collect()] == [*range(2000)]


JSON = st.recursive(st.none() | st.integers(0, 99) | st.text(st.sampled_from('a"\\[]{},:é\n '), max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["messages", "a", 'b"', "\\"]), x, max_size=3), max_leaves=8)


@settings(max_examples=60, deadline=None, phases=[Phase.generate])
@given(st.dictionaries(st.sampled_from(["messages", "title", 'q"', "\\"]), st.lists(JSON, max_size=5), max_size=4), st.integers(1, 40))
def test_shapes_of_ranges_add_up(tmp_path_factory, told, size):
    """Every range stands where the ranges before it say, and depths are those of the whole."""
    path = tmp_path_factory.getbasetemp() / "shape"
    path.write_text(json.dumps(told, ensure_ascii=False))
    file = ranges._File(ranges._uri(str(path)))
    whole = ranges._Range(file, 0, file.size)
    flipped, depth = False, 0
    for a in range(0, file.size, size):
        own = ranges._Range(file, a, a + size)
        end = min(a + size, file.size)
        assert (own.depth(flipped, depth) == whole.depth(False, 0)[a:end]).all() and (own.outside(flipped) == whole.outside(False)[a:end]).all()
        assert own.is_utf8(file)
        depth += own.change(flipped)
        flipped ^= bool(own.quotes % 2)
    assert not flipped and depth == 0


def test_packets_with_long_files_import_alike(spark, tmp_path):
    inbox = tmp_path / "instagram-ann-2026-01-01-x/your_instagram_activity/messages/inbox"
    for name, text in FILES.items():
        (inbox / f"t {name}+1").mkdir(parents=True)
        (inbox / f"t {name}+1" / "message_1.json").write_text(text)
    files = packets.list_files(spark, str(tmp_path))
    tables = [imports.import_packets(files, "instagram", large=large) for large in (1 << 20, 30)]
    keys = {"messages": ["source_message_key", "raw_json", "body_text"], "threads": ["source_thread_key", "title", "thread_kind", "ever_group"], "warnings": ["path", "warning"], "people": ["source_thread_key", "identity_key"]}
    for table, columns in keys.items():
        one, other = (sorted(map(str, t[table].select(*columns).collect())) for t in tables)
        assert one == other and one
