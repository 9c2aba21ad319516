import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from letterloom.llm import queries, spelling
from letterloom.llm.spelling import Grams, one_edit


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from ((word[:i] + x + word[i:], i, 0, 1) for x in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :], i, 1, 0
            yield from ((word[:i] + x + word[i + 1 :], i, 1, 1) for x in letters if x != word[i])


WORD = st.text("ab", min_size=6, max_size=13)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=5), max_size=25), st.lists(WORD, min_size=1, max_size=4))
def test_no_edit_changes_more_grams_than_the_bound(dictionary, words):
    """Of grams that are the same in both words, at the same distance from the end where the edit is not."""
    closed = {g[:k] for g in dictionary for k in range(3, len(g) + 1)}
    grams = Grams(dict.fromkeys(closed, 1), 3, 5)
    for word in words:
        own = grams.decompose(word)
        most = grams.affected(word, own)
        assert all(a < c and b < d for (a, b), (c, d) in zip(own, own[1:]))
        for other, i, out, put in edits(word, "abc"):
            theirs = set(grams.decompose(other))
            kept = sum((p, e) in theirs if e <= i else p >= i + out and (p - out + put, e - out + put) in theirs for p, e in own)
            assert len(own) - kept <= most


def told(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def by_hand(counts, times=10):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            if counts[best] >= times * counts[w]:
                form[w] = best
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def words_of(kind):
    r = random.Random(kind)
    letters = "ab" if kind else "abcé"
    words = {"".join(r.choice(letters) for _ in range(r.randrange(7, 11))) for _ in range(350)}
    if kind:
        words |= {"a" * k for k in range(7, 90)} | {"a" * k + "b" for k in range(60, 70)} | {"x" * 500 + y for y in ("", "x", "y", "yy")} | {"漢字" * 5, "漢字" * 5 + "x"}
    return {w: 10 ** r.randrange(5) for w in sorted(words)}


@pytest.mark.parametrize("kind, frequent, most", [(0, 20, 1 << 13), (1, 3, 1 << 13), (1, 10**6, 40), (0, 1, 7)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, kind, frequent, most):
    counts = words_of(kind)
    words = spark.createDataFrame([*counts.items(), (None, 3)], "word string, n long").withColumn("gram", F.lit("clash")).repartition(3)
    assert told(spelling.variants(words, frequent=frequent, most=most)) == by_hand(counts)


def test_lists_without_words_of_their_length_are_passed_over():
    layout = pa.schema([("word", pa.string()), ("n", pa.int64()), ("level", pa.int8()), ("gram", pa.string()), ("kind", pa.int8()), ("len", pa.int32()), ("pos", pa.int32()), ("first", pa.int32()), ("second", pa.int32()), ("block", pa.int32())])
    rows = [("abcdefgh", 5, 0, "abc", 1, 7, 0, 0, 0, 0), ("abcdefgi", 5, 0, "abc", 1, 7, 0, 0, 0, 0)]
    batch = pa.RecordBatch.from_pylist([dict(zip(layout.names, r)) for r in rows], layout)
    assert [*spelling._near_in_lists(iter([batch]))] == [] == [*spelling._near_in_lists(iter([batch.slice(0, 0)]))]
    own = pa.RecordBatch.from_pylist([dict(zip(layout.names, ("abcdefg", 9, 0, "abc", 0, 7, 0, 0, 0, 0)))], layout)
    found = pa.Table.from_batches([*spelling._near_in_lists(iter([own, batch]))]).to_pylist()
    assert sorted((r["word"], r["near"], r["n"], r["near_n"]) for r in found) == [("abcdefg", "abcdefgh", 9, 5), ("abcdefg", "abcdefgi", 9, 5)]


def test_chains_end_at_their_root_and_ties_take_the_smallest(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "zzzzzzzz": 1, "zzzzzzz": 10, "zzzzzzzy": 10, "qqqqqqqqq": 5}
    found = {r.word: r for r in spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")).collect()}
    assert found["aaaaaaa"].root == "aaabbbb" and found["aaaaaaa"].form == "aaaaaab" and found["aaaaaaa"].form_n == 10
    assert found["zzzzzzzz"].form == "zzzzzzz" and found["zzzzzzzz"].n_near == 2
    assert tuple(found["qqqqqqqqq"]) == ("qqqqqqqqq", None, "qqqqqqqqq", 5, 0, None)
    with pytest.raises(ValueError, match="more frequent"):
        spelling.variants(spark.createDataFrame([("aaaaaaa", 1)], "word string, n long"), times=1)


def test_short_words_are_an_error_and_no_words_give_no_rows(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).count() == 0
    with pytest.raises(Exception, match="at least twice"):
        spelling.variants(spark.createDataFrame([("abcde", 3)], "word string, n long")).count()


def test_words_of_texts(docs):
    rows = [(k, t) for k, t in enumerate([None, "", "Straße ÀÉ×x d'été", "a1b AB ab\nAb", "naïve漢字naïve"])] + [(None, "ab"), (3, "ab")]
    got = {r.word: r.n for r in spelling.word_counts(docs(rows)).collect()}
    assert got == {"straße": 1, "ÀÉ×x": 1, "d": 1, "été": 1, "a": 1, "b": 1, "ab": 5, "naïve": 2}


def test_slips_follow_the_hash(docs):
    rows = [(k, f"word{chr(97 + k % 26)} plénitude x") for k in range(200)]
    want = Counter()
    for k, text in rows:
        for run in text.split():
            h = zlib.crc32(f"{k}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert len(want) > 32
    assert {r.word: r.n for r in spelling.word_counts(docs(rows), queries.with_slips).collect()} == want
