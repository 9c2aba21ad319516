import json
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from letterloom.llm import merge_rounds
from letterloom.llm.merge_rounds import Merges

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [None, "", "don't   stop\n\n now's", "  \n ", "x" * 9000, "naïve 漢字 ١٢ '''s 'S", f"{END} hi {END}{END}", f"a  {END}  b", "<|endof", "The the the  the", "a\0b", "word " * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("special", [True, False])
def test_ids_and_texts_are_the_librarys(spark, docs, special):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = not special
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (2, "repeated id")]
    found = merge_rounds.decode(merge_rounds.encode(docs(rows), PATH, special=special), PATH).collect()
    want = [(str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted((str(r.id), r.ids, r.text) for r in found) == sorted(want)
    assert merge_rounds.encode(docs([]).limit(0), PATH).count() == 0


def test_decoding_of_any_ids(spark, library):
    rows = [(1, None), (2, []), (3, [2634, 105, 50256, 99_999, -4, 0]), (4, [163]), (5, [163, 120]), (6, [None, 64])]
    found = merge_rounds.decode(spark.createDataFrame(rows, "id long, ids array<int>"), PATH)
    told = {r.id: r.text for r in found.collect()}
    assert told[1] is None and told[6] == library.decode([64])
    for i, ids in rows[1:5]:
        assert told[i] == library.decode([x for x in ids if 0 <= x], skip_special_tokens=False)


def by_hand(word, ranks):
    """The leftmost pair of lowest rank is merged, until none is known."""
    parts = list(word)
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = ["".join(parts[i : i + 2])]
    return parts


LETTERS = [c for _, c in sorted(merge_rounds._letters().items())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(*[st.text("abc", min_size=1, max_size=3)] * 2), max_size=12, unique=True), st.lists(st.text("abc", max_size=30), min_size=1, max_size=6))
def test_rounds_equal_single_merges(pairs, words):
    """Of any list of merges, also those whose parts are only made by later ones, and of words of any mix."""
    vocab = {}
    for token in [*LETTERS, *(x for a, b in pairs for x in (a, b, a + b))]:
        vocab.setdefault(token, len(vocab))
    flat, size = Merges(vocab, pairs).encode([w.encode() for w in words])
    ranks = {p: i for i, p in enumerate(pairs)}
    want = [[vocab[x] for x in by_hand(w, ranks)] for w in words]
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == want


def test_a_vocabulary_of_merges_in_order_is_merged_at_once(tmp_path):
    told = json.loads(open(PATH, encoding="utf-8").read())
    merges = told["model"]["merges"]
    assert Merges(told["model"]["vocab"], merges).all_at_once
    vocab = {t: i for i, t in enumerate([*LETTERS, *("".join(p) for n in (2, 3) for p in product("ab", repeat=n))])}
    assert not Merges(vocab, [("ab", "a"), ("a", "b")]).all_at_once
    told["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="plain kind"):
        merge_rounds.vocabulary(str(tmp_path / "other.json"))


def test_whole_table(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = merge_rounds.encode(rows, PATH).join(rows.select(F.col("doc_id").alias("id"), "text"), "id").collect()
    assert [r.ids for r in found] == [e.ids for e in library.encode_batch([r.text for r in found], add_special_tokens=False)]
