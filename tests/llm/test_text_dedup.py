import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from letterloom.llm import minhash, suffix_dedup
from letterloom.llm.components import connected_components
from llm.conftest import TWINS, components, words_of


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(12):
        base = prose(rng, rng.choice([3, 12, 80, 400]))
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            rows.append((k, " ".join(own)))
            k += 1
    rows += [(k, rows[0][1]), (k + 1, ""), (k + 2, None), (k + 3, " \t\n"), (k + 4, "One"), (k + 5, "one"), (k + 6, "one two"), (k + 7, "a b c " * 3000), (k + 8, "A B C " * 3000)]
    return rows


def sets_of(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_all_pairs(docs, words, percent, monkeypatch):
    monkeypatch.setattr(minhash, "PER_BLOCK", 4)
    rows = corpus()
    sets = {i: sets_of(t, words) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    found = minhash.near_duplicates(docs(rows + [(None, "one")]), words=words, percent=percent).collect()
    got = {r.id: r for r in found}
    assert len(found) == len(rows) + 1 and len(links) > 20
    assert got.pop(None).component_id is None
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_texts_of_equal_hash_stay_apart(docs, monkeypatch):
    assert [r.kept for r in minhash.near_duplicates(docs(list(enumerate(TWINS)))).collect()] == [True, True]
    rows = [(0, 1, 1, b"a b c d"), (1, 2, 2, b"e f g h"), (1, 3, 3, b"a b c d")]
    monkeypatch.setattr(minhash, "shingle_sets", lambda texts, words: [np.zeros(1, np.uint64) for _ in texts])
    assert minhash._block_links(rows, False, 3, 80) in ([(1, 3)], [(3, 1)])
    joined = b"abcdabcdxbcd"
    monkeypatch.setattr(suffix_dedup, "SpanHash", lambda values: lambda start, end: np.zeros(len(start), np.uint64))
    first, kind = suffix_dedup._equal_windows(joined, np.array([0, 4, 8]), np.zeros(3, np.int64), 4)
    assert kind.tolist() == [0, 0, 1] and first.tolist() == [0, 2]


def test_an_id_with_several_texts_is_one_node(docs):
    a, b, c = (" ".join(prose(random.Random(k), 50)) for k in range(3))
    got = minhash.near_duplicates(docs([(1, a), (2, a), (2, b), (3, b + " more"), (4, c)])).collect()
    assert {r.id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_near_duplicates_of_nothing(docs):
    assert minhash.near_duplicates(docs([]).limit(0)).count() == 0
    twice = minhash.near_duplicates(docs([(1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert [(r.id, r.component_id, r.kept) for r in twice] == [(1, 1, True)] * 2


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    ranks = minhash.superminhash([np.unique(a), np.unique(b), a[:1], a[:0]], 125)
    assert abs((ranks[0] == ranks[1]).mean() - 240 / 360) < 0.12
    assert np.isinf(ranks[3]).all() and len(set(np.floor(ranks[2]).tolist())) == 125


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 900), (None, 3), (500, 501), (501, 500)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}
    assert connected_components(edges.limit(0)).count() == 0


def removed(rows, least):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(d[p : p + least]) for d in data for p in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - least + 1):
            if seen[hash(d[p : p + least])] > 1:
                gone[p : p + least] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=5):
    rng = random.Random(seed)
    shared = [" ".join(prose(rng, 60)), "é漢" * 90, "ab" * 400]
    rows = []
    for i in range(40):
        parts = [" ".join(prose(rng, rng.randrange(80)))]
        for s in rng.sample(shared, rng.randrange(3)):
            cut = rng.randrange(40)
            parts += [s[cut:], " ".join(prose(rng, rng.randrange(30)))]
        rows.append((i, rng.choice(" \n").join(parts)))
    return rows + [(40, None), (41, ""), (None, rows[3][1]), (3, rows[3][1]), (42, "z" * 5000), (43, "y" * 99), (44, "q" * 100), (45, "q" * 100)]


@pytest.mark.parametrize(("least", "together", "bucket"), [(100, 2000, 1 << 18), (100, 2, 60), (37, 3, 500)])
def test_repeats_are_removed_exactly(docs, monkeypatch, least, together, bucket):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket)
    rows = passages()
    got = suffix_dedup.remove_repeats(docs(rows), least=least).collect()
    want = removed(rows, least)
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    assert sum(w[1] for w in want) > 5000


def test_cleaned_keeps_columns_and_whole_characters(docs):
    rows = passages()
    df = docs(rows)
    got = suffix_dedup.cleaned(df, least=100)
    assert got.columns == df.columns
    texts = [r.text for r in got.collect()]
    assert len(texts) == len(rows) and all(t is not None and "�" not in t for t in texts)
    assert suffix_dedup.cleaned(df.limit(0)).count() == 0


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 500), rng.integers(0, 9, 500)
    order = suffix_dedup.multikey_order([a, b])
    assert list(zip(a[order], b[order])) == sorted(zip(a, b))

def test_a_sieve_lets_all_pass_that_can(spark):
    from letterloom.llm.sieve import sieve_of, sifted

    keys = spark.range(0, 5000, 7).withColumn("k", F.col("id").cast("string"))
    rows = spark.range(5000).withColumn("k", F.col("id").cast("string"))
    sieve = sieve_of(keys, "k", "id")
    got = {r.id for r in sifted(rows, sieve, "k", "id").collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 1000
    assert {r.id for r in sifted(rows, sieve, "k", "id", wanted=False).collect()} == set(range(5000)) - got
    assert sifted(rows, sieve_of(keys.limit(0), "k"), "k").count() == 0
