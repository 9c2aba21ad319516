import corpus_pipeline as cp
from conftest import SF
from llm.conftest import components, words_of
from llm.test_text_dedup import sets_of


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = cp.written(cp.reject_toxic(spark, docs, SF), "t")
    assert toxic.columns == docs.columns and toxic.count() < docs.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(r.doc_id) != 0 for r in docs.join(toxic, "doc_id", "left_anti").collect())

    near = cp.written(cp.drop_near_copies(spark, toxic, SF), "n")
    sets = {r.doc_id: sets_of(r.text, 5) for r in toxic.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {i for i in sets if want[i] == i}

    clean = cp.written(cp.cut_repeats(spark, near, SF), "c")
    assert clean.columns == docs.columns and clean.count() == near.count()
    before = {r.doc_id: r.text for r in near.collect()}
    seen = {}
    for i, t in before.items():
        b = t.encode()
        for p in range(len(b) - cp.PASSAGE + 1):
            seen.setdefault(b[p : p + cp.PASSAGE], set()).add((i, p))
    touched = {i for places in seen.values() if len(places) > 1 for i, _ in places}
    for r in clean.collect():
        assert (r.text != before[r.doc_id]) == (r.doc_id in touched) and r.n_chars == len(r.text)

    packed = cp.pack_sequences(spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == set(before) and max(r.offset + r.length for r in packed) <= 2048


def test_repeated_rows_lose_copies_and_not_their_text(spark):
    text = {k: " ".join(f"{k}{i * i}" for i in range(80)) for k in "abcd"}
    rows = [(1, text["a"]), (1, text["a"]), (None, text["b"]), (None, text["b"]), (None, text["a"]), (2, text["c"]), (2, text["d"]), (3, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    near = cp.written(cp.drop_near_copies(spark, docs, SF), "n")
    want = {(1, text["a"]), (None, text["b"]), (2, text["c"]), (2, text["d"]), (3, ""), (None, None)}
    assert near.count() == 6 and {(r.doc_id, r.text) for r in near.collect()} == want
    assert {(r.doc_id, r.text) for r in cp.cut_repeats(spark, near, SF).collect()} == {(i, t or "") for i, t in want}


def test_run_is_its_stages(spark):
    found = cp.run(spark, SF).collect()
    assert found and len({(r.doc_id, r.piece) for r in found}) == len(found)
    assert words_of("A b") == ["a", "b"]
