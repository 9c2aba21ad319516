import base64
import hashlib
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from letterloom.llm import bpe, packing, pretokens
from letterloom.llm.pretokens import Pretokens

from llm.conftest import TWINS

public = pytest.importorskip("public_tokenizers")
import regex  # noqa: E402
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

RANKS = public.path("byte_bpe_50k.tiktoken")
TEXTS = [*TWINS, " ".join(TWINS), None, "", "don't   stop\n\n now's", "  \n ", "x" * 9000, "naïve 漢字 ١٢ '''s 'S", "<|endoftext|> hi", "The the the  the", "a\0b", "word " * 5000, "don't   stop\n\n now's"]


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t'strevdlmé漢1²!?\0  ́\x1c\x85aB")), max_size=25), min_size=1, max_size=6))
def test_pretokens_are_the_patterns_matches(texts):
    cut = Pretokens(texts)
    for i, t in enumerate(texts):
        assert [cut.word(k) for k in range(cut.first[i], cut.first[i + 1])] == regex.findall(public.PATTERN, t)


def test_words_of_equal_hash_stay_apart(monkeypatch):
    texts = ["the cat the dog", "", "cat  a cat"]
    want = [Pretokens([t]).word(i) for t in texts for i in range(len(Pretokens([t]).start))]
    assert len({tuple(Pretokens([w]).distinct()[1]) for w in TWINS}) == 1 and len(Pretokens([" ".join(TWINS)]).distinct()[0]) == 2
    monkeypatch.setattr(pretokens, "SpanHash", lambda values: lambda start, end: np.zeros(len(start), np.uint64))
    cut = Pretokens(texts)
    at, like = cut.distinct()
    words = packing._Words(public.path("byte_bpe_50k.json"))
    for _ in range(2):
        ids, sizes = words.ids(texts)
        assert ids.tolist() == [i for w in want for i in words._encode(w)] and sizes.sum() == len(ids)
    assert [cut.word(at[k]) for k in like] == want and len({cut.word(i) for i in at}) == len(at) < len(want)


def test_words_that_come_again_stay_remembered(monkeypatch):
    """Where many rare words pass, only these are encoded anew; all words are those of the library, line ends too."""
    path = public.path("byte_bpe_50k.json")
    library, words = Tokenizer.from_file(path), packing._Words(path)
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    asked, model = [], words.model
    words.model = SimpleNamespace(tokenize=lambda w: (asked.append(w), model.tokenize(w))[1])
    common = "".join(f" common{chr(97 + k)}" for k in range(10)) + "\n\n ÿþ\xff\0\x7f\xa0\xad \t\n漢"
    for i in range(20):
        text = common + "".join(f" rare{chr(97 + i)}{chr(97 + k)}" for k in range(12))
        ids, sizes = words.ids([text, ""])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids), 0]
        assert len(words.place) <= 40 + 40
    assert all(asked.count(w) == 1 for w in asked) and len(asked) > 20 * 12
    for text in ("".join(f" x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) for _ in range(3)):  # more than may stay
        ids, _ = words.ids([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and len(words.place) <= 40 + 100


@pytest.mark.parametrize("chunk", [1 << 24, 50])
def test_encode_and_decode(docs, encoder, chunk):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (2, "repeated id")]
    found = bpe.decode(bpe.encode(docs(rows), RANKS, public.PATTERN, chunk=chunk), RANKS).collect()
    got = sorted((str(r.id), r.n_tokens, bytes(r.ids), bytes(r.bytes)) for r in found)
    ids = [encoder.encode_ordinary(t or "") for _, t in rows]
    assert got == sorted((str(i), len(x), np.array(x, "<u4").tobytes(), (t or "").encode()) for (i, t), x in zip(rows, ids))
    assert bpe.decode(bpe.encode(docs([]).limit(0), RANKS, public.PATTERN), RANKS).count() == 0


def test_packing_places_every_token_once(docs, encoder):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (2, "repeated id")]
    longest = 64
    found = packing.pack(docs(rows), public.path("byte_bpe_50k.json"), longest=longest).collect()
    want = Counter()
    for i, t in rows:
        ids = [*encoder.encode_ordinary(t or ""), 0]
        first = len(ids) % longest or longest
        for k, a in enumerate([0, *range(first, len(ids), longest)]):
            part = ids[a : first if k == 0 else a + longest]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= longest
    assert len(sequences) <= -(-sum(r.length for r in found) // longest) + 1
    assert packing.pack(docs([]).limit(0), public.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=25))
def test_plans_use_the_histogram_once(count):
    uses = packing.plan(count, 50)
    used = Counter()
    for lengths, n in uses:
        assert n > 0 and sum(lengths) <= 50
        for v in lengths:
            used[v] += n
    assert used == Counter(count)
    total = sum(n for _, n in uses)
    assert total <= 1.5 * -(-sum(v * n for v, n in count.items()) // 50) + 1 or max(count) > 25


def test_the_fit_finds_an_exact_packing():
    count = np.zeros(101, np.int64)
    count[60], count[40], count[30], count[20], count[50] = 50, 50, 30, 30, 30
    patterns = packing._patterns(count, 100)
    fit = packing.nonnegative_fit(patterns, count, rounds=2000)
    made = sum(np.bincount(patterns[:, k], fit, 101) for k in range(3))
    assert np.abs(made - count)[1:].max() < 1
    assert sum(n for _, n in packing.plan({int(v): int(count[v]) for v in np.flatnonzero(count)}, 100)) <= 82


def test_workers_give_memory_back_after_each_batch(monkeypatch):
    import pyarrow as pa

    from letterloom.llm import kernels

    asked = []
    monkeypatch.setattr(kernels, "_trim", asked.append)
    batch = pa.record_batch({"t": ["a" * 9, None, "b"]})
    assert [x[2] for x in kernels.text_blocks(batch.column(0), 4)] == [["a" * 9], ["", "b"]]
    assert sum(p.num_rows for p in kernels.parts_of(batch, 0, 4)) == 3
    assert asked == [0, 0]
