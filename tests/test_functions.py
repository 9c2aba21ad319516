import string
import time
import unicodedata
import plistlib
from datetime import datetime

import pytest
from hypothesis import Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from letterloom.functions import keys, payloads, text, times


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_clean_text(spark):
    given = [None, "  a\t b\n", "CafÃ©", "Café", " x y\x1c", "ï¿½ok", "漢Ã©"]
    assert column(spark, given, text.clean_text) == ["", "a b", "Café", "Café", "x y", "ï¿½ok", "漢Ã©"]


def slug_of(value):
    """The rule, character by character: accents fall, & is a word, all else but letters and digits of ASCII separates."""
    kept = [c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.combining(c)]
    runs = "".join(c if c in string.ascii_lowercase + string.digits else " " for c in "".join(kept).lower().replace("&", " and ")).split()
    return "-".join(runs) or "untitled"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=12), min_size=1, max_size=40))
def test_slugs_of_any_text(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.s for r in text.with_slug(df, "v", "s").collect()}
    assert got == {i: slug_of(v) for i, v in enumerate(values)}


def test_slugs(spark):
    df = spark.createDataFrame([("José & Co.",), ("A  &  B",), ("漢字",), (None,), ("--",)], "v string")
    assert [r.s for r in text.with_slug(df, "v", "s").orderBy("s").collect()] == ["a-and-b", "jose-and-co", "untitled", "untitled", "untitled"]


def test_keys_that_are_wrong_are_errors(spark):
    df = spark.createDataFrame([("@Ann.B",)], "v string")
    assert df.select(text.normalize_account_key(F.col("v"))).first()[0] == "ann.b"
    with pytest.raises(Exception, match="not an account key"):
        df.select(text.normalize_account_key(F.lit("a b"))).collect()
    with pytest.raises(Exception, match="unknown view kind"):
        df.select(text.view_path(F.lit("planet"), F.lit("a"), F.lit("b"))).collect()


def test_times(spark):
    apple = column(spark, ["700000000000000000", "1600000000", "86400", None, "x"], times.apple_date_to_ts)
    assert apple == [datetime(2023, 3, 8, 20, 26, 40), datetime(2020, 9, 13, 12, 26, 40), datetime(2001, 1, 2), datetime(1970, 1, 1), datetime(1970, 1, 1)]
    assert column(spark, ["1500", None], lambda c: times.epoch_ms_to_ts(c, True)) == [datetime(1970, 1, 1, 0, 0, 1, 500000), None]


def test_paths(spark):
    path = "meta-2026-Aug-29-10-11-12/facebook-ann-2026-01-02-x/your_facebook_activity/messages/inbox/t/message_10.json"
    one = lambda f: column(spark, [path], f)[0]
    assert one(lambda c: keys.export_root(c, "facebook")) == "meta-2026-Aug-29-10-11-12/facebook-ann-2026-01-02-x"
    assert one(lambda c: keys.relative_thread_key(c, "facebook")) == "your_facebook_activity/messages/inbox/t"
    assert one(lambda c: keys.is_message_file(c, "facebook"))
    assert one(lambda c: keys.freshness_key(c, F.lit(None).cast("timestamp"))) == 20260829101112
    assert column(spark, ["your_instagram_activity/messages/inbox/t/message.json"], lambda c: keys.relative_thread_key(c, "instagram")) == ["messages/inbox/t"]
    assert column(spark, ["message.json", "x/message.json"], lambda c: keys.is_message_file(c, "facebook")) == [True, False]
    assert column(spark, ["instagram-@Ann-2026-01-02", "instagram-x"], lambda c: keys.export_account_key(c, "instagram")) == ["ann", None]


def test_bodies_from_payloads(spark):
    given = ['{"content":" hi "}', '{"share":{"link":"l","share_text":"t"}}', '{"share":{"link":"l"}}', "{}", '{"content":""}']
    assert column(spark, given, lambda c: payloads.message_body(F.parse_json(c))) == ["hi", "t\nl", "l", None, None]
    names = column(spark, ['{"participants":["a",{"name":" b "},"a",{"name":""},7]}'], lambda c: payloads.participant_names(F.parse_json(c)))
    assert names == [["a", "b"]]


def test_slugs_of_long_texts_take_a_look_per_character(spark):
    """Accents and characters that become several ones, in a text of two million characters: work is per character, not
    per character and entry of the table; and private characters are none that stand for others."""
    df = spark.range(1).select(F.expr("concat(repeat('aé½b ', 400000), 'ﬃ', '\\uE000\\uE005', 'x')").alias("v"))
    began = time.monotonic()
    slug = text.with_slug(df, "v", "s").first().s
    assert time.monotonic() - began < 15
    assert slug == "ae1-2b-" * 400000 + "ffi-x"


def test_accents_of_every_code_point(spark):
    """Each assigned code point between letters, and after one that it may combine with, as Python takes accents off."""
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)] if unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rows = spark.createDataFrame([(c, f"x{c}y Z{c}9 &{c}") for c in every], "c string, t string").repartition(8)
    slugs = text.with_slug(rows, "t", "slug")
    assert "Python" not in slugs._jdf.queryExecution().optimizedPlan().toString()
    plain = lambda t: "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)).lower().replace("&", " and ")
    dashed = str.maketrans({c: "-" for c in map(chr, range(128)) if c not in string.ascii_lowercase + string.digits})

    def want(t):
        kept = "".join(c if c in string.ascii_lowercase + string.digits else "-" for c in plain(t).translate(dashed))
        return "-".join(filter(None, kept.split("-"))) or "untitled"

    wrong = [(hex(ord(r.c)), r.slug, want(r.t)) for r in slugs.collect() if r.slug != want(r.t)]
    assert not wrong, (len(wrong), wrong[:20])


def bodies(spark, blobs):
    rows = spark.createDataFrame([(i, None if i % 2 else "", b) for i, b in enumerate(blobs)], "i int, text string, attributedBody binary")
    return [r.body_text for r in payloads.with_bodies(rows).orderBy("i").collect()]


def test_attributed_bodies(spark):
    blobs = [plistlib.dumps({"a": ["NSString", "hello there"]}), b"\x00\x01NSMutable\x00hello world\x00", "wide text".encode("utf-16le"), b"", None, b"\x00\x01"]
    blobs += [plistlib.dumps(["short", "the longest"], fmt=plistlib.FMT_BINARY), b"bplist00 broken but told", b"<?xml broken"]
    assert bodies(spark, blobs) == ["hello there", "hello world", "wide text", None, None, None, "the longest", "bplist00 broken but told", "<?xml broken"]
    told = spark.createDataFrame([("said", b"\x00never read\x00")], "text string, attributedBody binary")
    assert payloads.with_bodies(told).first().body_text == "said"


PIECE = st.sampled_from([b"abc", b"longer run ", b"NSString", b"  ", b"\n", b"\x00", b"\x00\x00", b"\xff", b"\xe2\x82", "é€😀".encode(), b"\xef\xbf\xbd", "wide one".encode("utf-16le"), b"h\x00i\x00 \x00", b"\x00\xd8", b"\x3d\xd8\x00\xde", b"~", b"\x7f"])


@settings(max_examples=6, deadline=None, phases=[Phase.generate])
@given(st.lists(st.lists(PIECE, max_size=8).map(b"".join), min_size=100, max_size=250))
def test_printable_bodies_are_those_of_the_bytes(spark, blobs):
    assert bodies(spark, blobs) == [payloads._body_of(b) for b in blobs]


def test_import_order_is_by_path_parts(spark):
    paths = ["a-b/x", "a/x", "m/message_2.json", "m/message_10.json"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(F.split("p", "/")).collect()
    assert [r.p for r in got] == ["a/x", "a-b/x", "m/message_10.json", "m/message_2.json"]


def test_payloads_are_read_once_per_fact(spark):
    """However often a title or body names what it is made of, the payload is asked for it once."""
    rows = spark.createDataFrame([('{"participants":["a",{"name":" b "}],"share":{"link":"l"}}',)], "v string").select(F.parse_json("v").alias("p"))
    found = rows.select(payloads.message_body(F.col("p")).alias("body"), payloads.packet_title(F.lit(""), payloads.participant_names(F.col("p")), F.lit("folder")).alias("title"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in ("$.content", "$.share.link", "$.participants")] == [1, 1, 1]
    assert tuple(found.first()) == ("l", "a, b")
