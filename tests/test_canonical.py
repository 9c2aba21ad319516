import hashlib
import json
import math

from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from letterloom.functions.canonical import canonical_json, parse_payload
from letterloom.functions.keys import message_fingerprint

#: Letters, escapes, what looks like JSON, and control characters, but no surrogates and no keys beyond U+FFFF.
TEXT = st.text(st.sampled_from(list('aé漢 "\\/,:{}[]\b\f\n\r\t\x00\x01\x02\x0b\x1a\x1f\x7f uE01.5-')), max_size=12) | st.sampled_from(["\\u001F", '\\"1.0,', '": 2.50]', "1.5, 2.5}", "😀"])
KEY = st.text(st.sampled_from(list('abE é"\\,:1.')), max_size=6)
FLOAT = st.floats(allow_nan=False, allow_infinity=False, allow_subnormal=False).map(lambda x: float(f"{x:.14e}")).filter(math.isfinite)
NUMBER = st.integers(-(10**37), 10**37) | FLOAT | st.sampled_from([0.0, -0.0, 1.0, 100.0, 1e7, 1e15, 1e16, 1e-4, 1e-5, 123456789.125, 2.5e-4, 1e22, 1.7976931348623157e308])
VALUE = st.recursive(st.none() | st.booleans() | NUMBER | TEXT, lambda inner: st.lists(inner, max_size=4) | st.dictionaries(KEY, inner, max_size=4), max_leaves=12)


@settings(max_examples=10, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(KEY, VALUE, max_size=5), min_size=40, max_size=120), st.booleans(), st.sampled_from([None, 1]))
def test_the_text_is_pythons(spark, payloads, ascii_only, indent):
    texts = [json.dumps(p, ensure_ascii=ascii_only, indent=indent) for p in payloads]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, text string").select("i", parse_payload(F.col("text")).alias("v"))
    got = {r.i: (r.told, r.fp) for r in rows.select("i", canonical_json(F.col("v")).alias("told"), message_fingerprint(F.col("v")).alias("fp")).collect()}
    for i, p in enumerate(payloads):
        want = json.dumps(json.loads(texts[i]), sort_keys=True, ensure_ascii=False)
        assert got[i][0] == want
        assert got[i][1] == hashlib.sha256(want.encode()).hexdigest()


def test_numbers_as_they_are_written(spark):
    texts = ["1", "1.0", "-0", "-0.0", "1e3", "1E+3", "2.50", "100.00", "12345678901234567.0", "123456789012345678901234567890", "0.00012", "0.000012", "1.5e-07", "9999999.0", "10000000.0", "[1.0,[2.0E10],{\"a\":3.0e-9}]", "[0.1,1,\"1.0\",-2.0]", "  [ 1.0 ]  "]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, text string").select("i", canonical_json(parse_payload(F.col("text"))).alias("told"))
    assert {r.i: r.told for r in rows.collect()} == {i: json.dumps(json.loads(t)) for i, t in enumerate(texts)}


def test_what_is_no_json_is_null(spark):
    texts = ["{", "1.0.0", '{"a":1.0', '{"a":"\x01 1.0,"}', "", '{"a" 1.0}', "nul"]
    rows = spark.createDataFrame([*enumerate([*texts, None])], "i int, text string").select(parse_payload(F.col("text")).alias("v"))
    assert rows.where("v is not null").count() == 0
    assert rows.select(canonical_json(F.col("v")).alias("c")).where("c is not null").count() == 0


def test_the_plan_has_no_python(spark):
    rows = spark.createDataFrame([("{}",)], "text string").select(message_fingerprint(parse_payload(F.col("text"))))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString().replace("ExistingRDD", "")
