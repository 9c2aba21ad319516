import re

import pytest
from pyspark.sql import functions as F

THUE = "a"
while len(THUE) < 1024:
    THUE += THUE.translate(str.maketrans("ab", "ba"))
#: Two words whose polynomial hashes modulo 2^64 agree for every base.
TWINS = [THUE, THUE.translate(str.maketrans("ab", "ba"))]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of (id, text) with columns whose names the operators use themselves."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        for name in ("id", "h", "n", "held", "slot", "label", "toxicity", "bands", "chunk", "part", "other0"):
            df = df.withColumn(name, F.lit(f"clash {name}"))
        return df.repartition(3)

    return make


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def components(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}
