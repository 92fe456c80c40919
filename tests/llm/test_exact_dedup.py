import hashlib
import re

from offerweave.llm.exact_dedup import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        same = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        ids = [j for j in same if j is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **x):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    return sorted(map(tuple, exact_dedup(df, **x).collect()), key=str)


def test_against_brute_force(spark):
    long = "very long text " * 20_000
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\x0bb", "a b ", "A b", "a b", "é", "same head " * 20 + "x", "same head " * 20 + "y", long, long + " ", long + "z"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(7, "a b"), (7, "a b"), (None, "a b"), (None, "only null"), (None, "only null"), (-5, "é")]
    rows += [(1000 + i, "one hot copy") for i in range(400)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, salts=1) == brute(rows)
    assert run(spark, rows, salts=5_000) == brute(rows)


def test_salts_follow_the_partitions(spark):
    """A hot group is dealt over as many parts as the exchange has; the rows stay the same."""
    rows = [(i, "one hot copy" if i % 3 else f"text {i}") for i in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty(spark):
    assert run(spark, []) == []
