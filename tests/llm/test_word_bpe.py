import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from offerweave.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
TEXTS = [None, "", " \n ", "Hello, World's  été 123 <|endoftext|> naïve x ​ é 你好", "foo<|endoftext|>bar", "a b   c", "a ́b", "İSTANBUL ΣΑΣ ß", " ", "x \u0085 y", "A<|ENDOFTEXT|>"]


@pytest.mark.parametrize("size", [0, 3_000])
def test_against_the_library(spark, monkeypatch, size):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choices("abAB'. \n1é,", k=rng.randint(0, 900))) for _ in range(60)] + ["very long " * 30_000, "word" * 50_000, " " * 300_000 + "x"]
    if size:
        monkeypatch.setattr(word_bpe, "CHUNK", size)
        monkeypatch.setattr(word_bpe, "BUCKET", size)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, TEXTS[3], "y"), (None, "null id", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted(map(tuple, word_bpe.encode_documents(df, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = TOK.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), TOK.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert word_bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_rows_without_a_fixed_order(spark):
    """Two passes over a plan that isn't deterministic would differ: it is written first."""
    from pyspark.sql import functions as F

    df = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.rand() * 500).cast("int").cast("string"), F.lit(" a b")).alias("text"))
    got = word_bpe.encode_documents(df, PATH).collect()
    assert len(got) == 3_000 and all(len(r.ids.split()) == r.n_tokens for r in got)
