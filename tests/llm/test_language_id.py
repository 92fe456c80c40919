import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from offerweave.llm import language_id as li

PIECES = li.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def brute(word, prob, number):
    """Sum over all segmentations, one after another."""
    chars = word.decode(errors="surrogateescape")
    if not chars:
        return 1.0
    total = 0.0
    for n in range(1, len(chars) + 1):
        p = chars[:n].encode(errors="surrogateescape")
        if p in number:
            total += prob[number[p]] * brute(chars[n:].encode(errors="surrogateescape"), prob, number)
        elif n == 1:
            total += prob[len(number)] * brute(chars[n:].encode(errors="surrogateescape"), prob, number)
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    prob = rng.random((len(PIECES) + 1, 2)) * 1e-3
    number = {p: i for i, p in enumerate(PIECES)}
    parts = [" the".encode(), " señor".encode(), " internat".encode(), " 你好x".encode(), " ".encode(), "éa".encode()]
    got = li.Lattice(PIECES).score(parts, prob)
    for i, w in enumerate(parts):
        for k in (0, 1):
            assert got[i, k] == pytest.approx(np.log(brute(w, prob[:, k], number)), rel=1e-9), w


def test_long_words_are_summed_whole():
    """Words over PART bytes against a forward pass in logarithms, and both ways against each other."""
    rng = np.random.default_rng(2)
    prob = rng.random((len(PIECES) + 1, 2)) * 1e-4
    number = {p: i for i, p in enumerate(PIECES)}
    lattice = li.Lattice(PIECES)
    words = [" information".encode(), " xyzinternational".encode(), " ñandú你好".encode(), " ".encode()]
    for w, row in zip(words, lattice.score(words, prob), strict=True):
        assert lattice.score_long(w, prob) == pytest.approx(row.tolist(), rel=1e-9)
    for w in (" " + "internationalización" * 40, " " + "你好é" * 300 + "x", " " + "q" * 2_000):
        w = w.encode()
        alpha = np.full((len(w) + 1, 2), -np.inf)
        alpha[0] = 0
        for s in range(len(w)):
            n = li._LEAD[w[s]]
            ends = {s + k: number[w[s : s + k]] for k in range(1, lattice.longest + 1) if s + k <= len(w) and w[s : s + k] in number}
            if n and s + int(n) not in ends:
                ends[s + int(n)] = len(PIECES)
            for e, i in ends.items() if n else ():
                alpha[e] = np.logaddexp(alpha[e], alpha[s] + np.log(prob[i]))
        assert lattice.score([w], prob)[0] == pytest.approx(alpha[-1], rel=1e-9)


TEXTS = {"en": "the house is near the river and the children play with their dogs", "de": "das haus steht nahe am fluss und die kinder spielen mit ihren hunden", "fr": "la maison est près de la rivière et les enfants jouent avec leurs chiens"}


def docs(spark):
    rows = []
    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        w = TEXTS[lang].split()
        rows.append((i, " ".join(w[j % len(w)] for j in range(i % 7, i % 7 + 9)), lang, "x"))
    rows += [(500, None, "en", "x"), (501, "", None, "x"), (502, "12 -- 34 …", "de", "x"), (503, "你好", None, "x"), (None, TEXTS["de"], None, "x"), (504, "THE HOUSE " * 9_000, None, "x")]
    rows += [(505, "x" * 5_000 + "é" * 3_000, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_predictions(spark):
    df = docs(spark)
    model = li.train(df, public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in li.identify(df, model).withColumn("held", li.held_out(F.col("doc_id"))).collect()}
    assert len(got) == df.count()
    for i in range(120):
        assert got[i].lang_pred == got[i].lang and 0 <= got[i].score <= 1
        assert got[i].held == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i].lang_pred for i in (500, 501, 502, None, 504)] == ["und", "und", "und", "de", "en"]
    assert got[503].lang_pred != "und" and got[505].lang_pred != "und" and got[500].score == 0


def test_no_labels_and_empty(spark):
    df = docs(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    none = li.train(df.filter("lang = 'zz'"), path)
    assert {r.lang_pred for r in li.identify(df, none).collect()} == {"und"}
    assert li.identify(df.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet' where text is not null and lang is not null").fetchall()
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = li.fit([r[1] for r in own], [r[2] for r in own], PIECES)
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    langs, _ = model.predict(pa.array([r[1] for r in test]))
    assert np.mean([a == r[2] for a, r in zip(langs, test, strict=True)]) >= 0.97


def test_sample_counts_distinct_texts_and_takes_long_ones(spark, monkeypatch):
    """Copies don't use up a language's share; texts over the limit fill up what short ones leave."""
    seen = []
    monkeypatch.setattr(li, "fit", lambda texts, langs, pieces: seen.extend(zip(langs, texts, strict=True)))
    rows = [(i, "the same house", "en") for i in range(20_000)]
    rows += [(30_000 + i, f"house {'abcdefghij'[i % 10] * (i // 10 + 1)}", "en") for i in range(40)]
    rows += [(40_000 + i, f"haus {i} " + "haus " * 4_000, "de") for i in range(20)]
    own = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    path = public_tokenizers.path("piece_bpe_32k.model")
    li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path)
    assert sorted(t for x, t in seen if x == "en") == sorted({t for t, x in own if x == "en"})
    assert sorted(t for x, t in seen if x == "de") == sorted({t[: li.SAMPLE_BYTES] for t, x in own if x == "de"})
    seen.clear()
    short = {t for i, t, x in rows[20_000:] if x == "en" and zlib.crc32(str(i).encode()) % 4 != 2}
    li.train(spark.createDataFrame(rows[20_000:], "doc_id long, text string, lang string").withColumn("lang", F.lit("en")), path, sample=len(short) + 3)
    assert len(seen) == len(short) + 3 and {t for _, t in seen} >= short


def test_sample_is_the_least_hashes(spark):
    """However many texts and copies a language has; null labels, held out rows and empty texts bring none."""
    rows = [(i, f"text number {i % 3_000}", "hot") for i in range(9_000)] + [(10_000 + i, f"text number {i}", "few") for i in range(7)]
    rows += [(20_000 + i, f"long {i} " + "x" * li.SAMPLE_BYTES, "few") for i in range(50)] + [(30_000, "", "few"), (30_001, None, "few"), (30_002, "no label", None)]
    got = li.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20).collect()
    for lang in ("hot", "few"):
        own = {t for i, t, x in rows if x == lang and t and zlib.crc32(str(i).encode()) % 4 != 2}
        order = sorted(own, key=lambda t: (len(t) > li.SAMPLE_BYTES, xxhash.xxh64_intdigest(t.encode(), 42) & (2**63 - 1)))
        assert [r._text for r in sorted(got, key=lambda r: r._at) if r._lang == lang] == [t[: li.SAMPLE_BYTES] for t in order[:20]]
    assert {r._lang for r in got} == {"hot", "few"}
