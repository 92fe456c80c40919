import re

from tokenizers import Tokenizer

import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(cp.STAGES)[name]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], COLUMNS)


PROSE = {"en": "the house stands near the river and the children play with their dogs all day long", "de": "das haus steht nahe am fluss und die kinder spielen jeden tag mit ihren hunden"}


def rows():
    out = [(i, " ".join(w + str(i) if j % 3 == 0 else w for j, w in enumerate((PROSE[lang] + " ").split() * 4)), lang) for i, lang in enumerate(["en", "de"] * 8)]
    passage = " ".join(f"shared{j} word" for j in range(30))
    out += [(100 + i, f"{PROSE['en']} {' '.join(f'own{i}w{k}' for k in range(12))} {passage} tail{i}x", "en") for i in range(5)]
    out += [(200, out[0][1], "en"), (201, out[0][1].replace(" ", "  "), "en"), (202, out[1][1].upper(), "de")]
    return out + [(300, None, "en"), (301, "", None), (302, " 12 -- !", "de"), (100, out[16][1], "en")]


def test_stages(spark):
    d = docs(spark, rows())
    kept = stage("language ID")(spark, d, "")
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t, _ in rows() if i not in (300, 301, 302))
    once = stage("exact dedup")(spark, kept, "")
    got = sorted(r.doc_id for r in once.collect())
    assert got == sorted([*range(16), 100, 101, 102, 103, 104, 202])
    near = stage("SimHash near-dedup")(spark, once, "")
    assert 202 not in {r.doc_id for r in near.collect()}
    cut = stage("substring dedup")(spark, near, "")
    assert cut.columns == d.columns
    text = {r.doc_id: r.text for r in cut.collect()}
    assert "shared5" in text[100] and "shared5" not in text[101] and "own1w5" in text[101]
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    packed = stage("packing")(spark, cut, "").collect()
    tok = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(tok.encode(r.text).ids) + 1 for r in cut.collect())


def test_empty_table(spark):
    d = docs(spark, [])
    for name, f in cp.STAGES[:-1]:
        d = f(spark, d, "")
        assert d.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
    assert cp.STAGES[-1][1](spark, d, "").count() == 0


def test_run(spark):
    """The whole pipeline on a table, against five plain stages one after another."""
    import duckdb
    import test_near_copies
    import test_substring_dedup

    path = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{path}/documents.parquet' order by 1").fetchall()
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    least = {}
    for i, t in rows:
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    rows = [(i, t) for i, t in rows if i in set(least.values())]
    near = set(test_near_copies.brute(rows))
    rows = [(i, t) for i, t in rows if i in near]
    whole, want = dict(rows), {}
    tok = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    for i, n, gone, kept in test_substring_dedup.brute(rows, 20):
        if not gone or gone < n:
            want[i] = len(tok.encode(kept if gone else whole[i], add_special_tokens=False).ids) + 1
    got = cp.run(spark, path).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert {r.doc_id: r.doc_tokens for r in got} == want
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == want


def test_null_and_repeated_ids_with_different_texts(spark):
    """Each different text keeps a row, whatever other rows have the same id."""
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abce")
    d = docs(spark, [(i, t, "en") for i, t in [(None, a), (None, b), (None, b + " "), (None, c), (3, c), (5, a), (5, e), (7, c), (7, b + " x9 x8 x7")] for _ in range(2)])
    once = stage("exact dedup")(spark, d, "")
    got = sorted((r.doc_id or 0, r.text.split()[0], len(r.text.split())) for r in once.collect())
    assert got == [(0, "b0", 40), (0, "b0", 40), (3, "c0", 40), (5, "a0", 40), (5, "e0", 40), (7, "b0", 43)]
    near = stage("SimHash near-dedup")(spark, once, "")
    assert sorted((r.doc_id or 0, r.text.split()[0]) for r in near.collect()) == [(3, "c0"), (5, "a0"), (5, "e0"), (7, "b0")]
