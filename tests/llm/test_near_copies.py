import random

import numpy as np

import corpus_pipeline as cp
from offerweave.llm import near_copies as nc


def brute(rows):
    """Rows that stay, all pairs compared."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                root[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    far = 2**63
    return sorted(min(far if i is None else i for i, _ in g) for g in groups.values())


def changed(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


def table_rows():
    rng = random.Random(5)
    rows, at = [], 0
    for size in (1, 4, 5, 30, 200, 400):
        for _ in range(6):
            base = [f"w{rng.randrange(5_000)}" for _ in range(size)]
            for n in (0, 0, 1, 2, 4, 6, 8, 10):
                rows.append((at, " ".join(changed(base, min(n * size // 200, size), rng)) + ("" if n else " ")))
                at += 1
    chain = [f"c{i}" for i in range(60)]  # neighbours link, ends don't
    rows += [(at + i, " ".join(chain[i * 3 : i * 3 + 40])) for i in range(6)]
    rng.shuffle(rows)
    return rows


def stage(spark, rows):
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(cp.STAGES)["SimHash near-dedup"](spark, d, "")
    assert got.columns == d.columns
    return got.collect()


def test_stage_against_brute_force(spark):
    rows = table_rows()
    assert sorted(r.doc_id for r in stage(spark, rows)) == brute(rows)


def test_a_tenth_of_the_words_changed_in_a_row(spark):
    words = [f"word{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:270] + [f"other{i}" for i in range(30)])), (3, " ".join(words[:200] + [f"far{i}" for i in range(100)]))]
    assert [r.doc_id for r in sorted(stage(spark, rows), key=lambda r: r.doc_id)] == [1, 3]


def test_rows_of_null_and_repeated_ids_are_judged_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, b), (None, b + " end"), (5, c), (5, a + " end"), (5, c), (7, c + " end")]
    got = sorted((r.doc_id or 0, r.text[0]) for r in stage(spark, rows))
    assert got == [(0, "b"), (5, "a"), (5, "c")]


def test_shingles_piece_by_piece_and_recall_of_bands():
    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 300, 2_000)).encode()
    assert (nc.shingles(text, piece=50) == nc.shingles(text)).all()
    missed = 0
    for _ in range(2_000):
        h = rng.integers(0, 2**64 - 1, 100, np.uint64)
        missed += not (nc.bands(h[:90])[0] == nc.bands(h[10:])[0]).any()  # 80 of 100
    assert missed <= 1


def test_links_of_a_crowded_fingerprint_that_no_first_or_last_class_has(spark, monkeypatch):
    """Pairs linked only to each other, amid many classes that share fingerprints but don't link."""
    base, rows = [f"b{i}" for i in range(174)], []
    for at in range(0, 240, 2):
        own = [f"own{at}w{i}" for i in range(25)]
        rows += [(at, " ".join(base + own)), (at + 1, " ".join(base + own[:5] + [w + "x" for w in own[5:]]))]
    assert brute(rows) == list(range(0, 240, 2))
    assert sorted(r.doc_id for r in stage(spark, rows)) == brute(rows)
    monkeypatch.setattr(nc, "BLOCK", 50)  # blocks meet two at a time
    assert sorted(r.doc_id for r in stage(spark, rows)) == brute(rows)
