import random
import re

import numpy as np

from offerweave.llm import packed
from offerweave.llm import substring_dedup as sd


def brute(rows, n):
    first, out = {}, []
    split = [(i if i is not None else 2**63 - 1, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, (i, s)), (i, s))
    for (raw, _), (i, w) in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (i, s):
                gone.update(range(s, s + n))
        out.append((raw, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}é"[: rng.randint(2, 5)] for i in range(400)]
    text = lambda n: rng.choice([" ", "\n", " \t "]).join(rng.choices(vocab, k=n))
    passage = text(45)
    docs = [None, "", " \n", "short text"] + [text(rng.randint(1, 200)) for _ in range(30)]
    docs += [text(rng.randint(0, 30)) + " " + passage + "\n" + text(rng.randint(0, 30)) for _ in range(25)]
    docs += ["a " * 90, "a " * 57, "a b " * 40, passage, passage, text(5_000)]
    rows = [(rng.randint(-3, 80), t) for t in docs] + [(None, passage), (5, docs[9]), (5, docs[9])]
    rng.shuffle(rows)
    return rows


def run(spark, rows, n=20):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string").repartition(3)
    return sorted(map(tuple, sd.substring_dedup(df, window=n).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = cases(1)
    assert run(spark, rows) == brute(rows, 20)


def test_kept_columns_and_whole_texts(spark):
    rows = cases(3)
    df = spark.createDataFrame([(i, t, f"{i}|{t}", [1.5, None], "y") for i, t in rows], "doc_id long, text string, was string, more array<double>, kept string")
    found = sd.substring_dedup(df, keep=["was", "more"], whole=True).collect()
    assert len(found) == len(rows)
    kept = {}
    for i, n, gone, text in brute(rows, 20):
        kept.setdefault((i, n, gone), set()).add(text)
    for r in found:
        assert r.was.startswith(f"{r.doc_id}|") and r.more == [1.5, None]
        t = r.was.split("|", 1)[1]
        if r.n_removed:
            assert r.kept_text in kept[r.doc_id, r.n_words, r.n_removed]
        else:
            assert (r.kept_text is None and t == "None") or r.kept_text == t


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packed, "MOST_PARTS", 3)  # several buckets to a partition
    for name, value in (("BUCKET", 2_000), ("CHUNK", 3_000)):
        monkeypatch.setattr(sd, name, value)
    rows = cases(2)
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, rows, 7) == brute(rows, 7)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, "")]


def test_window_hashes():
    h = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    for n in (1, 2, 3, 5, 7, 16, 20):
        whole = [0] * (50 - n + 1)
        for i in range(len(whole)):
            for j in range(n):
                whole[i] = (whole[i] * sd._B + int(h[i + j])) % 2**64
        assert sd.window_hashes(h, n).tolist() == whole
        assert sd.sliding_min(h, n).tolist() == [min(h[i : i + n].tolist()) for i in range(len(whole))]


def test_equal_hashes_are_compared():
    codes = np.array([1, 2, 9, 1, 2, 9, 3, 4], np.int32)
    at, group = sd.equal_groups(codes, np.array([0, 3, 6]), np.zeros(3, np.uint64), 2)
    assert sorted(zip(at.tolist(), group.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1)]
