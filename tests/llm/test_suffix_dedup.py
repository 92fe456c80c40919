import random

import numpy as np
import pytest

from offerweave.llm import packed
from offerweave.llm import suffix_dedup as sd
from offerweave.llm.run_length_index import RunLengthIndex, suffix_order


def brute(rows, n):
    first, out = {}, []
    texts = [(i if i is not None else 2**63 - 1, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in range(len(b) - n + 1):
            k = b[s : s + n]
            first[k] = min(first.get(k, i), i)
    for (raw, _), (i, b) in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < i:
                gone[s : s + n] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((raw, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcde é\nñ你", k=n))
    passages = [text(130), text(60), "ab" * 60]
    docs = [None, "", "short", "x" * 49, "x" * 50, "x" * 51, "-" * 400, "-" * 333 + "end"]
    docs += [text(rng.randint(1, 500)) for _ in range(25)]
    for _ in range(40):
        p = rng.choice(passages)
        a, b = sorted(rng.choices(range(len(p) + 1), k=2))
        docs.append(text(rng.randint(0, 90)) + p[a:b] + text(rng.randint(0, 40)) + rng.choice(passages))
    docs += [docs[10], docs[11], docs[30] + "!", "?" + docs[31], text(9_000)]
    rows = [(rng.randint(-5, 90), t) for t in docs] + [(None, passages[0]), (4, docs[12]), (4, docs[12])]
    rng.shuffle(rows)
    return rows


def run(spark, rows, n=50):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.suffix_dedup(df, window=n).collect()), key=str)


@pytest.mark.parametrize("size,window", [(0, 50), (3_000, 50), (2_000, 28)])
def test_against_brute_force(spark, monkeypatch, size, window):
    if size:
        monkeypatch.setattr(packed, "MOST_PARTS", 3)  # several buckets to a partition
        for name, value in (("CHUNK", size), ("BUCKET", 4 * size), ("VALUES", 300), ("INDEX", 500)):
            monkeypatch.setattr(sd, name, value)
    rows = cases(size)
    assert run(spark, rows, window) == brute(rows, window)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, b"")]


def test_common_hashes_change_no_result(spark, monkeypatch):
    rows = cases(9)
    texts = b"".join((t or "").encode() for _, t in rows)
    h = np.unique(sd.hashes(texts + b"\0" * 64, len(texts) - sd.K + 1))
    monkeypatch.setattr(sd, "_common", lambda *_: sd.Common(h[::3].copy()))
    assert run(spark, rows) == brute(rows, 50)


def strings(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ab", k=80)) for _ in range(6)]
    out = {b[x : x + rng.randint(50, 80)].encode() for b in base for x in (0, 0, 3, 7, 20)} | {b"a" * k for k in (50, 60, 80)}
    return sorted({s for s in out if len(s) >= 50}, key=lambda s: rng.random())


def test_suffix_order_and_index():
    for seed in range(5):
        s = strings(seed)
        data = np.frombuffer(b"".join(s), np.uint8)
        size = np.array([len(x) for x in s])
        at = np.r_[0, np.cumsum(size)]
        owner = np.arange(len(s))[::-1] * 3
        text = b"\0".join(bytes(c + 1 for c in x) for x in s) + b"\0"
        left = np.concatenate([np.arange(n, -1, -1) for n in size])
        order = suffix_order(np.frombuffer(text + b"\0" * 64, np.uint8), left)
        assert order.tolist() == sorted(range(len(left)), key=lambda p: (text[p : p + left[p]], p))
        index = RunLengthIndex(data, at, owner, 50)
        assert len(index.run) < len(left) / 2  # repetitive strings have few runs
        got = {(i, o): x for i, o, x in zip(*(x.tolist() for x in index.repeats()), strict=True)}
        places = {}
        for i, x in enumerate(s):
            for o in range(len(x) - 49):
                places.setdefault(x[o : o + 50], []).append((i, o))
        want = {p: min(int(owner[i]) for i, _ in v) for v in places.values() if len(v) > 1 for p in v}
        assert got == want


def test_matching_statistics():
    """Streamed from the samples at run ends: the longest match of each suffix with another one."""
    for seed in range(5):
        s = strings(seed)
        index = RunLengthIndex(np.frombuffer(b"".join(s), np.uint8), np.r_[0, np.cumsum([len(x) for x in s])], np.arange(len(s)), 50)
        suffixes = sorted(x[o:] for x in s for o in range(len(x)))

        def shared(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        longest = {}
        for a, b in zip(suffixes[:-1], suffixes[1:], strict=True):
            n = shared(a, b)
            longest[a], longest[b] = max(longest.get(a, 0), n), max(longest.get(b, 0), n)
        for alive, read, _, upper, lower in index.statistics():
            assert np.maximum(upper, lower).tolist() == [longest[s[i][len(s[i]) - read :]] for i in alive.tolist()]


@pytest.mark.parametrize("size", [60, 100, 333, 5_000])
def test_parts_hold_each_window_once(size):
    at = np.r_[0, np.cumsum([0, 30, 49, 50, 51, 700, 120, 2_345, 1])]
    seen = []
    for a, b, bounds, i in sd._parts(at, 50, size):
        for d in range(len(bounds) - 1):
            assert at[i + d] <= a + bounds[d] and a + bounds[d + 1] <= at[i + d + 1]
            seen += [(i + d, int(x)) for x in range(a + bounds[d], a + bounds[d + 1] - 49)]
    assert seen == [(d, x) for d in range(len(at) - 1) for x in range(at[d], at[d + 1] - 49)]


def test_match():
    s = strings(11) * 2
    rng = random.Random(1)
    ident = np.array([rng.randint(0, 9) for _ in s])
    size = np.array([len(x) for x in s])
    i, offset, count = sd.match(np.frombuffer(b"".join(s), np.uint8), size, ident, 50)
    got = {(a, o + k) for a, o, n in zip(i.tolist(), offset.tolist(), count.tolist(), strict=True) for k in range(n)}
    least = {}
    for x, d in zip(s, ident.tolist(), strict=True):
        for o in range(len(x) - 49):
            least[x[o : o + 50]] = min(least.get(x[o : o + 50], d), d)
    assert got == {(a, o) for a, x in enumerate(s) for o in range(len(x) - 49) if least[x[o : o + 50]] < ident[a]}


def test_minimisers_are_found_once_for_the_stretches_of_a_chunk(monkeypatch):
    """Each part of a chunk is hashed once there, not again for its values."""
    import pyarrow as pa

    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4_000)).encode()
    size, none, parts = np.array([4_000, 4_000]), sd.Common(np.zeros(0, np.uint64)), []
    ident, key, at, data = np.array([1, 2]), np.array([7, 7]), np.array([0, 4_000, 8_000]), np.frombuffer(text * 2, np.uint8)
    value, multi = sd._minimisers(ident, at, data, 50, 30, none)
    blobs = [packed.pack(ident, np.zeros(2, np.uint8), key, size, data), packed.pack(np.array([0]), np.packbits(multi))]
    monkeypatch.setattr(sd, "Slice", lambda *x, made=sd.Slice: parts.append(len(x[0])) or made(*x))
    out = list(sd._stretches(50, 30, 1, 1, 1, none)([pa.record_batch([pa.array(blobs, pa.binary())], ["blob"])]))
    assert sum(parts) == 8_000
    settled = [packed.unpack(blob) for _, blob in out if len(packed.unpack(blob)) == 2]
    names, _, _, count = packed.unpack(settled[0][1].tobytes())
    assert names.tolist() == [2, 7] and count.sum() == 4_000 - 49
