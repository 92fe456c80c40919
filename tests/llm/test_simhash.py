import random
import re

import numpy as np
import xxhash

from offerweave.llm import simhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint():
    for t in (b"", b"a", b"A b", b"a\tB  c\n", b"x y z w q r s t" * 9, "é ß ñ Éa".encode() * 3):
        for piece in (1, 2, 5, 7, 1_000):
            assert simhash.fingerprint(t, piece=piece) == brute_fingerprint(t)


def test_resolve_loses_no_link():
    """Every distance up to three, over all block patterns, connects; nothing else does."""
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 5)) if rng.random() < 0.6 else rng.sample(range(16), 3):
                y ^= 1 << b
            fps.append(y)
    fps = sorted(set(fps))
    arr = np.array(fps, np.uint64)
    n = simhash.FLIPS.shape[1]
    a, b = simhash.resolve(np.repeat(arr, 4 * n), np.tile(np.arange(4 * n, dtype=np.uint8), len(arr)))
    at = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True):
        assert bin(x ^ y).count("1") <= 3
        root[find(at[x])] = find(at[y])
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), i), i)
    assert [least[find(i)] for i in range(len(fps))] == brute_components(fps, list(range(len(fps))))


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta iota".split(), k=rng.randint(1, 300))) for _ in range(30)]
    texts = [None, "", "  ", "\n"] + base + [b + " zz" for b in base] + [b.upper() for b in base[:5]] + ["word " * 20_000] * 2
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(texts)] + [(7, base[0], "y"), (7, base[0], "y"), (None, base[1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(df).collect()), key=str)
    fps = [brute_fingerprint((t or "").encode()) for _, t, _ in rows]
    comp = brute_components(fps, [r[0] for r in rows])
    assert got == sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp, strict=True)), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_dedup(df).count() == 0
