"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints link at three or fewer differing bits. Half that radius is one and a half: the odd
bit is met by blanking one of the four 16-bit blocks, the rest by flipping at most one of the
other 48 bits. If two fingerprints differ in one to three bits, some block holds exactly one of
them or all of them, so blanking a block leaves two differing bits at most, or none, and the two
meet on a variant that lies within one flip of both. Every distinct fingerprint thus emits
4 x 49 variants; they are shuffled in packed form, and each colliding variant is resolved without
listing its pairs:

* fingerprints equal in the blanked block differ in two bits at most: all link, as a star;
* blanked blocks one bit apart add one: found by looking up the 16 flips;
* fingerprints with the same 48 bits, unflipped, and blocks two or three bits apart are found by
  looking up the 680 two- and three-bit masks.

Each edge is verified by its number of differing bits before it is returned.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.llm import packed
from offerweave.llm.components import connected_components
from offerweave.llm.shared import table

BLOCKS, WIDTH = 4, 16
VARIANTS = BLOCKS * (64 - WIDTH + 1)
#: Variants to a bucket.
BUCKET = 500_000
SEED = 42
#: Bytes of a text that are hashed at once.
PIECE = 1_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _blank(g: int) -> np.uint64:
    return np.uint64(~(((1 << WIDTH) - 1) << (WIDTH * g)) & (2**64 - 1))


def _flips(g: int) -> np.ndarray:
    """What 0 and each of the bits outside block g flip."""
    return np.array([0] + [1 << b for b in range(64) if not WIDTH * g <= b < WIDTH * (g + 1)], np.uint64)


FLIPS = np.stack([_flips(g) for g in range(BLOCKS)])
FAR_MASKS = [sum(1 << b for b in c) for k in (2, 3) for c in combinations(range(WIDTH), k)]


def _ones(words: list[bytes], k: int) -> tuple[np.ndarray, int]:
    """(how often each bit is set, number of hashes) over all runs of k words."""
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    h = np.array([of(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    return set_bits(h), len(h)


def set_bits(h: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def _pieces(text: bytes, size: int):
    """The text cut at white space into pieces of about ``size`` bytes."""
    at = 0
    while at < len(text):
        to = at + size
        space = _SPACE.search(text, to) if to < len(text) else None
        to = space.start() if space else len(text)
        yield text[at:to]
        at = to


def fingerprint(text: bytes, shingle: int = 3, piece: int = PIECE) -> int:
    """The SimHash of a text, piece by piece: memory doesn't grow with its length."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for part in _pieces(text, piece):
        held += part.lower().split()
        if len(held) >= shingle:
            more, count = _ones(held, shingle)
            ones, n, held = ones + more, n + count, held[len(held) - shingle + 1 :]
    if not n and held:
        ones, n = _ones(held, len(held))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(_id, _fp) of every row, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, at = packed.texts(batch.column("_text"))
            data = data.tobytes()
            found = np.fromiter((fingerprint(data[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, len(at) - 1)
            yield pa.record_batch([batch.column("_id"), pa.array(found.view(np.int64))], ["_id", "_fp"])

    return packed.map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, f"_id {kind}, _fp long")


def _emit(parts: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8_192):
                fp = np.asarray(batch.column("_fp").slice(at, 8_192), np.int64).view(np.uint64)
                for g in range(BLOCKS):
                    key = (fp[:, None] ^ FLIPS[g][None, :]) & _blank(g)
                    bucket = packed.deal(packed.mix(key.ravel() + np.uint64(g)), parts)
                    for p, where in packed.by_part(bucket, parts):
                        who, flip = np.divmod(where, FLIPS.shape[1])
                        yield p, packed.pack(fp[who], (flip + g * FLIPS.shape[1]).astype(np.uint8), level=1)

    return run


def _near(a: np.ndarray, b: np.ndarray, radius: int = 3) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def resolve(fp: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints of a bucket which link through its variants."""
    heads, tails = [], []

    def add(a, b):
        ok = _near(a, b)
        heads.append(a[ok])
        tails.append(b[ok])

    def look_up(c, of, masks):
        """c: sorted (group, block value); of: a fingerprint of each."""
        for m in masks:
            other = c ^ m
            at = np.searchsorted(c, other)
            at[at == len(c)] = 0
            hit = (c[at] == other) & (other > c)
            if hit.any():
                add(of[hit], of[at[hit]])

    n = FLIPS.shape[1]
    for g in range(BLOCKS):
        own = (code >= g * n) & (code < (g + 1) * n)
        f, flip = fp[own], code[own] - g * n
        key = (f ^ FLIPS[g][flip]) & _blank(g)
        order = np.argsort(key)
        f, flip, key = f[order], flip[order], key[order]
        same = key[1:] == key[:-1]
        met = np.r_[same, False] | np.r_[False, same]
        f, flip, key = f[met], flip[met], key[met]
        if not len(f):
            continue
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        block = ((f >> np.uint64(WIDTH * g)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
        c = (group << WIDTH) | block
        order = np.argsort(c, kind="stable")
        f, flip, c = f[order], flip[order], c[order]
        new = np.r_[True, c[1:] != c[:-1]]
        first = np.flatnonzero(new)
        head = f[first][np.cumsum(new) - 1]
        add(head[~new], f[~new])
        look_up(c[first], f[first], [1 << b for b in range(WIDTH)])
        plain = flip == 0
        if plain.any():
            c, f = c[plain], f[plain]
            group = c >> WIDTH
            same = group[1:] == group[:-1]
            met = np.r_[same, False] | np.r_[False, same]
            if met.any():
                look_up(c[met], f[met], FAR_MASKS)
    a = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
    b = np.concatenate([*tails, np.zeros(0, np.uint64)]).view(np.int64)
    if not len(a):
        return a, b
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def _meet(batches):
    got = [packed.unpack(b) for b in packed.blobs(batches)]
    if got:
        a, b = resolve(*(np.concatenate(x) for x in zip(*got, strict=True)))
        for at in range(0, len(a), 100_000):
            yield pa.record_batch([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], ["a", "b"])


def ball_links(distinct: DataFrame, rows: int) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column _fp, ``rows`` distinct ones) that link."""
    parts = max(1, -(-rows * VARIANTS // BUCKET))
    sent = packed.send(packed.map_rows(distinct, _emit(parts)), parts)
    return packed.map_batches(sent, packed.by_bucket(_meet, parts), "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Words are what ASCII white space separates, A-Z lower-cased; texts with fewer words than a
    shingle have one shingle, texts without words (null included) the fingerprint zero, which
    links like any other. component_id is the smallest id reachable over links; null ids never
    give it a name unless a component has no other. Repeated rows share their class. An empty
    table gives no rows.
    """
    of = table(fingerprints(docs, id_col, text_col, shingle))
    classes = table(of.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = connected_components(ball_links(classes.select("_fp"), classes.count()))
    rooted = table(
        classes.join(roots, classes["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    )
    least = table(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")))
    named = table(rooted.join(least, "_root").select("_fp", "component_id"))
    return of.join(named, "_fp").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
