"""SimHash near-dedup for stages: five-word shingles, Jaccard similarity 0.8 or more.

Texts with equal shingle sets are one class. Candidates come from the ball hashing of operator 9
over the SimHash of each set (three or fewer differing bits). A pair of similarity 0.8 differs in
some ten of 64 bits, so most such pairs lie outside any ball that can be enumerated: variants
within half of a radius of 17 bits would be 10^10 a fingerprint. Each class therefore has BANDS
further fingerprints, each of ROWS minimum hashes; two classes of similarity s share one with
probability 1 - (1 - s^ROWS)^BANDS, which at 0.8 is 1 - 7e-6.

All classes that share a fingerprint (equal SimHashes are one too) are candidates of each other,
and are judged in two steps. First a class is compared with the one it meets by SimHash and with
two of each fingerprint, the first and the last in an order of the fingerprint's own, which are
rows in proportion to the classes. Pairs of three or fewer classes with a fingerprint all meet so.
Then, in fingerprints of more classes that still belong to several groups, every pair of two groups
is compared: blocks of these classes meet in tasks, two at a time, that work pair by pair without
making rows of them; a pair is taken by the first fingerprint it shares, and passed over once other
links have joined its groups. No link that would join two groups is left out. Candidates are
estimated by a byte of each minimum hash, and all that are not far from similar (LOW) are compared
by their whole sets, built again from the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.llm import packed
from offerweave.llm.components import connected_components
from offerweave.llm.shared import table
from offerweave.llm.simhash import PIECE, SEED, _pieces, ball_links, set_bits

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 30, 5
#: Candidates with a lower estimate are not compared: 0.8 less four deviations of the estimate.
LOW = 0.67
#: Classes, and shingles of theirs, that a block of a crowded fingerprint has on average at most.
BLOCK, BLOCK_SHINGLES = 1_024, 2_000_000
#: Hashes that are multiplied out at once.
CHUNK = 2_048
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, k: int = SHINGLE, piece: int = PIECE) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of all words if there are fewer."""
    of, found, held = xxhash.xxh64_intdigest, [], []

    def runs(words, k):
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts, ends = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
        return np.unique(np.array([of(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64))

    for part in _pieces(text, piece):
        held += part.lower().split()
        if len(held) >= k:
            found.append(runs(held, k))
            held = held[len(held) - k + 1 :]
    if not found and held:
        found.append(runs(held, len(held)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def bands(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The BANDS fingerprints of a set that is not empty, and a byte of each minimum hash."""
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[at : at + CHUNK, None] * _FACTORS).min(0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = packed.mix(out ^ column) + np.uint64(1)
    return out, (packed.mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def simhash(hashes: np.ndarray) -> int:
    """The SimHash of a set, as a signed number; zero if it is empty."""
    return int(np.packbits(2 * set_bits(hashes) > len(hashes), bitorder="little").view(np.int64)[0])


def _met_by_simhash(classes: DataFrame) -> DataFrame:
    """Pairs (a, a_size, b, b_size) of the smallest classes of fingerprints that operator 9 links."""
    least = F.min(F.struct(F.col("_node").alias("a"), F.col("_size").alias("a_size"))).alias("_least")
    by_fp = table(classes.groupBy("_fp").agg(least).select("_fp", "_least.*"))
    edges = table(ball_links(by_fp.select("_fp"), by_fp.count()).withColumnsRenamed({"a": "_x", "b": "_y"}))
    left = edges.join(by_fp, edges["_x"] == by_fp["_fp"]).select("_y", "a", "a_size")
    near = left.join(by_fp.withColumnsRenamed({"a": "b", "a_size": "b_size"}), F.col("_y") == F.col("_fp"))
    return near.select("a", "a_size", "b", "b_size")


def text_digest(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _texts(batch):
    data, at = packed.texts(batch.column("_text"))
    data = data.tobytes()
    return (data[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _sign(batches):
    for batch in batches:
        kind, size, fp, keys, sketch = [], [], [], [], []
        for text in _texts(batch):
            h = shingles(text)
            fp.append(simhash(h))
            kind.append(xxhash.xxh128_digest(h.tobytes(), SEED))
            size.append(len(h))
            own, some = bands(h) if len(h) else (np.zeros(0, np.uint64), b"")
            own = np.r_[own, packed.mix(np.array(fp[-1:], np.int64).view(np.uint64) ^ _FACTORS[:1])] if len(h) else own
            keys.append(own.view(np.int64))
            sketch.append(some)
        yield pa.record_batch(
            [batch.column("_id"), batch.column("_digest"), pa.array(kind, pa.binary()), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
            ["_id", "_digest", "_class", "_size", "_fp", "_keys", "_sketch"],
        )


def _sets(batches):
    for batch in batches:
        for part in packed.slices(batch, "_text", 4_000_000):
            sets = [shingles(t).view(np.int64) for t in _texts(part)]
            yield pa.record_batch([part.column("_node"), pa.array(sets, pa.list_(pa.int64()))], ["_node", "_set"])


def _estimate(a, b):
    """Similarity by the share of equal bytes: unequal hashes agree in a byte once in 256."""
    return ((a == b).mean(1) * 256 - 1) / 255


def _sketches(column):
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _likely(batches):
    """Pairs whose sketches agree in a share of LOW or more."""
    for batch in batches:
        kept = np.flatnonzero(_estimate(_sketches(batch.column("_x")), _sketches(batch.column("_y"))) >= LOW)
        yield pa.record_batch([batch.column(c).take(pa.array(kept)) for c in ("a", "b")], ["a", "b"])


def _sets_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(_node, _set) of distinct nodes, built from their texts."""
    wanted = table(classes.join(nodes, "_node").select("_node", "_digest"))
    held = texts.join(wanted, "_digest").select("_node", "_text").dropDuplicates(["_node"])
    return table(packed.map_batches(held, _sets, "_node long, _set array<long>"))


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, and their sizes) whose sets are similar enough."""
    pairs = pairs.filter(F.least("a_size", "b_size") >= LEAST * F.greatest("a_size", "b_size") - 0.5).select("a", "b").distinct()
    sketches = classes.filter("_size > 0").select("_node", "_sketch")
    both = pairs.join(sketches.withColumnsRenamed({"_node": "a", "_sketch": "_x"}), "a").join(sketches.withColumnsRenamed({"_node": "b", "_sketch": "_y"}), "b")
    pairs = table(packed.map_batches(both.select("a", "b", "_x", "_y"), _likely, "a long, b long"))
    nodes = pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b").alias("_node"))).distinct()
    sets = _sets_of(nodes, classes, texts)
    left = sets.select(F.col("_node").alias("a"), F.col("_set").alias("_a"))
    right = sets.select(F.col("_node").alias("b"), F.col("_set").alias("_b"))
    both = table(pairs.join(right, "b")).join(left, "a")
    shared = both.select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("_n"), (F.size("_a") + F.size("_b")).alias("_all"))
    return table(shared.filter(F.col("_n") / (F.col("_all") - F.col("_n")) >= LEAST).select("a", "b"))


def _open_pairs(unit: pa.Table) -> pa.Table:
    """One row with the pairs of a unit that may link two groups: of both its blocks, sharing no
    earlier fingerprint, not far from similar; the likeliest first."""
    unit = unit.combine_chunks()
    key, low, high = (unit.column(c)[0].as_py() for c in ("_key", "_i", "_j"))
    node, root, size, block = (unit.column(c).to_numpy() for c in ("_node", "_root", "_size", "_block"))
    order = np.argsort(size, kind="stable")
    node, root, size, block = node[order], root[order], size[order], block[order]
    sketch = _sketches(unit.column("_sketch"))[order]
    keys = pc.list_flatten(unit.column("_keys")).to_numpy().reshape(len(node), -1)[order]
    keys = keys[:, : np.flatnonzero(keys[0] == key)[0]]
    upto = np.searchsorted(size, (size + 0.5) / LEAST, "right")
    got = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    for i in range(len(node)):
        j = np.arange(i + 1, upto[i])
        j = j[(root[j] != root[i]) & ((low == high) | (block[j] != block[i]))]
        about = _estimate(sketch[j], sketch[i])
        on = about >= LOW
        j, about = j[on], about[on]
        new = ~(keys[j] == keys[i]).any(1)
        got.append((np.full(new.sum(), i), j[new], about[new]))
    a, b, about = (np.concatenate(x) for x in zip(*got, strict=True))
    by = np.argsort(-about, kind="stable")
    a, b = a[by], b[by]
    some = {"_key": [key], "_i": [low], "_j": [high]} | {k: [x] for k, x in (("_a", node[a]), ("_b", node[b]), ("_ra", root[a]), ("_rb", root[b]))}
    return pa.table(some if len(a) else {k: [] for k in some}, schema=_OPEN)


_UNIT = "_key long, _i int, _j int"
_OPEN = pa.schema([("_key", pa.int64()), ("_i", pa.int32()), ("_j", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("_a", "_b", "_ra", "_rb")]])


def _join_groups(members: pa.Table, pairs: pa.Table) -> pa.Table:
    """The links among a unit's pairs that join its groups; pairs of groups joined before are passed over."""
    column = members.column("_set").combine_chunks()
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    sets = {n: np.sort(values[a:b]) for n, a, b in zip(members.column("_node").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
    above, found = {}, []

    def top(x):
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for row in pairs.to_batches():
        for of in zip(*(row.column(c).values.to_numpy().tolist() for c in ("_a", "_b", "_ra", "_rb")), strict=True):
            a, b, p, q = of[0], of[1], top(of[2]), top(of[3])
            if p == q:
                continue
            x, y = sets[a], sets[b]
            n = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
            if n / (len(x) + len(y) - n) >= LEAST:
                above[p] = q
                found.append((a, b))
    return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _rest(links: DataFrame, crowd: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the groups of ``links``, of all pairs that share a fingerprint of ``crowd``
    (_key, _node, _size: those of more than three classes)."""
    roots = connected_components(links)
    rooted = crowd.join(roots, crowd["_node"] == roots["node"], "left").select("_key", "_node", "_size", F.coalesce("root", "_node").alias("_root"))
    rooted = table(rooted)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("_size") / BLOCK_SHINGLES)).cast("int")
    several = rooted.groupBy("_key").agg(blocks.alias("_blocks"), F.min("_root").alias("_low"), F.max("_root").alias("_high")).filter("_low < _high")
    dealt = rooted.join(several.select("_key", "_blocks"), "_key").withColumn("_block", F.pmod(F.xxhash64("_node"), "_blocks").cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    units = table(dealt.select("_key", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "_block", "_node", "_root", "_size"))
    unit = ["_key", "_i", "_j"]
    told = units.join(classes.select("_node", "_keys", "_sketch"), "_node")
    pairs = table(told.groupBy(unit).applyInArrow(_open_pairs, _UNIT + ", _a array<long>, _b array<long>, _ra array<long>, _rb array<long>"))
    members = pairs.select(*unit, F.explode(F.array_union("_a", "_b")).alias("_node"))
    sets = _sets_of(members.select("_node").distinct(), classes, texts)
    held = members.join(sets, "_node")
    return table(held.groupBy(unit).cogroup(pairs.toDF(*pairs.columns).groupBy(unit)).applyInArrow(_join_groups, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of texts that links join: the id and text_sha256 of the row that stays.

    Two texts link if their sets of five-word shingles have Jaccard similarity 0.8 or more. Words
    are what ASCII white space separates, A-Z lower-cased; texts with fewer words have one
    shingle, and those without words (null included) are one group. The row with the smallest id
    stays, a null id after all others; among rows of that id the one with the smallest digest.
    Rows are told apart by id and text, so repeated and null ids with different texts are judged
    apart. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(text_digest(F.col(text_col)).alias("_digest"), F.col(text_col).alias("_text"))
    rows = docs.select(F.col(id_col).alias("_id"), text_digest(F.col(text_col)).alias("_digest"), F.col(text_col).alias("_text"))
    of = table(packed.map_batches(rows, _sign, f"_id {kind}, _digest string, _class binary, _size long, _fp long, _keys array<long>, _sketch binary"))
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_digest")).alias("_first")
    found = of.groupBy("_class").agg(first, F.min("_digest").alias("_digest"), F.first("_size").alias("_size"), F.first("_fp").alias("_fp"), F.first("_keys").alias("_keys"), F.first("_sketch").alias("_sketch"))
    classes = table(found.withColumn("_node", F.monotonically_increasing_id()))

    keyed = classes.select("_node", "_size", F.explode("_keys").alias("_key"))
    place = F.struct(F.xxhash64("_node", "_key").alias("at"), F.col("_node").alias("a"), F.col("_size").alias("a_size"))
    met = keyed.groupBy("_key").agg(F.min(place).alias("_low"), F.max(place).alias("_high"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = table(met.select("_key", F.array("_low", "_high").alias("_heads"), "_n"))
    members = keyed.withColumnsRenamed({"_node": "b", "_size": "b_size"}).join(met, "_key").select("b", "b_size", F.explode("_heads").alias("_head"))
    stars = members.select("_head.a", "_head.a_size", "b", "b_size").filter("a <> b")
    turned = [F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("a_size")).otherwise(F.col("b_size")).alias("a_size")]
    turned += [F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("b_size")).otherwise(F.col("a_size")).alias("b_size")]
    links = _linked(stars.union(_met_by_simhash(classes)).select(turned), classes, texts)
    crowd = table(keyed.join(met.filter("_n > 3").select("_key"), "_key").select("_key", "_node", "_size"))
    if not crowd.isEmpty():
        links = links.union(_rest(links, crowd, classes, texts))

    roots = connected_components(links)
    named = classes.join(roots, classes["_node"] == roots["node"], "left").select("_first", F.coalesce("root", "_node").alias("_root"))
    stay = named.groupBy("_root").agg(F.min("_first").alias("_first"))
    return stay.select(F.col("_first._id").alias(id_col), F.col("_first._digest").alias("text_sha256"))
