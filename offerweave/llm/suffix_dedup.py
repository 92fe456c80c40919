"""Substring dedup over bytes with a run-length index of the repetitive part of a corpus.

1. Documents are dealt into chunks. A chunk names the minimiser of every ``window`` bytes by a
   hash; buckets of hashes tell which occur in more than one document. Only text around these can
   repeat, and only it goes on.
2. Stretches of windows that share such a minimiser are sent to its bucket, identical ones of a
   chunk once. The bucket builds a run-compressed Burrows-Wheeler transform of the distinct
   stretches with samples at the run ends, streams the stretches through it, which gives how far
   each place matches another (matching statistics), and marks the matches of a window or more
   whose interval of suffixes holds an earlier document.
3. Marks go back to the chunks, where the marked bytes are taken out.

Texts travel compressed, by chunk, through one exchange that three steps read. A passage that very many documents share doesn't load a bucket:
a chunk sends each stretch of it once, and stretches at its edges go by minimisers of what
surrounds it, since frequent ones (of a bounded sample) are ranked last; that list only chooses
buckets, no result depends on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.llm import packed
from offerweave.llm.run_length_index import RunLengthIndex
from offerweave.llm.substring_dedup import by_document, docs_table, gather_texts, later, marks_of, runs_of, sliding_min

K = 20
SLICE, CHUNK, BUCKET = 1_000_000, 6_000_000, 4_000_000
#: Bytes of stretches that are indexed at once; a bucket that holds more is cut by minimiser.
INDEX = 2_000_000
#: Minimisers to a bucket of hashes; bits beyond those that number all places.
VALUES, SPARE_BITS = 1_000_000, 14
#: A hash is common if its share of the sample is at least this; bytes of that sample.
COMMON, SAMPLE = 1 / 65536, 32_000_000

_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_LATE = np.uint64(1 << 63)


def load(text: bytes, offset: int, n: int) -> np.ndarray:
    """The eight bytes from each of n positions."""
    return np.ndarray((n,), "<u8", text, offset, (1,))


class Common:
    """Membership in a short sorted list, with a small table that settles most look-ups."""

    def __init__(self, values: np.ndarray):
        self.values, self.table = values, np.zeros(1 << 20, bool)
        self.table[values >> np.uint64(43)] = True

    def __reduce__(self):
        return Common, (self.values,)

    def rank(self, x: np.ndarray) -> np.ndarray:
        """63-bit hashes, those of the list above all others."""
        if len(self.values):
            at = np.flatnonzero(self.table[x >> np.uint64(43)])
            y = x[at]
            found = np.searchsorted(self.values, y)
            found[found == len(self.values)] = 0
            x[at[self.values[found] == y]] |= _LATE
        return x


def hashes(text: bytes, n: int) -> np.ndarray:
    """63-bit hashes of the K bytes from each of n positions."""
    h = load(text, 0, n) * _MULTIPLY[0]
    h += load(text, 8, n) * _MULTIPLY[1]
    h += load(text, K - 8, n) * _MULTIPLY[2]
    return packed.mix(h) >> np.uint64(1)


class Slice:
    """Windows of some documents and the hash of each one's minimiser."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int, common: Common):
        self.text = data.tobytes() + b"\0" * 64
        n = max(0, len(data) - window + 1)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
        self.valid = np.arange(n) + window <= at[1:][self.doc]
        self.least = sliding_min(common.rank(hashes(self.text, len(data) - K + 1)), window - K + 1) if n else np.zeros(0, np.uint64)


def _parts(at: np.ndarray, window: int, size: int = SLICE):
    """(first byte, end, bounds, first document) of parts of about ``size`` bytes: whole documents, or
    stretches of a long one that overlap by all but a byte of a window, so that each window is in
    one part."""
    for i, j in _slices(at, size):
        if at[j] - at[i] <= 2 * size:
            yield int(at[i]), int(at[j]), at[i : j + 1] - at[i], i
            continue
        for a in range(int(at[i]), int(at[j]) - window + 1, size):
            b = min(a + size + window - 1, int(at[j]))
            yield a, b, np.array([0, b - a]), i


def _slices(at: np.ndarray, size: int = SLICE):
    """Runs (first, end) of documents with about SLICE bytes."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def _values(least: np.ndarray, bits: int) -> np.ndarray:
    return packed.mix(least) >> np.uint64(64 - bits)


def _common(rows: DataFrame, total: int) -> Common:
    none = Common(np.zeros(0, np.uint64))

    def run(batches):
        for batch in batches:
            for part in packed.slices(batch, "_text", 4 * SLICE):
                data, _ = packed.texts(part.column("_text"))
                n = len(data) - K + 1
                if n <= 0:
                    continue
                value, count = np.unique(hashes(data.tobytes() + b"\0" * 64, n), return_counts=True)
                often = count >= max(8, COMMON / 4 * n)
                yield pa.record_batch([pa.array(value[often].view(np.int64)), pa.array(count[often])], ["v", "n"])
                yield pa.record_batch([pa.array([-1], pa.int64()), pa.array([n])], ["v", "n"])

    some = rows.sample(fraction=min(1.0, SAMPLE / total), seed=7)
    counts = packed.map_batches(some, run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.col("v") == -1, F.col("n").desc(), "v").limit(int(1 / COMMON)).collect()
    whole = counts.filter("v = -1").first()
    if whole is None:
        return none
    return Common(np.sort(np.array([r.v for r in found if r.v != -1 and r.n >= COMMON * whole.n], np.int64).view(np.uint64)))


def _chunk(batches):
    """(ident, null, key, at, data, other blobs) of a chunk."""
    docs, rest = [], []
    for blob in packed.blobs(batches):
        x = packed.unpack(blob)
        (docs if len(x) >= 5 else rest).append(x)
    if not docs:
        if rest:
            raise RuntimeError("answers without the texts of their chunk")
        return None
    ident, null, key, size, data = (np.concatenate(x) for x in zip(*docs, strict=True))
    return ident, null, key, np.r_[0, np.cumsum(size)], data, rest


def _number(key: np.ndarray, chunks: int) -> int:
    """The chunk of documents with these keys, none of them empty."""
    return int(packed.deal(packed.mix(key[:1].view(np.uint64)), chunks)[0])


def _minimisers(ident, at, data, window, bits, common):
    """Sorted distinct values of a chunk and whether each occurs in two documents of it."""
    found, owners = [], []
    for a, b, bounds, i in _parts(at, window):
        s = Slice(data[a:b], bounds, window, common)
        first, _ = runs_of(s.valid, s.doc, s.least)
        found.append(_values(s.least[first], bits))
        owners.append(ident[i + s.doc[first]])
    value, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    new = np.r_[True, value[1:] != value[:-1]] if len(value) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    if not len(first):
        return value, new
    return value[first], np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)


def _bucket_bounds(value: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket of hashes begins in sorted values: buckets are even ranges."""
    edges = np.array([-(-(b << bits) // buckets) for b in range(buckets)], np.uint64)
    return np.r_[np.searchsorted(value, edges), len(value)]


def _ask(window: int, bits: int, buckets: int, chunks: int, common: Common):
    def run(batches):
        if (found := _chunk(batches)) is None:
            return
        ident, _, key, at, data, _ = found
        if not len(data):
            return
        value, multi = _minimisers(ident, at, data, window, bits, common)
        me = _number(key[np.diff(at) > 0], chunks)
        bounds = _bucket_bounds(value, buckets, bits)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            v = value[bounds[b] : bounds[b + 1]]
            planes = np.diff(v, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
            yield b, packed.pack(np.array([me, b], np.int64), np.packbits(multi[bounds[b] : bounds[b + 1]]), *planes[: -(-bits // 8)])

    return run


def _answer(batches):
    """In a bucket of hashes: which of each chunk's values occur in two documents."""
    who, values, multi = [], [], []
    for blob in packed.blobs(batches):
        (chunk, b), flags, *planes = packed.unpack(blob)
        step = np.zeros((len(planes[0]), 8), np.uint8)
        step[:, : len(planes)] = np.stack(planes, 1)
        who.append((int(chunk), int(b)))
        values.append(np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64))
        multi.append(np.unpackbits(flags, count=len(step)).astype(bool))
    if not who:
        return
    whole = np.concatenate(values)
    order = np.argsort(whole)
    v = whole[order]
    same = v[1:] == v[:-1]
    met = np.r_[same, False] | np.r_[False, same]  # values of a chunk are distinct: two chunks
    shared = np.empty(len(v), bool)
    shared[order] = met
    at = 0
    for (chunk, b), own in zip(who, multi, strict=True):
        yield chunk, packed.pack(np.array([b], np.int64), np.packbits(shared[at : at + len(own)] | own))
        at += len(own)


def _stretches(window: int, bits: int, hash_buckets: int, buckets: int, chunks: int, common: Common):
    """Stretches around shared minimisers to their buckets; identical ones of a chunk go once."""

    def run(batches):
        if (found := _chunk(batches)) is None:
            return
        ident, _, key, at, data, rest = found
        if not len(data):
            return
        me = _number(key[np.diff(at) > 0], chunks)
        got = []
        for a, b, bounds, i in _parts(at, window):
            s = Slice(data[a:b], bounds, window, common)
            first, count = runs_of(s.valid, s.doc, s.least, most=window - K + 1)
            got.append((first + a, count, _values(s.least[first], bits), i + s.doc[first]))
        first, count, v, doc = (np.concatenate(x) for x in zip(*got, strict=True))
        del got, s
        value = np.unique(v)  # those that the chunk asked about
        bounds = _bucket_bounds(value, hash_buckets, bits)
        shared = np.zeros(len(value), bool)
        if len(rest) != np.count_nonzero(np.diff(bounds)):
            raise RuntimeError("a chunk lacks answers of buckets that it asked")
        for (b,), flags in rest:
            n = bounds[b + 1] - bounds[b]
            shared[bounds[b] : bounds[b + 1]] = np.unpackbits(flags, count=n).astype(bool)
        value = value[shared]
        place = np.searchsorted(value, v)
        place[place == len(value)] = 0
        on = value[place] == v if len(value) else np.zeros(len(v), bool)
        first, count, v, doc = first[on], count[on], v[on], doc[on]
        if not len(first):
            return
        # equal stretches: by hash, then byte by byte
        text = data.tobytes() + b"\0" * 64
        whole = load(text, 0, len(data) + 56)
        last = first + count - 1
        h = count.astype(np.uint64)
        for k, a in enumerate([*range(0, window - 8, 8), window - 8]):
            h = packed.mix(h + whole[first + a] * _MULTIPLY[k % 7] + whole[last + a] * _MULTIPLY[(k + 3) % 7])
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        alike = count[a] == count[b]
        for k in [*range(0, window - 8, 8), window - 8]:
            alike &= (whole[first[a] + k] == whole[first[b] + k]) & (whole[last[a] + k] == whole[last[b] + k])
        same[same] = alike  # a stretch has at most 2 * window bytes: its first and last window cover it
        group = np.cumsum(np.r_[True, ~same]) - 1
        gone = np.empty(len(first), bool)
        gone[order] = later(group, ident[doc[order]], np.zeros(len(first), np.int64))
        start = first - at[doc]
        i = np.flatnonzero(gone)
        for _, blob in marks_of(ident[doc[i]], key[doc[i]], start[i], count[i], 1):
            yield me % buckets, packed.pack(np.array([me], np.int32), blob)
        keep = np.flatnonzero(~gone)
        for p, i in packed.by_part(packed.deal(packed.mix(v[keep]), buckets), buckets):
            i = keep[i]
            size = count[i] + window - 1
            own = b"".join([text[x:y] for x, y in zip(first[i].tolist(), (first[i] + size).tolist(), strict=True)])
            yield p, packed.pack(ident[doc[i]], key[doc[i]], start[i].astype(np.int32), packed.narrow(size), own)

    return run


def match(data: np.ndarray, size: np.ndarray, ident: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, offset, count) of the runs of windows that occur in a document with a smaller
    ident, among stretches that follow each other in ``data``."""
    at = np.r_[0, np.cumsum(size)]
    raw = data.tobytes()
    number, distinct = {}, []
    which = np.empty(len(size), np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        s = raw[a:b]
        if (n := number.get(s)) is None:
            n = number[s] = len(distinct)
            distinct.append(i)
        which[i] = n
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ident)
    heads = np.array(distinct)
    own = np.concatenate([data[a:b] for a, b in zip(at[heads].tolist(), at[heads + 1].tolist(), strict=True)])
    del number, distinct, raw, data
    index = RunLengthIndex(own, np.r_[0, np.cumsum(size[heads])], least, window)
    string, offset, owner = index.repeats()
    hit = owner < least[string]
    string, offset = string[hit], offset[hit].astype(np.int64)
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.r_[True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(string) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    string, offset, count = string[first], offset[first], np.diff(np.r_[first, len(string)])
    # a stretch whose string a smaller document has is marked whole, others as their string is
    whole = np.flatnonzero(ident > least[which])
    part = np.flatnonzero(ident == least[which])
    low, high = np.searchsorted(string, which[part]), np.searchsorted(string, which[part], "right")
    times = high - low
    run = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    return (
        np.r_[whole, np.repeat(part, times)],
        np.r_[np.zeros(len(whole), np.int64), offset[run]],
        np.r_[size[whole].astype(np.int64) - window + 1, count[run]],
    )


def groups_of(data: np.ndarray, size: np.ndarray, window: int, common: Common, most: int):
    """Runs of positions of stretches, each of about ``most`` bytes, or one minimiser's if these are
    more: stretches of different minimisers share no window."""
    if len(data) <= most:
        yield np.arange(len(size))
        return
    at = np.r_[0, np.cumsum(size)]
    least = np.empty(len(size), np.uint64)
    for i, j in _slices(at):
        least[i:j] = Slice(data[at[i] : at[j]], at[i : j + 1] - at[i], window, common).least[at[i:j] - at[i]]
    order = np.argsort(least)
    least, ends = least[order], np.cumsum(size[order])
    edges = np.flatnonzero(np.r_[True, least[1:] != least[:-1], True])  # of minimisers
    upto = np.r_[0, ends][edges]
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
        yield np.sort(order[edges[i] : edges[j]])
        i = j


def _index(window: int, chunks: int, common: Common, most: int):
    def run(batches):
        got = []
        for blob in packed.blobs(batches):
            x = packed.unpack(blob)
            if len(x) == 2:  # settled before
                yield int(x[0][0]), x[1].tobytes()
            else:
                got.append(x)
        if not got:
            return
        ident, key, start, size, data = (np.concatenate(x) for x in zip(*got, strict=True))
        del got, x
        size = size.astype(np.int64)
        at = np.r_[0, np.cumsum(size)]
        found = []
        for some in groups_of(data, size, window, common, most):
            if len(some) == len(size):
                own = data
            else:
                own = np.concatenate([data[a:b] for a, b in zip(at[some].tolist(), at[some + 1].tolist(), strict=True)])
            i, offset, count = match(own, size[some], ident[some], window)
            found.append((some[i], (start[some[i]] + offset).astype(np.int32), count.astype(np.int32)))
        del data
        i, begin, count = (np.concatenate(x) for x in zip(*found, strict=True))
        yield from marks_of(ident[i], key[i], begin, count, chunks)

    return run


def _apply(window: int):
    def run(batches):
        if (found := by_document(batches)) is None:
            return
        ident, null, at, data, doc, start, count, _ = found
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, at[doc] + start, 1)
        np.add.at(change, at[doc] + start + count + window - 1, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        del change
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        edges = at[:-1][at[:-1] < at[1:]]
        first[edges] = gone[edges]
        removed, spans = (np.r_[0, np.cumsum(x, dtype=np.int32)][at].astype(np.int64) for x in (gone, first))
        kept = data[~gone]
        del data, gone, first
        to = at - removed
        for i, j in _slices(to):
            own = slice(i, j)
            text = kept[to[i] : to[j]]
            offsets = pa.py_buffer((to[i : j + 1] - to[i]).astype(np.int32))
            yield pa.record_batch(
                [
                    pa.array(ident[own], mask=(null[own] & 1).astype(bool)),
                    pa.array(np.diff(at)[own]),
                    pa.array(np.diff(removed)[own]),
                    pa.array(np.diff(spans)[own]),
                    pa.Array.from_buffers(pa.binary(), j - i, [None, offsets, pa.py_buffer(np.ascontiguousarray(text))]),
                ],
                ["_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (remaining bytes, binary).

    A byte of a text (UTF-8) goes if a ``window``-byte string over it also starts in a document
    with a smaller id. Null text is empty; texts shorter than the window keep all. Rows of one id
    never remove each other's bytes, repeated rows are treated alike. A null id counts as larger
    than any other. Other columns are ignored. An empty table gives no rows. ``window`` is at
    least 28.
    """
    rows = docs_table(docs, id_col, text_col)
    total = packed.total_bytes(docs, text_col)
    out = "_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    chunks = max(1, -(-total // CHUNK))
    places = max(1, total * 2 // (window - K + 2))
    bits = min(63, places.bit_length() + SPARE_BITS)
    hash_buckets, buckets = max(1, -(-places // VALUES)), max(1, -(-total * 4 // BUCKET))
    common = _common(rows, total) if total else Common(np.zeros(0, np.uint64))
    texts = packed.share(packed.map_rows(rows, gather_texts(chunks)), chunks)
    asked = packed.map_rows(packed.ordered(texts, chunks), packed.by_bucket(_ask(window, bits, hash_buckets, chunks, common), chunks))
    answers = packed.map_rows(packed.send(asked, hash_buckets), packed.by_bucket(_answer, hash_buckets))
    both = packed.together(packed.share(answers, chunks), texts, chunks)
    sent = packed.map_rows(both, packed.by_bucket(_stretches(window, bits, hash_buckets, buckets, chunks, common), chunks))
    marks = packed.map_rows(packed.send(sent, buckets), packed.by_bucket(_index(window, chunks, common, INDEX), buckets))
    both = packed.together(packed.share(marks, chunks), texts, chunks)
    return packed.map_batches(both, packed.by_bucket(_apply(window), chunks), out).withColumnRenamed("_id", id_col)
