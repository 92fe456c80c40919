"""Substring dedup over word windows by super-k-mer partitioning.

Every window of ``window`` words is assigned to its minimiser, the least hash among its runs of
``K`` words. Consecutive windows that share a minimiser travel as one packed string (a
super-k-mer) to the minimiser's bucket, where windows are sorted and equal ones compared word by
word: all but those at the smallest (doc_id, start) are removed.

Three things keep a passage that very many documents share from loading one bucket:

* within a slice of a partition, a window that occurs earlier in the slice is settled there and
  doesn't travel;
* runs of K words that are frequent in a bounded sample are ranked behind all others, so that a
  window at the edge of a common passage goes by what surrounds the passage. The list (at most
  1 / COMMON entries) only chooses buckets; no result depends on it;
* a super-k-mer carries at most as many windows as one minimiser position can serve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.llm import packed, words

K = 3
#: Bytes of text that are worked on at once, that a bucket and a chunk of documents get, and that
#: a mapper gathers before it sends.
SLICE, BUCKET, CHUNK, HELD = 2_000_000, 2_500_000, 8_000_000, 12_000_000
#: A run of K words is common if its share of the sample is at least this; bytes of that sample.
COMMON, SAMPLE = 1 / 8192, 32_000_000

_B = 0x9E3779B97F4A7C15
_LATE = np.uint64(1 << 63)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 1 << 64))


def join(a: np.ndarray, b: np.ndarray, size_b: int) -> np.ndarray:
    """Hashes of adjacent sequences to those of both together."""
    return a * _power(size_b) + b


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i <= len(h) - n."""
    sizes, out, got = h, None, 0
    step = 1
    while step <= n:
        if n & step:
            if out is None:
                out, got = sizes, step
            else:  # the part of ``step`` words goes before what is there
                m = len(h) - got - step + 1
                out = join(sizes[:m], out[step : step + m], got)
                got += step
        if 2 * step <= n:
            m = len(sizes) - step
            sizes = join(sizes[:m], sizes[step : step + m], step)
        step *= 2
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of x[i:i+n] for each i <= len(x) - n."""
    size, out = 1, x
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def rank(runs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Scrambled hashes, those of common runs above all others."""
    x = packed.mix(runs) >> np.uint64(1)
    if len(common):
        at = np.searchsorted(common, x)
        at[at == len(common)] = 0
        x = np.where(common[at] == x, x | _LATE, x)
    return x


def equal_groups(codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``starts``, group of each) of windows that equal another, word by word."""
    order = np.argsort(hashes)
    h = hashes[order]
    same = h[1:] == h[:-1]
    met = np.r_[same, False] | np.r_[False, same] if len(h) else np.zeros(0, bool)
    order, h = order[met], h[met]
    if not len(order):
        return order, order
    new = np.r_[True, h[1:] != h[:-1]]
    at = starts[order]
    pair = ~new[1:]
    alike = np.ones(pair.sum(), bool)
    a, b = at[:-1][pair], at[1:][pair]
    for j in range(n):
        alike &= codes[a + j] == codes[b + j]
    if alike.all():
        return order, np.cumsum(new) - 1
    group = np.unique(codes[at[:, None] + np.arange(n)], axis=0, return_inverse=True)[1].ravel()
    by = np.argsort(group, kind="stable")
    return order[by], group[by]


def later(group: np.ndarray, ident: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which members of the groups (adjacent ones) are not at the smallest (ident, start)."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.lexsort((start, ident, group))
    g = group[order]
    new = np.r_[True, g[1:] != g[:-1]]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(group), bool)
    out[order] = (ident[order] != ident[head]) | (start[order] != start[head])
    return out


def runs_of(keep: np.ndarray, *same: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of runs of consecutive True positions over which each of ``same`` is even;
    ``most`` splits longer ones."""
    at = np.flatnonzero(keep)
    if not len(at):
        return at, at
    new = np.r_[True, at[1:] != at[:-1] + 1]
    for x in same:
        y = x[at]
        new[1:] |= y[1:] != y[:-1]
    if most:
        index = np.arange(len(at))
        new |= (index - np.maximum.accumulate(np.where(new, index, 0))) % most == 0
    first = np.flatnonzero(new)
    return at[first], np.diff(np.r_[first, len(at)])


class Slice:
    """Words and windows of some documents."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.data, at = packed.texts(batch.column("_text"))
        self.ident, _ = packed.ids(batch.column("_id"))
        self.key = np.asarray(batch.column("_key"), np.int64)
        self.starts, self.ends, first = words.spans(self.data, at)
        self.codes, distinct = words.codes(self.data, self.starts, self.ends)
        self.h = words.hashes(distinct)[self.codes] if distinct else np.zeros(0, np.uint64)
        self.first, self.window = first, window
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        left = first[1:][self.doc] - np.arange(len(self.doc))
        self.valid = (left >= window)[: max(0, len(self.doc) - window + 1)]


def docs_table(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """_id, _text and _key, which tells rows of one id with other texts apart, and the columns to
    keep, by number."""
    return docs.select(
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)],
        F.col(id_col).cast("long").alias("_id"),
        F.col(text_col).alias("_text"),
        F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).alias("_key"),
    )


def _common(docs: DataFrame, total: int) -> np.ndarray:
    def run(batches):
        for batch in batches:
            for part in packed.slices(batch, "_text", SLICE):
                s = Slice(part, K)
                if not s.valid.any():
                    continue
                x = rank(window_hashes(s.h, K)[s.valid], np.zeros(0, np.uint64))
                value, count = np.unique(x, return_counts=True)
                often = count >= max(8, COMMON / 4 * len(x))
                yield pa.record_batch([pa.array(value[often].view(np.int64)), pa.array(count[often])], ["v", "n"])
                yield pa.record_batch([pa.array([-1], pa.int64()), pa.array([len(x)])], ["v", "n"])

    some = docs.sample(fraction=min(1.0, SAMPLE / max(total, 1)), seed=7)
    counts = packed.map_batches(some, run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    most = int(1 / COMMON)
    found = counts.orderBy(F.col("v") == -1, F.col("n").desc(), "v").limit(most).collect()
    whole = counts.filter("v = -1").first()
    return np.sort(np.array([r.v for r in found if r.v != -1 and r.n >= COMMON * whole.n], np.int64).view(np.uint64))


def _scatter(window: int, buckets: int, chunks: int, common: np.ndarray):
    """Super-k-mers to buckets 0 .. and what is settled to any bucket, marked for its chunk."""

    def run(batches):
        held, size, spare = {}, 0, 0

        def flush():
            while held:
                p, parts = held.popitem()
                yield p, packed.pack(*(np.concatenate(x) if isinstance(x[0], np.ndarray) else b"".join(x) for x in zip(*parts, strict=True)))

        def work(part):  # a call of its own, so that nothing of a slice is left when the next one is read
            nonlocal size, spare
            s = Slice(part, window)
            if not s.valid.any():
                return
            at = np.flatnonzero(s.valid)
            start = np.arange(len(s.doc)) - s.first[s.doc]
            whole = window_hashes(s.h, window)
            met, group = equal_groups(s.codes, at, whole[at], window)
            where = at[met]
            del at, met, whole
            gone = np.zeros(len(s.valid), bool)
            gone[where[later(group, s.ident[s.doc[where]], start[where])]] = True
            del where, group
            first, count = runs_of(gone, s.doc[: len(gone)])
            d = s.doc[first]
            for c, blob in marks_of(s.ident[d], s.key[d], start[first], count, chunks):
                spare += 1
                yield spare % buckets, packed.pack(np.array([c], np.int32), blob)
            least = sliding_min(rank(window_hashes(s.h, K), common), window - K + 1)
            first, count = runs_of(s.valid & ~gone, s.doc[: len(gone)], least, most=window - K + 1)
            raw = s.data.tobytes()
            a, b = s.starts[first], s.ends[first + count + window - 2]
            for p, i in packed.by_part(packed.deal(packed.mix(least[first]), buckets), buckets):
                d = s.doc[first[i]]
                text = b"".join([raw[x:y] for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True)])
                held.setdefault(p, []).append(
                    (s.ident[d], s.key[d], start[first[i]].astype(np.int32), (b[i] - a[i]).astype(np.int32), np.frombuffer(text, np.uint8))
                )
                size += len(text)

        for batch in batches:
            for part in packed.slices(batch, "_text", SLICE):
                yield from work(part)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _count(window: int, chunks: int):
    """In a bucket: sort the windows, mark all but the first of equal ones."""

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
        del got
        at = np.r_[0, np.cumsum(size)]
        a, b, first = words.spans(data, at)
        codes, distinct = words.codes(data, a, b)
        h = words.hashes(distinct)[codes]
        run_of = np.repeat(np.arange(len(size)), np.diff(first))
        valid = (first[1:][run_of] - np.arange(len(run_of)) >= window)[: len(run_of) - window + 1]
        where = np.flatnonzero(valid)
        met, group = equal_groups(codes, where, window_hashes(h, window)[where], window)
        where = where[met]
        r = run_of[where]
        begin = start[r] + (where - first[r])
        gone = np.zeros(len(valid), bool)
        gone[where[later(group, ident[r], begin)]] = True
        at, count = runs_of(gone, run_of[: len(gone)])
        r = run_of[at]
        yield from marks_of(ident[r], key[r], start[r] + (at - first[r]), count, chunks)

    return run


def marks_of(ident, key, begin, count, chunks: int):
    """Marks (first, count) to the chunks of their documents: the id and key of each document once,
    then how many marks it has, and these."""
    for c, j in packed.by_part(packed.deal(packed.mix(key.view(np.uint64)), chunks), chunks):
        j = j[np.lexsort((begin[j], ident[j], key[j]))]
        i, k = ident[j], key[j]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
        many = np.diff(np.r_[first, len(j)])
        yield c, packed.pack(np.r_[i[first], k[first]], packed.narrow(many), begin[j].astype(np.int32), packed.narrow(count[j]))


def gather_texts(chunks: int, keep: int = 0):
    """Documents to their chunks, compressed together with their first ``keep`` columns."""

    def run(batches):
        for batch in batches:
            for part in packed.slices(batch, "_text", 4 * SLICE):
                data, at = packed.texts(part.column("_text"))
                raw = data.tobytes()
                ident, null = packed.ids(part.column("_id"))
                null = null + 2 * np.asarray(part.column("_text").is_null()).astype(np.uint8)
                key = np.asarray(part.column("_key"), np.int64)
                to = packed.deal(packed.mix(key.view(np.uint64)), chunks)
                bare = np.flatnonzero(np.diff(at) == 0)  # nothing is marked there: any chunk will do
                to[bare] = (np.arange(len(bare)) + int(key[:1].view(np.uint64)[0] % np.uint64(chunks))) % chunks
                for c, i in packed.by_part(to, chunks):
                    text = b"".join([raw[x:y] for x, y in zip(at[i].tolist(), at[i + 1].tolist(), strict=True)])
                    rest = []
                    if keep:
                        own = part.select(list(range(keep))).take(pa.array(i))
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, own.schema) as writer:
                            writer.write_batch(own)
                        rest = [np.frombuffer(sink.getvalue(), np.uint8)]
                    yield c, packed.pack(ident[i], null[i], key[i], np.diff(at)[i], np.frombuffer(text, np.uint8), *rest)

    return run


def by_document(batches):
    """The texts of a chunk and what is marked in them: (ident, null, at, data, doc of each mark,
    start, count, kept columns). ``null`` has 1 for a null id and 2 for a null text. A mark counts
    for every row with its id and key."""
    docs, marks = [], []
    for blob in packed.blobs(batches):
        x = packed.unpack(blob)
        (docs if len(x) >= 5 else marks).append(x)
    if not docs:
        if marks:
            raise RuntimeError("marks without the texts of their chunk")
        return None
    ident, null, key, size, data = (np.concatenate(x) for x in list(zip(*docs, strict=True))[:5])
    kept = [pa.ipc.open_stream(pa.py_buffer(x[5])).read_all() for x in docs if len(x) > 5]
    kept = pa.concat_tables(kept).combine_chunks() if kept else None
    at = np.r_[0, np.cumsum(size)]
    del docs
    marks = [(*(np.repeat(x, many.astype(np.int64)) for x in np.split(name, 2)), start, count) for name, many, start, count in marks]
    who, k, start, count = (np.concatenate(x) for x in zip(*marks, strict=True)) if marks else (np.zeros(0, np.int64),) * 4
    order = np.argsort(key, kind="stable")
    low, high = np.searchsorted(key[order], k), np.searchsorted(key[order], k, "right")
    times = high - low
    mark = np.repeat(np.arange(len(k)), times)
    doc = order[np.repeat(low, times) + np.arange(len(mark)) - np.repeat(np.cumsum(times) - times, times)]
    own = ident[doc] == who[mark]  # keys are hashes: the id settles
    mark, doc = mark[own], doc[own]
    return ident, null, at, data, doc, start[mark].astype(np.int64), count[mark].astype(np.int64), kept


def _apply(window: int, whole: bool):
    def run(batches):
        from itertools import compress

        if (found := by_document(batches)) is None:
            return
        ident, null, at, data, doc, start, count, columns = found
        starts, ends, first = words.spans(data, at)
        change = np.zeros(len(starts) + 1, np.int32)
        np.add.at(change, first[doc] + start, 1)
        np.add.at(change, first[doc] + start + count + window - 1, -1)
        kept = np.cumsum(change[:-1]) == 0
        total = np.r_[0, np.cumsum(~kept)]
        n, gone = np.diff(first), total[first[1:]] - total[first[:-1]]
        raw = data.tobytes()
        out, rows, size = [], 0, 0
        for i in range(len(ident)):
            text = raw[at[i] : at[i + 1]]
            if whole and not gone[i]:
                out.append(None if null[i] & 2 else text)
            else:
                text = text.split()
                if gone[i]:
                    text = compress(text, kept[first[i] : first[i + 1]].tolist())
                out.append(b" ".join(text))
            size += len(out[-1] or b"")
            if size > SLICE or i + 1 == len(ident):
                own = slice(rows, i + 1)
                more = columns.slice(rows, i + 1 - rows).combine_chunks().to_batches()[0] if columns is not None else None
                yield pa.record_batch(
                    [
                        pa.array(ident[own], mask=(null[own] & 1).astype(bool)),
                        pa.array(n[own]),
                        pa.array(gone[own]),
                        pa.array(out, pa.binary()).cast(pa.string()),
                        *(more.columns if more else ()),
                    ],
                    ["_id", "n_words", "n_removed", "kept_text", *(more.schema.names if more else ())],
                )
                out, rows, size = [], i + 1, 0

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, keep: list[str] = (), whole: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (kept words joined by one space), and
    the columns of ``keep`` as they are.

    Words are what ASCII white space separates. A word goes if a window over it has the words of
    a window that starts earlier: in a smaller id, or in the same id at an earlier word. Null text
    has no words; texts shorter than a window keep all. With ``whole`` a text that loses nothing is
    kept as it is, its white space too, and null stays null. Repeated rows tie and are treated
    alike; rows of one id with other texts count as one document's occurrences. A null id sorts
    last. Columns not in ``keep`` are ignored. An empty table gives no rows.
    """
    keep = list(keep)
    rows = docs_table(docs, id_col, text_col, keep)
    total = packed.total_bytes(docs, text_col)
    buckets, chunks = max(1, -(-total // BUCKET)), max(1, -(-total // CHUNK))
    own = rows.select("_id", "_text", "_key")
    sent = packed.send(packed.map_rows(own, _scatter(window, buckets, chunks, _common(own, total) if total else np.zeros(0, np.uint64))), buckets)
    marks = packed.map_rows(sent, packed.by_bucket(_count(window, chunks), buckets))
    texts = packed.map_rows(rows, gather_texts(chunks, len(keep)))
    kinds = dict(docs.dtypes)
    out = ", ".join(["_id long, n_words long, n_removed long, kept_text string", *[f"_{i} {kinds[c]}" for i, c in enumerate(keep)]])
    found = packed.map_batches(packed.send(marks.unionByName(texts), chunks), packed.by_bucket(_apply(window, whole), chunks), out)
    return found.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_text", *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)])
