"""Packing token ids into sequences by first-fit decreasing with a tournament tree.

Documents are dealt at random into groups of bounded size and each group is packed on its own.
Documents longer than a sequence fill whole sequences; what remains of each is an item. Items go,
largest first, into the first bin that has room, which a tournament tree of bin capacities finds
in a logarithmic number of steps. Cuts are free, so the least filled bins are then cut to fill the
others, and the last bin of a group is laid out in sequences whose lengths are powers of two:
these need no padding.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.llm import packed

#: Bytes of text to a group.
GROUP = 12_000_000
SLICE = 4_000_000

#: How the byte-level pre-tokenizer splits a text, and the byte that each of its characters stands
#: for: printable bytes are themselves, the others follow from U+0100 on. Fixed values.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


#: Runs of so many white space characters are left to tokenizers.
SPACES = 50_000
_LONG_SPACE = re.compile(r"\s{%d}" % SPACES)


class Tournament:
    """First bin with room for an item: a complete binary tree whose inner nodes hold the largest
    free capacity below them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        found = at - self.leaves
        free[at] -= size
        at //= 2
        while at:
            most = free[2 * at] if free[2 * at] >= free[2 * at + 1] else free[2 * at + 1]
            if free[at] == most:
                break
            free[at] = most
            at //= 2
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions; every size is at most ``capacity``."""
    tree, bins = Tournament(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.place(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack_group(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a group of documents with these
    numbers of tokens."""
    pieces, seq = [], 0
    rest, start = [], []
    for d, n in enumerate(lengths):
        for at in range(0, n - capacity + 1, capacity):
            pieces.append((d, at, capacity, seq, 0))
            seq += 1
        if n % capacity:
            rest.append(n % capacity)
            start.append((d, n - n % capacity))
    bins = [[(*start[i], rest[i]) for i in b] for b in first_fit_decreasing(rest, capacity)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    room = [capacity - sum(p[2] for p in b) for b in bins]
    low, high = 0, len(bins) - 1
    while low < high:  # the least filled bin is cut to fill the others
        if not room[low]:
            low += 1
        elif not bins[high]:
            high -= 1
        else:
            d, at, n = bins[high].pop()
            take = min(n, room[low])
            bins[low].append((d, at, take))
            room[low] -= take
            room[high] += take
            if take < n:
                bins[high].append((d, at + take, n - take))
    for b in bins:
        total = sum(p[2] for p in b)
        sizes = [total] if total == capacity else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        b = b[::-1]
        for size in sizes:
            at = 0
            while at < size:
                d, begin, n = b.pop()
                take = min(n, size - at)
                pieces.append((d, begin, take, seq, at))
                at += take
                if take < n:
                    b.append((d, begin + take, n - take))
            seq += 1
    return pieces


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a plain byte-level BPE file by bytes; empty if ids don't rank its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return {}
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return {}
    char = {chr(b): b for b in PRINTABLE}
    char |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
    added = {t["content"] for t in spec["added_tokens"]}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(set(ids)) or any(c not in model["vocab"] for c in char):
        return {}
    return {bytes(char[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added}


class Encoder:
    """Ids of whole texts as a tokenizers file gives them. A plain byte-level vocabulary is run by
    tiktoken, several times faster; texts that hold an added token or a very long run of white
    space are left to tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if found := ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=found, special_tokens={})

    def encode_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        """Whether the fast way can take a text: no added token, and no run of white space so long
        that its look-ahead would exhaust the stack."""
        return not (self.added and self.added.search(text)) and (len(text) < SPACES or not _LONG_SPACE.search(text))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [np.array(x, np.uint32) for x in self.encode_ids(texts)]
        return [np.array(self.fast.encode_ordinary(t) if self._plain(t) else self.encode_ids([t])[0], np.uint32) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pack(path: str, capacity: int, end: int):
    def run(batches):
        encode = encoder(path)
        groups, ident, null, ids, sizes = [], [], [], [], []
        for batch in batches:
            for part in packed.slices(batch, "_text", SLICE):
                found = encode(part.column("_text").fill_null("").to_pylist())
                a, b = packed.ids(part.column("_id"))
                ident.append(a)
                null.append(b)
                ids.append(np.concatenate(found))
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
                groups.append(np.asarray(part.column("_group"), np.int64))
        if not ids:
            return
        groups, ident, null, ids, sizes = (np.concatenate(x) for x in (groups, ident, null, ids, sizes))
        first = np.r_[0, np.cumsum(sizes)]
        for g in np.unique(groups):
            docs = np.flatnonzero(groups == g)
            docs = docs[np.lexsort((first[docs], ident[docs]))]
            of, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pack_group((sizes[docs] + 1).tolist(), capacity), strict=True))
            doc = docs[of]
            crc = []
            for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                piece = ids[first[d] + s : min(first[d] + s + n, first[d + 1])]
                value = zlib.crc32(piece.astype("<u4").tobytes())
                crc.append(zlib.crc32(np.array([end], "<u4").tobytes(), value) if len(piece) < n else value)
            yield pa.record_batch(
                [pa.array(ident[doc], mask=null[doc]), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc] + 1), pa.array((int(g) << 32) + seq), pa.array(offset)],
                ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 1) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level tokenizers file that every executor has. Each
    document's ids are followed by ``end``; null text counts as empty, so such a document is one
    token. Every row is packed, repeated ones and those with a null id too. ``capacity`` must be a
    power of two. sequence_id is unique over the table. An empty table gives no rows. Other
    columns are ignored.
    """
    total = packed.total_bytes(docs, text_col)
    groups = max(1, -(-total // GROUP))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_id", "_text"), F.lit(groups)).cast("int"))
    out = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return packed.map_batches(rows.repartitionById(groups, F.col("_group")), _pack(tokenizer, capacity, end), out).withColumnRenamed("_id", id_col)
