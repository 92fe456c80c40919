"""BPE encoding and decoding through a distinct-word table.

Each partition splits its texts into words, names each word by its position in the partition's
own list of distinct words, and asks the word's bucket for the ids. A bucket brings together what
all partitions ask, encodes each distinct word once and answers every request with a join on the
word. Documents are then assembled by position from the answers. Decoding joins the ids with the
piece of each id. Only words and positions travel, packed; texts don't.

Requests and places are two passes over the same rows, so that neither is written to disk but by
its shuffle. Both cut the same slices, as rows come in the same order (see in_order); a slice's tag
is a digest of its content, so an answer to another slice is never taken for its own.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.llm import packed, words
from offerweave.llm.packing import encoder
from offerweave.llm.shared import table

SLICE = 8_000_000
#: Bytes of distinct words to a bucket, and bytes of text to an assembling task.
BUCKET, CHUNK = 2_000_000, 24_000_000
ASK, PLACE = 0, 1
SUFFIX = "</w>"


def _split(kind: int, buckets: int, chunks: int):
    """Requests (distinct words to their buckets) or places (each document's words)."""

    def run(batches):
        for batch in batches:
            for some in packed.slices(batch, "_text", SLICE):
                data, at = packed.texts(some.column("_text"))
                ident, null = packed.ids(some.column("_id"))
                starts, ends, first = words.spans(data, at)
                code, distinct = words.codes(data, starts, ends)
                # slices with one tag are equal, and so are the answers they get
                tag = xxhash.xxh3_64_intdigest(data.tobytes(), xxhash.xxh3_64_intdigest(at.tobytes() + ident.tobytes())) >> 1
                to = int(packed.deal(packed.mix(np.array([tag], np.uint64)), chunks)[0])
                of = packed.deal(packed.mix(words.hashes(distinct)), buckets)
                often = np.bincount(code, minlength=len(distinct))
                order = np.lexsort((-often, of))
                bucket = of[order]
                number = np.empty(len(order), np.int64)
                number[order] = numbers(bucket)
                if kind == ASK:
                    for p, i in packed.by_part(bucket, buckets):
                        found = [distinct[j] for j in order[i].tolist()]
                        size = np.fromiter(map(len, found), np.int32, len(found))
                        yield p, packed.pack(np.array([tag, to, p], np.int64), packed.narrow(size), b"".join(found))
                else:
                    asked = np.unique(bucket)
                    planes = number[code].astype(np.uint32).view(np.uint8).reshape(-1, 4).T
                    yield to, packed.pack(np.array([tag], np.int64), ident, null, packed.narrow(np.diff(first)), asked, *planes)

    return run


def numbers(bucket: np.ndarray) -> np.ndarray:
    """Numbers of words that are ordered by bucket and, in a bucket, by falling frequency. Words
    of like rank in their buckets get numbers near each other, so frequent words get small ones."""
    first = np.searchsorted(bucket, bucket)
    out = np.empty(len(bucket), np.int64)
    out[np.lexsort((bucket, np.arange(len(bucket)) - first))] = np.arange(len(bucket))
    return out


def _encode(path: str):
    """In a bucket: each distinct word once, then every request answered."""

    def run(batches):
        tok = encoder(path)
        got = [packed.unpack(b) for b in packed.blobs(batches)]
        if not got:
            return
        size = np.concatenate([x[1].astype(np.int64) for x in got])
        data = np.concatenate([x[2] for x in got])
        offsets = pa.py_buffer(np.r_[0, np.cumsum(size)])
        column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        code, distinct = np.asarray(column.indices), column.dictionary.to_pylist()
        table = []
        for at in range(0, len(distinct), 10_000):
            table += tok.encode_ids([w.decode() for w in distinct[at : at + 10_000]])
        count = np.fromiter(map(len, table), np.int64, len(table))
        flat = np.fromiter(chain.from_iterable(table), np.uint32, int(count.sum()))
        begin = np.cumsum(count) - count
        at = 0
        for (tag, to, p), own, _ in got:
            c = code[at : at + len(own)]
            at += len(own)
            n = count[c]
            ids = flat[np.arange(n.sum()) + np.repeat(begin[c] - (np.cumsum(n) - n), n)]
            yield int(to), packed.pack(np.array([tag, p], np.int64), packed.narrow(n), packed.narrow(ids))

    return run


def pieces(path: str) -> pa.Array:
    """The piece of each id as decode() joins them: a piece is its own text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out = [""] * tok.get_vocab_size()
    for piece, i in tok.get_vocab().items():
        out[i] = piece
    return pa.array(out, pa.large_string())


def _joined(values: pa.Array, which: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values[which], joined by one space between one end and the next."""
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(which)))
    return pc.binary_join(lists, pa.scalar(" ", values.type))


def _assemble(path: str):
    def run(batches):
        piece = pieces(path)
        written = pa.array([str(i) for i in range(len(piece))], pa.large_string())
        places, answers = [], {}
        for blob in packed.blobs(batches):
            x = packed.unpack(blob)
            if len(x) == 9:
                places.append(x)
            else:
                answers[tuple(x[0].tolist())] = x[1:]
        for (tag,), ident, null, size, asked, *planes in places:
            own = [answers[int(tag), p] for p in asked.tolist()]
            count = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in own)]).astype(np.int64)
            flat = np.concatenate([np.zeros(0, np.uint32), *(x[1] for x in own)]).astype(np.int64)
            bucket = np.repeat(np.arange(len(own)), [len(x[0]) for x in own]) if own else np.zeros(0, np.int64)
            number = np.stack(planes, 1).view(np.uint32).ravel()
            at = np.empty(len(count), np.int64)
            at[numbers(bucket)] = np.arange(len(count))
            word = at[number]
            first = np.r_[0, np.cumsum(size.astype(np.int64))]
            n = np.r_[0, np.cumsum(count[word])]
            tokens = n[first[1:]] - n[first[:-1]]
            if (count == 0).any():  # a word that the normaliser leaves nothing of has no place
                stays = count[word] > 0
                first = np.r_[0, np.cumsum(stays)][first]
                word = word[stays]
            ends = np.r_[0, np.cumsum(count)]
            id_words, piece_words = _joined(written, flat, ends), _joined(piece, flat, ends)
            rows = 0
            while rows < len(ident):  # some 300,000 words at a time, whole documents
                to = max(rows + 1, int(np.searchsorted(first, first[rows] + 300_000, "right")) - 1)
                these, cut = word[first[rows] : first[to]], first[rows : to + 1] - first[rows]
                some = slice(rows, to)
                yield pa.record_batch(
                    [
                        pa.array(ident[some], mask=null[some].astype(bool)),
                        pa.array(tokens[some]),
                        _joined(id_words, these, cut).cast(pa.string()),
                        _joined(piece_words, these, cut).cast(pa.string()),
                    ],
                    ["_id", "n_tokens", "ids", "decoded"],
                )
                rows = to

    return run


def in_order(df: DataFrame) -> DataFrame:
    """``df`` such that reading it twice gives the same rows in the same order: filters and columns
    over files do, if they are deterministic; everything else is written first."""
    nodes, plan = [df._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        plan.append(node)
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    plain = all(n.nodeName().split()[0] in ("Project", "Filter", "Relation", "LogicalRelation", "LocalRelation") and n.deterministic() for n in plan)
    return df if plain else table(df)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (decimal, joined by one space), decoded.

    ``tokenizer`` is the path of a tokenizers file that every executor has: one that drops white
    space, so that words are encoded alone, and has no decoder, so that pieces are joined by one
    space. Null text counts as empty: no ids. Added tokens in a text are encoded as such. Every
    row is encoded, repeated ones and those with a null id too. An empty table gives no rows.
    Other columns are ignored.
    """
    total = packed.total_bytes(docs, text_col)
    buckets, chunks = max(1, -(-total // (8 * BUCKET))), max(1, -(-total // CHUNK))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = in_order(rows)
    asked = packed.send(packed.map_rows(rows, _split(ASK, buckets, chunks)), buckets)
    answers = packed.map_rows(asked, packed.by_bucket(_encode(tokenizer), buckets))
    places = packed.map_rows(rows, _split(PLACE, buckets, chunks))
    found = packed.send(answers.unionByName(places), chunks)
    return packed.map_batches(found, packed.by_bucket(_assemble(tokenizer), chunks), "_id long, n_tokens long, ids string, decoded string").withColumnRenamed("_id", id_col)
