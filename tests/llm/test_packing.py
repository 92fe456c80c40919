import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offerweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def check(pieces, capacity=2048):
    """Every id once, no gaps, little padding."""
    docs, seqs = {}, {}
    for d, start, length, seq, offset in pieces:
        docs.setdefault(d, []).append((start, length))
        seqs.setdefault(seq, []).append((offset, length))
    for v in docs.values():
        at = 0
        for start, length in sorted(v):
            assert start == at and length > 0
            at += length
    total = pad = 0
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return {d: sum(x[1] for x in v) for d, v in docs.items()}, pad, total


@given(st.lists(st.integers(1, 7000), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_pack_group(lengths):
    sizes, pad, total = check(packing.pack_group(lengths, 2048))
    assert sizes == dict(enumerate(lengths)) and pad == 0


@given(st.lists(st.integers(1, 100), max_size=80))
@settings(max_examples=60, deadline=None)
def test_first_fit_decreasing(sizes):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b in bins:
            if sum(sizes[j] for j in b) + sizes[i] <= 100:
                b.append(i)
                break
        else:
            bins.append([i])
    assert packing.first_fit_decreasing(sizes, 100) == bins


TEXTS = ["", " ", "  ", "\n\n a", "a  b", "Don't  stop\t\tnow \n", "x\r\n y", "été ß 你好   ok", "tail   ", "a  b", "<|endoftext|> z", "1234 56,7.8", "'s 're", " lead", "\x0b\x0c x"]


@given(st.text(alphabet="ab1'. \n\t é\u00a0\u2003\u0085你", max_size=30) | st.text(max_size=20))
@settings(max_examples=300, deadline=None)
def test_encoder_any(text):
    encode = packing.encoder(PATH)
    assert encode.fast
    want = TOK.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in encode([text, "", text + "<|endoftext|>"])] == [want, [], TOK.encode(text + "<|endoftext|>").ids]


@pytest.mark.parametrize("odd", [" " * 1_000_000 + "x", "a" + "\n" * 600_000, "\u2003" * 200_000 + " y", "ab " * 100_000])
def test_very_long_white_space(odd):
    assert packing.encoder(PATH)([odd])[0].tolist() == TOK.encode(odd, add_special_tokens=False).ids


@pytest.mark.parametrize("groups", [1, 5])
def test_against_brute_force(spark, monkeypatch, groups):
    rng = random.Random(4)
    texts = [None, *TEXTS] + ["".join(rng.choices("ab cd\n é", k=rng.randint(0, 4000))) for _ in range(60)] + ["long words here " * 20_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    monkeypatch.setattr(packing, "GROUP", sum(len((t or "").encode()) for t in texts) // groups + 1)
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH).collect()
    sizes, pad, _ = check([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got])
    ids = {i: [*TOK.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    assert sizes == {i: len(v) for i, v in ids.items()} and pad == 0
    for r in got:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert sorted((r.length, r.doc_tokens) for r in packing.pack_documents(df, PATH).collect()) == [(1, 1)] * 3
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
