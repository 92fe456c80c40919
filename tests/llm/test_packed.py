import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerweave.llm import packed, words


def test_round_trip():
    arrays = [np.arange(5, dtype=np.int64), np.zeros(0, np.uint8), np.array([1, 255], np.uint8), np.array([2**63], np.uint64), np.array([0.5], np.float32)]
    got = packed.unpack(packed.pack(*arrays, b"text"))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, got[:-1], strict=True)) and got[-1].tobytes() == b"text"


@given(st.lists(st.integers(0, 9), max_size=40), st.sampled_from([10, 1_000]))
@settings(max_examples=80, deadline=None)
def test_by_part(part, parts):
    got = {p: i.tolist() for p, i in packed.by_part(np.array(part, np.int32), parts)}
    assert got == {p: [i for i, x in enumerate(part) if x == p] for p in set(part)}


@pytest.mark.parametrize("most,kind", [(0, np.uint8), (255, np.uint8), (256, np.uint16), (2**32, np.uint64)])
def test_narrow(most, kind):
    assert packed.narrow(np.array([0, most])).dtype == kind and packed.narrow(np.zeros(0, np.int64)).dtype == np.uint8


def test_parts_are_even():
    n = np.bincount(packed.deal(packed.mix(np.arange(100_000, dtype=np.uint64)), 64), minlength=64)
    assert n.min() > 1_300 and n.max() < 1_800


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\né", max_size=12)), max_size=10), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_texts_slices_and_words(texts, size):
    batch = pa.record_batch([pa.array(texts, pa.string())], ["t"])
    parts = list(packed.slices(batch, "t", size))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts
    for p in parts:
        data, at = packed.texts(p.column("t"))
        starts, ends, first = words.spans(data, at)
        code, distinct = words.codes(data, starts, ends)
        raw = data.tobytes()
        for i, t in enumerate(p.column("t").to_pylist()):
            want = (t or "").encode().split()
            own = range(first[i], first[i + 1])
            assert [raw[starts[j] : ends[j]] for j in own] == want == [distinct[code[j]] for j in own]
