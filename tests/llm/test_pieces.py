"""Words encoded side by side, decoding of many rows, and the map of integers, each held to a plain version."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tracework.llm import pieces
from tracework.llm.intmap import IntMap
from tracework.llm.pieces import Vocabulary, normalise
from tracework.llm.queries import PIECES


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as f:
        return f.read()


def test_int_map_is_a_dict():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 5000, 700))
    m = IntMap(len(keys))
    m.put(keys[:300], np.arange(1, 301, dtype=np.int32))
    m.put(keys[300:], np.arange(301, len(keys) + 1, dtype=np.int32))
    want = {k: i for i, k in enumerate(keys.tolist(), 1)}
    assert m.get(np.arange(5000)).tolist() == [want.get(k, 0) for k in range(5000)]
    with pytest.raises(ValueError):
        m.put(np.array([9000]), np.array([1], np.int32))


def test_words_side_by_side_are_the_words_alone(model, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "_CACHE", 50)  # both generations turn over
    monkeypatch.setattr(pieces, "_BLOCK", 300)
    v, sp = Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    r = random.Random(5)
    texts = ["", " ", "a", "\U0001f600", "ab\U0001f600cd", "x" * 500, "ſ\u0000", "一二三四" * 40]
    texts += ["".join(r.choice("etaoinéßя一 ,.1\n") for _ in range(r.randint(1, 90))) for _ in range(300)]
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        assert [x.tolist() for x in v.encode_all([normalise(t) for t in part])] == [sp.encode(t) for t in part]


def test_decoding_many_rows_is_decoding_each(model, monkeypatch):
    v = Vocabulary(model)
    odd = [v.byte[0xC3], v.byte[0x28]]  # not UTF-8
    rows = [[], None, v.encode(normalise("  two words ")).tolist(), v.encode(normalise("\U0001f600é")).tolist()]
    for extra in ([], [odd]):
        column = pa.array(rows + extra, pa.list_(pa.int32()))
        want = [None if x is None else v.decode(x) for x in rows + extra]
        assert v.decode_all(column).to_pylist() == want
        assert v.decode_all(column.slice(2)).to_pylist() == want[2:]
        monkeypatch.setattr(pieces, "_AT_ONCE", 3)
        parts = list(v.decode_parts(column))
        assert sum(n for n, _ in parts) == len(column) and len(parts) > 1
        assert [t for _, texts in parts for t in texts.to_pylist()] == want
