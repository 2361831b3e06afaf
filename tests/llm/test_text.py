import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footfall.llm import _text

from .helpers import ALNUM, SPACED, words

texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aAbZ09 \t\n\r\x0b\x0c.,éß🙂  \x00")), max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts, st.sampled_from([1, 7, 1 << 20]))
def test_words_are_those_of_the_pattern(rows, size):
    for pattern, ends in ((SPACED, _text.SPACE), (ALNUM, _text.NON_ALNUM)):
        found = [[] for _ in rows]
        for lo, hi, raw, at in _text.blocks(pa.array(rows, pa.string()), size):
            w = _text.words(raw, at, ends)
            data = _text.LOWER[raw].tobytes()
            for d, s, e in zip(w.doc, w.start, w.end, strict=True):
                found[lo + d].append(data[s:e].decode())
            assert len(w.first) == hi - lo + 1
        assert found == [words(t, pattern) for t in rows]


def test_hashes_do_not_depend_on_the_place():
    a, b = _text.hash_of("x abc yy abc"), _text.hash_of("abc")
    assert a[1] == a[3] == b[0] and len(set(a.tolist())) == 3
    assert _text.hash_of("ab")[0] != _text.hash_of("ba")[0] != _text.hash_of("a")[0]


def test_no_collisions_among_many_words():
    many = " ".join(f"{i:x}" for i in range(200_000))
    assert len(np.unique(_text.hash_of(many))) == 200_000


@pytest.mark.parametrize("column", [pa.array([], pa.string()), pa.array([None, None], pa.string()), pa.chunked_array([pa.array(["a"]), pa.array(["b", None])])])
def test_columns(column):
    raw, at = _text.texts_of(column)
    assert len(at) == len(column) + 1 and at[-1] == len(raw)


def test_grams():
    h = _text.hash_of("a b c a b")
    g = _text.gram_hash(h, 2)
    assert len(g) == 4 and g[0] == g[3] and g[0] != g[1] and len(_text.gram_hash(h, 9)) == 0
