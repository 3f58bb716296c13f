import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corrente.llm import textscan as ts

words = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é日\n.-", max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(words)
def test_words_and_ngrams(texts):
    for chunk in ts.chunks(pa.array(texts, pa.string()), 40):
        s, e, off = chunk.words(ts.WORD)
        h = chunk.hashes(s, e)
        for i in range(chunk.n_rows):
            mine = (texts[chunk.first_row + i] or "").encode()
            expect = re.findall(rb"[0-9A-Za-z\x80-\xff]+", mine)
            assert [chunk.buf[a:b].tobytes() for a, b in zip(s[off[i] : off[i + 1]], e[off[i] : off[i + 1]], strict=True)] == expect
            alone = next(ts.chunks(pa.array([mine.decode().lower()])), None)
            if alone is not None and expect:
                assert (alone.hashes(*alone.words(ts.WORD)[:2]) == h[off[i] : off[i + 1]]).all()
        g, r = ts.ngrams(h, off, 3, whole_short=True)
        counts = off[1:] - off[:-1]
        assert sorted(r.tolist()) == sorted(i for i, n in enumerate(counts.tolist()) for _ in range(max(1, n - 2) if n else 0))


def test_every_row_is_in_one_chunk():
    texts = ["x" * n for n in (0, 5, 100, 0, 3, 50, 1)]
    assert sum(c.n_rows for c in ts.chunks(pa.array(texts), 10)) == len(texts)
    assert [c.first_row for c in ts.chunks(pa.array(texts), 10)] == sorted({c.first_row for c in ts.chunks(pa.array(texts), 10)})
