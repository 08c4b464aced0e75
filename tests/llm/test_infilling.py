import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilscan.llm import automaton, infilling

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
TEXTS = st.text(alphabet="ab\n<P>SM é́😀", max_size=60)


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    form = "plain" if not text or any(t in text for t in infilling.TAGS) or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *((None, None) if form == "plain" else (len(p), len(m))), sha(out), sha(text), out)


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")) for r in df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 5))
def test_events_from_every_state(text, state):
    own = automaton.lines(infilling.TAGS)
    data = np.frombuffer(text.encode(), np.uint8)
    at, units, tags = state, [], []
    for i, kind in enumerate(own.classes[data].tolist()):
        units += [i] * int(own.events["units"][at, kind])
        tags += [i] * int(own.events["tags"][at, kind])
        at = int(own.steps[at, kind])
    got = own.summary(data)
    assert [x.tolist() for x in own.places(data, state, "units", "tags")] == [units, tags]
    assert (got["to"][state], got["units"][state], got["tags"][state], got["chars"], got["bytes"]) == (at, len(units), len(tags), len(text), len(data))
    if state == 0:
        assert len(units) == len(UNIT.findall(text)) and (len(tags) > 0) == any(t in text for t in infilling.TAGS)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_short_texts_equal_brute_force(texts):
    h = lambda d: [int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    got = list(infilling.Infilling()._cut([(d, h(d), t.encode(), d) for d, t in enumerate(texts)], True))
    assert got == [brute(d, t) for d, t in enumerate(texts)]


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_restore(form):
    out = b"".join(infilling.arrange(b"a\n", b"", b"b", form)) if form != "plain" else b"a\nb"
    assert infilling.restore(out, form) == b"a\nb"


@pytest.mark.parametrize(("chunk", "fan"), [(5, 3), (64, 2), (1 << 16, 64)])
def test_long_texts_equal_brute_force(spark, chunk, fan):
    rng = random.Random(7)
    letters = ["a", "é", "\n", "<P>", "<", "😀", "word ", "<S", "M>"]
    texts = ["".join(rng.choices(letters, [9, 3, 3, 0.02, 1, 1, 5, 0.3, 0.3], k=rng.choice([1, 20, 90]))) for _ in range(60)]
    docs = [*enumerate(texts), (61, None), (62, ""), (None, "a\nb\nc"), (None, "a\nb\nc"), (63, "\n" * 50), (64, "no line end " * 9), (5, texts[5])]
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, chunk long").repartition(3)
    got = rows(infilling.Infilling(chunk=chunk, fan=fan).run(frame))
    assert got == sorted((brute(*r) for r in docs), key=str)


def test_rates(spark):
    docs = [(i, f"line {i}\nand\nmore\n") for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk in (8, 1 << 16):
        assert rows(infilling.Infilling(rate=40, spm=80, chunk=chunk).run(frame)) == sorted((brute(*r, 40, 80) for r in docs), key=str)


def test_odd_rows(odd, none):
    want = sorted((brute(r.doc_id, r.text) for r in odd.collect()), key=str)
    assert rows(infilling.Infilling(chunk=1 << 12, fan=2).run(odd)) == want
    assert infilling.Infilling().run(none).count() == 0
