import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from docaudit.llm import runs
from tests.llm.helpers import documents, rows


def plain_runs(words):
    """Every stretch by definition: for each period the maximal stretches, kept if no smaller period explains them."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted((s, l, q) for (s, l), q in found.items())


def plain_words(doc_id, text, plant):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        original = list(words)
        for i in range(a, n):
            words[i] = original[a + (i - a) % p]
    return words


def plain_row(doc_id, text, plant):
    words = plain_words(doc_id, text, plant)
    found = plain_runs(words)
    gone = {i for s, l, q in found for i in range(s + q, s + l)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{l},{q}\n" for s, l, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def batch_runs(texts):
    words, first, _ = runs.split_words(pa.array([" ".join(t) for t in texts], pa.string()))
    start, length, period = runs.find_runs(words, first)
    out = [[] for _ in texts]
    for s, l, q in zip(start.tolist(), length.tolist(), period.tolist()):
        row = int(np.searchsorted(first, s, side="right")) - 1
        while first[row + 1] == first[row]:
            row -= 1
        out[row].append((s - int(first[row]), l, q))
    return out


WORD = st.lists(st.sampled_from("abc"), min_size=1, max_size=9)
POWERS = st.lists(st.tuples(WORD, st.integers(1, 9), st.integers(0, 4)), max_size=5)


@settings(max_examples=400, deadline=None)
@given(st.lists(POWERS, min_size=1, max_size=4))
def test_runs_by_definition(data):
    texts = [[w for unit, times, cut in powers for w in (unit * times)[: max(1, len(unit) * times - cut)]] for powers in data]
    assert batch_runs(texts) == [plain_runs(t) for t in texts]


def test_runs_of_runs():
    """Periods whose blocks are themselves periodic, Fibonacci words, and long powers."""
    rng = random.Random(3)
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    texts = [list("a" * 3000), list("ab" * 700 + "a"), list(fib[-1]), list(("aaaaaaab" * 5 + "c") * 5), list((("ab" * 9 + "b") * 5 + "c") * 6), list(("a" * 40 + "b") * 6)]
    for _ in range(60):
        unit = "".join(rng.choices("ab", [5, 1], k=rng.randrange(1, 40)))
        texts.append(list("".join(rng.choices("ab", k=rng.randrange(9))) + unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))] + rng.choice(["", "c", "a"]) + unit * 5))
    assert batch_runs(texts) == [plain_runs(t) for t in texts]


def test_extension_beyond_the_top_level():
    unit = [f"w{i}" for i in range(3000)]
    text = ["x"] + unit * 5 + ["y"]
    assert batch_runs([text, ["z"] * 9000]) == [[(1, 15000, 3000)], [(0, 9000, 1)]]


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_runs(spark, plant):
    rng = random.Random(7)
    data = [(i, " ".join(rng.choices(["la", "le", "li", "Lo"], k=rng.randrange(60)))) for i in range(150)]
    data += [(200, None), (201, ""), (202, " \n\t"), (203, "a " * 6), (204, "a " * 5), (205, "a\tb\n" * 4), (206, "a b a b a b a"), (207, "é  " * 8), (None, "x y z " * 9), (None, None)]
    data += [(208, "ha " * 30_000 + "end"), (3, "again and " * 6), (3, "again and " * 6)]
    found = runs.periodic_runs(documents(spark, data), plant=plant)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = [d for d in data if d[0] != 208]
    key = lambda t: tuple((v is not None, v) for v in t)
    assert rows(found.where("doc_id is null or doc_id <> 208"), *columns) == sorted((plain_row(*d, plant) for d in small), key=key)
    assert runs.periodic_runs(documents(spark, [])).count() == 0
    if not plant:
        row = found.where("doc_id = 208").first()
        assert (row["start"], row["length"], row["period"], row["n_dropped"], row["n_words"]) == (0, 30_000, 1, 29_999, 30_001)
        texts = runs.periodic_runs(documents(spark, [(1, "so so so so so so far")]), with_text=True).first()
        assert texts["collapsed"] == "so far" and [tuple(r) for r in texts["runs"]] == [(0, 6, 1)]
