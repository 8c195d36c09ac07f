import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as S

from docaudit.llm import chunks, embeddings, lines, minhash
from docaudit.llm.components import components
from tests.llm.helpers import Union, documents, lower, rows, split_words, thue_morse

LONG = "\n".join(f"line number {i} of a very long text {i * i}" for i in range(20_000))
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "ONE"), (7, LONG), (8, LONG.upper()), (9, LONG + "!"),
    (10, "Straße É"), (11, "straße é"), (12, "straße É"), (None, "One"), (None, "without id"), (4, "One"), (13, "a\x00b"), (14, "a\x00B"),
]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    links += [(5, 5), (None, 3), (2001, 2000)]
    union = Union()
    for a, b in links:
        if a is not None and a != b:
            union.join(a, b)
    got = rows(components(spark.createDataFrame(links, "a long, b long")), "node", "component")
    assert got == sorted((n, union.find(n)) for n in list(union.parent))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- exact dedup -------------------------------------------------------------------------------------------------


def exact_expected(data):
    groups = defaultdict(list)
    for doc_id, text in data:
        groups[lower(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=lambda t: tuple((v is not None, v) for v in t))


@pytest.mark.parametrize("width", [16, 1])  # one byte makes names collide: they must be told apart
def test_exact_duplicates(spark, width):
    noise = random.Random(5)
    filler = ["".join(noise.choices("abcdefgh ", k=3000)) for _ in range(8)]
    data = AWKWARD + [(100 + i, filler[i % 8] + filler[(i * 3) % 8]) for i in range(40)] + [(200 + i, "hot copy") for i in range(60)]
    found = chunks.exact_duplicates(documents(spark, data), width)
    assert rows(found, "doc_id", "keep_id", "group_size", "text_sha256") == exact_expected(data)
    kept = found.where("kept").groupBy("text_sha256").count().collect()
    assert {r["count"] for r in kept} == {1} and len(kept) == len({lower(t) for _, t in data})
    assert found.where("kept and doc_id is not null and doc_id <> keep_id").count() == 0


def test_exact_empty_table(spark):
    found = chunks.exact_duplicates(documents(spark, []))
    assert found.count() == 0 and "text_sha256" in found.columns


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 60_000, dtype=np.uint8)
    shifted = np.concatenate([np.full(37, 97, np.uint8), body])
    ends = [np.array(chunks.cuts(d, np.array([0, len(d)]))[0]) for d in (body, shifted)]
    assert len(set(ends[0]) & set(ends[1] - 37)) > 0.8 * len(ends[0])
    assert max(np.diff(np.append(0, ends[0]))) <= chunks.MOST
    assert ends[0][-1] == len(body) and (np.diff(ends[0]) > 0).all()


# --- line dedup --------------------------------------------------------------------------------------------------


def lines_expected(data):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: 2**63 - 1 if i is None else i
    for doc_id, text in data:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(rank(doc_id))
    out = []
    for doc_id, text in data:
        split = (text or "").split("\n")
        kept = [x for x in split if len(key(x)) < 10 or min(holders[key(x)]) == rank(doc_id)]
        out.append((doc_id, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda t: tuple((v is not None, v) for v in t))


@pytest.mark.parametrize("heavy", [None, 0.0])  # 0: every sampled key is dealt out in blocks
def test_line_dedup(spark, monkeypatch, heavy):
    if heavy is not None:
        monkeypatch.setattr(lines, "HEAVY", heavy)
        monkeypatch.setattr(lines, "HEAVY_LINES", 0)
        monkeypatch.setattr(lines, "SAMPLE", 1.0)
    rng = random.Random(8)
    pool = [f"shared passage number {i}" for i in range(12)] + ["short", "", "  Shared Passage Number 3\t", " nbsp kept line", "exactly10c", "exactly9c"]
    data = AWKWARD + [(300 + i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)) + ["common licence line"])) for i in range(80)]
    data += [(390, "\n\n"), (391, "own line repeated\nown line repeated")]
    found = lines.dedup_lines(documents(spark, data))
    assert rows(found, "doc_id", "n_lines", "n_dropped", "kept_text") == lines_expected(data)


def test_line_dedup_empty_table(spark):
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_bitmaps_are_runs(spark):
    data = [(1, "first common line\nsecond common line\nthird common line"), (2, "x\nfirst common line\nsecond common line\ny\nthird common line")]
    got = lines.keep_bitmaps(documents(spark, data)).collect()
    assert [(r["id"], r["starts"], r["ends"], r["dropped"]) for r in got] == [(2, [1, 4], [3, 5], 3)]


# --- near duplicates ---------------------------------------------------------------------------------------------


def near_expected(data, k, percent):
    sets = []
    for _, text in data:
        w = split_words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    union = Union()
    for i, (a, _) in enumerate(data):
        union.find(a)
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                union.join(a, data[j][0])
    return sorted((d, len(s), union.find(d) if s else d) for (d, _), s in zip(data, sets, strict=True))


def near_data(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.choice([4, 9, 40, 120])) for _ in range(6)]
    data = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        data.append((i, " ".join(w)))
    return data


@pytest.mark.parametrize(("k", "percent", "piece"), [(3, 85, 256), (5, 80, 256), (3, 85, 8)])
def test_near_duplicates(spark, monkeypatch, k, percent, piece):
    monkeypatch.setattr(minhash, "PIECE", piece)
    data = near_data(k) + [(500, None), (501, ""), (502, " \t "), (503, "two words"), (504, "Two  WORDS"), (505, "two words more"), (506, LONG), (507, LONG + " end")]
    data += [(600 + i, "hot copy of one and the same text") for i in range(50)]
    found = minhash.near_duplicates(documents(spark, data), k, percent)
    assert rows(found, "doc_id", "n_shingles", "component_id") == near_expected(data, k, percent)
    assert found.where("kept <> (doc_id = component_id)").count() == 0


def test_near_chain_is_one_component(spark):
    words = [f"c{i}" for i in range(260)]
    data = [(i, " ".join(words[i : i + 120])) for i in range(0, 140, 4)]  # neighbours alike, the ends are not
    found = minhash.near_duplicates(documents(spark, data), 3, 85)
    assert {r["component_id"] for r in found.collect()} == {0}


def test_near_null_and_repeated_ids(spark):
    data = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "only without id here")]
    found = minhash.near_duplicates(documents(spark, data), 3, 85)
    assert rows(found, "doc_id", "component_id", "kept") == [(None, None, False), (None, 3, False), (3, 3, True), (3, 3, True)]
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_signature_matches_at_the_rate_of_similarity():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2))
    agree = []
    for _ in range(200):
        mixed = rng.permutation(pool)
        agree.append((minhash.signature(np.sort(mixed[:30])) == minhash.signature(np.sort(mixed[5:35]))).mean())
    assert abs(np.mean(agree) - 25 / 35) < 0.03


# --- vectors -----------------------------------------------------------------------------------------------------

VECTORS = S.StructType([S.StructField("vec_id", S.LongType()), S.StructField("embedding", S.ArrayType(S.FloatType())), S.StructField("label", S.IntegerType()), S.StructField("id", S.StringType())])


def vectors_expected(data, least):
    unit = []
    for _, v, label in data:
        ok = v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if ok else None
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    union, links = Union(), [0] * len(data)
    for i in range(len(data)):
        union.find(data[i][0])
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                union.join(data[i][0], data[j][0])
    return sorted((d[0], n, union.find(d[0])) for d, n in zip(data, links, strict=True))


@pytest.mark.parametrize("piece", [512, 16])
def test_near_vectors(spark, monkeypatch, piece):
    monkeypatch.setattr(embeddings, "PIECE", piece)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 64))
    data = []
    for i in range(400):
        noise = rng.normal(size=64) * rng.choice([0.05, 0.14, 0.3])
        data.append((i, [float(x) for x in centres[rng.integers(8)] + noise], int(rng.integers(2))))
    data += [(500 + i, data[0][1], data[0][2]) for i in range(30)]
    data += [(600, [2 * x for x in data[0][1]], data[0][2]), (601, data[0][1], None), (602, None, 1), (603, [], 1), (604, [0.0] * 64, 1)]
    data += [(605, [float("nan")] * 64, 1), (606, [float("inf")] + [1.0] * 63, 1), (607, [None] + [1.0] * 63, 1), (608, [1.0, 2.0, 3.0], 1), (609, [1.0, 2.0, 3.001], 1)]
    data += [(610, [3e38, 1e38, 0.0, -0.0], 0), (611, [3e38, 1e38, -0.0, 0.0], 0)]
    df = spark.createDataFrame([(*d, "x") for d in data], VECTORS).repartition(3)
    found = embeddings.near_vectors(df, 0.98)
    assert rows(found, "vec_id", "n_links", "component_id") == vectors_expected(data, 0.98)


def test_near_vectors_empty_and_repeated(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0, "x"), (1, [1.0, 0.0], 0, "x"), (None, [1.0, 0.0], 0, "x")], VECTORS)
    assert rows(embeddings.near_vectors(twice), "vec_id", "n_links", "component_id", "kept") == [(None, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(embeddings.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(embeddings.hadamard(embeddings.hadamard(x)), x)


@pytest.mark.parametrize("n", [1024, 2048])
def test_minhash_tells_confusable_words_apart(spark, n):
    first, second = thue_morse(n)
    data = [(1, f"x y {first} z"), (2, f"x y {second} z"), (3, first), (4, second), (5, f"X y {first} z")]
    found = minhash.near_duplicates(documents(spark, data), words_per_shingle=3, percent=85)
    assert rows(found, "doc_id", "component_id") == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]
