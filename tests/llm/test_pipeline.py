"""The pipeline stage by stage against plain versions, on a table with every awkward row."""

import random

import pytest

import corpus_pipeline as C
from docaudit.llm.queries import ORACLES, QUERIES
from docaudit.llm import mixing
from tests.llm.helpers import SCHEMA, Union, documents, lower, split_words, thue_morse

SOUNDS = {"xx": ["ka", "to", "mi", "re", "su", "no"], "yy": ["schl", "ung", "pfe", "ber", "ich", "gen"]}


def corpus():
    rng = random.Random(11)
    word = lambda lang: "".join(rng.choices(SOUNDS[lang], k=rng.randrange(1, 5)))
    rows = []
    for i in range(260):
        lang = "xx" if i % 3 else "yy"
        rows.append((i, " ".join(word(lang) for _ in range(rng.randrange(30, 90))), lang, rng.choice(["a", "a", "a", "b", None])))
    for i in range(40):  # exact copies in another case, near copies with one other word
        doc_id, text, lang, source = rows[rng.randrange(60)]
        rows.append((300 + i, text.upper() if i % 2 else text, lang, source))
    for i in range(40):
        doc_id, text, lang, source = rows[100 + rng.randrange(40)]
        words = text.split()
        words[-1] = word(lang)
        rows.append((400 + i, " ".join(words), lang, source))
    rows += [(500, None, "xx", "a"), (501, "", "xx", "a"), (502, "12 34 $$", None, "b"), (503, "щука фыва жюри ёлка цапля", None, "b")]
    rows += [(504, "ka to mi " * 20_000, "xx", "long"), (7, rows[7][1], rows[7][2], rows[7][3]), (None, "kato miresu noka " * 9, "xx", None)]
    return rows


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, corpus()), []
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "unused").cache()
        out.append(docs)
    return out


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda t: (t[0] is None, t))


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "piece_encoding"]
    assert all(df.columns == SCHEMA.names for df in stages[:-1])


def test_language_stage_drops_what_it_rejects(stages):
    gone = {500, 501, 502, 503}
    assert kept(stages[0]) == sorted(((d, t) for d, t, *_ in corpus() if d not in gone), key=lambda t: (t[0] is None, t))


def test_exact_stage(stages):
    groups = {}
    for doc_id, text in kept(stages[0]):
        groups.setdefault(lower(text), []).append((doc_id is not None, doc_id, text))
    want = sorted(((g[1], g[2]) for g in (max(v) for v in groups.values())), key=lambda t: (t[0] is None, t))
    assert kept(stages[1]) == want


def test_near_stage(stages):
    rows, union = kept(stages[1]), Union()
    sets = {}
    for doc_id, text in rows:
        w = split_words(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    ids = [d for d in sets if d is not None]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                union.join(a, b)
    assert kept(stages[2]) == [(d, t) for d, t in rows if d is None or union.find(d) == d]
    assert stages[2].count() < stages[1].count()


def test_mixing_stage_repeats_documents(stages):
    before = {d: t for d, t in kept(stages[2])}
    after = kept(stages[3])
    counts = {}
    for doc_id, text in after:
        assert before[doc_id] == text
        counts[doc_id] = counts.get(doc_id, 0) + 1
    assert set(counts.values()) <= {1, 2}
    size = lambda rows: sum(len(split_words(t)) for _, t in rows)
    # The one document of its source is taken whole or not at all; the others come near their targets.
    assert abs(size(after) - 1.5 * size(before.items())) < max(size([r]) for r in before.items())


def test_encoding_stage_loses_nothing(stages):
    assert stages[4].count() == stages[3].count() and stages[4].where("not round_trip").count() == 0


def test_mixing_stage_by_row(spark):
    """Rows without an id, and rows that repeat one, are copied as often as the mix takes them together."""
    rng = random.Random(2)
    data = [(None, "w " * n, "xx", s) for n, s in [(20, "a"), (20, "a"), (20, "b"), (40, "b"), (40, None), (60, "c"), (80, "c")]]
    data += [(i % 9, " ".join(rng.choices(["p", "q"], k=10 + i % 4)), "yy", rng.choice(["a", "b"])) for i in range(40)]
    docs = documents(spark, data)
    words = sum(len(t.split()) for _, t in kept(C.mix_sources(spark, docs, "unused")))
    taken = mixing.mix(docs).collect()
    assert words == sum(r["taken"] for r in taken) and words <= 2 * sum(r["size"] for r in taken)


def test_near_stage_without_ids(spark):
    """Of near copies without an id one row stays, an id goes before none, and confusable words are no copies."""
    left = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:-1], f"x{k}"]) for k in range(6)]
    first, second = thue_morse(1024)
    data = [(None, near[0]), (None, near[1]), (None, near[2]), (None, "quite another text of some words"), (None, None), (None, "")]
    data += [(1, f"a b c d {first}"), (2, f"a b c d {second}")]
    found = left(C.near_dedup(spark, documents(spark, data), "unused"))
    assert [t for _, t in found if t in near] and sum(t in near for _, t in found) == 1 and len(found) == 6
    found = left(C.near_dedup(spark, documents(spark, [*data, (7, near[3])]), "unused"))
    assert [(d, t) for d, t in found if t in near] == [(7, near[3])]


def test_empty_table_runs_through(spark):
    docs = documents(spark, [])
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "unused").cache()
        assert docs.count() == 0


def test_registry():
    assert [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES), key=lambda n: list(QUERIES).index(n))
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)
