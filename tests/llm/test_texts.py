import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from docaudit.llm import language, mixing, pieces, pii, quality, records
from docaudit.llm import text as T
from docaudit.llm.queries import tokenizer_file
from tests.llm.helpers import documents, rows, split_words, thue_morse

# --- words and hashes --------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1f\xa0▁日", max_size=30)), max_size=6), st.integers(1, 4))
def test_words_and_shingles(texts, k):
    data, offsets = T.block(pa.array(texts, pa.string()))
    data = T.LOWER[data]
    starts, ends, first = T.words(data, offsets)
    plain = [split_words(t) for t in texts]
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == [w for ws in plain for w in ws]
    assert np.diff(first).tolist() == [len(w) for w in plain]
    values, at = T.shingles(T.span_hashes(data, starts, ends), first, k)
    names = [[tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [] for w in plain]
    assert np.diff(at).tolist() == [len(n) for n in names]
    pairs = list(zip([n for ns in names for n in ns], values.tolist()))
    assert len({v for _, v in pairs}) == len({n for n, _ in pairs}) == len(set(pairs))


# --- personal data -----------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def passes_luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and passes_luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


PARTS = st.sampled_from(["a", "b.c", "@", ".", "-", "+", "1", "12", "255", "256", "4111 1111 1111 1111", "4111111111111111", " ", "(", ")", "é", "x@y.z", "0001", "9", "+1 (743) 555-3824"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_very_long_runs():
    assert pii.base_spans("1" * 200_000 + "." + "a" * 200_000) == []
    assert pii.base_spans("a" * 100_000 + "@x.y") == [("email", 0, 100_004)]


def personal_rows():
    rng = random.Random(6)
    out = []
    for i in range(240):
        d = lambda n: "".join(rng.choices("0123456789", k=n))  # noqa: B023, E731
        card = next(c for c in (d(16) for _ in iter(int, 1)) if passes_luhn(digits(c)))
        value = [f"person.{d(2)}@mail{d(1)}.example.com", f"+1 ({d(3)}) 555-{d(4)}", card, f"10.{rng.randrange(256)}.3.{rng.randrange(256)}", f"token {d(16)}", "the year 2024"][i % 6]
        out.append((i, f"words before it and then {value} and words after it.\nNext line."))
    return out


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(documents(spark, personal_rows()))


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("please write to person.19 (at) mail5.example.com for it", "email", "person.19 (at) mail5.example.com"),
    ("please call (743) 555-3824 for it", "phone", "(743) 555-3824"),
    ("please call 743-555-3824 for it", "phone", "743-555-3824"),
])
def test_field_adds_what_patterns_miss(field, text, kind, found):
    base, every = pii.all_spans(text, field)
    assert base == [] and [(k, text[a:b]) for k, a, b in every] == [(kind, found)]


WRITTEN_OUT = [f for s, k in [("first.last@mail.example.com", "email"), ("name@mail.example.com", "email"), ("+33 1 42 68 53 00", "phone"), ("+1 (743) 555-3824", "phone")]
               for f, _, _ in pii.variants(s, k, 0, len(s))]
WRITTEN_OUT += ["name [at] mail [dot] example [dot] com", "first.last (at) mail.sub.example.co.uk", "name (At) example.com", "name {at} example {dot} com", "0033 1 42 68 53 00", "01 42 68 53 00", "06.12.34.56.78"]


@pytest.mark.parametrize("form", WRITTEN_OUT)
def test_written_out_spans_are_seen_and_found_whole(field, form):
    for before, after in [("", ""), ("a long line of many words that stands before it: " * 3, " and a long line of words after it" * 3), ("+1 (743) 555-3824, ", ".")]:
        text = before + form + after
        base, every = pii.all_spans(text, field)
        seen = pii.stretches(text, pii._open(text, base))
        assert any(a <= len(before) and len(before) + len(form) <= b for a, b in seen)
        assert [text[a:b] for _, a, b in every if (_, a, b) not in base] == [form]


@pytest.mark.parametrize("text", ["the year 2024 and 12 of 345 rows", "version 3.11.2 of it", "plain words at home", "a @ b", "12345 6789 pieces", ""])
def test_field_leaves_clean_text_alone(field, text):
    assert pii.all_spans(text, field) == ([], [])


def test_personal_data_table(spark, field):
    long = "é words " * 30_000
    data = [(1, None), (2, ""), (3, long + "x.1@mail5.example.com"), (4, "+1 (743) 555-3824 and 1.2.3.4"), (4, "+1 (743) 555-3824 and 1.2.3.4"), (None, "4111 1111 1111 1111")]
    got = rows(pii.find_personal_data(documents(spark, data), field), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = []
    for doc_id, t in data:
        spans = plain_spans(t or "")
        n = [sum(s[0] == k for s in spans) for k in pii.KINDS]
        want.append((doc_id, *n, hashlib.sha256(text(spans).encode()).hexdigest(), text(spans)))
    assert got == sorted(want, key=lambda t: tuple((v is not None, v) for v in t))
    assert pii.redact("a +1 (743) 555-3824 b", pii.base_spans("a +1 (743) 555-3824 b")) == "a [phone] b"
    assert pii.find_personal_data(documents(spark, []), pii.fit(documents(spark, []))).count() == 0


# --- quality -----------------------------------------------------------------------------------------------------


def test_quality_orders_grades(spark):
    rng = random.Random(9)
    words = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    data, labels = [], []
    for i in range(600):
        w = rng.choices(words, k=rng.randrange(5, 60))
        g = i % 3
        if g == 0:
            w[rng.randrange(len(w))] = rng.choice(["nastyone", "nastytwo"])
        if g == 1:
            w = [x + "###" for x in w]
        data.append((i, " ".join(w)))
        labels.append((i, int(g == 2), int(g == 0), "x"))
    data += [(1000, None), (1001, ""), (1002, " ".join(words * 200)), (1002, " ".join(words * 200)), (None, "worda wordb"), (1003, " ".join(words * 100) + " nastyone")]
    labels += [(None, 1, 0, "x"), (5000, 1, 0, "x"), (1, None, 0, "x"), (2, 1, 1, "x"), (1001, None, None, "x")]
    docs = documents(spark, data)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = quality.fit(docs, table.where("doc_id is null or doc_id % 4 <> 1"))
    got = {r["doc_id"]: r for r in quality.rate(docs, model).collect()}
    held = [i for i in range(600) if i % 4 == 1 and i not in (1, 2)]
    assert np.mean([got[i]["kept"] == (i % 3 > 0) for i in held]) > 0.97
    means = [np.mean([got[i]["expected_grade"] for i in held if i % 3 == g]) for g in range(3)]
    assert means[0] + 0.5 < means[1] < means[2] - 0.5
    assert got[1002]["kept"] and not got[1003]["kept"]  # one harmful word in a long text
    assert model.thresholds[0] < model.thresholds[1]
    assert all(0 <= r["p_at_least_2"] <= r["p_at_least_1"] <= 1 and math.isclose(r["expected_grade"], r["p_at_least_1"] + r["p_at_least_2"]) for r in got.values())
    assert quality.rate(docs, model).count() == len(data)
    empty = quality.fit(docs, table.limit(0))
    assert quality.rate(documents(spark, []), empty).count() == 0 and quality.rate(docs, empty).count() == len(data)


# --- piece encoding ----------------------------------------------------------------------------------------------


def small_model():
    keys = ["\xff", "\xffa", "a", "b", "ab", "ba", "aba", "é", "日", "\xffab", "bb", "abb", "\xff\xff"]
    keys = [k.replace("\xff", "\x00").encode().replace(b"\x00", b"\xff") for k in keys]
    scores = np.array([-3.0, -2.5, -2.0, -2.1, -2.6, -3.9, -3.0, -4.0, -5.0, -3.1, -4.2, -3.3, -4.0])
    return pieces.PieceModel(keys, np.arange(256, 256 + len(keys)), scores, np.arange(256))


def best_score(model, chunk):
    """Best sum of scores over all ways to cut a chunk."""
    index = {k: i for i, k in enumerate(model.keys)}
    best = [0.0] + [-math.inf] * len(chunk)
    for s in range(len(chunk)):
        if best[s] == -math.inf:
            continue
        n = 1 if chunk[s] < 0xC0 or chunk[s] == 0xFF else 2 if chunk[s] < 0xE0 else 3 if chunk[s] < 0xF0 else 4
        for e in range(s + 1, len(chunk) + 1):
            if chunk[s:e] in index:
                best[e] = max(best[e], best[s] + model.scores[index[chunk[s:e]]])
        if chunk[s : s + n] not in index:
            best[s + n] = max(best[s + n], best[s] + model.unknown)
    return best[-1]


def score_of(model, ids):
    index = {int(v): i for i, v in enumerate(model.ids)}
    total, spelled = 0.0, b""
    for i in ids.tolist():
        total += model.scores[index[i]] if i in index else 0.0
        spelled += b"" if i in index else bytes([i])
    return total + model.unknown * len(spelled.decode())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab éx\n日🎉▁\x00", max_size=80), min_size=1, max_size=5))
def test_viterbi_is_best_and_decodes(texts):
    model = small_model()
    for value, ids in zip(texts, model.encode(texts)):
        assert model.decode(ids) == value
        raw = b"\xff" + value.encode().replace(b" ", b"\xff")
        assert math.isclose(score_of(model, ids), best_score(model, raw), abs_tol=1e-9)


def test_long_chunks_are_solved_alike():
    model = small_model()
    rng = random.Random(3)
    for _ in range(40):
        chunk = "".join(rng.choices("abéx日", k=rng.randrange(1, 40))).encode()
        assert model.solve([chunk])[0] == model.solve_long(chunk)


def test_pieces_may_not_cross_chunks():
    with pytest.raises(ValueError):
        pieces.PieceModel([b"a\xffb"], np.array([300]), np.array([-1.0]), np.arange(256))


def test_encode_and_decode_tables(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    data = [(1, None), (2, ""), (3, "Hello  world ▁ \n\t\x00 日本🎉"), (4, "word " * 40_000), (5, "x" * 50_000), (5, "x" * 50_000), (None, "no id")]
    done = pieces.encode(documents(spark, data), path)
    assert done.where("not round_trip or n_pieces <> size(ids)").count() == 0
    back = rows(pieces.decode(done, path), "doc_id", "text")
    assert back == sorted([(d, t or "") for d, t in data], key=lambda t: tuple((v is not None, v) for v in t))
    assert {r["text_sha256"] for r in done.where("doc_id = 4").collect()} == {hashlib.sha256(b"word " * 40_000).hexdigest()}
    assert pieces.encode(documents(spark, []), path).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).collect()[0]["text"] is None


# --- language ----------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(2)
    sounds = {"xx": ["ka", "to", "mi", "re", "su"], "yy": ["schl", "ung", "pfe", "ber", "ich"], "zz": ["éau", "ção", "ñe", "où", "ï"]}
    make = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."
    data = [(i, make(lang, rng.randrange(3, 80)), lang, "s") for i, lang in enumerate(rng.choices(list(sounds), k=600))]
    data += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 $$$ ...", "zz"), (1003, "щука жюри фыва ёлка цапля", None), (1004, make("yy", 40_000), "yy"), (1005, make("xx", 9).upper(), None)]
    data += [(None, make("zz", 50), "zz"), (7, data[7][1], data[7][2])]
    docs = documents(spark, data)
    assert {r["doc_id"] for r in docs.where(language.held_out()).collect()} == {d[0] for d in data if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 4 == 2}
    model = language.fit(docs.where(~language.held_out()), sample=150)
    assert set(model.languages) == set(sounds)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = [d for d in data[:600] if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert np.mean([got[d[0]]["lang_pred"] == d[2] and not got[d[0]]["rejected"] for d in held]) > 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1000, 1001, 1002))
    assert got[1003]["rejected"] and got[1003]["lang_pred"] in sounds  # too far from every centroid
    assert got[1004]["lang_pred"] == "yy" and got[1005]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(docs, model).count() == len(data)
    nothing = language.fit(documents(spark, []))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"} and language.identify(documents(spark, []), nothing).count() == 0


# --- records -----------------------------------------------------------------------------------------------------


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    data = [(5, None), (3, ""), (9, "It's HERE, don't (stop). <|endoftext|> İstanbul ΑΣ é é"), (1, "a  b\tc\n" * 9000), (4, "x" * 20_000), (7, "naïve-café_9...!? 日本語"), (4, "again"), (None, "no id"), (11, " \n ")]
    folder = f"file://{tmp_path}/rec"
    got = rows(records.encoded_documents(documents(spark, data), path, 2, folder), "doc_id", "start", "n_tokens", "ids_crc32")
    want, start = [], 0
    for doc_id, text in sorted(((d, t or "") for d, t in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    index = records.read_index(spark, folder)
    some = records.read_records(index.where("doc_id in (9, 1)").orderBy("doc_id", ascending=False), folder).collect()
    assert sorted(r["doc_id"] for r in some) == [1, 9]
    file = sorted(f for f in os.listdir(tmp_path / "rec/data") if f.endswith(".rec"))
    assert len(file) == index.select("file").distinct().count()
    raw = (tmp_path / "rec/data" / file[0]).read_bytes()
    assert records.unframe(raw)[3] <= len(raw)
    for spot in (0, 9, 20, len(raw) - 1):
        broken = bytearray(raw)
        broken[spot] ^= 1
        with pytest.raises(ValueError):
            at = 0
            while at < len(broken):
                at = records.unframe(bytes(broken), at)[3]
    assert records.encoded_documents(documents(spark, []), path).count() == 0


def test_frames_choose_their_width():
    for ids in ([], [1, 2, 65535], [65536, 4_000_000_000]):
        doc_id, before, back, end = records.unframe(records.frame(7, 11, np.array(ids, np.uint32)))
        assert (doc_id, before, back.tolist()) == (7, 11, ids)


# --- mixing ------------------------------------------------------------------------------------------------------


def filled(sizes, weights, share, most):
    """Targets by bisection on the common level."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, low, high = share * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(most * sizes[s], mid * weight[s]) for s in names) < total:
            low = mid
        else:
            high = mid
    return {s: min(most * sizes[s], high * weight[s]) for s in names}


@pytest.mark.parametrize("share", [0.2, 1.0, 1.5, 2.0])
def test_mix(spark, share):
    rng = random.Random(4)
    data = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5)), "en", rng.choices(["a", "b", "B", "é", None, "rare"], [30, 5, 10, 10, 5, 0.3])[0]) for i in range(1500)]
    data += [(2000, None, "en", "a"), (2001, " \n", "en", "hollow"), (2002, "w " * 30_000, "en", "rare"), (7, data[7][1], "en", data[7][3]), (None, "w w w", "en", "a")]
    docs = documents(spark, data)
    got = mixing.mix(docs, share=share).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, _, source in data:
        sizes[source] = sizes.get(source, 0) + len(split_words(text))
    goal = filled(sizes, mixing.WEIGHTS, share, 2.0)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], goal[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["times"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= max(3, 0.01 * goal[s]) for s in sizes if s != "rare")
    again = mixing.mix(docs.repartition(7), share=share)
    assert rows(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=lambda t: tuple((v is not None, v) for v in t))
    other = mixing.mix(docs, share=share, seed=1)
    if share < 2:
        assert rows(other, "doc_id", "taken") != rows(again, "doc_id", "taken")


@pytest.mark.parametrize("huge", [1, 4])
def test_mix_passes_over_documents_that_do_not_fit(spark, huge):
    """A huge document at the border stops no draw: the result is that of one walk in the order of draws."""
    rng = random.Random(9)
    data = [(i, "w " * int(rng.lognormvariate(3, 1) + 1), "en", "a") for i in range(600)]
    data += [(1000 + i, "w " * 12_000, "en", "a") for i in range(huge)]
    docs = documents(spark, data)
    got = mixing.mix(docs, share=0.4).collect()
    target = got[0]["target"]
    assert abs(sum(r["taken"] for r in got) - target) <= 3
    gap, walked = target, set()
    for r in mixing.sized(docs).orderBy("slice", "draw").collect():
        if r["size"] <= gap:
            gap -= r["size"]
            walked.add(r["doc_id"])
    assert walked <= {r["doc_id"] for r in got if r["times"]} and sum(r["times"] for r in got) <= len(walked) + 1


def test_mix_empty_tables(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    got = mixing.mix(documents(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]


def test_word_hashes_and_span_table():
    rng = np.random.default_rng(5)
    words = [*thue_morse(256), *thue_morse(1024), *thue_morse(2048), "", "a", "\x00", "a\x00", "x" * 8, "x" * 9, "y" * 513]
    words += ["".join(rng.choice(list("abc"), rng.integers(1, 30))) for _ in range(3000)]
    words = sorted(set(words))
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    for key in (0, 12345):
        assert len(np.unique(T.word_hashes(data, starts, ends, key))) == len(words)
    hashes = T.word_hashes(data, starts, ends) & np.uint64(0xFFF)  # so few that they clash
    table = T.SpanTable(14)
    rows = table.find(hashes, T.lanes(data), starts, ends)
    assert (rows == -1).all()
    new = table.unknown(hashes, rows, ends - starts)
    table.add(hashes[new], data, starts[new], ends[new])
    rows = table.find(hashes, T.lanes(data), starts, ends)
    assert (rows[new] == np.arange(len(new))).all() and (np.delete(rows, new) < 0).all() and (rows == table.CLASH).any()


def test_records_of_confusable_words(spark):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    data = [(i, w) for i, w in enumerate([*thue_morse(1024), *thue_morse(2048), "q" * 5000, "a b"])]
    got = rows(records.encoded_documents(documents(spark, data), path, 2), "doc_id", "n_tokens", "ids_crc32")
    ids = [[*library.encode(t, add_special_tokens=False).ids, 2] for _, t in data]
    assert got == [(i, len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for i, v in enumerate(ids)]
