import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from docaudit.llm import token_counts
from docaudit.llm.queries import tokenizer_file
from tests.llm.helpers import documents, rows

PATH = tokenizer_file("piece_bpe_32k.model")
AWKWARD = [
    None, "", " ", "  ", "\n", "\n\n", " \n ", "a\n b", "a \nb\n", "\nword", "a\n\nword word", "▁", "a▁b", "▁▁ a", "<s> </s> <unk>", "<0x0A>", "日本語の文章です", "x" * 3000,
    "\r\n\t tab", "éà ü ß", "a\x00b", "many   blanks      here", "word " * 5000, "🙂🙂 🙂", "a  ", "Hello, World! 12345",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r\t▁é日<s>/", max_size=40), max_size=5))
def test_counts_of_a_block(texts):
    own = token_counts.counter(PATH)
    own.memo.clear()
    frequent = token_counts.Lengths(8)
    units = [b"a", b"b", b" a", b"\nb", "é".encode()]
    raw, ends = np.frombuffer(b"".join(units), np.uint8), np.cumsum([len(u) for u in units])
    starts = np.concatenate([[0], ends[:-1]])
    frequent.keep(token_counts.T.word_hashes(raw, starts, ends), raw, starts, ends, own.sizes(raw, starts, ends))
    expected = [len(own._library.encode(t)) for t in texts]
    assert own.splits
    for table in (None, frequent):
        assert own.count(pa.array(texts, pa.string()), table).tolist() == expected


def test_whole_texts_where_pieces_cross_borders(library):
    own = token_counts.TokenCounter(PATH)
    own.splits = False
    texts = [t or "" for t in AWKWARD]
    assert own.count(pa.array(texts)).tolist() == [len(library.encode(t)) for t in texts]


def test_count_tokens(spark, library):
    data = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "without id"), (3, "repeated id"), (3, "repeated id")] + [(100 + i, f"common words of a row {i % 7}") for i in range(300)]
    found = token_counts.count_tokens(documents(spark, data), PATH, limit=4)
    plain = [(d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4) for d, t in data]
    assert rows(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(plain, key=lambda t: tuple((v is not None, v) for v in t))
    assert token_counts.count_tokens(documents(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.counter("vocabulary.txt")


def test_frequent_table_holds_the_frequent(spark, library):
    data = [(i, "the same words again and again " * 3 + f"rare{i}") for i in range(200)]
    table = token_counts.frequent_lengths(documents(spark, data), PATH)
    held = {table.span(i).decode(): int(v) for i, v in enumerate(table.values)}
    assert held == {w: len(library.encode(w)) for w in ("the", "same", "words", "again", "and")}


def test_frequent_table_counts_whole_texts(spark, library):
    """Words far behind the first megabyte of a partition, and those of any partition, are counted."""
    late = documents(spark, [(1, "early " * 200_000 + "later later")]).coalesce(1)
    table = token_counts.frequent_lengths(late, PATH)
    assert {table.span(i).decode(): int(v) for i, v in enumerate(table.values)} == {w: len(library.encode(w)) for w in ("early", "later")}
    many = spark.range(40).selectExpr("id as doc_id", "concat('odd', id, ' odd', id) as text").repartitionByRange(40, "doc_id")
    table = token_counts.frequent_lengths(many, PATH)
    assert {table.span(i).decode() for i in range(table.n)} == {f"odd{i}" for i in range(40)}


def test_frequent_table_of_a_full_count(spark, library, monkeypatch):
    """A task that hands its counts on several times counts the same."""
    monkeypatch.setattr(token_counts, "COUNTED", 8)
    monkeypatch.setattr(token_counts, "HANDED_ROWS", 3)
    words = [f"word{i}" for i in range(100)]
    table = token_counts.frequent_lengths(documents(spark, [(i, " ".join(words + words)) for i in range(3)] + [(9, None)]), PATH)
    assert {table.span(i).decode(): int(v) for i, v in enumerate(table.values)} == {w: len(library.encode(w)) for w in words}


def test_sampled_partitions_are_few_and_spread():
    taken = [i for i in range(1 << 20) if token_counts._sampled(i)]
    assert len(taken) == 16 + 8 * 16 and taken[-1] > 0.9 * (1 << 20)
