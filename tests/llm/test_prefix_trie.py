import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as S

from docaudit.llm import prefix_trie
from tests.llm.helpers import rows

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = S.StructType([
    S.StructField("conv_id", S.LongType()), S.StructField("turn", S.LongType()), S.StructField("role", S.StringType()), S.StructField("text", S.StringType()),
    S.StructField("name", S.StringType()), S.StructField("depth", S.StringType()), S.StructField("n", S.StringType()),
])


def table(spark, data):
    return spark.createDataFrame([(*d, "x", "y", "z") for d in data], SCHEMA).repartition(3)


def plain_rebuilt(data):
    own = defaultdict(list)
    for conv_id, turn, role, text in data:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv_id].append(((turn is not None, turn or 0), digest, (role, text)))
    ordered = {c: [t for *_, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in ordered.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = ordered.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain_trie(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, who in members.items():
        weight = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += weight
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    found = [(min(w), len(p), min(members[p[:-1]]) if p else None, len(w), kids[p], leaves[p], saved[p], sha(p)) for p, w in members.items()]
    return sorted(found, key=lambda t: tuple((v is not None, v) for v in t))


def random_data(seed, n=160):
    rng = random.Random(seed)
    data = []
    for c in range(n):
        if rng.random() < 0.1:
            continue  # base conversations may be absent
        kind = rng.random()
        size = rng.choice([1, 2, 3, 5, 9, 30])
        turns = [("user" if i % 2 else "assistant", "common" if kind < 0.4 else rng.choice(["yes", "no no", "", "a b c"])) for i in range(size)]
        if kind > 0.95:
            turns[-1] = (None, None)
        data += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_definition(spark, seed):
    data = random_data(seed)
    data += [(500, None, "user", "first"), (500, None, "user", "first"), (500, 3, "x", None), (500, 1, None, "second"), (None, 1, "user", "no conversation")]
    data += [(510, 2, "user", "tie b"), (510, 2, "user", "tie a"), (2**40 + 7, 0, "é", "ü " * 3000)]
    assert rows(prefix_trie.conversation_trie(table(spark, data)), *COLUMNS) == plain_trie(plain_rebuilt(data))


def test_deep_hot_and_turnless(spark):
    """A caterpillar (a branch at every depth), thousands of copies, and conversations that lose all their turns."""
    data = [(100_000 + 20 * k, i, "u", "spine" if i < k else f"leaf{k}") for k in range(120) for i in range(k + 1)]
    data += [(200_000 + k, i, "u", f"hot {i}") for k in range(1, 2000) if k % 20 for i in range(4)]
    data += [(300_001 + k, 0, "u", "short") for k in range(19)]  # no base: those with h > 0 have no turn left
    assert rows(prefix_trie.conversation_trie(table(spark, data)), *COLUMNS) == plain_trie(plain_rebuilt(data))


def test_empty_and_all_turnless(spark):
    assert prefix_trie.conversation_trie(table(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(table(spark, [(None, 1, "a", "b")])).count() == 0
    ids = [c for c in range(300_001, 300_020) if zlib.crc32(str(c).encode()) % 4]
    data = [(c, 0, "u", "gone") for c in ids]
    assert rows(prefix_trie.conversation_trie(table(spark, data)), *COLUMNS) == plain_trie(plain_rebuilt(data))


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    low, high = prefix_trie.F.col("a"), prefix_trie.F.col("b")
    for r in spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.two_fattest(low, high).alias("f")).collect():
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda v: v & -v)
