"""Prefix trie of conversations, built and read as a Z-fast trie of stored tables.

Every prefix of a conversation has a name: a SHA-256 chain over its turns, cut to 16 bytes. The trie is kept compacted:
a node spans the depths low < d <= depth on which nothing branches or ends, and is found by its handle, the name of its
path at the two-fattest depth of that range (the number there that most powers of two divide).

1. Identical conversations become one key, counted before the shuffle.
2. In rounds every key that is left looks for its exit node by fat binary search: each step joins the names of the keys
   at one depth with the handles, and halves the range of depths; the number of steps is the logarithm of the longest
   conversation. A last join on the next turn tells how far the exit node's span is shared.
3. Spans are cut where keys leave them or end. Of the keys that leave at one place with one turn, a random one is
   inserted as a leaf, all such batches at once; the others go on below it. Every round leaves an expected share of a
   group behind, so rounds grow with the logarithm of the number of keys, not with the depth.
4. Sums over subtrees run along parent links by pointer doubling (partial sums before each shuffle), so their rounds grow
   with the logarithm of the depth.
5. Spans are expanded to one row per depth.

A conversation is a record: 24 bytes per turn of it lie in one row. All else is dealt by name; copies and common turns
are counted before they meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docaudit.llm.common import ready, store

WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
#: Conversation ids of one stretch of this many values are joined to one piece of text before they meet.
ID_BITS = 12


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the (digest, words) of its turns by turn number, null first; equal numbers by digest."""
    ready(conversations.sparkSession)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(whole, 1, 32)).alias("digest"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        ).alias("t"),
    )
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return sorted_.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(given: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations as the contract rebuilds them: the first h turns of conversation c - c % group, then c's own turns after
    its first h, with h = crc32(decimal c) % heads."""
    given = store(given)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = given.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head"))
    found = given.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(base, "base", "left")
    none = F.array().cast(given.schema["turns"].dataType)
    own = F.filter("turns", lambda t, i: i >= F.col("h"))
    return found.select("conv_id", F.concat(F.filter(F.coalesce("head", none), lambda t, i: i < F.col("h")), own).alias("turns"))


def _named(sequences: DataFrame) -> DataFrame:
    """conv_id, name of the whole sequence, names of all its prefixes but the empty one, sums of words up to every depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, names, sums = [], [], []
            for turns in batch.column("turns").to_pylist():
                name, total = ROOT, 0
                own, words = [], [0]
                for turn in turns:
                    name = hashlib.sha256(name + turn["digest"]).digest()[:16]
                    total += turn["words"]
                    own.append(name)
                    words.append(total)
                last.append(name)
                names.append(own)
                sums.append(words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(last, pa.binary()), pa.array(names, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64()))],
                ["conv_id", "name", "names", "sums"],
            )

    return sequences.select("conv_id", "turns").mapInArrow(run, "conv_id long, name binary, names array<binary>, sums array<long>")


def two_fattest(low: Column, high: Column) -> Column:
    """The number in low < f <= high that the highest power of two divides."""
    bit = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bit), bit)


def _or_nothing(key: Column) -> Column:
    """``key``, or for null a value that no name equals and that differs from row to row, so such rows are dealt evenly."""
    return F.coalesce(key, F.concat(F.lit(b"-"), F.col("name")))


_NODE = ["name", "parent", "low", "depth", "span", "sums"]


def _handles(nodes: DataFrame) -> DataFrame:
    """The table that fat binary search asks: handle, and name, low and depth of its node."""
    at = two_fattest(F.col("low"), F.col("depth")) - F.col("low")
    return nodes.select(F.element_at("span", at.cast("int")).alias("handle"), F.col("name").alias("hit"), F.col("low").alias("hit_low"), F.col("depth").alias("hit_depth"))


def _locate(keys: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """``keys`` with ``low`` raised to the depth of the deepest node that is a prefix of the key, and the child ``exit`` of that
    node whose span the key follows up to depth ``m`` (null and ``low`` if there is none)."""
    handles = _handles(nodes)
    rows = keys.withColumn("high", F.col("depth"))
    for _ in range(steps):
        fat = two_fattest(F.col("low"), F.col("high"))
        open_ = F.col("low") < F.col("high")
        rows = rows.withColumn("fat", F.when(open_, fat)).withColumn("probe", _or_nothing(F.get("names", F.col("fat") - 1)))
        hit = F.col("hit").isNotNull()
        whole = F.coalesce(F.get("names", F.col("hit_depth") - 1) == F.col("hit"), F.lit(False))
        low = F.when(whole, F.col("hit_depth")).when(hit, F.col("hit_low")).otherwise(F.col("low"))
        high = F.when(whole, F.col("high")).when(hit, F.col("hit_low")).when(open_, F.col("fat") - 1).otherwise(F.col("high"))
        rows = rows.join(handles, F.col("probe") == F.col("handle"), "left").select("name", "names", "sums", "depth", low.alias("low"), high.alias("high"))
    children = nodes.select(F.col("name").alias("exit"), F.get("span", F.lit(0)).alias("first"), F.col("span").alias("exit_span"))
    found = rows.withColumn("next", _or_nothing(F.get("names", F.col("low")))).join(children, F.col("next") == F.col("first"), "left")
    shared = F.size(F.filter("exit_span", lambda s, i: s == F.get("names", F.col("low") + i)))
    return found.select("name", "names", "sums", "depth", "low", "exit", F.when(F.col("exit").isNull(), F.col("low")).otherwise(F.col("low") + shared).alias("m"))


def _cut(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """``nodes`` with spans cut at the given depths; cuts: exit, depths."""
    own = nodes.join(cuts, F.col("name") == F.col("exit"), "left")
    whole = own.where("depths is null").select(*_NODE)
    ends = own.where("depths is not null").withColumn("to", F.concat(F.sort_array("depths"), F.array("depth")))
    parts = ends.withColumn("from", F.concat(F.array("low"), F.col("to"))).select("*", F.posexplode("to").alias("i", "end")).withColumn("begin", F.get("from", F.col("i")))
    size = F.col("end") - F.col("begin")
    at = F.col("begin") - F.col("low")
    made = parts.select(
        F.get("span", F.col("end") - F.col("low") - 1).alias("name"),
        F.when(at == 0, F.col("parent")).otherwise(F.get("span", at - 1)).alias("parent"),
        F.col("begin").alias("low"), F.col("end").alias("depth"),
        F.slice("span", at + 1, size).alias("span"), F.slice("sums", at + 1, size + 1).alias("sums"),
    )
    return whole.unionByName(made)


def build(keys: DataFrame) -> DataFrame:
    """The compacted nodes below the root: name, parent (ROOT under the root), low, depth, span (names of the depths low + 1 to
    depth), sums (of words from low to depth). keys: distinct name, names, sums, of one turn or more."""
    longest = keys.agg(F.max(F.size("names"))).first()[0] or 0
    steps = int(longest).bit_length()
    pending = keys.select("name", "names", "sums", F.size("names").alias("depth"), F.lit(0).alias("low"))
    nodes: DataFrame | None = None
    seed = 0
    while True:
        if nodes is None:
            found = pending.withColumn("exit", F.lit(None).cast("binary")).withColumn("m", F.col("low"))
        else:
            found = store(_locate(pending, nodes, steps))
        # Keys that end here are in the trie once the cuts are made; the others branch off at m.
        branching = found.where("m < depth").withColumn("next", F.get("names", F.col("m")))
        draw = F.xxhash64(F.lit(seed), "name")
        chosen = branching.groupBy("next").agg(F.min_by(F.struct("name", "names", "sums", "depth", "m"), draw).alias("k")).select("k.*")
        leaves = store(
            chosen.select(
                "name", F.when(F.col("m") == 0, F.lit(ROOT)).otherwise(F.get("names", F.col("m") - 1)).alias("parent"), F.col("m").alias("low"), "depth",
                F.slice("names", F.col("m") + 1, F.col("depth") - F.col("m")).alias("span"),
                F.slice("sums", F.col("m") + 1, F.col("depth") - F.col("m") + 1).alias("sums"),
            )
        )
        if nodes is None:
            nodes = leaves
        else:
            cuts = found.where("exit is not null").groupBy("exit").agg(F.collect_set("m").alias("depths"))
            nodes = store(_cut(nodes, cuts).unionByName(leaves))
        left = branching.join(leaves.select("name"), "name", "left_anti")
        pending = store(left.select("name", "names", "sums", "depth", F.col("m").alias("low")))
        if pending.isEmpty():
            return nodes
        seed += 1


def _doubled(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """``rows`` (name, parent, values, jumps) with every value folded over the subtree of its node.

    sums: how to fold each column, ``sum`` or ``min``. After k rounds a value covers the 2^k generations below a node, and
    its k-th jump leads 2^k generations up. Rows that come with their jumps (an earlier fold's) use them.
    """
    made = "jumps" in rows.columns
    fold = {"sum": F.sum, "min": F.min}
    both = {"sum": lambda x, y: x + F.coalesce(y, F.lit(0)), "min": lambda x, y: F.least(x, y)}
    rest = [c for c in rows.columns if c not in sums]
    if not made:
        none = F.when(F.col("parent") != F.lit(ROOT), F.col("parent"))
        rows, rest = rows.withColumn("jumps", F.array(none)), [*rest, "jumps"]
    k = 0
    while True:
        jump = F.get("jumps", F.lit(k))
        near = rows.where(jump.isNotNull())
        if near.isEmpty():
            return rows
        added = near.groupBy(jump.alias("above")).agg(*(fold[how](c).alias(f"more_{c}") for c, how in sums.items()))
        values = [both[how](F.col(c), F.col(f"more_{c}")).alias(c) for c, how in sums.items()]
        grown = rows.join(added, F.col("name") == F.col("above"), "left").select(*rest, *values)
        if not made:
            far = rows.select(F.col("name").alias("mid"), jump.alias("far"))
            grown = (
                grown.withColumn("mid_", _or_nothing(jump)).join(far, F.col("mid_") == F.col("mid"), "left")
                .withColumn("jumps", F.concat("jumps", F.array("far"))).select(*rest, *sums)
            )
        rows, k = store(grown), k + 1


def _id_digests(ended: DataFrame) -> DataFrame:
    """name and the SHA-256 of its ascending, comma-joined ids; ended: name, conv_id (distinct).

    Ids meet in pieces of at most 2^ID_BITS of them; a task then reads the pieces of a name in order and keeps only the
    state of the hash, so a name may have any number of ids.
    """
    pieces = ended.groupBy("name", F.shiftright("conv_id", ID_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, hashlib.sha256()
        for batch in batches:
            done, digests = [], []
            for other, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if other == name:
                    state.update(b",")
                else:
                    if name is not None:
                        done.append(name)
                        digests.append(state.hexdigest())
                    name, state = other, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), pa.array(digests, pa.string())], ["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["name", "ends_sha256"])

    return pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids").mapInArrow(run, "name binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, turns), the empty one included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Members of a prefix are the sequences that start with it. n_leaves counts the childless prefixes of its subtree, itself
    included; saved_tokens sums (members - 1) * words of the last turn over the subtree; ends_sha256 is of the ascending,
    comma-joined ids of the sequences that end with it. conv_id is unique. A sequence without turns is a member of the
    root alone. An empty table gives an empty result.
    """
    named = store(_named(sequences))
    keys = store(named.groupBy("name").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("names").alias("names"), F.first("sums").alias("sums")))
    nodes = build(keys.where(F.col("name") != F.lit(ROOT)).select("name", "names", "sums"))

    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "name")
    own = keys.select("name", "n", "conv_id")
    counted = (
        nodes.join(own, "name", "left").join(children, "name", "left")
        .select("name", "parent", F.coalesce("n", F.lit(0)).alias("n"), "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.col("n_children").isNull().cast("long").alias("leaves"))
    )
    folded = _doubled(store(counted), {"n": "sum", "conv_id": "min", "leaves": "sum"})
    words = nodes.select("name", (F.element_at("sums", -1) - F.element_at("sums", 1)).alias("words"))
    weighed = store(folded.join(words, "name").withColumn("saved", (F.col("n") - 1) * F.col("words")))
    total = weighed.agg(F.sum("saved"), F.sum(F.when(F.col("parent") == F.lit(ROOT), F.col("leaves"))), F.count(F.when(F.col("parent") == F.lit(ROOT), 1))).first()
    done = _doubled(weighed, {"saved": "sum"})

    ends = store(_id_digests(named.select("name", "conv_id")))
    above = done.select(F.col("name").alias("under"), F.col("conv_id").alias("above"))
    everyone = store(keys.agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")))
    first, turnless = everyone.first()["conv_id"], ends.where(F.col("name") == F.lit(ROOT)).first()

    spans = (
        nodes.withColumn("under", _or_nothing(F.nullif("parent", F.lit(ROOT)))).drop("parent")
        .join(done.drop("parent"), "name").join(above, "under", "left").join(ends, "name", "left")
        .select("*", F.posexplode("span").alias("i", "prefix"))
    )
    last = F.col("i") == F.size("span") - 1
    no_one = hashlib.sha256(b"").hexdigest()
    below = spans.select(
        "conv_id", (F.col("low") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("conv_id")).otherwise(F.coalesce("above", F.lit(first))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.get("sums", F.col("i")) - F.get("sums", F.lit(0)))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(no_one))).otherwise(F.lit(no_one)).alias("ends_sha256"),
    )
    saved, leaves, n_children = total
    root = everyone.where("n is not null").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.lit(n_children).cast("long").alias("n_children"), F.lit(leaves or 1).cast("long").alias("n_leaves"),
        F.lit(saved or 0).cast("long").alias("saved_tokens"), F.lit(turnless["ends_sha256"] if turnless else no_one).alias("ends_sha256"),
    )
    return root.unionByName(below)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of all rebuilt conversations (see ``rebuilt`` and ``prefix_trie``).

    Turns are ordered by turn, null first, equal numbers by a digest of role and text; null role or text counts as empty;
    repeated rows are repeated turns; rows without conv_id belong to no conversation. Other columns are ignored; an empty
    table gives an empty result.
    """
    return prefix_trie(rebuilt(paths(conversations)))
