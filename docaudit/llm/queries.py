"""The registered queries of this package and their DuckDB text: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docaudit.llm import chunks, embeddings, language, lines, minhash, mixing, pieces, pii, prefix_trie, quality, records, runs, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are; OWN_TOKENIZERS names another folder."""
    folder = os.environ.get("OWN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_pieces")
def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return done.select("doc_id", "n_pieces", "ids", "text_sha256", "round_trip")


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query(
    "op5_line_dedup",
    rf"""
    with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    lines as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from docs),
    keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as k from lines),
    firsts as (select k, min(doc_id) as low, max(doc_id) as high from keyed where length(k) >= 10 group by k having low <> high),
    marked as (select keyed.*, firsts.low is not null and firsts.low <> doc_id as gone from keyed left join firsts using (k))
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
      sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
    from marked group by doc_id
    """,
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op6_records")
def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encoded_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


@query(
    "op7_embeddings",
    """
    with recursive parts as (
      select vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))) as norm from embeddings
      where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda v: v is not null and isfinite(v)))),
    good as (select vec_id, label, list_transform(embedding, lambda v: v::double / norm) as u from parts where norm > 0),
    links as (
      select a.vec_id as x, b.vec_id as y from good a join good b on a.label = b.label and a.vec_id <> b.vec_id
      where list_inner_product(a.u, b.u) >= 0.98),
    reach(v, c) as (select vec_id, vec_id from embeddings union select l.y, r.c from reach r join links l on l.x = r.v)
    select e.vec_id, (select count(*) from links where x = e.vec_id) as n_links, min(r.c) as component_id, e.vec_id = min(r.c) as kept
    from embeddings e join reach r on r.v = e.vec_id group by e.vec_id
    """,
)
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


@query(
    "op8_exact_dedup",
    f"""
    with norm as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents)
    select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
      doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
    from norm
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


@query("op10_minhash")
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, percent=85)


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), limit=4096)


@query(
    "op12_prefix_trie",
    r"""
    with clean as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations where conv_id is not null),
    coded as (select conv_id, turn, sha256(strlen(r) || ':' || r || t) as k, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w from clean),
    given as (select conv_id, list({'k': k, 'w': w} order by turn nulls first, k[:32]) as turns from coded group by conv_id),
    bytes as (select conv_id, turns, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0])) as steps from given),
    crc as (select conv_id, turns, xor(list_reduce(steps, lambda c, e: xor(xor(c, e) >> 1, case when xor(c, e) % 2 = 1 then 3988292384 else 0 end), 4294967295::bigint), 4294967295) % 4 as h from bytes),
    rebuilt as (
      select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
      from crc c left join given b on b.conv_id = c.conv_id - c.conv_id % 20),
    prefixes as (select conv_id, unnest(range(0, len(turns) + 1)) as d, turns from rebuilt),
    named as (select conv_id, d, turns[1:d] as p, d = len(turns) as ends from prefixes),
    nodes as (
      select p, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
      from named group by p, d),
    kids as (select p[1:d - 1] as p, d - 1 as d, count(*) as n_children from nodes where d > 0 group by 1, 2),
    full_nodes as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.p = n.p and k.d = n.d),
    above as (select p, d, n_convs, n_children, unnest(range(0, d + 1)) as a from full_nodes),
    folded as (
      select p[1:a] as p, a as d, count(*) filter (n_children = 0) as n_leaves, sum(case when d = 0 then 0 else (n_convs - 1) * p[d].w end) as saved_tokens
      from above group by 1, 2)
    select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children::bigint as n_children, f.n_leaves, f.saved_tokens::bigint as saved_tokens, n.ends_sha256
    from full_nodes n join folded f on f.p = n.p and f.d = n.d left join nodes u on n.d > 0 and u.p = n.p[1:n.d - 1] and u.d = n.d - 1
    """,
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)
