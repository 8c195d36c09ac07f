"""A corpus pipeline from the operators of docaudit.llm.

Language ID, exact dedup, MinHash near-dedup, mixing to target weights, piece encoding. Every stage takes
(spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and reread as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docaudit.llm import chunks, language, minhash, mixing, pieces
from docaudit.llm.common import fresh, id_column, ready, store
from docaudit.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text has no letter or lies too far from every centroid.

    Learns from the stage's own input, without the documents held out by their id. Rows are judged one by one, so null and
    repeated ids and repeated rows each keep or lose their own row; a null or empty text has no letter. Columns of any
    other name pass through. An empty table gives an empty result.
    """
    model = language.fit(docs.where(~language.held_out()))
    found = fresh(docs, "language")
    return language.with_language(docs, model, found).where(~F.col(f"{found}.rejected")).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a null text is empty, null ids come last, and of rows that
    repeat the id one stays."""
    kept = chunks.exact_duplicates(docs).where("kept").select("doc_id", "text_sha256").distinct()
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256)
    id_, sha_ = fresh(docs, "kept_id"), fresh(docs, "kept_sha256")
    named = kept.select(id_column().alias(id_), F.col("text_sha256").alias(sha_))
    found = docs.join(named, (id_column() == F.col(id_)) & (sha == F.col(sha_)), "inner")
    # A row repeated whole, id included, is one document; the join has already put such rows together.
    return found.dropDuplicates([id_, sha_]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity 0.8 or more) the one with the smallest doc_id stays.

    Rows without an id get numbers above every id for this stage, so of near copies without one a single row stays too, and
    an id goes before none. Of rows that repeat an id all stay or go together, judged by their smallest text. Texts without
    words are linked with nothing and stay.
    """
    number, row = fresh(docs, "row_number"), fresh(docs, "row_digest")
    known = docs.where("doc_id is not null")
    highest = known.agg(F.max("doc_id")).first()[0] or 0
    # A number is a digest of the text, so whichever task makes it, it is the same; rows that share one are exact copies.
    room = min(2**62, 2**63 - 2 - max(highest, 0))
    ids = F.coalesce(F.col("doc_id"), F.lit(max(highest, 0)) + 1 + F.pmod(F.xxhash64(F.lit(5), F.coalesce("text", F.lit(""))), F.lit(room)))
    numbered = docs.withColumn(number, ids)
    judged = minhash.near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text"), words_per_shingle=5, percent=80)
    dropped = store(judged.where("not kept and doc_id is not null").select(F.col("doc_id").alias(row)).distinct())
    return numbered.join(dropped, F.col(number) == F.col(row), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Rows meet their number of copies by id, source and size; of rows that share all three, as many copies are written as the
    mix takes of them together, the first rows (by a digest of the text) getting what is left over. Null ids, texts and
    sources are values like others.
    """
    key = [fresh(docs, n) for n in ("mixed_id", "mixed_source", "mixed_size")]
    own = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")]
    sums, rows_, place, copy = (fresh(docs, n) for n in ("times_sum", "rows", "place", "copy"))
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2])).agg(
        F.sum("times").alias(sums), F.count("*").alias(rows_)
    )
    named = store(taken.where(F.col(sums) > 0))

    def met(keys: DataFrame) -> DataFrame:
        return docs.join(keys, own[0].eqNullSafe(F.col(key[0])) & own[1].eqNullSafe(F.col(key[1])) & (own[2] == F.col(key[2])))

    counted = met(named.where(F.col(rows_) == 1)).withColumn(copy, F.col(sums))
    several = named.where(F.col(rows_) > 1)
    if not several.isEmpty():  # nearly every key is one row; only the others are numbered
        order = Window.partitionBy(*key).orderBy(F.xxhash64("text"))
        share = F.floor(F.col(sums) / F.col(rows_)) + (F.col(place) <= F.col(sums) % F.col(rows_)).cast("long")
        counted = counted.unionByName(met(several).withColumn(place, F.row_number().over(order)).withColumn(copy, share).drop(place))
    return counted.where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int")))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row that is left, row by row: repeated rows and ids give repeated results, a null text counts as
    empty, other columns are left out."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: Centroids, near-duplicates and seeded draws have no SQL text; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored and reread."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
