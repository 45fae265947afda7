"""The corpus pipeline: documents, through five stages, to packed token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, mixing, packing, quality, suffix
from quarry.llm.common import Scratch, scratch_root, small, table


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. The verdict belongs to the text, so equal rows share it; rows that
    share doc_id, or have none, are judged each by their own text."""
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    gone = quality.judge_quality(docs.select(key.alias("doc_id"), "text")).where(~F.col("keep"))
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("crc").alias("__crc")).distinct()
    return docs.join(small(gone.checkpoint()), (key == F.col("__gone")) & (F.crc32(F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")) == F.col("__crc")), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, the one with the smallest doc_id; rows that are linked with nothing stay. Every
    row is judged by its own text, also where rows share doc_id or have none: such rows count as documents of their own,
    behind those with a doc_id of their own. Of rows that share doc_id (or have none) and text, one stays, the smallest
    by all columns."""
    scratch_root(spark)  # names the folder of checkpoints
    id_ = docs["doc_id"].cast("long")
    ids = docs.groupBy(id_.alias("__shared")).count().where("count > 1 or __shared is null").select("__shared").checkpoint()
    if ids.isEmpty():
        gone = jaccard.near_duplicates(docs).where("component_id < doc_id").select(F.col("doc_id").alias("__gone"))
        return docs.join(small(gone.checkpoint()), id_ == F.col("__gone"), "left_anti")
    shared = small(ids.where("__shared is not null"))
    own = docs.join(shared, id_ == F.col("__shared"), "left_anti").where(id_.isNotNull())
    odd = _once(docs.join(shared, id_ == F.col("__shared"), "left_semi").unionByName(docs.where(id_.isNull())))
    # numbers behind all doc_ids, in a table of their own so that they stay the same
    top = docs.agg(F.coalesce(F.max(id_), F.lit(0).cast("long"))).first()[0]
    numbers = odd.select("__key", "doc_id").orderBy(F.col("doc_id").asc_nulls_last(), "__key")
    numbers = numbers.select("__key", (F.monotonically_increasing_id() + top + 1).alias("__row")).checkpoint()
    rows = own.withColumn("__row", id_).unionByName(odd.join(numbers, "__key").drop("__key"))
    gone = jaccard.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).where("component_id < doc_id")
    gone = small(gone.select(F.col("doc_id").alias("__gone")).checkpoint())
    return rows.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out; a document of which nothing is left goes."""
    return suffix.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    taken = mixing.mix(docs).where("copies > 0")
    copies = taken.select(F.col("row_hash").alias("__hash"), F.col("doc_id").alias("__doc"), F.col("copies").alias("__copies")).distinct()
    rows = docs.withColumn("__own", mixing.row_hash(F.col("doc_id").cast("long"), F.col("source"), F.col("text")))
    rows = rows.join(copies, (F.col("__own") == F.col("__hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return packing.pack_sequences(docs)


def _once(docs: DataFrame) -> DataFrame:
    """docs with __key, which tells doc_id and text, and one row of each; only repeated ones are shuffled whole."""
    name = lambda x: F.coalesce(x, F.lit("null"))
    key = F.concat_ws(" ", name(F.col("doc_id").cast("long").cast("string")), name(F.sha2(F.col("text"), 256))).alias("__key")
    keyed = docs.select(key, F.struct(*docs.columns).alias("__row"))
    repeated = keyed.groupBy("__key").count().where("count > 1").select("__key").checkpoint()
    one = keyed.join(repeated, "__key", "left_semi").groupBy("__key").agg(F.min("__row").alias("__row"))
    return keyed.join(repeated, "__key", "left_anti").unionByName(one).select("__key", "__row.*")


STAGES = [
    ("quality classifier", drop_bad_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]
#: SQL can express neither the classifier nor the genetic algorithm; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for k, (_, stage) in enumerate(STAGES):
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
            if k:
                scratch.remove(f"stage{k - 1}")
        return scratch.finish(docs)
