"""Service classes, audits of placements, verified reads of published tags, and what may be reclaimed, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import columns, digest
from quarry.operators import manifest

OBJECTIVE = "class string, replicas int, min_regions int, min_zones int, require_archive boolean, deletion string"
#: The four service classes: one region, zone failures survived, the loss of a region survived, two regions and an archive apart.
SERVICE_CLASSES = [
    ("ephemeral", 1, 1, 1, False, "evictable"),
    ("standard", 2, 1, 2, False, "policy"),
    ("premium", 2, 2, 2, False, "versions"),
    ("immutable", 3, 3, 3, True, "locked"),
]


def service_objectives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERVICE_CLASSES, OBJECTIVE)


def placement_findings(keys: DataFrame, copies: DataFrame, resources: DataFrame, objectives: DataFrame) -> DataFrame:
    """key, class, finding: every way in which the copies(key, resource, role) of keys(key, class) miss the objective of
    their class: class (no such one), replicas, regions, zones, archive, or resource (a copy on one that the catalogue does
    not have). Only durable copies on known resources count, each resource once; latency copies never do."""
    # resources and objectives are configuration; a key has at most one durable copy on each resource
    r = F.broadcast(resources.select(F.col("id").alias("resource"), "region", "zone", "backend").dropDuplicates(["resource"]))
    durable = copies.where("role = 'durable'").select("key", "resource").distinct().join(r, "resource", "left")
    by = durable.groupBy("key").agg(
        F.count("region").alias("n"), F.size(F.collect_set("region")).alias("regions"), F.size(F.collect_set(F.when(F.col("region").isNotNull(), F.struct("region", "zone")))).alias("zones"),
        F.count_if(F.coalesce(F.col("backend") == "archive", F.lit(False))).alias("archives"), F.count_if(F.col("region").isNull()).alias("strangers"),
    )
    both = keys.join(F.broadcast(objectives.withColumn("named", F.lit(True))), "class", "left").join(by, "key", "left").fillna(0, ["n", "regions", "zones", "archives", "strangers"])
    short = lambda have, least, what: F.when(F.col(have) < F.col(least), what)
    found = [F.when(F.col("named").isNull(), "class"), short("n", "replicas", "replicas"), short("regions", "min_regions", "regions"), short("zones", "min_zones", "zones")]
    found += [F.when(F.col("require_archive") & (F.col("archives") == 0), "archive"), F.when(F.col("strangers") > 0, "resource")]
    return both.select("key", "class", F.explode(F.array_compact(F.array(*found))).alias("finding"))


def unneeded_moves(before: DataFrame, after: DataFrame, added: list[str], removed: list[str]) -> DataFrame:
    """key, node of after(key, node) that before does not have although node has not joined and no owner of key has left: a
    change of members should move nothing else, so this is empty for rendezvous owners."""
    gone = before.join(after, ["key", "node"], "left_anti").groupBy("key").agg(F.count_if(F.col("node").isin(removed)).alias("freed"))
    new = after.join(before, ["key", "node"], "left_anti").where(~F.col("node").isin(added))
    return new.join(gone.where("freed > 0"), "key", "left_anti").select("key", "node")


def reclaim_verdicts(chunks: DataFrame, references: DataFrame, repairs: DataFrame, now: Column) -> DataFrame:
    """chunk, verdict of chunks(chunk, tombstoned): reclaim, or what protects it first: live (a reference that is not
    deleted), held (a legal hold), retained (a retention period that has not ended), repair (one is due) or no_tombstone.
    references(chunk, deleted, hold, retain_until); a null there counts as not deleted, not held, not retained."""
    yes = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    by = references.groupBy("chunk").agg(yes(~F.coalesce("deleted", F.lit(False))).alias("live"), yes(F.col("hold")).alias("held"), yes(F.col("retain_until") > now).alias("retained"))
    both = chunks.join(by, "chunk", "left").join(repairs.select("chunk").distinct().withColumn("repair", F.lit(True)), "chunk", "left")
    verdict = F.when(F.col("live"), "live").when(F.col("held"), "held").when(F.col("retained"), "retained").when(F.col("repair"), "repair")
    return both.select("chunk", verdict.when(~F.coalesce("tombstoned", F.lit(False)), "no_tombstone").otherwise("reclaim").alias("verdict"))


MAX_ENTRIES = 1 << 20
MAX_BYTES = 1 << 30


def read_published(tags: DataFrame, blobs: DataFrame, entries: DataFrame, objects: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, domain: bytes = digest.DOMAIN) -> DataFrame:
    """tag, payload, status of tags(tag, commit): each step is verified before the next: the commit and the bootstrap
    manifest in blobs(id, payload), limits, the recipe in entries(level1, seq, logical_offset, length, chunk), the chunks
    in objects(id, payload). status is ok or the first step that fails: unknown, commit, level0, limit, chunk_count,
    recipe_<finding>, missing_chunk, integrity or length; payload is null then. Blobs and objects are unique by id.
    Overlays are resolved before, by manifest.resolve_objects."""
    verified = lambda kind: F.col("payload").isNotNull() & (columns.content_id(kind, domain)("payload") == F.col("id"))
    named = lambda ids: ids.where("id is not null").distinct().join(blobs.select("id", "payload"), "id")
    commits = named(tags.select(F.col("commit").alias("id")))
    commits = commits.select(F.col("id").alias("commit"), verified("commit").alias("good"), manifest.commit_fields(F.col("payload")).alias("c")).select("commit", F.lit(True).alias("there"), F.when(F.col("good"), F.col("c.level0")).alias("level0"))
    commits = manifest.settled(commits)  # ids alone, here and below: each step is used by several later ones
    # the id of a bootstrap manifest is taken over all its bytes, its own digest over those before it
    heads = named(commits.select(F.col("level0").alias("id")))
    heads = heads.select(F.col("id").alias("level0"), verified("level0").alias("good"), manifest.level0_fields(F.col("payload"), domain).alias("f")).where("good and f.error is null")
    heads = heads.select("level0", "f.level1", "f.nar_length", "f.chunk_count", ((F.col("f.chunk_count") <= max_entries) & (F.col("f.nar_length") <= max_bytes)).alias("fits"))
    heads = manifest.settled(heads)
    # only recipes within the limits are gathered, and none that has more entries than its manifest says
    recipe = heads.where("fits").select("level0", "level1", "nar_length").join(entries, "level1")
    found = manifest.recipe_findings(recipe.withColumnRenamed("level0", "object")).withColumnRenamed("object", "level0")
    heads = heads.join(found, "level0", "left").withColumn("entries", F.coalesce("entries", F.lit(0))).withColumn("finding", F.when(F.col("entries") == 0, F.when(F.col("nar_length") != 0, "end")).otherwise(F.col("finding")))
    fault = F.when(~F.col("fits"), "limit").when(F.col("entries") != F.col("chunk_count"), "chunk_count").when(F.col("finding").isNotNull(), F.concat(F.lit("recipe_"), "finding"))
    heads = manifest.settled(heads.withColumn("fault", fault).select("level0", "fault"))
    parts = recipe.select("level0", "seq", "length", F.col("chunk").alias("id")).join(heads.where("fault is null").select("level0"), "level0", "left_semi")
    # every chunk is hashed once, however many recipes name it
    held = objects.select("id", "payload").join(parts.select("id").distinct(), "id", "left_semi").withColumn("good", verified("chunk"))
    parts = parts.join(held, "id", "left").withColumn("bad", F.when(F.col("payload").isNull(), "missing_chunk").when(~F.col("good"), "integrity").when(F.octet_length("payload") != F.col("length"), "length"))
    whole = parts.groupBy("level0").agg(F.expr("listagg(payload) within group (order by seq)").alias("payload"), F.min(F.when(F.col("bad").isNotNull(), F.struct("seq", "bad"))).alias("first"))
    heads = heads.join(whole, "level0", "left").select("level0", "payload", F.coalesce("fault", "first.bad", F.lit("ok")).alias("read"))
    out = tags.join(commits, "commit", "left").join(heads, "level0", "left")
    status = F.when(F.col("there").isNull(), "unknown").when(F.col("level0").isNull(), "commit").otherwise(F.coalesce("read", F.lit("level0")))
    return out.withColumn("status", status).select("tag", F.when(F.col("status") == "ok", F.coalesce("payload", F.lit(b""))).alias("payload"), "status")
