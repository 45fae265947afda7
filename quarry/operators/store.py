"""Chunk tables, the content-addressed store, the metadata graph, tiers and placement, as DataFrame operators."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import cdc, columns, digest


def chunk_table(streams: DataFrame, key: str, payload: str, options: cdc.ChunkOptions, emit_payload: bool = False, hash_: str = "sha256") -> DataFrame:
    """key, seq, offset, length, hash (sha256, blake3 or none) and, if wanted, payload: one row per chunk. Without payloads, only digests leave
    the Python workers; an empty stream has no chunk, a null one neither."""
    kind = dict(streams.dtypes)[key]
    hashed = {"sha256": lambda b: hashlib.sha256(b).digest(), "blake3": lambda b: digest.blake3(bytes(b)), "none": lambda b: None}[hash_]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                seq, offset, length, hashes, pieces, count = [], [], [], [], [], []
                for data in part.column(1):
                    data = memoryview(data.as_buffer()) if data.is_valid else b""
                    cuts = np.array(cdc.cut_lengths(data, options), dtype=np.int64) if len(data) else np.zeros(0, np.int64)
                    ends = np.cumsum(cuts)
                    count.append(len(cuts))
                    seq.append(np.arange(len(cuts), dtype=np.int32))
                    offset.append(ends - cuts)
                    length.append(cuts)
                    parts = [data[s:e] for s, e in zip((ends - cuts).tolist(), ends.tolist(), strict=True)]
                    hashes += map(hashed, parts)
                    if emit_payload:
                        pieces += map(bytes, parts)
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), count), pa.int32()))
                out = [keys, *(pa.array(np.concatenate(c)) for c in (seq, offset, length)), pa.array(hashes, pa.binary())]
                names = [key, "seq", "offset", "length", "hash", "payload"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(pieces, pa.binary())] * emit_payload, names=names[: 5 + emit_payload])

    return streams.select(key, F.col(payload).alias("payload")).mapInArrow(work, f"{key} {kind}, seq int, offset long, length long, hash binary" + ", payload binary" * emit_payload)


#: Tasks of rows that are dealt out, if that gives every core two at least: more would cost more than they even out.
SHARES = 48


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly to all cores: a file of narrow rows is read by few tasks, however much work a row is.
    The number is given, so that small shares are not put together again."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, min(SHARES, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def hash_jobs(jobs: DataFrame) -> DataFrame:
    """index, offset, length, digest of jobs(index, offset, data), in order of index, however workers finish."""
    return jobs.select("index", "offset", F.octet_length("data").cast("long").alias("length"), columns.sha256_raw(F.col("data")).alias("digest")).orderBy("index")


def compression_jobs(jobs: DataFrame, codec: str = "zstd", level: int | None = None) -> DataFrame:
    """index, compressed of jobs(index, data), in order of index. Payloads are compressed before they are sorted."""
    return jobs.select("index", columns.compress(codec, level)("data").alias("compressed")).orderBy("index")


def dedup_summary(chunks: DataFrame) -> DataFrame:
    """refs, unique chunks, logical and physical bytes. Counted by hash first, so no distinct set is gathered."""
    by = chunks.groupBy("hash").agg(F.count("*").alias("refs"), F.first("length").alias("length"))
    return by.agg(F.sum("refs").alias("refs"), F.count("*").alias("unique_chunks"), F.sum(F.col("refs") * F.col("length")).alias("logical_bytes"), F.sum("length").alias("physical_bytes"))


def put_objects(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new(id, ...) that store does not have, once each: what a put appends."""
    return new.dropDuplicates(["id"]).join(store.select("id"), "id", "left_anti")


def get_verified(wanted: DataFrame, store: DataFrame, recompute: Column) -> DataFrame:
    """wanted(id) with payload and status: ok, integrity (bytes do not have the id) or missing."""
    got = wanted.join(store, "id", "left")
    return got.withColumn("status", F.when(F.col("payload").isNull(), "missing").when(recompute == F.col("id"), "ok").otherwise("integrity"))


def reassemble(chunks: DataFrame, key: str) -> DataFrame:
    """key and its payload, chunks in order of seq."""
    return chunks.groupBy(key).agg(F.expr("coalesce(listagg(payload) within group (order by seq), x'')").alias("payload"))


def contains(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted(id) with held: whether the store has it."""
    return wanted.join(store.select("id").distinct().withColumn("held", F.lit(True)), "id", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def delete_objects(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without gone(id); ids that it does not have change nothing."""
    return store.join(gone.select("id"), "id", "left_anti")


def decode_ids(blob: Column) -> Column:
    """ids and error of a manifest's bytes, its 32-byte ids in order; null bytes (an unknown manifest) give null ids."""
    n = F.octet_length(blob)
    ids = F.transform(F.when(n > 0, F.sequence(F.lit(0), (n / 32).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.substring(blob, k * 32 + 1, F.lit(32)))
    error = F.when(n % 32 != 0, F.concat(F.lit("corrupt_manifest "), n.cast("string")))
    return F.struct(F.when(blob.isNotNull() & error.isNull(), ids).alias("ids"), error.alias("error"))


def get_manifests(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    """manifest, ids, status of wanted(manifest): ok, unknown, or the error of its bytes in manifests(manifest, blob)."""
    got = wanted.join(manifests.select("manifest", decode_ids(F.col("blob")).alias("x"), F.lit(True).alias("there")), "manifest", "left")
    return got.select("manifest", "x.ids", F.when(F.col("there").isNull(), "unknown").otherwise(F.coalesce("x.error", F.lit("ok"))).alias("status"))


def refcount_of(wanted: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    """chunk, refcount of wanted(chunk): 0 where no manifest names it."""
    return wanted.join(refcounts(manifest_chunks), "chunk", "left").withColumn("refcount", F.coalesce("refcount", F.lit(0).cast("long")))


def tiered_put(new: DataFrame, warm: DataFrame, cold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a put of new(id, payload) appends to the cold tier, which is written first, and then to the warm one."""
    return put_objects(cold, new), put_objects(warm, new)


def refcounts(manifest_chunks: DataFrame) -> DataFrame:
    """chunk, refcount: per occurrence in manifest_chunks(manifest, chunk)."""
    return manifest_chunks.groupBy("chunk").agg(F.count("*").alias("refcount"))


def put_manifests(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new(manifest, seq, chunk) whose manifest is not known yet; what is put again changes nothing."""
    return new.join(existing.select("manifest").distinct(), "manifest", "left_anti")


def current_roots(log: DataFrame) -> DataFrame:
    """name, manifest of the log (name, manifest, seq): the last write wins; a null manifest removes the root."""
    last = log.groupBy("name").agg(F.max_by(F.struct("manifest"), "seq").alias("x"))
    return last.select("name", "x.manifest").where("manifest is not null")


def reachable(roots: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    """Distinct chunks of manifests that a root names; a root without manifest names none."""
    return manifest_chunks.join(roots.select("manifest").distinct(), "manifest", "left_semi").select("chunk").distinct()


def collectible(tracked: DataFrame, roots: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    return tracked.select("chunk").distinct().join(reachable(roots, manifest_chunks), "chunk", "left_anti")


def tiered_read(wanted: DataFrame, warm: DataFrame, cold: DataFrame) -> DataFrame:
    """id, payload, tier (warm, cold or miss), promote: cold hits are to be added to warm."""
    got = wanted.join(warm.select("id", F.col("payload").alias("w")), "id", "left").join(cold.select("id", F.col("payload").alias("c")), "id", "left")
    tier = F.when(F.col("w").isNotNull(), "warm").when(F.col("c").isNotNull(), "cold").otherwise("miss")
    return got.select("id", F.coalesce("w", "c").alias("payload"), tier.alias("tier"), (tier == "cold").alias("promote"))


MAX_NODES = 10_000


def owners(keys: DataFrame, nodes: list[str], replicas: int, weigh: Callable[[str, bytes], int] = digest.weight) -> DataFrame:
    """key (binary), node, rank: the replicas best nodes by rendezvous weight, ties by name. The members are a
    configuration (at most MAX_NODES), ranked next to each key, so no key is ever repeated per node in a shuffle."""
    members = sorted(set(nodes))
    if len(members) > MAX_NODES:
        raise ValueError(f"{len(members)} nodes; at most {MAX_NODES}")

    @F.pandas_udf("array<string>")
    def rank(key: pd.Series) -> pd.Series:
        return key.map(lambda k: heapq.nsmallest(replicas, members, key=lambda n: (-weigh(n, k), n)))

    return keys.select("key", F.posexplode(rank("key")).alias("rank", "node")).withColumn("rank", F.col("rank") + 1)


def plan_placement(resources: DataFrame, objectives: DataFrame, domain: bytes = digest.DOMAIN) -> DataFrame:
    """class, position, id, region, zone: the plan of every feasible objective(class, replicas, min_regions, min_zones,
    require_archive) over resources(id, region, zone, backend): an archive first if required, then the best resource
    of each new region, then of each new zone, then by rank."""
    first = Window.partitionBy("id").orderBy("region", "zone", "backend")
    r = resources.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    key = columns.content_id("chunk", domain)(columns.utf8(F.col("class")))

    @F.pandas_udf("binary")
    def weigh(id_: pd.Series, key_: pd.Series) -> pd.Series:
        return pd.Series([digest.weight(i, k).to_bytes(8, "big") for i, k in zip(id_, key_, strict=True)])

    stats = r.agg(F.count("*").alias("n"), F.countDistinct("region").alias("regions"), F.countDistinct("region", "zone").alias("zones"), F.max(F.col("backend") == "archive").alias("archive"))
    ok = objectives.join(F.broadcast(stats)).where("replicas between 1 and n and min_regions between 1 and least(replicas, regions) and min_zones between 1 and least(replicas, zones) and (archive or not require_archive)")
    # a catalogue of resources and classes is configuration, small on both sides
    c = ok.withColumn("key", key).join(F.broadcast(r)).withColumn("w", weigh("id", "key"))
    by = Window.partitionBy("class")
    rank = lambda *part: F.row_number().over(Window.partitionBy("class", *part).orderBy(F.desc("w"), "id"))
    c = c.withColumn("rank", rank())
    top = F.min(F.when(F.col("require_archive") & (F.col("backend") == "archive"), F.col("rank"))).over(by)
    c = c.withColumn("phase", F.when(F.col("rank") == top, 0))
    used = lambda part, phase: F.max(F.col("phase") <= phase).over(Window.partitionBy("class", *part))
    for phase, part, least in ((1, ["region"], "min_regions"), (2, ["region", "zone"], "min_zones")):
        count = F.count("phase").over(by) if phase == 1 else F.size(F.collect_set(F.when(F.col("phase").isNotNull(), F.struct(*part))).over(by))
        fresh = F.col("phase").isNull() & ~F.coalesce(used(part, phase), F.lit(False))
        c = c.withColumn("have", count).withColumn("fresh", fresh)
        c = c.withColumn("lead", F.when(F.col("fresh"), F.min(F.when(F.col("fresh"), F.col("rank"))).over(Window.partitionBy("class", *part)) == F.col("rank")))
        turn = F.sum(F.when(F.col("lead"), 1).otherwise(0)).over(by.orderBy("rank"))
        c = c.withColumn("phase", F.coalesce("phase", F.when(F.col("lead") & (turn <= F.col(least) - F.col("have")), phase)))
    place = F.row_number().over(by.orderBy(F.coalesce("phase", F.lit(3)), "rank"))
    return c.withColumn("position", place).where("position <= replicas").select("class", "position", "id", "region", "zone")
