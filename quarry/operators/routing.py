"""Nodes that put and get whole files, routed reads and writes between them, and repair, as DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import cdc, columns, digest
from quarry.operators import store


def blob_url(node: Column, id_: Column) -> Column:
    """Where a peer serves the object with this binary id."""
    return F.concat(F.rtrim(node, F.lit("/")), F.lit("/swarm/blob/"), columns.hex_lower(id_))


def node_put(files: DataFrame, options: cdc.ChunkOptions, domain: bytes = digest.DOMAIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """objects(id, payload), manifests(manifest, seq, chunk) and roots(name, manifest) of files(name, payload). The id
    of a manifest is that of its chunk ids in order; an empty file has a manifest without chunks."""
    chunks = store.chunk_table(files, "name", "payload", options, emit_payload=True)
    chunks = chunks.select("name", "seq", columns.content_id("chunk", domain)("payload").alias("chunk"), "payload")
    objects = chunks.groupBy("chunk").agg(F.first("payload").alias("payload")).withColumnRenamed("chunk", "id")
    lists = chunks.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("chunks"))
    lists = files.select("name").distinct().join(lists, "name", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<seq:int,chunk:binary>>")))
    body = F.aggregate("chunks", F.lit(b""), lambda a, x: F.concat(a, x["chunk"]))
    lists = lists.withColumn("manifest", columns.content_id("level1", domain)(body))
    manifests = lists.dropDuplicates(["manifest"]).select("manifest", F.explode("chunks").alias("x")).select("manifest", "x.seq", "x.chunk")
    return objects, manifests, lists.select("name", "manifest")


def node_get(names: DataFrame, roots: DataFrame, manifests: DataFrame, objects: DataFrame, domain: bytes = digest.DOMAIN) -> DataFrame:
    """name, payload, status of names(name): ok, unknown (no such root), integrity (a chunk is not what its id says) or
    missing_chunk with the id of the first one that is absent."""
    known = names.join(roots, "name", "left")
    parts = known.join(manifests, "manifest").join(objects.withColumnRenamed("id", "chunk"), "chunk", "left")
    good = columns.content_id("chunk", domain)("payload") == F.col("chunk")
    # checked before parts are gathered, so that no Python function runs on whole files
    parts = parts.select("name", "seq", "chunk", "payload", F.when(F.col("payload").isNull(), "missing").when(~good, "integrity").alias("bad"))
    whole = F.expr("listagg(payload) within group (order by seq)")
    first = F.min(F.when(F.col("bad").isNotNull(), F.struct("seq", "bad", "chunk")))
    got = parts.groupBy("name").agg(whole.alias("payload"), first.alias("first"))
    status = F.when(F.col("manifest").isNull(), "unknown").when(F.col("first.bad") == "missing", F.concat(F.lit("missing_chunk "), columns.hex_lower(F.col("first.chunk")))).when(F.col("first.bad").isNotNull(), "integrity").otherwise("ok")
    out = known.join(got, "name", "left").withColumn("status", status)
    return out.select("name", F.when(F.col("status") == "ok", F.coalesce("payload", F.lit(b""))).alias("payload"), "status")


def is_owner(keys: DataFrame, nodes: list[str], replicas: int, me: str) -> DataFrame:
    """key, owner: whether node me is among the owners of each key."""
    return store.owners(keys, nodes, replicas).groupBy("key").agg(F.bool_or(F.col("node") == me).alias("owner"))


def replica_targets(keys: DataFrame, nodes: list[str], replicas: int, me: str, weigh: Callable[[str, bytes], int] = digest.weight) -> DataFrame:
    """key, node: the other owners, to which a node sends what it has put; it keeps its own copy, owner or not."""
    return store.owners(keys, nodes, replicas, weigh).where(F.col("node") != me).select("key", "node")


def routed_put(new: DataFrame, nodes: list[str], replicas: int, me: str, failing: list[str] = (), weigh: Callable[[str, bytes], int] = digest.weight) -> DataFrame:
    """id, node, status of new(id): durable on node me, then replicated or failed on every other owner. A replica that
    fails does not fail the put; repair() finds it later."""
    own = new.select("id", F.lit(me).alias("node"), F.lit("durable").alias("status"))
    there = replica_targets(new.select(F.col("id").alias("key")), nodes, replicas, me, weigh)
    status = F.when(F.col("node").isin(list(failing)), "failed").otherwise("replicated")
    return own.unionByName(there.select(F.col("key").alias("id"), "node", status.alias("status")))


def routed_get(wanted: DataFrame, local: DataFrame, peers: DataFrame, nodes: list[str], replicas: int, me: str, failing: list[str] = (), weigh: Callable[[str, bytes], int] = digest.weight) -> DataFrame:
    """id, payload, source (local, a node, or null), status (ok, missing, or error) and promote (to be added to local)
    of wanted(id, binary), from local(id, payload) and peers(node, id, payload). Owners are asked in order, but for
    node me; a failing one that is met before an answer makes the read an error."""
    misses = wanted.select("id").distinct().join(local.select("id"), "id", "left_anti")
    asked = store.owners(misses.select(F.col("id").alias("key")), nodes, replicas, weigh).where(F.col("node") != me)
    asked = asked.select(F.col("key").alias("id"), "rank", "node", F.col("node").isin(list(failing)).alias("failed"))
    # who answers is settled on ids alone; only the answers are joined to payloads
    held = peers.select("id", "node").distinct().withColumn("held", F.lit(True))
    asked = asked.join(held, ["id", "node"], "left").where("failed or held")
    answer = asked.groupBy("id").agg(F.min_by(F.struct("node", "failed"), "rank").alias("x")).select("id", "x.node", "x.failed")
    there = peers.dropDuplicates(["id", "node"]).select("id", "node", F.col("payload").alias("theirs"))
    answer = answer.join(there, ["id", "node"], "left")
    out = wanted.join(local.select("id", F.col("payload").alias("own"), F.lit(True).alias("here")), "id", "left").join(answer, "id", "left")
    peer = F.col("failed") == F.lit(False)
    status = F.when(F.col("here") | peer, "ok").when(F.col("failed"), "error").otherwise("missing")
    source = F.when(F.col("here"), "local").when(F.col("failed").isNotNull(), F.col("node"))
    return out.select("id", F.when(F.col("here"), F.col("own")).when(peer, F.col("theirs")).alias("payload"), source.alias("source"), status.alias("status"), F.coalesce(peer, F.lit(False)).alias("promote"))


def repair(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """key, node, finding (missing, corrupt or misplaced) and replication (under, over or exact, by good copies) for all
    that differs between desired(key, node) and observed(key, node, good)."""
    both = desired.withColumn("want", F.lit(True)).join(observed.withColumn("have", F.lit(True)), ["key", "node"], "full")
    finding = F.when(F.col("have").isNull(), "missing").when(~F.col("good"), "corrupt").when(F.col("want").isNull(), "misplaced")
    both = both.withColumn("finding", finding)
    counts = both.groupBy("key").agg(F.count("want").alias("wanted"), F.count_if(F.coalesce(F.col("have") & F.col("good"), F.lit(False))).alias("copies"))
    level = F.when(F.col("copies") < F.col("wanted"), "under").when(F.col("copies") > F.col("wanted"), "over").otherwise("exact")
    return both.where("finding is not null").join(counts.select("key", level.alias("replication")), "key").select("key", "node", "finding", "replication")
