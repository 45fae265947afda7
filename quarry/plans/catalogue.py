"""The registered queries and, where SQL can express them, their SQL. All run over whole tables and whole texts."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import columns, digest
from quarry.functions.cdc import ChunkOptions
from quarry.operators import lifecycle, manifest, protocol, routing, store
from quarry.plans.chunk_sql import chunks_sql
from quarry.streaming import push

SMALL = ChunkOptions(64, 256, 1024)
SEED = bytes(range(32))
NODES = ["n1", "n2", "n3", "n4"]
_CHUNKS = chunks_sql(SMALL)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))


# ---- chunks
@query(_CHUNKS + 'select doc_id, seq, "offset", length from chunks')
def chunk_boundaries(spark, sf_dir):
    return store.chunk_table(streams(spark, sf_dir), "doc_id", "payload", SMALL).select("doc_id", "seq", "offset", "length")


@query(_CHUNKS + 'select doc_id, seq, "offset", length, hash from chunks')
def chunk_hashes(spark, sf_dir):
    out = store.chunk_table(streams(spark, sf_dir), "doc_id", "payload", SMALL)
    return out.select("doc_id", "seq", "offset", "length", F.lower(F.hex("hash")).alias("hash"))


@query("select doc_id, octet_length(encode(text))::BIGINT as n_bytes, true as contiguous from documents where octet_length(encode(text)) > 0")
def chunk_coverage(spark, sf_dir):
    c = store.chunk_table(streams(spark, sf_dir), "doc_id", "payload", SMALL)
    by = c.groupBy("doc_id").agg(F.sum("length").alias("n_bytes"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("start"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("x"))
    joined = F.forall(F.sequence(F.lit(1), F.size("x")), lambda i: (i == 1) | (F.get("x", i - 1)["offset"] == F.get("x", i - 2)["offset"] + F.get("x", i - 2)["length"]))
    return by.select("doc_id", "n_bytes", (joined & (F.col("start") == 0) & (F.col("end") == F.col("n_bytes"))).alias("contiguous"))


@query("select doc_id, sha256(text) as sha256 from documents where octet_length(encode(text)) > 0")
def chunk_roundtrip(spark, sf_dir):
    c = store.chunk_table(streams(spark, sf_dir), "doc_id", "payload", SMALL, emit_payload=True)
    objects = c.groupBy("hash").agg(F.first("payload").alias("payload"))
    back = c.select("doc_id", "seq", "hash").join(objects, "hash")
    return store.reassemble(back, "doc_id").select("doc_id", F.sha2("payload", 256).alias("sha256"))


@query(_CHUNKS + """, by_hash as (select hash, count(*) as refs, any_value(length) as length from chunks group by 1)
select sum(refs)::BIGINT as refs, count(*) as unique_chunks, sum(refs * length)::BIGINT as logical_bytes, sum(length)::BIGINT as physical_bytes from by_hash""")
def dedup_summary(spark, sf_dir):
    return store.dedup_summary(store.chunk_table(streams(spark, sf_dir), "doc_id", "payload", SMALL))


@query(_CHUNKS + "select length // 64 * 64 as bucket, count(*) as chunks, sum(length)::BIGINT as bytes from chunks group by 1")
def chunk_size_histogram(spark, sf_dir):
    c = store.chunk_table(streams(spark, sf_dir), "doc_id", "payload", SMALL)
    return c.groupBy((F.floor(F.col("length") / 64) * 64).cast("long").alias("bucket")).agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))


def slices(spark, sf_dir, size: int = 512) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                rows = [(u, o // size, x[o : o + size], o + size >= len(x)) for u, x in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True) for o in range(0, len(x or b""), size)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["upload", "slice_no", "data", "is_last"])

    s = streams(spark, sf_dir).select(F.col("doc_id").cast("string").alias("upload"), "payload")
    return s.mapInArrow(cut, "upload string, slice_no long, data binary, is_last boolean")


@query(_CHUNKS + 'select doc_id, seq::BIGINT as seq, "offset", length from chunks')
def push_equals_batch(spark, sf_dir):
    return push.push_chunks_batch(slices(spark, sf_dir), SMALL).select(F.col("upload").cast("long").alias("doc_id"), "seq", "offset", "length")


# ---- scalars
@query("select doc_id, sha256(text) as sha256 from documents")
def sha256_hex(spark, sf_dir):
    return streams(spark, sf_dir).select("doc_id", columns.sha256_hex(F.col("payload")).alias("sha256"))


@query("select doc_id, lower(hex(encode(text))) as hex, base64(encode(text)) as b64 from documents")
def hex_base64(spark, sf_dir):
    return streams(spark, sf_dir).select("doc_id", columns.hex_lower(F.col("payload")).alias("hex"), columns.base64_plain(F.col("payload")).alias("b64"))


def base32_sql(h: str) -> str:
    """SQL for the 52 characters of 32 bytes given as hexadecimal, low index first."""
    byte = f"case when {{}} < 32 then ('0x' || substr({h}, 2 * ({{}}) + 1, 2))::INTEGER else 0 end"
    low, high = byte.format(*["(n * 5) // 8"] * 2), byte.format(*["(n * 5) // 8 + 1"] * 2)
    return f"array_to_string(list_transform(range(0, 52), lambda n: substr('{digest.ALPHABET}', ((((({low}) >> ((n * 5) % 8)) | (({high}) << (8 - (n * 5) % 8)))) & 31)::INTEGER + 1, 1)), '')"


@query(f"with c as (select doc_id, {base32_sql('h')} as f from (select doc_id, sha256(text) as h from documents)) select doc_id, reverse(f) as nix, f as forward from c")
def base32_both(spark, sf_dir):
    h = streams(spark, sf_dir).select("doc_id", F.sha2("payload", 256).alias("h"))
    return h.select("doc_id", columns.nix_base32(F.col("h"), 32).alias("nix"), columns.forward_base32(F.col("h"), 32).alias("forward"))


@query("select doc_id, sha256(text) as nix, sha256(text) as forward from documents")
def base32_roundtrip(spark, sf_dir):
    b = base32_both(spark, sf_dir)
    return b.select("doc_id", F.lower(F.hex(columns.nix_base32_decode()("nix")["data"])).alias("nix"), F.lower(F.hex(columns.forward_base32_decode()("forward")["data"])).alias("forward"))


@query("select page_id, url_encode(url) as segment, replace(url_encode(url), '%2F', '/') as path from pages")
def uri_encode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", columns.uri_encode(F.col("url")).alias("segment"), columns.uri_encode(F.col("url"), True).alias("path"))


@query("select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp from events")
def sigv4_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", columns.sigv4_date(F.col("ts")).alias("stamp"))


def _codec(name: str):
    def f(spark, sf_dir):
        p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("b"))
        p = p.select("page_id", columns.compress(name)("b").alias("z"))
        p = p.select("page_id", columns.codec_of(F.col("z")).alias("codec"), columns.decompress_auto()("z").alias("x"))
        return p.select("page_id", "codec", F.octet_length("x.data").cast("long").alias("n_bytes"), F.sha2("x.data", 256).alias("sha256"))

    f.__name__ = f"codec_roundtrip_{name}"
    return query(f"select page_id, '{name}' as codec, octet_length(encode(html))::BIGINT as n_bytes, sha256(html) as sha256 from pages")(f)


for _name in ("zstd", "lz4", "xz", "bzip2"):
    _codec(_name)


@query("select page_id, case when octet_length(encode(html)) > 3000 then 'decompressed_size_exceeded' end as error from pages")
def bomb_guard(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", columns.compress("zstd")(F.encode("html", "UTF-8")).alias("z"))
    return p.select("page_id", columns.decompress("zstd", 3000)("z")["error"].alias("error"))


# ---- content-addressed store
@query("select min(doc_id) as doc_id, count(*) as copies from documents group by text having count(*) > 1")
def exact_duplicate_docs(spark, sf_dir):
    ids = streams(spark, sf_dir).select("doc_id", columns.content_id()("payload").alias("id"))
    return ids.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


@query("select doc_id, case when first % 11 = 0 then 'missing' when first % 7 = 0 then 'integrity' else 'ok' end as status from (select doc_id, min(doc_id) over (partition by text) as first from documents)")
def cas_get_verified(spark, sf_dir):
    """Texts put once each; of every seventh object the bytes are changed, every eleventh is lost."""
    s = streams(spark, sf_dir).withColumn("id", columns.content_id()("payload"))
    objects = store.put_objects(s.where("false").select("id"), s.groupBy("id").agg(F.min("doc_id").alias("first"), F.any_value("payload").alias("payload")))
    objects = objects.where("first % 11 <> 0").select("id", F.when(F.col("first") % 7 == 0, F.concat(F.lit(b"x"), "payload")).otherwise(F.col("payload")).alias("payload"))
    return store.get_verified(s.select("doc_id", "id"), objects, columns.content_id()("payload")).select("doc_id", "status")


@query("select p_partkey, case when p_partkey % 5 = 0 then 'unknown' when p_partkey % 7 = 0 then 'corrupt_manifest 33' else 'ok' end as status, case when p_partkey % 5 = 0 or p_partkey % 7 = 0 then null else array_to_string(list_transform(range(p_size), lambda i: sha256((p_partkey + i)::VARCHAR)), ' ') end as ids from part")
def manifest_lookup(spark, sf_dir):
    """Manifests as bytes, some absent and some of a wrong length."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("manifest"), "p_size")
    ids = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.sha2((F.col("manifest") + i).cast("string"), 256))
    blob = F.when(F.col("manifest") % 7 == 0, F.lit(bytes(33))).otherwise(F.unhex(F.array_join(ids, "")))
    got = store.get_manifests(p.select("manifest"), p.where("manifest % 5 <> 0").select("manifest", blob.alias("blob")))
    return got.select(F.col("manifest").alias("p_partkey"), "status", F.array_join(F.transform("ids", lambda x: F.lower(F.hex(x))), " ").alias("ids"))


@query("select p_partkey as chunk, (select count(*) from lineitem where l_partkey = p_partkey and l_orderkey % 64 = 0) as refcount from part")
def refcount_lookup(spark, sf_dir):
    """Of chunks that some manifests name and others that none does."""
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"))
    return store.refcount_of(wanted, manifest_chunks(spark, sf_dir).where("manifest % 64 = 0"))


@query("select p_partkey as id, p_partkey % 2 <> 0 as to_cold, p_partkey % 3 <> 0 as to_warm, p_partkey % 2 = 0 and p_partkey % 10 <> 0 as held_cold from part")
def tiered_writes(spark, sf_dir):
    """What puts append to either tier, and what the cold one holds after deletions."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("payload"))
    old = p.where("id % 2 = 0")
    cold, warm = store.tiered_put(p.unionByName(p), p.where("id % 3 = 0"), old)
    out = store.contains(p.select("id"), cold).withColumnRenamed("held", "to_cold")
    out = out.join(store.contains(p.select("id"), warm).withColumnRenamed("held", "to_warm"), "id")
    return out.join(store.contains(p.select("id"), store.delete_objects(old, p.where("id % 10 = 0"))).withColumnRenamed("held", "held_cold"), "id")


@query("select substr(sha256(text), 1, 2) as shard, count(distinct text) as objects from documents group by 1")
def object_shards(spark, sf_dir):
    s = streams(spark, sf_dir).select(F.sha2("payload", 256).alias("id")).distinct()
    return s.groupBy(F.substring_index(columns.object_key(F.col("id")), "/", 1).alias("shard")).agg(F.count("*").alias("objects"))


def manifest_chunks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.col("l_partkey").alias("chunk"))


def roots(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 5").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("manifest"))
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("manifest")


@query("select l_partkey as chunk, count(*) as refcount from lineitem group by 1")
def manifest_refcounts(spark, sf_dir):
    return store.refcounts(manifest_chunks(spark, sf_dir))


_REACH = "select distinct l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey < 5))"


@query(_REACH.replace("l_partkey from", "l_partkey as chunk from"))
def gc_reachable(spark, sf_dir):
    return store.reachable(roots(spark, sf_dir), manifest_chunks(spark, sf_dir))


@query(f"select distinct l_partkey as chunk from lineitem where l_partkey not in ({_REACH})")
def gc_collectible(spark, sf_dir):
    m = manifest_chunks(spark, sf_dir)
    return store.collectible(m, roots(spark, sf_dir), m)


@query("select name, manifest from (select event_type || ':' || user_id as name, arg_max(case when event_type = 'error' and event_id % 2 = 0 then -1 else event_id end, event_id) as manifest from events group by 1) where manifest >= 0")
def roots_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("name"), F.when(~((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)), F.col("event_id")).alias("manifest"), F.col("event_id").alias("seq"))
    return store.current_roots(log)


_PARTS = "select l_partkey as chunk from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_nationkey = {}"


@query(f"{_PARTS.format(1)} intersect {_PARTS.format(2)}")
def shared_chunks(spark, sf_dir):
    def parts(n):
        c = table(spark, sf_dir, "customer").where(F.col("c_nationkey") == n).select("c_custkey")
        o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(c, F.col("o_custkey") == c.c_custkey, "left_semi")
        m = manifest_chunks(spark, sf_dir)
        return m.join(o, m.manifest == o.o_orderkey, "left_semi").select("chunk")

    return parts(1).intersect(parts(2))


@query("select p_partkey as id, case when p_partkey % 3 = 0 or p_partkey % 2 = 0 then p_name end as payload, case when p_partkey % 3 = 0 then 'warm' when p_partkey % 2 = 0 then 'cold' else 'miss' end as tier, p_partkey % 3 <> 0 and p_partkey % 2 = 0 as promote from part")
def tiered_reads(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("payload"))
    return store.tiered_read(p.select("id"), p.where("id % 3 = 0"), p.where("id % 2 = 0"))


# ---- placement
def _keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", columns.content_id()(F.encode(F.col("p_partkey").cast("string"), "UTF-8")).alias("key"))


def _plain_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", columns.utf8(F.col("p_partkey").cast("string")).alias("key"))


def ranks_sql(nodes: list[str]) -> str:
    """Owners by SHA-256 weights; the weight's first byte counts least, so bytes are compared from the eighth down."""
    value = " || ".join(f"substr(h, {2 * i + 1}, 2)" for i in reversed(range(8)))
    return f"""select p_partkey, node, row_number() over (partition by p_partkey order by {value} desc, node)::INTEGER as rank
from (select p_partkey, node, sha256(node || p_partkey) as h from part, (select unnest({nodes!r}) as node))"""


@query(f"select * from ({ranks_sql(NODES)}) where rank <= 3")
def owner_ranks(spark, sf_dir):
    k = _plain_keys(spark, sf_dir)
    return store.owners(k.select("key"), NODES, 3, digest.weight_sha256).join(k, "key").select("p_partkey", "node", F.col("rank").cast("int").alias("rank"))


@query("select p_partkey, 3::BIGINT as owners, 3::BIGINT as nodes from part")
def owner_cardinality(spark, sf_dir):
    k = _keys(spark, sf_dir)
    o = store.owners(k.select("key"), NODES, 3).groupBy("key").agg(F.count("*").alias("owners"), F.countDistinct("node").alias("nodes"))
    return k.join(o, "key").select("p_partkey", "owners", "nodes")


@query(f"select count(*) as keys, count(*) filter (where node = 'n5') as moved, true as all_to_new, 0::BIGINT as unneeded from ({ranks_sql([*NODES, 'n5'])}) where rank = 1")
def remap_fraction(spark, sf_dir):
    k = _plain_keys(spark, sf_dir).select("key")
    a, b = (store.owners(k, n, 1, digest.weight_sha256).select("key", "node") for n in (NODES, [*NODES, "n5"]))
    two = a.withColumnRenamed("node", "a").join(b.withColumnRenamed("node", "b"), "key")
    m = two.agg(F.count("*").alias("keys"), F.count_if(F.col("a") != F.col("b")).alias("moved"), F.bool_and((F.col("a") == F.col("b")) | (F.col("b") == "n5")).alias("all_to_new"))
    return m.crossJoin(lifecycle.unneeded_moves(a, b, ["n5"], []).agg(F.count("*").alias("unneeded")))  # one row each


def catalogue_of_resources(spark):
    r = [("us-a", "us", "a", "object"), ("us-b", "us", "b", "filesystem"), ("eu-a", "eu", "a", "filesystem"), ("eu-b", "eu", "b", "object"), ("vault", "ap", "a", "archive")]
    o = [("single", 1, 1, 1, False), ("regional", 2, 2, 2, False), ("wide", 4, 3, 4, True), ("archived", 2, 1, 1, True), ("too-many", 9, 1, 1, False), ("odd", 2, 3, 1, False)]
    return spark.createDataFrame(r, "id string, region string, zone string, backend string"), spark.createDataFrame(o, "class string, replicas int, min_regions int, min_zones int, require_archive boolean")


@query("select * from (values ('single', 1::BIGINT, true, true, true), ('regional', 2, true, true, true), ('wide', 4, true, true, true), ('archived', 2, true, true, true)) as t(class, n, regions_ok, zones_ok, archive_ok)")
def policy_plans(spark, sf_dir):
    r, o = catalogue_of_resources(spark)
    p = store.plan_placement(r, o).join(r.select("id", "backend"), "id").join(o, "class")
    p = p.groupBy("class").agg(F.count("*").alias("n"), (F.countDistinct("region") >= F.max("min_regions")).alias("regions_ok"), (F.countDistinct("region", "zone") >= F.max("min_zones")).alias("zones_ok"), ~(F.max("require_archive") & ~F.max((F.col("backend") == "archive") & (F.col("position") == 1))))
    return p.toDF("class", "n", "regions_ok", "zones_ok", "archive_ok")


# ---- nodes and routing
@query("select doc_id, case when doc_id % 13 = 0 then 'unknown' else 'ok' end as status, case when doc_id % 13 <> 0 then sha256(text) end as sha256 from documents")
def node_roundtrip(spark, sf_dir):
    files = streams(spark, sf_dir).select(F.col("doc_id").alias("name"), "payload")
    objects, manifests, roots_ = routing.node_put(files, SMALL)
    got = routing.node_get(files.select("name"), roots_.where("name % 13 <> 0"), manifests, objects)
    return got.select(F.col("name").alias("doc_id"), "status", F.sha2("payload", 256).alias("sha256"))


@query(f"""
with r as ({ranks_sql(NODES)}),
a as (select p_partkey, arg_min(node, rank) as node from r where rank <= 2 and (node = 'n2' and p_partkey % 2 = 0 or node = 'n3' and p_partkey % 5 <> 0 or node = 'n4') group by 1)
select p.p_partkey, case when p.p_partkey % 3 = 0 then p_name when node = 'n4' then null else node || p_name end as payload, case when p.p_partkey % 3 = 0 then 'local' else node end as source,
  case when p.p_partkey % 3 = 0 then 'ok' when node = 'n4' then 'error' when node is null then 'missing' else 'ok' end as status, p.p_partkey % 3 <> 0 and coalesce(node <> 'n4', false) as promote from part p left join a on a.p_partkey = p.p_partkey""")
def routed_reads(spark, sf_dir):
    """Two owners a key are asked in order of rank; n2 and n3 hold some keys, n4 fails, n1 reads."""
    p = _plain_keys(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("payload")), "p_partkey").withColumnRenamed("key", "id")
    holds = lambda n, which: p.where(which).select(F.lit(n).alias("node"), "id", F.concat(F.lit(n), "payload").alias("payload"))
    peers = holds("n2", "p_partkey % 2 = 0").unionByName(holds("n3", "p_partkey % 5 <> 0"))
    got = routing.routed_get(p.select("id"), p.where("p_partkey % 3 = 0").select("id", "payload"), peers, NODES, 2, "n1", ["n4"], digest.weight_sha256)
    return p.select("p_partkey", "id").join(got, "id").drop("id")


@query(f"select p_partkey, 'n1' as node, 'durable' as status from part union all select p_partkey, node, case when node = 'n3' then 'failed' else 'replicated' end from ({ranks_sql(NODES)}) where rank <= 2 and node <> 'n1'")
def routed_writes(spark, sf_dir):
    k = _plain_keys(spark, sf_dir).withColumnRenamed("key", "id")
    put = routing.routed_put(k.select("id"), NODES, 2, "n1", ["n3"], digest.weight_sha256)
    return k.join(put, "id").select("p_partkey", "node", "status")


@query("""
with n as (select unnest(['n1', 'n2', 'n3', 'n4']) as node), d as (select p_partkey, node from part, n),
f as (select p_partkey, node, case when node = 'n1' and p_partkey % 5 = 0 then 'missing' when node = 'n2' and p_partkey % 7 = 0 then 'corrupt' end as finding from d
  union all select p_partkey, 'old', 'misplaced' from part where p_partkey % 11 = 0)
select p_partkey, node, finding, case when (p_partkey % 5 = 0)::INT + (p_partkey % 7 = 0)::INT > (p_partkey % 11 = 0)::INT then 'under'
  when (p_partkey % 5 = 0)::INT + (p_partkey % 7 = 0)::INT < (p_partkey % 11 = 0)::INT then 'over' else 'exact' end as replication from f where finding is not null""")
def repair_findings(spark, sf_dir):
    k = _keys(spark, sf_dir)
    d = store.owners(k.select("key"), NODES, 4).select("key", "node")
    seen = d.join(k, "key").where("not (node = 'n1' and p_partkey % 5 = 0)").select("key", "node", (~((F.col("node") == "n2") & (F.col("p_partkey") % 7 == 0))).alias("good"))
    seen = seen.unionByName(k.where("p_partkey % 11 = 0").select("key", F.lit("old").alias("node"), F.lit(True).alias("good")))
    return routing.repair(d, seen).join(k, "key").select("p_partkey", "node", "finding", "replication")


@query("""select doc_id, '{"hash":"' || sha256(text) || '","offset":0,"length":' || octet_length(encode(text)) || '}' as json, sha256(text) as back from documents""")
def chunk_json(spark, sf_dir):
    s = streams(spark, sf_dir).select("doc_id", columns.chunk_json(columns.sha256_raw(F.col("payload")), F.lit(0), F.octet_length("payload")).alias("json"))
    return s.select("doc_id", "json", columns.hex_lower(columns.chunk_from_json(F.col("json"))["hash"]).alias("back"))


@query("""select event_id, case when e is null then 'PUT' end as method, case when e is null then '/u' || user_id end as target, case when e is null then event_id end as content_length, case when e is null then 'Bearer ' || user_id end as authorization, e as error
from (select *, case when event_id % 5 = 0 then 'malformed request line' when event_id % 7 = 0 then 'invalid content-length' when event_id % 11 = 0 then 'unexpected eof in headers' when event_id % 13 = 0 then 'request body too large' end as e from events)""")
def request_heads(spark, sf_dir):
    id_, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    line = F.when(F.col("event_id") % 5 == 0, "PUT\r\n").otherwise(F.concat(F.lit("PUT /u"), user, F.lit(" HTTP/1.1\r\n")))
    length = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), id_)).when(F.col("event_id") % 13 == 0, F.lit(str((32 << 30) + 1))).otherwise(id_)
    end = F.when(F.col("event_id") % 11 == 0, "").otherwise("\r\n")
    raw = F.concat(line, F.lit("content-length: "), length, F.lit("\r\nAUTHORIZATION:  Bearer "), user, F.lit(" \r\n"), end)
    return table(spark, sf_dir, "events").select("event_id", protocol.request_head(raw).alias("h")).select("event_id", "h.*")


# ---- manifests, recipes, tags and overlays
@query("select o_orderkey, case when o_orderkey % 7 = 0 then 'digest' when o_orderkey % 11 = 0 then 'version' when o_orderkey % 13 = 0 then 'length' end as error, case when not (o_orderkey % 7 = 0 or o_orderkey % 11 = 0 or o_orderkey % 13 = 0) then o_orderkey end as generation, case when not (o_orderkey % 7 = 0 or o_orderkey % 11 = 0 or o_orderkey % 13 = 0) then o_custkey end as chunk_count from orders")
def level0_manifests(spark, sf_dir):
    """Bootstrap manifests written, some of them changed or cut, and read."""
    o = store.spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    b = manifest.level0_blob(F.col("o_orderkey"), F.lit(1), F.lit(2), F.col("o_custkey"), columns.shake256(F.encode(F.col("o_orderkey").cast("string"), "UTF-8")), F.lit(None).cast("binary"))
    o = o.withColumn("b", b)
    put = lambda at, x: F.concat(F.substring("b", 1, at), F.lit(x), F.expr(f"substring(b, {at + 1 + len(x)}, 4096)"))
    o = o.withColumn("b", F.when(F.col("o_orderkey") % 7 == 0, put(16, b"\x09")).when(F.col("o_orderkey") % 11 == 0, put(4, b"\x02")).when(F.col("o_orderkey") % 13 == 0, F.substring("b", 1, 100)).otherwise(F.col("b")))
    o = o.select("o_orderkey", manifest.level0_fields(F.col("b")).alias("f"))
    return o.select("o_orderkey", "f.error", F.col("f.generation").cast("long").alias("generation"), F.col("f.chunk_count").cast("long").alias("chunk_count"))


@query("select l_orderkey as object, count(*) as entries, case when l_orderkey % 7 = 0 then 'start' when l_orderkey % 5 = 0 then 'end' end as finding from lineitem group by 1")
def recipe_checks(spark, sf_dir):
    """Orders as objects, their items as entries; some begin late, some end early."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"), F.col("l_quantity").cast("long").alias("length"))
    w = Window.partitionBy("object")
    x = x.withColumn("end", F.sum("length").over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("length").over(w))
    late = F.when(F.col("object") % 7 == 0, 1).otherwise(0)
    x = x.select("object", "seq", "length", (F.col("end") - F.col("length") + late).alias("logical_offset"), (F.col("total") + F.when(F.col("object") % 5 == 0, 1).otherwise(0)).alias("nar_length"))
    return manifest.recipe_findings(x)


@query("""with c as (select l_partkey as chunk, count(*) as n from lineitem group by 1)
select chunk, case when chunk % 7 = 0 then null when chunk % 5 = 0 then 0 when chunk % 11 = 0 then n + 1 end::BIGINT as recorded, n as counted, case when chunk % 7 = 0 then 'absent' when chunk % 5 = 0 then 'zero' else 'wrong' end as finding from c where chunk % 7 = 0 or chunk % 5 = 0 or chunk % 11 = 0""")
def refcount_audit(spark, sf_dir):
    m = manifest_chunks(spark, sf_dir)
    s = store.refcounts(m).where("chunk % 7 <> 0")
    s = s.withColumn("refcount", F.when(F.col("chunk") % 5 == 0, F.lit(0).cast("long")).when(F.col("chunk") % 11 == 0, F.col("refcount") + 1).otherwise(F.col("refcount")))
    return manifest.refcount_findings(s, m)


@query("select l_partkey as part, count(*) as refcount, null::VARCHAR as error from lineitem group by 1")
def refcount_snapshot(spark, sf_dir):
    """References written as segments and read again."""
    c = store.refcounts(manifest_chunks(spark, sf_dir)).withColumn("part", F.col("chunk")).withColumn("chunk", columns.sha256_raw(F.encode(F.col("chunk").cast("string"), "UTF-8")))
    back = manifest.refcount_rows(manifest.refcount_segments(c.select("chunk", "refcount"), 7, bytes(32)))
    return c.select("part", "chunk").join(back.select("chunk", F.col("refcount").cast("long").alias("refcount"), "error"), "chunk").drop("chunk")


@query("with f as (select event_type || ':' || user_id as tag, event_id as seq, event_id % 3 as commit from events) select tag, seq, case when seq = min(seq) over (partition by tag) then 'published' when commit = first_value(commit) over (partition by tag order by seq) then 'same' else 'refused' end as status from f")
def tag_publication(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("tag"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("commit"))
    return manifest.publish_tags(e).select("tag", "seq", "status")


def _overlays(spark, sf_dir):
    """Chains of eight parts; part p writes objects p % 3 and p % 4, and hides p % 5."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("manifest"))
    commits = p.select("manifest", F.when(F.col("manifest") % 8 != 0, F.col("manifest") - 1).alias("parent"), F.col("manifest").alias("generation"))
    object_ = lambda n, alive: F.struct((F.col("manifest") % n + 10 * n).alias("object"), F.when(F.lit(alive), F.col("manifest")).alias("recipe"))
    hidden = F.struct((F.col("manifest") % 3 + 30).alias("object"), F.lit(None).cast("long").alias("recipe"))
    own = F.when(F.col("manifest") % 5 == 0, F.array(hidden, object_(4, True))).otherwise(F.array(object_(3, True), object_(4, True)))
    return commits, p.select("manifest", F.explode(own).alias("x")).select("manifest", "x.object", "x.recipe"), p


@query("""
with e as (select p_partkey as m, 30 + p_partkey % 3 as object, case when p_partkey % 5 <> 0 then p_partkey end as recipe from part union all select p_partkey, 40 + p_partkey % 4, p_partkey from part),
r as (select p_partkey as tip, object, recipe, p_partkey - m as depth, row_number() over (partition by p_partkey, object order by m desc) as k from part join e on m <= p_partkey and m // 8 = p_partkey // 8)
select tip, object, recipe, depth::INTEGER as depth from r where k = 1 and recipe is not null""")
def overlay_objects(spark, sf_dir):
    return manifest.resolve_objects(*_overlays(spark, sf_dir))


@query("select p_partkey as tip, (p_partkey % 8)::INTEGER as depth, 'ok' as status from part")
def overlay_chains(spark, sf_dir):
    commits, _, tips = _overlays(spark, sf_dir)
    return manifest.chain_status(commits, tips)


@query(f"select p_partkey as chunk from part where p_size < 25 and p_partkey not in ({_REACH})")
def gc_with_grace(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"), F.col("p_size").alias("created"))
    return manifest.collectible_before(p, roots(spark, sf_dir), manifest_chunks(spark, sf_dir), F.lit(25))


@query("select source as tenant, sum(n)::BIGINT as logical_bytes, sum(one)::BIGINT as physical_bytes from (select source, text, sum(octet_length(encode(text))) as n, any_value(octet_length(encode(text))) as one from documents group by 1, 2) group by 1")
def tenant_metering(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("tenant"), F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), F.octet_length("text").cast("long").alias("length"))
    return manifest.metering(d)


@query("select p_partkey, case when p_partkey % 97 = 0 then 'left_only' when p_partkey % 89 = 0 then 'right_only' else 'changed' end as finding from part where p_partkey % 97 = 0 or p_partkey % 89 = 0 or p_partkey % 83 = 0")
def replica_differences(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", columns.sha256_raw(F.encode(F.col("p_partkey").cast("string"), "UTF-8")).alias("id"), F.col("p_name").alias("digest"))
    right = p.where("p_partkey % 97 <> 0").withColumn("digest", F.when((F.col("p_partkey") % 83 == 0) & (F.col("p_partkey") % 89 != 0), "x").otherwise(F.col("digest")))
    d = manifest.replica_differences(p.where("p_partkey % 89 <> 0 or p_partkey % 97 = 0").select("id", "digest"), right.select("id", "digest"))
    return d.join(p.select("p_partkey", "id"), "id").select("p_partkey", "finding")


@query("select event_type as counter, sum(a - r)::BIGINT as value from (select event_type, user_id, max(event_id) as a, max(event_id // 2) as r from events group by 1, 2) group by 1")
def counter_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("counter"), F.col("user_id").alias("node"), F.col("event_id").alias("added"), F.expr("event_id div 2").alias("removed"))
    return manifest.counter_values(e)


@query("""select event_id, '<D:multistatus xmlns:D="DAV:">' || chr(10) || '<D:response>' || chr(10) || '<D:href>/c/u' || user_id || '/</D:href>' || chr(10) || '<D:propstat>' || chr(10) || '<D:prop>' || chr(10) || '<D:displayname>u' || user_id || '</D:displayname>' || chr(10)
|| '<D:getlastmodified>Thu, 01 Jan 1970 00:00:00 GMT</D:getlastmodified>' || chr(10) || '<D:resourcetype><D:collection/></D:resourcetype>' || chr(10) || '</D:prop>' || chr(10) || '<D:status>HTTP/1.1 200 OK</D:status>' || chr(10) || '</D:propstat>' || chr(10) || '</D:response>' || chr(10) || '</D:multistatus>' || chr(10) as body from events where event_type = 'signup'""")
def propfind_bodies(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select("event_id", protocol.propfind_body(F.concat(F.lit("/c/u"), F.col("user_id").cast("string"), F.lit("/"))).alias("body"))


# ---- signatures, witness, narinfo, requests
def suppliers(spark, sf_dir):
    return store.spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))


@query("select s_suppkey, case when s_suppkey % 7 = 0 then 'invalid' else 'valid' end as verdict from supplier")
def signature_verdicts(spark, sf_dir):
    s = suppliers(spark, sf_dir).select("s_suppkey", F.encode("s_name", "UTF-8").alias("m"))
    s = s.withColumn("sig", columns.ed25519_sign(SEED)("m")).withColumn("m", F.when(F.col("s_suppkey") % 7 == 0, F.concat("m", F.lit(b"!"))).otherwise(F.col("m")))
    return s.select("s_suppkey", F.when(columns.ed25519_verify(digest.public_key(SEED))("m", "sig"), "valid").otherwise("invalid").alias("verdict"))


@query("""select s_suppkey, case s_suppkey % 6 when 1 then 'decode_error' when 2 then 'invalid_public_key: expected 32 bytes' when 3 then 'invalid_signature: expected 64 bytes' when 4 then 'verification_failed' when 5 then 'decode_error' end as error,
case when s_suppkey % 4 = 1 then 'invalid_secret_key: expected 32 bytes' when s_suppkey % 4 = 2 then 'decode_error' end as sign_error from supplier""")
def signature_errors(spark, sf_dir):
    """Keys and signatures in base64, each wrong in its own way."""
    secret, public = base64.b64encode(SEED).decode(), base64.b64encode(digest.public_key(SEED)).decode()
    k, k4 = F.col("s_suppkey") % 6, F.col("s_suppkey") % 4
    s = suppliers(spark, sf_dir).select("s_suppkey", F.encode("s_name", "UTF-8").alias("m"))
    s = s.withColumn("sig", columns.sign_data("m", F.lit(secret))["signature"])
    sig = F.when(k == 3, F.lit(secret)).when(k == 5, F.concat("sig", F.lit("!"))).otherwise(F.col("sig"))
    key = F.when(k == 1, F.lit("not base64")).when(k == 2, F.lit("AAAA")).otherwise(F.lit(public))
    wrong = F.when(k4 == 1, F.lit("AAAA")).when(k4 == 2, F.lit(secret[:-1])).otherwise(F.lit(secret))
    return s.select("s_suppkey", columns.signature_error(F.when(k == 4, F.lit(b"other")).otherwise(F.col("m")), sig, key).alias("error"), columns.sign_data("m", wrong)["error"].alias("sign_error"))


@query("""select s_suppkey, case when s_suppkey % 4 in (0, 3) then 'cache-' || s_suppkey end as name, case s_suppkey % 4 when 1 then 'nix key: expected <name>:<base64>' when 2 then 'nix key: invalid base64' end as error,
case when s_suppkey % 4 = 0 then 'cache-' || s_suppkey end as public_name, case s_suppkey % 4 when 1 then 'nix key: expected <name>:<base64>' when 2 then 'nix key: invalid base64' when 3 then 'nix key: decoded key shorter than 32 bytes' end as public_error from supplier""")
def named_keys(spark, sf_dir):
    k, name = F.col("s_suppkey") % 4, F.concat(F.lit("cache-"), F.col("s_suppkey").cast("string"))
    public = digest.public_key(SEED)
    key = F.when(k == 3, base64.b64encode(SEED + public).decode()).when(k == 2, "%%%").otherwise(base64.b64encode(public).decode())
    text = F.when(k == 1, name).otherwise(F.concat(F.lit(" "), name, F.lit(":"), key, F.lit("\n")))
    s = suppliers(spark, sf_dir).select("s_suppkey", columns.named_key("secret")(text).alias("s"), columns.named_key("public")(text).alias("p"))
    return s.select("s_suppkey", "s.name", "s.error", F.col("p.name").alias("public_name"), F.col("p.error").alias("public_error"))


#: Published known answers.
KNOWN_ANSWERS = (
    ("shake256", "", "46b9dd2b0ba88d13233b3feb743eeb243fcd52ea62b81b82b50c27646ed5762f"),
    ("blake3", "hello world", "d74981efa70a0c880b8d8c1985d075dbcbf679b99a5f9914e5aaf96b831a9e24"),
    ("hmac", "what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
)


@query("select * from (values " + ", ".join(f"('{f}', '{x}', '{y}')" for f, x, y in KNOWN_ANSWERS) + ") as t(fn, input, digest)")
def known_digests(spark, sf_dir):
    rows = spark.createDataFrame([(f, x) for f, x, _ in KNOWN_ANSWERS], "fn string, input string").withColumn("b", columns.utf8(F.col("input")))
    out = F.when(F.col("fn") == "shake256", columns.hex_lower(columns.shake256("b"))).when(F.col("fn") == "blake3", columns.blake3_hex("b")).otherwise(columns.hex_lower(columns.hmac_sha256(b"Jefe")("b")))
    return rows.select("fn", "input", out.alias("digest"))


@query("select s_suppkey, case when s_suppkey % 5 = 0 then 401 when s_suppkey % 3 = 0 then 403 else 200 end as status from supplier")
def token_verdicts(spark, sf_dir):
    @F.pandas_udf("string")
    def token(key: pd.Series) -> pd.Series:
        b = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=")

        def make(k: int) -> str:
            head = b(json.dumps({"alg": "EdDSA"}).encode()) + b"." + b(json.dumps({"cache": "main", "scope": "read" if k % 3 == 0 else "write", "exp": 50 if k % 5 == 0 else 5000, "iat": 1}).encode())
            return (head + b"." + b(digest.sign(SEED, head))).decode()

        return key.map(make)

    s = suppliers(spark, sf_dir).select("s_suppkey", token("s_suppkey").alias("t"))
    return s.select("s_suppkey", protocol.token_verdict(F.col("t"), "main", 100, digest.public_key(SEED)).alias("status"))


@query("select user_id, count(*) as n, max(case when event_id % 1009 = 0 then 1 else 0 end) = 0 as valid from events group by 1")
def witness_verify(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), columns.sha256_raw(F.encode("event_type", "UTF-8")).alias("action_hash"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_ns"), F.lit(1).alias("witness_type"))
    w = protocol.witness_entries(e, "user_id")
    bad = F.concat(F.substring("entry", 1, 10), F.lit(b"\xff\x00\xff"), F.expr("substring(entry, 14, 60)"))
    w = w.withColumn("entry", F.when(F.col("seq") % 1009 == 0, bad).otherwise(F.col("entry")))
    return protocol.verify_witness(w, "user_id")


def narinfos(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    path = F.concat(F.lit("/nix/store/"), F.substring(F.sha2("s_name", 256), 1, 32), F.lit("-supplier-"), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", path.alias("path"), F.sha2(F.col("s_suppkey").cast("string"), 256).alias("h"), (F.col("s_suppkey") * 10).alias("size"), F.when(F.col("s_suppkey") % 2 == 0, F.array(path)).otherwise(F.array().cast("array<string>")).alias("refs"))


_NAR = "select s_suppkey, '/nix/store/' || substr(sha256(s_name), 1, 32) || '-supplier-' || s_suppkey as path, s_suppkey * 10 as size, s_suppkey % 2 = 0 as has from supplier"


@query(f"select s_suppkey, path as store_path, 'nar/' || s_suppkey || '.nar' as url, 'zstd' as compression, size as nar_size, case when has then path else '' end as refs, 2 as sigs, null::VARCHAR as error from ({_NAR})")
def narinfo_parse(spark, sf_dir):
    n = narinfos(spark, sf_dir)
    text = protocol.narinfo_text(F.col("path"), F.concat(F.lit("nar/"), F.col("s_suppkey").cast("string"), F.lit(".nar")), F.lit("zstd"), F.col("h"), F.col("size"), F.col("h"), F.col("size"), F.col("refs"), F.lit(None).cast("string"), F.array(F.lit("a:1"), F.lit("b:2")))
    p = n.select("s_suppkey", protocol.narinfo_fields(text).alias("f"))
    return p.select("s_suppkey", "f.store_path", "f.url", "f.compression", "f.nar_size", F.array_join("f.references", " ").alias("refs"), F.size("f.sigs").alias("sigs"), "f.error")


@query("""select s_suppkey, case s_suppkey % 10 when 1 then 'bad_hash' when 2 then 'base32' when 3 then 'base32' when 4 then 'bad_hash' when 5 then 'bad_number' when 6 then 'bad_number' when 7 then 'URL' when 8 then 'bad_hash' when 9 then 'NarSize' end as error from supplier""")
def narinfo_errors(spark, sf_dir):
    """Records with one thing wrong each: prefix, character, spare bits, length, number, range, missing fields."""
    k = F.col("s_suppkey") % 10
    h = F.lit("sha256:" + "0" * 52)
    nar = F.when(k == 1, F.lit("md5:" + "0" * 52)).when(k == 2, F.lit("sha256:" + "e" * 52)).when(k == 3, F.lit("sha256:2" + "0" * 51)).when(k == 4, F.lit("sha256:" + "0" * 40)).otherwise(h)
    size = F.when(k == 5, "12x").when(k == 6, str(1 << 64)).otherwise(str((1 << 64) - 1))
    line = lambda key, v, absent: F.when(k == absent, F.lit("")).otherwise(F.concat(F.lit(f"{key}: "), v, F.lit("\n")))
    text = F.concat(line("StorePath", F.lit("/nix/store/x"), -1), line("URL", F.lit("nar/x"), 7), line("FileHash", F.when(k == 8, F.lit("x")).otherwise(h), -1), line("NarHash", nar, -1), line("NarSize", size, 9))
    return suppliers(spark, sf_dir).select("s_suppkey", protocol.narinfo_fields(text)["error"].alias("error"))


@query(f"""select s_suppkey, '1;' || path || ';sha256:' || reverse({base32_sql('h')}) || ';' || size || ';' || case when has then path else '' end as fingerprint from (select *, sha256(s_suppkey::VARCHAR) as h from ({_NAR}))""")
def narinfo_fingerprint(spark, sf_dir):
    return narinfos(spark, sf_dir).select("s_suppkey", protocol.fingerprint(F.col("path"), F.col("h"), F.col("size"), F.col("refs")).alias("fingerprint"))


@query(f"select s_suppkey, s_suppkey % 7 <> 0 as verified, 1 as sigs from ({_NAR})")
def narinfo_resign(spark, sf_dir):
    """Foreign signatures go, ours comes; every seventh text is changed afterwards."""
    n = narinfos(spark, sf_dir)
    text = protocol.narinfo_text(F.col("path"), F.lit("nar/x"), F.lit("xz"), F.col("h"), F.col("size"), F.col("h"), F.col("size"), F.col("refs"), F.lit(None).cast("string"), F.array(F.lit("a:1"), F.lit("b:2")))
    signed = n.select("s_suppkey", protocol.resign(text, "ours-1", SEED).alias("t"))
    changed = F.when(F.col("s_suppkey") % 7 == 0, F.regexp_replace("t", "NarSize: ", "NarSize: 9")).otherwise(F.col("t"))
    signed = signed.withColumn("t", changed)
    return signed.select("s_suppkey", protocol.verify_any(F.col("t"), {"ours-1": digest.public_key(SEED)}).alias("verified"), F.regexp_count("t", F.lit("(?m)^Sig: ")).alias("sigs"))


@query("select method, status, count(*) as requests from (select case event_type when 'click' then 'GET' when 'view' then 'HEAD' when 'purchase' then 'PUT' when 'error' then 'DELETE' else 'PROPFIND' end as method, case when event_type in ('click', 'view') then case when last_value(case event_type when 'purchase' then event_id when 'error' then -1 end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) >= 0 then 200 else 404 end when event_type = 'purchase' then 200 when event_type = 'error' then 204 else 207 end as status from events) group by 1, 2")
def access_log(spark, sf_dir):
    return request_log_asof(spark, sf_dir).groupBy("method", "status").agg(F.count("*").alias("requests"))


METHODS = {"click": "GET", "view": "HEAD", "purchase": "PUT", "error": "DELETE", "signup": "PROPFIND"}


@query("""
with r as (select event_id as seq, case event_type when 'click' then 'GET' when 'view' then 'HEAD' when 'purchase' then 'PUT' when 'error' then 'DELETE' else 'PROPFIND' end as method, 'u' || user_id as path from events),
v as (select *, last_value(case method when 'PUT' then seq when 'DELETE' then -1 end ignore nulls) over (partition by path order by seq rows between unbounded preceding and 1 preceding) as v from r)
select seq, method, path, case when method in ('GET', 'HEAD') then case when v >= 0 then 200 else 404 end when method = 'PUT' then 200 when method = 'DELETE' then 204 else 207 end as status,
case when method in ('GET', 'HEAD') and v >= 0 then v end as body_of from v""")
def request_log_asof(spark, sf_dir):
    method = F.lit("OPTIONS")
    for k, v in METHODS.items():
        method = F.when(F.col("event_type") == k, v).otherwise(method)
    return protocol.request_log(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), method.alias("method"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.lit(True).alias("authorized")))


@query("""
with r as (select event_id as seq, event_type, case event_type when 'click' then 'GET' when 'view' then 'HEAD' when 'purchase' then 'PUT' when 'error' then 'DELETE' else 'PROPFIND' end as method, 'u' || user_id as path, props from events),
v as (select *, last_value(case method when 'PUT' then seq when 'DELETE' then -1 end ignore nulls) over (partition by path order by seq rows between unbounded preceding and 1 preceding) as v from r),
b as (select v.seq, v.method, v.path, case when method in ('GET', 'HEAD') then case when v >= 0 then 200 else 404 end when method = 'PUT' then 200 when method = 'DELETE' then 204 else 207 end as status,
  case when method = 'PROPFIND' then 'application/xml; charset=utf-8' when method in ('GET', 'HEAD') and v >= 0 then 'application/octet-stream' else 'text/plain' end as kind,
  case when method in ('GET', 'HEAD') and v >= 0 then e.props when method = 'PROPFIND' then '<D:multistatus xmlns:D="DAV:">' || chr(10) || '<D:response>' || chr(10) || '<D:href>/' || path || '</D:href>' || chr(10) || '<D:propstat>' || chr(10) || '<D:prop>' || chr(10) || '<D:displayname>' || path || '</D:displayname>' || chr(10)
    || '<D:getlastmodified>Thu, 01 Jan 1970 00:00:00 GMT</D:getlastmodified>' || chr(10) || '<D:resourcetype><D:collection/></D:resourcetype>' || chr(10) || '</D:prop>' || chr(10) || '<D:status>HTTP/1.1 200 OK</D:status>' || chr(10) || '</D:propstat>' || chr(10) || '</D:response>' || chr(10) || '</D:multistatus>' || chr(10) else '' end as body
  from v left join (select event_id, props from events) e on e.event_id = v.v)
select seq, 'HTTP/1.1 ' || status || ' ' || case status when 200 then 'OK' when 204 then 'No Content' when 207 then 'Multi-Status' else 'Not Found' end || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(body)) || chr(13) || chr(10) || 'Content-Type: ' || kind || chr(13) || chr(10)
  || 'Connection: close' || chr(13) || chr(10) || chr(13) || chr(10) || case when method = 'HEAD' then '' else body end as response from b""")
def request_responses(spark, sf_dir):
    """Every request answered in full: what was put before is read back, framed as it goes over the wire."""
    bodies = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), columns.utf8(F.col("props")).alias("body"))
    return protocol.respond(request_log_asof(spark, sf_dir), bodies).select("seq", F.decode("response", "UTF-8").alias("response"))


@query("select 'cache-info' as name, 'StoreDir: /nix/store' || chr(10) || 'WantMassQuery: 1' || chr(10) || 'Priority: 30' || chr(10) as body union all select 'options', 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Length: 0' || chr(13) || chr(10) || 'DAV: 1,2' || chr(13) || chr(10) || 'Allow: OPTIONS, GET, HEAD, PUT, DELETE, MKCOL, PROPFIND' || chr(13) || chr(10) || 'Connection: close' || chr(13) || chr(10) || chr(13) || chr(10)")
def fixed_responses(spark, sf_dir):
    return spark.createDataFrame([("cache-info", protocol.cache_info()), ("options", protocol.options_response().decode())], "name string, body string")


# ---- ordered jobs, audits, verified reads and reclaiming
@query("select doc_id as index, (doc_id * 7)::BIGINT as \"offset\", octet_length(encode(text))::BIGINT as length, sha256(text) as digest from documents")
def ordered_hash_jobs(spark, sf_dir):
    jobs = streams(spark, sf_dir).select(F.col("doc_id").alias("index"), (F.col("doc_id") * 7).alias("offset"), F.col("payload").alias("data"))
    return store.hash_jobs(jobs).withColumn("digest", columns.hex_lower(F.col("digest")))


@query("select page_id as index, sha256(html) as sha256 from pages")
def ordered_compression_jobs(spark, sf_dir):
    """Compressed in order and read back."""
    jobs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("index"), columns.utf8(F.col("html")).alias("data"))
    return store.compression_jobs(jobs).select("index", F.sha2(columns.decompress("zstd")("compressed")["data"], 256).alias("sha256"))


@query("select * from (values ('ephemeral', 1, 1, 1, false, 'evictable'), ('standard', 2, 1, 2, false, 'policy'), ('premium', 2, 2, 2, false, 'versions'), ('immutable', 3, 3, 3, true, 'locked')) as t(class, replicas, min_regions, min_zones, require_archive, deletion)")
def service_classes(spark, sf_dir):
    return lifecycle.service_objectives(spark)


#: Which keys have a durable copy on which resource; eu-b holds latency copies only, gone is in no catalogue.
COPIES = {"us-a": "p_partkey % 7 <> 0", "us-b": "p_partkey % 2 = 0", "eu-a": "p_partkey % 3 = 0", "vault": "p_partkey % 5 = 0", "gone": "p_partkey % 13 = 0"}


@query(f"""
with k as (select p_partkey, (['ephemeral', 'standard', 'premium', 'immutable', 'unheard'])[p_partkey % 11 % 5 + 1] as class, ({COPIES['us-a']})::INT as a, ({COPIES['us-b']})::INT as b, ({COPIES['eu-a']})::INT as e, ({COPIES['vault']})::INT as v from part),
f as (select p_partkey, class, unnest([case when class = 'unheard' then 'class' end,
  case when a + b + e + v < case class when 'ephemeral' then 1 when 'immutable' then 3 else 2 end and class <> 'unheard' then 'replicas' end,
  case when greatest(a, b) + e + v < case class when 'premium' then 2 when 'immutable' then 3 else 1 end and class <> 'unheard' then 'regions' end,
  case when a + b + e + v < case class when 'ephemeral' then 1 when 'immutable' then 3 else 2 end and class <> 'unheard' then 'zones' end,
  case when class = 'immutable' and v = 0 then 'archive' end, case when {COPIES['gone']} then 'resource' end]) as finding from k)
select p_partkey as key, class, finding from f where finding is not null""")
def placement_audit(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("ephemeral", "standard", "premium", "immutable", "unheard")]), (F.col("p_partkey") % 11 % 5 + 1).cast("int"))
    durable = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in COPIES.items()]))
    copy = F.concat(F.transform(durable, lambda r: F.struct(r.alias("resource"), F.lit("durable").alias("role"))), F.array(F.struct(F.lit("eu-b").alias("resource"), F.lit("latency").alias("role"))))
    copies = p.select(F.col("p_partkey").alias("key"), F.inline(copy))
    return lifecycle.placement_findings(p.select(F.col("p_partkey").alias("key"), name.alias("class")), copies, catalogue_of_resources(spark)[0], lifecycle.service_objectives(spark))


@query("""
with r as (select l_partkey as chunk, bool_or(l_orderkey % 50 = 0) as live, bool_or(l_orderkey % 61 = 0) as held, bool_or(l_orderkey % 40 > 38) as retained from lineitem group by 1)
select p_partkey as chunk, case when live then 'live' when held then 'held' when retained then 'retained' when p_partkey % 6 = 0 then 'repair' when p_partkey % 5 = 0 then 'no_tombstone' else 'reclaim' end as verdict from part left join r on chunk = p_partkey""")
def reclaiming(spark, sf_dir):
    """Items as references, most of them deleted; some held, some retained."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("chunk"), F.expr("l_orderkey % 50 <> 0").alias("deleted"), F.expr("l_orderkey % 61 = 0").alias("hold"), F.expr("l_orderkey % 40").alias("retain_until"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"), F.expr("p_partkey % 5 <> 0").alias("tombstoned"))
    return lifecycle.reclaim_verdicts(p, refs, p.where("chunk % 6 = 0"), F.lit(38))


@query("""select doc_id, status, case when status = 'ok' then sha256(text) end as sha256 from (select doc_id, text, case when doc_id % 19 = 0 then 'unknown' when doc_id % 17 = 0 then 'commit' when doc_id % 13 = 0 then 'level0' when doc_id % 11 = 0 then 'limit'
  when doc_id % 7 = 0 then 'chunk_count' when doc_id % 5 = 0 then 'recipe_end' else 'ok' end as status from documents)""")
def published_reads(spark, sf_dir):
    """Texts published with commit, bootstrap manifest and recipe, some of them damaged on the way, read by their tags."""
    files = streams(spark, sf_dir).select("doc_id", "payload", F.octet_length("payload").cast("long").alias("n"))
    chunks = store.chunk_table(files, "doc_id", "payload", SMALL, emit_payload=True, hash_="none")
    chunks = chunks.withColumn("id", columns.content_id("chunk")("payload")).withColumn("level1", columns.sha256_raw(F.col("doc_id").cast("string")))
    chunks = manifest.settled(chunks)  # what was published is a table
    entries = chunks.select("level1", "seq", F.col("offset").alias("logical_offset"), "length", F.col("id").alias("chunk"))
    count = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    d = F.col("doc_id")
    size = F.when(d % 11 == 0, F.lit(lifecycle.MAX_BYTES + 1)).when(d % 5 == 0, F.col("n") + 1).otherwise(F.col("n"))
    h = files.join(count, "doc_id", "left").fillna(0, ["chunks"])
    h = h.withColumn("head", manifest.level0_blob(d, F.lit(1), size, F.col("chunks") + F.when(d % 7 == 0, 1).otherwise(0), columns.sha256_raw(d.cast("string")), F.lit(None).cast("binary")))
    h = h.withColumn("level0", columns.content_id("level0")("head")).withColumn("record", manifest.commit_record(d, F.col("level0"), F.lit(None).cast("binary"), F.lit(1)))
    h = manifest.settled(h.withColumn("commit", columns.content_id("commit")("record")).select("doc_id", "head", "level0", "record", "commit"))
    changed = lambda c, when: F.when(when, F.concat(F.substring(c, 1, 20), F.lit(b"\xff\x00\xff"), F.expr(f"substring({c}, 24)"))).otherwise(F.col(c))
    blobs = h.select(F.col("commit").alias("id"), changed("record", d % 17 == 0).alias("payload")).unionByName(h.select(F.col("level0").alias("id"), changed("head", d % 13 == 0).alias("payload")))
    tags = h.select(d.alias("tag"), F.when(d % 19 == 0, columns.sha256_raw(F.lit("none"))).otherwise(F.col("commit")).alias("commit"))
    objects = chunks.select("id", "payload").dropDuplicates(["id"])
    return lifecycle.read_published(tags, blobs, entries, objects).select(F.col("tag").alias("doc_id"), "status", F.sha2("payload", 256).alias("sha256"))
