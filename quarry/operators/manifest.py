"""Manifest blobs, recipes, reference snapshots, tags, overlays and anti-entropy, as DataFrame operators."""

from __future__ import annotations

import struct
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import columns, digest
from quarry.operators import store

# Fixed values of the formats: magic, sizes, and the tags of records with how often each may occur.
LEVEL0_MAGIC = b"FCAS"
LEVEL0_SIZE = 4096
LEVEL0_HEADER = 0x12C
LEVEL0_DIGEST_AT = 0xFE0
LEVEL1_TAGS = {1: "object_table", 2: "chunk_table", 3: "parent", 4: "refcount", 5: "witness", 6: "metadata", 7: "hash_algorithms"}
LEVEL1_REQUIRED = (1, 2, 7)
REFCOUNT_MAGIC = b"FCRC"
REFCOUNT_HEADER = 64
REFCOUNT_ENTRY = 40
COMMIT_MAGIC = b"FCCM"
COMMIT_SIZE = 96
CHUNK_ENTRY = 56
WITNESS_EVENTS = {1: "chunk accepted", 2: "level 1 assembled", 3: "manifest committed", 4: "tag published", 5: "tag deleted", 6: "sweep completed"}


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of df, in the folder that the session names; a temporary one only in a local session."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='quarry-')}")
    return df.checkpoint()


def le(value: Column, n: int) -> Column:
    """The n bytes of a non-negative number, least significant first."""
    h = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * (n - i) - 1, 2) for i in range(n)]))


def from_le(blob: Column, at: int, n: int) -> Column:
    """The number (decimal) in n bytes from place at, least significant first."""
    h = F.hex(F.substring(blob, at + 1, n))
    return F.conv(F.concat(*[F.substring(h, 2 * (n - i) - 1, 2) for i in range(n)]), 16, 10).cast("decimal(20,0)")


def level0_blob(generation: Column, created_ns: Column, nar_length: Column, chunk_count: Column, level1: Column, parent: Column, domain: bytes = digest.DOMAIN) -> Column:
    """The 4,096 bytes of an unsigned bootstrap manifest; ids are 32 bytes, or null for none."""
    id_ = lambda c: F.coalesce(c, F.lit(bytes(32)))
    head = F.concat(
        F.lit(LEVEL0_MAGIC), le(F.lit(1), 2), le(F.lit(0), 2), le(generation, 8), le(created_ns, 8), le(nar_length, 8), le(chunk_count, 8),
        id_(level1), F.lit(bytes(96)), id_(parent), F.lit(bytes(32 + 64 + 4)), F.lit(bytes(LEVEL0_DIGEST_AT - 2 - LEVEL0_HEADER)), le(F.lit(LEVEL0_HEADER), 2),
    )
    return F.concat(head, columns.content_id("level0", domain)(head))


def level0_fields(blob: Column, domain: bytes = digest.DOMAIN) -> Column:
    """generation, created_ns, nar_length, chunk_count, level1, parent and error of a bootstrap manifest. error is the
    first check that fails (length, magic, version, reserved, digest), or null; fields are null where there is one."""
    good = columns.content_id("level0", domain)(F.substring(blob, 1, LEVEL0_DIGEST_AT)) == F.substring(blob, LEVEL0_DIGEST_AT + 1, 32)
    # the Python function's result and the blob are computed once, then named as often as the checks need
    return columns.let(F.struct(blob.alias("blob"), good.alias("good")), lambda x: columns.let(F.struct(x["blob"].alias("blob"), _level0_error(x["blob"], x["good"]).alias("error")), _level0_struct))


def _level0_error(blob: Column, good: Column) -> Column:
    size = LEVEL0_DIGEST_AT - 2 - LEVEL0_HEADER
    rest = (F.substring(blob, LEVEL0_HEADER + 1, size) != F.lit(bytes(size))) | (from_le(blob, LEVEL0_DIGEST_AT - 2, 2) != LEVEL0_HEADER)
    error = F.when(blob.isNull() | (F.octet_length(blob) != LEVEL0_SIZE), "length").when(F.substring(blob, 1, 4) != F.lit(LEVEL0_MAGIC), "magic")
    return error.when(from_le(blob, 4, 2) != 1, "version").when(rest, "reserved").when(~good, "digest")


def _level0_struct(x: Column) -> Column:
    blob, error = x["blob"], x["error"]
    id_ = lambda at: F.nullif(F.substring(blob, at + 1, 32), F.lit(bytes(32)))
    fields = {"generation": from_le(blob, 8, 8), "created_ns": from_le(blob, 16, 8), "nar_length": from_le(blob, 24, 8), "chunk_count": from_le(blob, 32, 8), "level1": id_(0x28), "parent": id_(0xA8)}
    return F.struct(*[F.when(error.isNull(), c).alias(k) for k, c in fields.items()], error.alias("error"))


def level1_encode(records: list[tuple[int, int, bytes]]) -> bytes:
    """Records (tag, flags, value) by ascending tag, each padded to eight bytes."""
    return b"".join(struct.pack("<HHI", t, f, len(v)) + v + bytes(-len(v) % 8) for t, f, v in sorted(records))


def level1_decode(blob: bytes, max_records: int = 1 << 16) -> tuple[list[tuple[int, int, bytes]], str | None]:
    """The records that are understood, and the first error: truncated, padding, order, repeated, critical, missing or
    too_many. Unknown records that are not critical are skipped."""
    out, at, last = [], 0, -1
    while at < len(blob):
        if len(blob) - at < 8:
            return out, "truncated"
        tag, flags, n = struct.unpack_from("<HHI", blob, at)
        end = at + 8 + n
        if end + -n % 8 > len(blob):
            return out, "truncated"
        if any(blob[end : end + -n % 8]):
            return out, "padding"
        if tag < last or (tag == last and tag in LEVEL1_TAGS):
            return out, "order" if tag < last else "repeated"
        if tag not in LEVEL1_TAGS and flags & 1:
            return out, "critical"
        if len(out) >= max_records:
            return out, "too_many"
        if tag in LEVEL1_TAGS:
            out.append((tag, flags, blob[at + 8 : end]))
        at, last = end + -n % 8, tag
    return out, None if {t for t, _, _ in out} >= set(LEVEL1_REQUIRED) else "missing"


_RECORD = T.StructType([T.StructField("tag", T.IntegerType()), T.StructField("flags", T.IntegerType()), T.StructField("value", T.BinaryType())])


@F.pandas_udf(T.StructType([T.StructField("records", T.ArrayType(_RECORD)), T.StructField("error", T.StringType())]))
def level1_fields(blob: pd.Series) -> pd.DataFrame:
    rows = [level1_decode(b) if b is not None else ([], "missing") for b in blob]
    return pd.DataFrame([([{"tag": t, "flags": f, "value": v} for t, f, v in r], e) for r, e in rows], columns=["records", "error"])


def recipe_findings(entries: DataFrame) -> DataFrame:
    """object, entries, finding of entries(object, nar_length, seq, logical_offset, length): null where entries start at
    0, follow each other without gap or overlap and end at nar_length; else start, gap, overlap or end, by first entry."""
    before = F.lag(F.col("logical_offset") + F.col("length")).over(Window.partitionBy("object").orderBy("seq"))
    e = entries.withColumn("due", before)
    bad = F.when(F.col("due").isNull() & (F.col("logical_offset") != 0), "start").when(F.col("logical_offset") > F.col("due"), "gap").when(F.col("logical_offset") < F.col("due"), "overlap")
    by = e.withColumn("bad", bad).groupBy("object").agg(
        F.count("*").alias("entries"), F.min(F.when(F.col("bad").isNotNull(), F.struct("seq", "bad"))).alias("first"),
        F.max(F.struct("seq", (F.col("logical_offset") + F.col("length")).alias("end"), "nar_length")).alias("last"),
    )
    return by.select("object", "entries", F.coalesce("first.bad", F.when(F.col("last.end") != F.col("last.nar_length"), "end")).alias("finding"))


def refcount_findings(snapshot: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    """chunk, recorded, counted, finding of all in snapshot(chunk, refcount) that differs from the references counted in
    manifest_chunks(manifest, chunk): repeated, zero, absent, stale (no reference any more) or wrong."""
    s = snapshot.groupBy("chunk").agg(F.count("*").alias("rows"), F.min("refcount").alias("recorded"))
    both = s.join(store.refcounts(manifest_chunks).withColumnRenamed("refcount", "counted"), "chunk", "full")
    finding = F.when(F.col("rows") > 1, "repeated").when(F.col("recorded") == 0, "zero").when(F.col("rows").isNull(), "absent").when(F.col("counted").isNull(), "stale").when(F.col("recorded") != F.col("counted"), "wrong")
    return both.select("chunk", "recorded", "counted", finding.alias("finding")).where("finding is not null")


def publish_tags(log: DataFrame) -> DataFrame:
    """log(tag, commit, seq, ...) with status: a tag is bound once (published); the same binding again is a repetition
    (same), any other is refused."""
    first = log.groupBy("tag").agg(F.min(F.struct("seq", "commit")).alias("first"))
    status = F.when(F.col("seq") == F.col("first.seq"), "published").when(F.col("commit") == F.col("first.commit"), "same").otherwise("refused")
    return log.join(first, "tag").withColumn("status", status).drop("first")


#: Chains are followed to 2 ** DOUBLINGS ancestors; only cycles go further in any store that holds fewer commits.
DOUBLINGS = 40


def _ancestry(commits: DataFrame, tips: DataFrame, doublings: int) -> tuple[DataFrame, DataFrame]:
    """tip, at, depth of all ancestors, by doubling until no chain goes further; and the tips whose chains go on after
    so many doublings, or come back to a commit. Tables between the rounds are checkpoints."""
    jump = commits.where("parent is not null").select(F.col("manifest").alias("at"), F.col("parent").alias("to"))
    start = tips.select(F.col("manifest").alias("tip")).distinct()
    reach, endless = start.select("tip", F.col("tip").alias("at"), F.lit(0).cast("long").alias("depth")), start.where("false")
    for k in range(doublings):
        here, there = F.struct("at", "depth"), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("at"), (F.col("depth") + (1 << k)).alias("depth")))
        reach = reach.join(jump, "at", "left").select("tip", F.explode(F.filter(F.array(here, there), lambda x: x.isNotNull())).alias("x")).select("tip", "x.at", "x.depth")
        again = reach.groupBy("tip").agg(F.count("*").alias("n"), F.count_distinct("at").alias("distinct")).where("n > distinct").select("tip")
        endless = settled(endless.unionByName(again).distinct())
        reach = settled(reach.join(endless, "tip", "left_anti"))  # a cycle is known as soon as a commit comes twice
        jump = settled(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("further")), "to").select("at", F.col("further").alias("to")))
        if reach.select("at").distinct().join(jump, "at", "left_semi").isEmpty():
            break
    deep = reach.where("depth = 0").join(jump.select("at"), "at", "left_semi").select("tip", F.lit("too_deep").alias("end"))
    return reach, endless.select("tip", F.lit("cycle").alias("end")).unionByName(deep)


def chain_status(commits: DataFrame, tips: DataFrame, doublings: int = DOUBLINGS) -> DataFrame:
    """tip, depth, status of tips(manifest) in commits(manifest, parent, generation): ok, cycle (depth is null), too_deep
    (2 ** doublings ancestors or more), missing (an ancestor is absent) or regression (a parent as new as its child)."""
    reach, ends = _ancestry(commits, tips, doublings)
    parents = commits.select(F.col("manifest").alias("parent"), F.col("generation").alias("older"))
    c = commits.join(parents, "parent", "left").select(F.col("manifest").alias("at"), F.lit(True).alias("known"), F.coalesce(F.col("older") >= F.col("generation"), F.lit(False)).alias("regress"))
    by = reach.join(c, "at", "left").groupBy("tip").agg(F.max("depth").cast("int").alias("depth"), F.bool_and(F.col("known").isNotNull()).alias("known"), F.bool_or("regress").alias("regress"))
    by = by.join(ends, "tip", "full")
    status = F.when(F.col("end").isNotNull(), F.col("end")).when(~F.col("known"), "missing").when(F.col("regress"), "regression").otherwise("ok")
    return by.select("tip", "depth", status.alias("status"))


def resolve_objects(commits: DataFrame, entries: DataFrame, tips: DataFrame, doublings: int = DOUBLINGS) -> DataFrame:
    """tip, object, recipe, depth: what each tip whose chain is ok shows: of entries(manifest, object, recipe) the
    nearest to the tip; a null recipe is a tombstone, which hides the object."""
    good = chain_status(commits, tips, doublings).where("status = 'ok'").select("tip")
    reach, _ = _ancestry(commits, good.withColumnRenamed("tip", "manifest"), doublings)
    e = reach.join(entries.withColumnRenamed("manifest", "at"), "at").groupBy("tip", "object").agg(F.min_by(F.struct("recipe", "depth"), "depth").alias("x"))
    return e.select("tip", "object", "x.recipe", F.col("x.depth").cast("int").alias("depth")).where("recipe is not null")


def collectible_before(objects: DataFrame, roots: DataFrame, manifest_chunks: DataFrame, cutoff: Column) -> DataFrame:
    """Unreachable chunks of objects(chunk, created) that are older than the grace period of writers."""
    old = objects.where(F.col("created") < cutoff)
    return store.collectible(old, roots, manifest_chunks)


def metering(chunks: DataFrame) -> DataFrame:
    """tenant, logical_bytes, physical_bytes of chunks(tenant, hash, length): each distinct chunk counts once per tenant."""
    by = chunks.groupBy("tenant", "hash").agg(F.sum("length").alias("all"), F.first("length").alias("one"))
    return by.groupBy("tenant").agg(F.sum("all").alias("logical_bytes"), F.sum("one").alias("physical_bytes"))


def replica_differences(left: DataFrame, right: DataFrame, digits: int = 3) -> DataFrame:
    """id, finding (left_only, right_only or changed) between two replicas (id binary, digest), unique by id. Bucket sums
    over the first hexadecimal digits of ids are compared first (two sums of 64-bit hashes each), so that only rows of
    buckets that differ are shuffled; there are at most 16 ** digits buckets, so the list of them is broadcast."""
    if not 1 <= digits <= 4:
        raise ValueError("digits must be in 1 to 4")
    bucket = F.substring(F.hex("id"), 1, digits)

    def sums(d: DataFrame, side: str) -> DataFrame:
        total = lambda salt: F.sum(F.xxhash64("id", "digest", F.lit(salt)).cast("decimal(20,0)"))
        return d.groupBy(bucket.alias("bucket")).agg(F.struct(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).alias(side))

    differ = sums(left, "l").join(sums(right, "r"), "bucket", "full").where(~F.col("l").eqNullSafe(F.col("r"))).select(F.col("bucket").alias("__bucket"))
    some = lambda d, side: d.join(F.broadcast(differ), bucket == F.col("__bucket"), "left_semi").select("id", F.struct("digest").alias(side))
    both = some(left, "l").join(some(right, "r"), "id", "full")
    finding = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    return both.select("id", finding.alias("finding")).where("finding is not null")


def counter_values(states: DataFrame) -> DataFrame:
    """counter, value of states(counter, node, added, removed) from any number of replicas: the largest of each node's
    counts, as they only grow, summed."""
    by = states.groupBy("counter", "node").agg(F.max("added").alias("a"), F.max("removed").alias("r"))
    return by.groupBy("counter").agg((F.sum("a") - F.sum("r")).alias("value"))


def chunk_entry(chunk: Column, plain: Column, stored: Column, codec: Column, flags: Column) -> Column:
    """The 56 bytes of a chunk table's entry."""
    return F.concat(chunk, le(plain, 8), le(stored, 8), le(codec, 2), le(flags, 2), F.lit(bytes(4)))


def chunk_entry_fields(entry: Column) -> Column:
    """chunk, plain, stored, codec and flags of an entry; null where it does not have 56 bytes."""
    fields = F.struct(F.substring(entry, 1, 32).alias("chunk"), from_le(entry, 32, 8).alias("plain"), from_le(entry, 40, 8).alias("stored"), from_le(entry, 48, 2).alias("codec"), from_le(entry, 50, 2).alias("flags"))
    return F.when(F.octet_length(entry) == CHUNK_ENTRY, fields)


def refcount_segments(counts: DataFrame, generation: int, level0: bytes, digits: int = 2) -> DataFrame:
    """bucket, segment of counts(chunk, refcount): a snapshot in segments by the first hexadecimal digits of chunks, as
    one segment of all would grow with the store; entries in order of chunk. Take more digits for a larger store."""
    head = lambda n: F.concat(F.lit(REFCOUNT_MAGIC), le(F.lit(1), 2), le(F.lit(REFCOUNT_ENTRY), 2), le(n, 8), le(F.lit(generation), 8), F.lit(level0), F.lit(bytes(8)))
    entries = counts.select(F.substring(F.hex("chunk"), 1, digits).alias("bucket"), F.concat("chunk", le(F.col("refcount"), 8)).alias("entry"))
    by = entries.groupBy("bucket").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    body = F.unhex(F.array_join(F.transform("entries", F.hex), ""))
    return by.select("bucket", F.concat(head(F.size("entries")), body).alias("segment"))


def refcount_rows(segments: DataFrame) -> DataFrame:
    """bucket, generation, chunk, refcount of segments(bucket, segment), and error: one row with magic, version or length
    for a segment that cannot be read, else order (also for a chunk that repeats) or zero on the entries concerned."""
    n = ((F.octet_length("segment") - REFCOUNT_HEADER) / REFCOUNT_ENTRY).cast("int")
    bad = F.when(F.substring("segment", 1, 4) != F.lit(REFCOUNT_MAGIC), "magic").when((from_le(F.col("segment"), 4, 2) != 1) | (from_le(F.col("segment"), 6, 2) != REFCOUNT_ENTRY), "version")
    bad = bad.when((F.octet_length("segment") < REFCOUNT_HEADER) | (F.octet_length("segment") != REFCOUNT_HEADER + REFCOUNT_ENTRY * from_le(F.col("segment"), 8, 8)), "length")
    entry = lambda k: F.substr("segment", k * REFCOUNT_ENTRY + F.lit(REFCOUNT_HEADER + 1), F.lit(REFCOUNT_ENTRY))
    read = segments.withColumn("bad", bad).withColumn("k", F.explode_outer(F.when(F.col("bad").isNull() & (n > 0), F.sequence(F.lit(0), n - 1))))
    read = read.where("bad is not null or k is not null").select("bucket", from_le(F.col("segment"), 16, 8).alias("generation"), "bad", "k", F.when(F.col("k").isNotNull(), entry(F.col("k"))).alias("entry"), F.when(F.col("k") > 0, F.substring(entry(F.col("k") - 1), 1, 32)).alias("before"))
    chunk, count = F.substring("entry", 1, 32), from_le(F.col("entry"), 32, 8)
    error = F.coalesce("bad", F.when(F.col("before") >= chunk, "order").when(count == 0, "zero"))
    return read.select("bucket", F.when(F.col("bad").isNull(), F.col("generation")).alias("generation"), chunk.alias("chunk"), count.alias("refcount"), error.alias("error"))


def commit_record(generation: Column, level0: Column, previous: Column, created_ns: Column) -> Column:
    """The 96 bytes of a commit record; no previous commit is null."""
    return F.concat(F.lit(COMMIT_MAGIC), le(F.lit(1), 2), le(F.lit(0), 2), le(generation, 8), level0, F.coalesce(previous, F.lit(bytes(32))), le(created_ns, 8), F.lit(bytes(8)))


def commit_fields(record: Column) -> Column:
    """generation, level0, previous, created_ns and error (length, magic or version) of a commit record."""
    error = F.when(record.isNull() | (F.octet_length(record) != COMMIT_SIZE), "length").when(F.substring(record, 1, 4) != F.lit(COMMIT_MAGIC), "magic").when(from_le(record, 4, 2) != 1, "version")
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(from_le(record, 8, 8)).alias("generation"), good(F.substring(record, 17, 32)).alias("level0"), good(F.nullif(F.substring(record, 49, 32), F.lit(bytes(32)))).alias("previous"), good(from_le(record, 80, 8)).alias("created_ns"), error.alias("error"))


def tag_binding(tag: Column, commit: Column, generation: Column) -> Column:
    return F.concat(le(F.octet_length(tag), 2), columns.utf8(tag), commit, le(generation, 8))


def tag_binding_fields(binding: Column) -> Column:
    """tag, commit and generation of a binding; null where its length is not what its tag says."""
    n = from_le(binding, 0, 2).cast("int")
    part = lambda at, size: F.substr(binding, at, size)
    fields = F.struct(F.decode(part(F.lit(3), n), "UTF-8").alias("tag"), part(n + 3, F.lit(32)).alias("commit"), from_le(part(n + 35, F.lit(8)), 0, 8).alias("generation"))
    return F.when(F.octet_length(binding) == n + 42, fields)
