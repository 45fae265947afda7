"""Known answers, definitions and SQL oracles for the engine."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import cdc, codecs, columns, digest
from quarry.plans import catalogue
from quarry.streaming import push

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_golden_boundaries():
    data = bytes((31 * i + i // 7) % 251 for i in range(65_659))
    got = cdc.cut_lengths(data, cdc.ChunkOptions(1024, 6000, 16384))
    assert got == [6162, *[7028] * 8, 3273]


@given(st.integers(0, 2**32), st.integers(0, 6000), st.sampled_from([(64, 256, 1024), (64, 300, 1500), (128, 1024, 4096)]), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_fast_cuts_equal_definition_and_slices(seed, n, sizes, bits):
    rng = random.Random(seed)
    data, o = bytes(rng.getrandbits(bits) for _ in range(n)), cdc.ChunkOptions(*sizes)
    want = cdc.cut_lengths_stepwise(data, o)
    assert cdc.cut_lengths(data, o) == want and sum(want) == n
    c, got, at = cdc.SliceCutter(o), [], 0
    while at < n:
        step = rng.randint(0, 700)
        got += c.push(data[at : at + step])
        at += step
    got += c.finish()
    assert [len(x) for _, x in got] == want and b"".join(x for _, x in got) == data and c.finish() == []
    with pytest.raises(ValueError):
        c.push(b"x")


def test_options():
    for good in ((64, 1024, 4096), (64, 256, 1024), (1 << 20, 4 << 20, 16 << 20)):
        cdc.ChunkOptions(*good)
    for bad, field in (((32, 1024, 4096), "min_size"), ((64, 64, 64), "avg_size"), ((64, 1024, 64 << 20), "max_size"), ((1024, 512, 4096), "avg_size"), ((64, 4096, 2048), "max_size")):
        with pytest.raises(ValueError, match=field):
            cdc.ChunkOptions(*bad)


def test_known_digests():
    assert digest.blake3(b"hello world").hex() == "d74981efa70a0c880b8d8c1985d075dbcbf679b99a5f9914e5aaf96b831a9e24"
    assert digest.shake256(b"").hex() == "46b9dd2b0ba88d13233b3feb743eeb243fcd52ea62b81b82b50c27646ed5762f"
    assert digest.forward_base32(b"foo") == "6vvy6" and digest.nix_base32(b"foo") == "6yvv6" and digest.nix_base32(b"") == ""
    import base64

    assert digest.nix_base32(base64.b64decode("LHmbxrZuoUhZ7p0Q+oD4wBzxH/byKBAKbJsfAZXoBCU=")) == "0984x2ah27wvdh510a7jyqgz2760z20gl44xxrcli8bfnv39ny9c"
    for n in (0, 1, 20, 32):
        b = bytes(range(n))
        assert digest.nix_base32_decode(digest.nix_base32(b)) == b == digest.forward_base32_decode(digest.forward_base32(b))
    with pytest.raises(ValueError):
        digest.nix_base32_decode("invalid!")
    # RFC 8032, test 1
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert digest.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert digest.sign(seed, b"").hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert digest.verify(digest.public_key(seed), b"", digest.sign(seed, b""), True) and not digest.verify(digest.public_key(seed), b"x", digest.sign(seed, b""))


def test_codecs():
    for codec in ("zstd", "lz4", "xz", "bzip2"):
        for data in (b"", b"A" * 101, bytes(range(256)) * 50):
            z = codecs.compress(codec, data)
            assert codecs.detect(z) == codec and codecs.decompress_auto(z) == data
        z = codecs.compress(codec, b"A" * 101)
        assert codecs.decompress(codec, z, 101) == b"A" * 101
        with pytest.raises(codecs.SizeExceeded):
            codecs.decompress(codec, z, 100)
    assert codecs.detect(b"BZh") is None and codecs.decompress_auto(b"plain text", passthrough=True) == b"plain text"
    with pytest.raises(ValueError, match="unknown_format"):
        codecs.decompress_auto(b"\0\0\0\0")
    assert codecs.decompress("zstd", codecs.compress("zstd", b"abc" * 9, dictionary=b"tiny-zstd-dictionary"), dictionary=b"tiny-zstd-dictionary") == b"abc" * 9


def test_witness_chain():
    chain = digest.witness_chain([(bytes(32), 10, 1), (bytes([1]) * 32, 11, 2)])
    assert len(chain) == 146 and [x[2:] for x in digest.verify_witness_chain(chain)] == [(10, 1), (11, 2)]
    for bad in (chain[:80] + bytes([chain[80] ^ 1]) + chain[81:], chain[:-1]):
        with pytest.raises(ValueError):
            digest.verify_witness_chain(bad)


def test_scalars(spark):
    df = spark.createDataFrame([("foobar",), ("fo",), ("f",), ("abc",), ("a=b=",), ("!!!!",)], "s string")
    got = df.select(columns.base64_plain(columns.utf8(F.col("s"))), columns.base64_decode(F.col("s")), columns.base64_error(F.col("s"))).collect()
    assert [r[0] for r in got[:3]] == ["Zm9vYmFy", "Zm8=", "Zg=="] and [r[2] for r in got[3:]] == ["length", "padding", "char"] and all(r[1] is None for r in got[3:])
    assert df.select(columns.blake3_hex(columns.utf8(F.lit("hello world")))).first()[0].startswith("d74981ef")
    columns.register(spark, catalogue.SMALL)
    assert spark.sql("select sum(length) from cdc_chunks(encode(repeat('abcdefgh', 1000), 'UTF-8'))").first()[0] == 8000


def test_placement_follows_definition(spark):
    from quarry.operators import store

    r, o = catalogue.catalogue_of_resources(spark)
    res, plans = r.collect(), {}
    for c in o.collect():
        key = digest.content_id(1, c["class"].encode())
        ranked = sorted(res, key=lambda x: (-digest.weight(x.id, key), x.id))
        if c["class"] in ("too-many", "odd"):
            continue
        out = [x for x in ranked if x.backend == "archive"][:1] if c.require_archive else []
        for field, least in ((lambda x: x.region, c.min_regions), (lambda x: (x.region, x.zone), c.min_zones)):
            for x in ranked:
                if len({field(y) for y in out}) < least and field(x) not in {field(y) for y in out}:
                    out.append(x)
        out += [x for x in ranked if x not in out][: c.replicas - len(out)]
        plans[c["class"]] = [x.id for x in out]
    got = {}
    for x in store.plan_placement(r, o).orderBy("class", "position").collect():
        got.setdefault(x["class"], []).append(x.id)
    assert got == plans


def test_streaming_push_equals_batch(spark, tmp_path):
    rows = catalogue.slices(spark, SF).where("cast(upload as long) < 40")
    rows.repartition(3, "slice_no").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = push.push_chunks(src, catalogue.SMALL).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["upload", "offset", "length", "hash"]
    got = spark.read.parquet(str(tmp_path / "out")).select(key).collect()
    want = push.push_chunks_batch(rows, catalogue.SMALL).select(key).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and want


def test_push_query_equals_boundaries(spark):
    cols = ["doc_id", "seq", "offset", "length"]
    assert Counter(map(tuple, catalogue.push_equals_batch(spark, SF).select(cols).collect())) == Counter(map(tuple, catalogue.chunk_boundaries(spark, SF).select(cols).collect()))


def test_dedup_totals(spark):
    assert tuple(catalogue.dedup_summary(spark, "/root/testdata/sf0.01").first()) == (8325, 7634, 2472458, 2280400)


def test_object_store(spark, tmp_path):
    from quarry.sources import objects

    s = catalogue.streams(spark, SF).select(columns.content_id()("payload").alias("id"), F.lit(1).alias("kind"), "payload").dropDuplicates(["id"])
    path = str(tmp_path / "objects")
    objects.write_objects(s.limit(50), path)
    objects.append_new(spark, s, path)
    assert objects.read_objects(spark, path).count() == s.count()


def test_sigv4_known_answer():
    from quarry.functions import sigv4

    got = sigv4.authorization("AKIDEXAMPLE", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "20150830T123600Z", "us-east-1", "service", "GET", "/", {"Host": "example.amazonaws.com", "X-Amz-Date": "20150830T123600Z"})
    assert got.endswith("Signature=5fa00fa31553b73ebf1942676e86291e8372ff2a2260956d9b8aae1d763fbf31")


def test_catalogue_document(spark):
    from quarry.sources.config import load_catalogue

    good = "version: 1\nresources:\n- {id: a, region: r, zone: z, backend: object}\nclasses:\n- {name: c, replicas: 1}\n"
    r, c = load_catalogue(spark, good)
    assert r.count() == 1 and tuple(c.first()) == ("c", 1, 1, 1, False)
    for a, b, why in (("version: 1", "version: 2", "version"), ("zone: z", "zone: ' '", "zone"), ("zone: z", "zone: z, x: 1", "unknown"), ("object", "tape", "backend"), ("classes:\n- {name: c, replicas: 1}\n", "", "classes"), ("resources:\n", "resources:\n- {id: a, region: r, zone: y, backend: object}\n", "duplicate")):
        with pytest.raises(ValueError, match=why):
            load_catalogue(spark, good.replace(a, b))


def test_streaming_witness(spark, tmp_path):
    from quarry.operators import protocol

    rows = [("a", k, bytes([k]) * 32, k, 1) for k in range(6)] + [("b", k, bytes([9]) * 32, k, 2) for k in range(3)]
    schema = "log string, seq long, action_hash binary, timestamp_ns long, witness_type int"
    for at in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] >= 3) == bool(at)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = push.append_witness(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = protocol.verify_witness(spark.read.parquet(str(tmp_path / "out")), "log").collect()
    assert {(r.log, r.n, r.valid) for r in got} == {("a", 6, True), ("b", 3, True)}


def test_routed_reads_ask_owners_in_order(spark):
    from quarry.operators import routing, store

    ids = [digest.content_id(1, bytes([k])) for k in range(30)]
    keys = spark.createDataFrame([(bytearray(i),) for i in ids], "id binary")
    peers = [("n2", i, b"two") for i in ids[:20]] + [("n3", i, b"three") for i in ids[10:25]]
    peers = spark.createDataFrame([(n, bytearray(i), bytearray(p)) for n, i, p in peers], "node string, id binary, payload binary")
    got = {bytes(r.id): (r.status, r.source) for r in routing.routed_get(keys, peers.limit(0).select("id", "payload"), peers, catalogue.NODES, 2, "n1", ["n4"]).collect()}
    have, want = {(r.node, bytes(r.id)) for r in peers.collect()}, {}
    for i in ids:
        want[i] = ("missing", None)
        for n in sorted(catalogue.NODES, key=lambda n: (-digest.weight(n, i), n))[:2]:
            if n == "n4" or n != "n1" and (n, i) in have:
                want[i] = ("error" if n == "n4" else "ok", n)
                break
    assert got == want and {s for s, _ in got.values()} == {"ok", "error", "missing"}
    own = routing.is_owner(keys.select(F.col("id").alias("key")), catalogue.NODES, 2, "n1").where("owner").count()
    sent = routing.routed_put(keys, catalogue.NODES, 2, "n1", ["n4"])
    assert sent.where("status = 'durable'").count() == 30 and sent.where("node <> 'n1'").count() == 60 - own
    assert {r.status for r in sent.where("node = 'n4'").collect()} == {"failed"}
    assert keys.limit(1).select(routing.blob_url(F.lit("http://a/"), F.col("id"))).first()[0].startswith("http://a/swarm/blob/")
    assert store.owners(keys.select(F.col("id").alias("key")), catalogue.NODES, 9).count() == 120


def test_node_finds_absent_and_changed_chunks(spark):
    from quarry.operators import routing

    files = spark.createDataFrame([("a", bytearray(b"x" * 3000)), ("b", bytearray(random.Random(1).randbytes(3000))), ("empty", bytearray())], "name string, payload binary")
    objects, manifests, roots = routing.node_put(files, catalogue.SMALL)
    names = spark.createDataFrame([("a",), ("b",), ("empty",), ("none",)], "name string")
    chunk = {n: manifests.join(roots.where(F.col("name") == n), "manifest").orderBy("seq").first()["chunk"] for n in "ab"}
    get = lambda o: {r.name: (r.status, r.payload and bytes(r.payload)) for r in routing.node_get(names, roots, manifests, o).collect()}
    whole = get(objects)
    assert whole["a"] == ("ok", b"x" * 3000) and whole["empty"][0] == "ok" and whole["none"] == ("unknown", None)
    assert get(objects.where(F.col("id") != F.lit(bytes(chunk["b"]))))["b"][0] == "missing_chunk " + chunk["b"].hex()
    changed = F.when(F.col("id") == F.lit(bytes(chunk["a"])), F.lit(b"y")).otherwise(F.col("payload"))
    assert get(objects.withColumn("payload", changed))["a"] == ("integrity", None)


def test_requests_and_responses(spark):
    from quarry.operators import protocol

    raws = ["GET / HTTP/1.1\r\n\r\n", "GET /a\r\n", "", "\r\n\r\n", "PUT /a x\nContent-Length: 3\ncontent-length: +4\n\nbody: 9\n\n", "PUT /a x\nContent-Length:\n\n", "PUT /a x\nContent-Length: 18446744073709551616\n\n", None]
    got = [r.h and tuple(r.h) for r in spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, r string").select("k", protocol.request_head(F.col("r")).alias("h")).orderBy("k").collect()]
    bad = lambda e: (None, None, None, None, e)
    assert got == [("GET", "/", 0, None, None), bad("unexpected eof in headers"), None, bad("malformed request line"), ("PUT", "/a", 4, None, None), bad("invalid content-length"), bad("invalid content-length"), None]
    df = spark.createDataFrame([("GET",), ("HEAD",)], "m string")
    out = [bytes(r[0]) for r in df.select(protocol.response(F.col("m"), F.lit(200), F.lit("OK"), F.lit("text/plain"), F.lit(b"body"))).collect()]
    assert out[0] == out[1] + b"body" and b"Content-Length: 4\r\n" in out[1] and out[1].endswith(b"\r\n\r\n")
    log = spark.createDataFrame([(1, "PUT", "a", 403), (2, "GET", "a", 200), (3, "PUT", "a", 200), (4, "GET", "a", 200), (5, "DELETE", "a", 401)], "seq long, method string, path string, verdict int")
    assert [r.status for r in protocol.request_log(log).orderBy("seq").collect()] == [403, 404, 200, 200, 401]


def test_manifest_records():
    from quarry.operators import manifest

    full = [(1, 0, b"objects"), (2, 0, b"chunks!!"), (7, 0, b""), (99, 0, b"skipped")]
    blob = manifest.level1_encode(full)
    assert len(blob) % 8 == 0 and manifest.level1_decode(blob) == (full[:3], None)
    error = lambda b: manifest.level1_decode(b)[1]
    assert error(blob[:-1]) == error(blob[:4]) == error(b"\1\0\0\0\xff\xff\xff\xff") == "truncated" and error(b"") == "missing"
    assert error(manifest.level1_encode([*full, (98, 1, b"")])) == "critical" and error(manifest.level1_encode([*full, (2, 0, b"")])) == "repeated"
    one = manifest.level1_encode(full[:1])
    assert error(one[:-1] + b"x") == "padding" and error(manifest.level1_encode(full[1:2]) + one) == "order" and manifest.level1_decode(blob, 2)[1] == "too_many"


def test_manifest_columns_and_recipes(spark):
    from quarry.operators import manifest

    blob = bytearray(manifest.level1_encode([(1, 0, b"a"), (2, 0, b""), (7, 0, b"")]))
    got = spark.createDataFrame([(1, blob), (2, None)], "k int, b binary").select("k", manifest.level1_fields("b").alias("f")).orderBy("k").collect()
    assert [(r.tag, bytes(r.value)) for r in got[0].f.records] == [(1, b"a"), (2, b""), (7, b"")] and got[0].f.error is None and got[1].f.error == "missing"
    n = spark.createDataFrame([(0,), (258,), (2**40 + 5,)], "n long").select("n", manifest.from_le(manifest.le(F.col("n"), 8), 0, 8).alias("m"), manifest.le(F.col("n"), 8).alias("b")).collect()
    assert all(r.m == r.n and bytes(r.b) == r.n.to_bytes(8, "little") for r in n)
    rows = [("ok", 5, 0, 0, 2), ("ok", 5, 1, 2, 3), ("gap", 6, 0, 0, 2), ("gap", 6, 1, 3, 3), ("overlap", 4, 0, 0, 2), ("overlap", 4, 1, 1, 3), ("start", 3, 0, 1, 2), ("end", 9, 0, 0, 2)]
    e = spark.createDataFrame(rows, "object string, nar_length long, seq int, logical_offset long, length long")
    assert {r.object: r.finding or "ok" for r in manifest.recipe_findings(e).collect()} == {k: k for k in ("ok", "gap", "overlap", "start", "end")}


def test_manifest_byte_forms(spark):
    from quarry.operators import manifest

    a, b = bytes(range(32)), bytes([1]) * 32
    c = spark.createDataFrame([(bytearray(b), 3), (bytearray(a), 1), (bytearray(bytes([0]) + b[1:]), 2)], "chunk binary, refcount long")
    seg = manifest.refcount_segments(c, 9, b).collect()
    assert sorted(len(r.segment) for r in seg) == [64 + 40, 64 + 80]
    whole = bytes(next(r.segment for r in seg if r.bucket == "00"))
    bad = {"good": whole, "magic": b"x" + whole[1:], "version": whole[:6] + b"\x29" + whole[7:], "length": whole[:-1], "order": whole[:64] + whole[104:] + whole[64:104], "zero": whole[:-8] + bytes(8), "short": whole[:20], "empty": whole[:8] + bytes(8) + whole[16:64]}
    rows = manifest.refcount_rows(spark.createDataFrame([(k, bytearray(v)) for k, v in bad.items()], "bucket string, segment binary")).collect()
    got = {k: sorted([r.error or "" for r in rows if r.bucket == k]) for k in bad}
    assert got == {"good": ["", ""], "magic": ["magic"], "version": ["version"], "length": ["length"], "order": ["", "order"], "zero": ["", "zero"], "short": ["length"], "empty": []}
    assert {(bytes(r.chunk), int(r.refcount), int(r.generation)) for r in rows if r.bucket == "good"} == {(a, 1, 9), (bytes([0]) + b[1:], 2, 9)}
    d = spark.createDataFrame([(1, bytearray(a), bytearray(b), "main/é")], "g long, a binary, b binary, t string")
    r = d.select(manifest.commit_fields(manifest.commit_record(F.col("g"), F.col("a"), F.col("b"), F.lit(5))).alias("c"), manifest.commit_fields(F.lit(b"x")).alias("x"), manifest.tag_binding_fields(manifest.tag_binding(F.col("t"), F.col("b"), F.col("g"))).alias("t"), manifest.tag_binding_fields(F.lit(b"\5\0abc")).alias("u"), manifest.chunk_entry_fields(manifest.chunk_entry(F.col("a"), F.lit(10), F.lit(7), F.lit(1), F.lit(0))).alias("e")).first()
    assert (int(r.c.generation), bytes(r.c.level0), bytes(r.c.previous), int(r.c.created_ns), r.c.error) == (1, a, b, 5, None) and r.x.error == "length" and r.x.generation is None
    assert (r.t.tag, bytes(r.t.commit), int(r.t.generation)) == ("main/é", b, 1) and r.u is None
    assert (bytes(r.e.chunk), *map(int, r.e[1:])) == (a, 10, 7, 1, 0)


def test_overlay_chains(spark):
    from quarry.operators import manifest

    rows = [(k, k - 1 if k else None, k) for k in range(40)] + [(100, 101, 5), (101, 100, 4), (200, 999, 1), (300, 301, 1), (301, None, 2)]
    c = spark.createDataFrame(rows, "manifest long, parent long, generation long")
    tips = spark.createDataFrame([(x,) for x in (0, 15, 16, 39, 100, 200, 300)], "manifest long")
    assert {r.tip: r.status for r in manifest.chain_status(c, tips).collect()} == {0: "ok", 15: "ok", 16: "ok", 39: "ok", 100: "cycle", 200: "missing", 300: "regression"}
    assert {r.tip: r.status for r in manifest.chain_status(c, tips, 4).where("tip < 50").collect()} == {0: "ok", 15: "ok", 16: "too_deep", 39: "too_deep"}
    assert {r.tip: r.depth for r in manifest.chain_status(c, tips, 6).where("tip < 50").collect()} == {0: 0, 15: 15, 16: 16, 39: 39}


def test_settings():
    from quarry.sources import settings

    env = {"X_S3_ENDPOINT": "https://h/x/", "X_S3_BUCKET": "b", "X_S3_REGION": "r", "X_S3_ACCESS_KEY_ID": "a", "X_S3_SECRET_ACCESS_KEY": "s", "X_S3_PREFIX": ""}
    assert settings.object_store(env, "X_") == settings.ObjectStore("https://h/x", "b", "r", "a", "s", None) and settings.object_store({}, "X_") is None
    for k, v in (("X_S3_ENDPOINT", "ftp://h"), ("X_S3_ENDPOINT", "https:///x"), ("X_S3_BUCKET", "")):
        with pytest.raises(ValueError):
            settings.object_store(env | {k: v}, "X_")
    with pytest.raises(ValueError, match="X_S3_REGION"):
        settings.object_store({k: v for k, v in env.items() if k != "X_S3_REGION"}, "X_")
    assert settings.swarm({"X_SWARM_SELF": " "}, "X_") is None
    assert settings.swarm({"X_SWARM_SELF": "http://a/ ", "X_SWARM_PEERS": "http://b/, ,http://a"}, "X_") == settings.Swarm("http://a", ("http://a", "http://b"), 3)
    assert settings.swarm({"X_SWARM_SELF": "a", "X_SWARM_REPLICAS": "0"}, "X_").replicas == 1
    with pytest.raises(ValueError, match="REPLICAS"):
        settings.swarm({"X_SWARM_SELF": "a", "X_SWARM_REPLICAS": "-1"}, "X_")
    assert settings.node(["l"], "d1", "d2", {"X_DATA_DIR": "e"}, "X_") == ("l", "e") and settings.node([], "d1", "d2", {}, "X_") == ("d1", "d2")


def same(v):
    return round(v, 6) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in want.description]
    got = catalogue.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(lambda r: tuple(map(same, r)), want.fetchall())) == Counter(tuple(map(same, r)) for r in got.select(names).collect())


# ---- limits, keys, lookups
def test_readers_are_bounded():
    import io

    o = cdc.ChunkOptions(64, 256, 1024)
    data = bytes(random.Random(4).randbytes(50_000))
    whole = [n for n in cdc.cut_lengths(data, o)]
    for size in (None, 4096, 5000, "9000"):
        got = cdc.collect_chunks(cdc.read_chunks(io.BytesIO(data), o, size), 50_000)
        assert [len(x) for _, x in got] == whole and b"".join(x for _, x in got) == data
    with pytest.raises(cdc.BufferLimitExceeded) as e:
        cdc.collect_chunks(cdc.read_chunks(io.BytesIO(data), o), 49_999)
    assert (e.value.attempted, e.value.limit) == (50_000, 49_999)
    assert [cdc.read_slice_cap(x) for x in (None, "x", 4095, 4096, 256 << 20, (256 << 20) + 1)] == [8 << 20, 8 << 20, 8 << 20, 4096, 256 << 20, 8 << 20]
    assert [cdc.buffer_limit(x) for x in (None, "1", 3 << 30, 9 << 30)] == [2 << 30, 64 << 20, 3 << 30, 3 << 30]


@pytest.mark.parametrize("stretch", [64, 100, 1 << 16])
def test_cuts_do_not_depend_on_stretches(monkeypatch, stretch):
    monkeypatch.setattr(cdc, "STRETCH", stretch)
    rng = random.Random(stretch)
    for n in (0, 63, 64, 65, 1000, 9000):
        data = bytes(rng.choices(b"ab\x00\xff", k=n)) if n % 2 else rng.randbytes(n)
        for o in (cdc.ChunkOptions(64, 256, 1024), cdc.ChunkOptions(100, 300, 1500)):
            assert cdc.cut_lengths(data, o) == cdc.cut_lengths_stepwise(data, o)


def test_small_slices_are_not_hashed_again_and_again(monkeypatch):
    seen, real = [], cdc.cut_lengths
    monkeypatch.setattr(cdc, "cut_lengths", lambda data, o: seen.append(len(data)) or real(data, o))
    cutter, data = cdc.SliceCutter(cdc.ChunkOptions(1024, 4096, 65536)), bytes(100_000)
    got = [x for i in range(0, len(data), 64) for x in cutter.push(data[i : i + 64])] + cutter.finish()
    assert [len(x) for _, x in got] == real(data, cdc.ChunkOptions(1024, 4096, 65536)) and sum(seen) < 12 * len(data)


def test_streams_are_cut_off_and_strategies_have_codecs():
    from quarry.functions import codecs

    data = b"A" * 1000
    for strategy, codec in codecs.STRATEGY.items():
        z = codecs.compress_for(strategy, data)
        assert codecs.detect(z) == codec and codecs.decompress_auto(z) == data
        assert codecs.decompress_auto(z, 100, passthrough=True) == data[:100]
        with pytest.raises(codecs.SizeExceeded):
            codecs.decompress_auto(z, 100)


def test_key_pairs_sign_and_verify():
    from quarry.functions import keys

    secret, public = keys.generate_keypair()
    signature = keys.sign_data(b"m", secret)
    assert keys.signature_error(b"m", signature, public) is None and keys.signature_error(b"n", signature, public) == keys.VERIFICATION
    assert keys.generate_keypair()[0] != secret


def test_long_chains_and_cycles(spark):
    from quarry.operators import manifest

    line = [(i, i - 1 if i else None, i) for i in range(300)]
    ring = [(1000 + i, 1000 + (i + 1) % 7, i) for i in range(7)] + [(2000, 1003, 9), (3000, 3000, 1), (4000, 4001, 5), (5000, 0, 0)]
    commits = spark.createDataFrame(line + ring, "manifest long, parent long, generation long")
    tips = spark.createDataFrame([(i,) for i in (0, 1, 17, 299, 1002, 2000, 3000, 4000, 5000)], "manifest long")
    got = {r.tip: (r.depth, r.status) for r in manifest.chain_status(commits, tips).collect()}
    assert got == {0: (0, "ok"), 1: (1, "ok"), 17: (17, "ok"), 299: (299, "ok"), 1002: (None, "cycle"), 2000: (None, "cycle"), 3000: (None, "cycle"), 4000: (1, "missing"), 5000: (1, "regression")}
    assert {r.tip: r.status for r in manifest.chain_status(commits, tips.where("manifest in (17, 299)"), doublings=5).collect()} == {17: "ok", 299: "too_deep"}
    entries = spark.createDataFrame([(0, "a", 10), (5, "b", 20), (200, "a", 30)], "manifest long, object string, recipe long")
    shown = {(r.tip, r.object): (r.recipe, r.depth) for r in manifest.resolve_objects(commits, entries, tips).collect()}
    assert shown == {(0, "a"): (10, 0), (1, "a"): (10, 1), (17, "a"): (10, 17), (17, "b"): (20, 12), (299, "a"): (30, 99), (299, "b"): (20, 294)}


def test_functions_are_callable_from_sql(spark):
    from quarry.functions import columns, keys

    columns.register(spark)
    secret, public = keys.generate_keypair()
    r = spark.sql(f"select sign_data(cast('m' as binary), '{secret}').signature as s, sha256_raw(cast('hello world' as binary)) as h, nix_base32_encode(cast('foo' as binary)) as n, forward_base32_encode(cast('foo' as binary)) as f, decompress_auto(compress_smallest(cast('x' as binary))).data as x").first()
    assert bytes(r.h).hex().startswith("b94d27b9") and (r.n, r.f, bytes(r.x)) == ("6yvv6", "6vvy6", b"x")
    assert spark.sql(f"select signature_error(cast('m' as binary), '{r.s}', '{public}') as e").first().e is None


# ---- audits, published reads
def test_published_reads_find_changed_and_absent_chunks(spark):
    from quarry.operators import lifecycle, manifest

    parts = {"a": [b"one", b"two"], "b": [b"two", b"three"], "c": [b"three", b"four"], "d": [b"one", b"one"], "e": []}
    id_ = lambda kind, x: digest.content_id(digest.KINDS[kind], x)
    rows = [(t, bytes([i + 1]) * 32, len(p), sum(map(len, p))) for i, (t, p) in enumerate(sorted(parts.items()))]
    h = spark.createDataFrame([(t, bytearray(x), n, size) for t, x, n, size in rows], "tag string, level1 binary, n long, size long")
    h = h.withColumn("head", manifest.level0_blob(F.lit(1), F.lit(1), F.col("size"), F.col("n"), F.col("level1"), F.lit(None).cast("binary"))).withColumn("level0", columns.content_id("level0")("head"))
    h = h.withColumn("record", manifest.commit_record(F.lit(1), F.col("level0"), F.lit(None).cast("binary"), F.lit(1))).withColumn("id", columns.content_id("commit")("record"))
    blobs = h.select("id", F.col("record").alias("payload")).unionByName(h.select(F.col("level0").alias("id"), F.col("head").alias("payload")))
    level1 = {t: x for t, x, _, _ in rows}
    entries = [(bytearray(level1[t]), k, sum(map(len, p[:k])), len(x), bytearray(id_("chunk", x))) for t, p in parts.items() for k, x in enumerate(p)]
    entries = spark.createDataFrame(entries, "level1 binary, seq int, logical_offset long, length long, chunk binary")
    held = [(bytearray(id_("chunk", x)), bytearray(y)) for x, y in ((b"one", b"one"), (b"two", b"two"), (b"three", b"thr33"))]
    objects = spark.createDataFrame(held, "id binary, payload binary")
    tags = h.select("tag", F.col("id").alias("commit")).unionByName(spark.createDataFrame([("x", None)], "tag string, commit binary"))
    read = lambda **k: {r.tag: (r.status, None if r.payload is None else bytes(r.payload)) for r in lifecycle.read_published(tags, blobs, entries, objects, **k).collect()}
    assert read() == {"a": ("ok", b"onetwo"), "b": ("integrity", None), "c": ("integrity", None), "d": ("ok", b"oneone"), "e": ("ok", b""), "x": ("unknown", None)}
    assert {t: s for t, (s, _) in read(max_entries=1).items()} == {"a": "limit", "b": "limit", "c": "limit", "d": "limit", "e": "ok", "x": "unknown"}
    objects = objects.where(objects.id != F.lit(bytes(id_("chunk", b"three"))))
    assert {t: s for t, (s, _) in read().items()} == {"a": "ok", "b": "missing_chunk", "c": "missing_chunk", "d": "ok", "e": "ok", "x": "unknown"}
    entries = entries.withColumn("length", F.col("length") + F.when(F.col("seq") == 1, 1).otherwise(0))
    assert read()["a"][0] == "recipe_end"


def test_placement_audit_of_odd_copies(spark):
    from quarry.operators import lifecycle

    r, _ = catalogue.catalogue_of_resources(spark)
    keys = spark.createDataFrame([(1, "premium"), (2, "premium"), (3, None), (4, "ephemeral")], "key int, class string")
    copies = [(1, "us-a", "durable"), (1, "us-a", "durable"), (1, "eu-a", "latency"), (2, "us-a", "durable"), (2, "eu-a", "durable"), (4, "nowhere", "durable"), (4, None, "durable")]
    got = lifecycle.placement_findings(keys, spark.createDataFrame(copies, "key int, resource string, role string"), r, lifecycle.service_objectives(spark))
    assert {(x.key, x.finding) for x in got.collect()} == {(1, "replicas"), (1, "regions"), (1, "zones"), (3, "class"), (4, "replicas"), (4, "regions"), (4, "zones"), (4, "resource")}


def test_moves_that_no_change_of_members_explains(spark):
    from quarry.operators import lifecycle

    df = lambda rows: spark.createDataFrame(rows, "key string, node string")
    before = df([("a", "1"), ("b", "1"), ("c", "2")])
    assert lifecycle.unneeded_moves(before, df([("a", "3"), ("b", "2"), ("c", "1")]), ["3"], ["2"]).collect() == [("b", "2")]


def test_reclaim_verdicts(spark):
    from quarry.operators import lifecycle

    c = spark.createDataFrame([(k, k != 6) for k in range(8)] + [(8, None)], "chunk int, tombstoned boolean")
    refs = [(0, None, None, None), (1, True, True, None), (2, True, None, 9), (3, True, False, 5), (4, True, None, None), (4, False, None, None)]
    refs = spark.createDataFrame(refs, "chunk int, deleted boolean, hold boolean, retain_until int")
    got = lifecycle.reclaim_verdicts(c, refs, spark.createDataFrame([(5,), (5,)], "chunk int"), F.lit(5))
    assert {r.chunk: r.verdict for r in got.collect()} == {0: "live", 1: "held", 2: "retained", 3: "reclaim", 4: "live", 5: "repair", 6: "no_tombstone", 7: "reclaim", 8: "no_tombstone"}


def test_keys_that_come_up_often_are_multiplied_by_tables():
    """The same signatures and verdicts by a table of multiples as by doubling, and far fewer operations."""
    seed = bytes(range(32))
    public, secret = digest.public_key(seed), digest._secret(seed)[0]
    for k in (0, 1, 15, 16, secret, digest.L - 1, (1 << 255) - 1):
        table = digest._Multiples(digest._B, 8, often=0), digest._Multiples(digest._point(public), 4, often=0)
        assert [digest._bytes(m.times(k)) for m in table] == [digest._bytes(digest._mul(k, m.point)) for m in table]
    message = [b"%d" % k for k in range(40)]
    signed = [digest.sign(seed, m) for m in message]
    plain, digest._add = digest._add, lambda p, q: (count.append(1), plain(p, q))[1]
    count: list = []
    try:
        assert all(digest.verify(public, m, s, True) for m, s in zip(message, signed, strict=True))
        count.clear()
        assert all(digest.verify(public, m, s) for m, s in zip(message, signed, strict=True)) and not digest.verify(public, b"x", signed[0])
    finally:
        digest._add = plain
    assert len(count) < 10 * len(message), "every product is doubled again"


def test_small_orders_and_odd_encodings_are_told_as_before():
    identity, minus = digest._bytes((0, 1, 1, 0)), (digest.P - 1).to_bytes(32, "little")
    odd = [(digest.P + 1).to_bytes(32, "little"), (1 | 1 << 255).to_bytes(32, "little")]
    for key in (identity, minus):
        assert digest.verify(key, b"m", identity + bytes(32)) is (key == identity or hash_is_even(identity, key)) and not digest.verify(key, b"m", identity + bytes(32), True)
    assert not any(digest.verify(identity, b"m", r + bytes(32)) or digest.verify(r, b"m", identity + bytes(32)) for r in odd)
    public = digest.public_key(bytes(32))
    s = digest.sign(bytes(32), b"m")
    assert not digest.verify(public, b"m", s[:32] + (int.from_bytes(s[32:], "little") + digest.L).to_bytes(32, "little"))


def hash_is_even(r, key):
    return int.from_bytes(hashlib.sha512(r + key + b"m").digest(), "little") % digest.L % 2 == 0


def test_costly_functions_of_few_narrow_rows_run_on_all_cores(spark):
    """A file of suppliers is read by one task; signing and verifying are not left to it."""
    for name in ("signature_errors", "signature_verdicts", "narinfo_resign", "token_verdicts", "named_keys", "narinfo_errors"):
        assert catalogue.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_column_functions_hand_large_results_over_in_pieces():
    """A batch of many rows is never held as Python objects, nor its results as one batch."""
    import pyarrow as pa

    data = bytes(range(256)) * 2048
    z = codecs.compress("zstd", data)
    pieces = list(columns.decompress("zstd").func(iter([pa.array([z] * 40 + [None, b"none of it"])])))
    got = [x for p in pieces for x in p.to_pylist()]
    assert max(p.nbytes for p in pieces) <= columns.HANDED + 2 * len(data) and len(pieces) > 10
    assert got == [{"data": data, "error": None}] * 40 + [{"data": None, "error": None}, {"data": None, "error": "malformed"}]
    packed = list(columns.compress("lz4").func(iter([pa.array([data, None])])))
    assert [x and codecs.decompress("lz4", x) for p in packed for x in p.to_pylist()] == [data, None]
    assert columns.shake256.func(pa.array([b"a", None], pa.binary())).to_pylist() == [digest.shake256(b"a"), None]


def test_slices_of_a_table_are_cut_in_order_without_a_call_for_each_upload(spark):
    data = random.Random(3).randbytes(700 * 64)
    rows = [("a", k, data[64 * k : 64 * k + 64], k == 699) for k in range(700)] + [("b", 0, b"x", True), ("b", 1, b"y", False), ("c", 1, b"late", True)] + [("d", 0, b"x", False), ("d", 0, b"x", False), ("d", 1, b"", True)]
    out = push.push_chunks_batch(spark.createDataFrame(random.Random(4).sample(rows, len(rows)), "upload string, slice_no long, data binary, is_last boolean"), catalogue.SMALL)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = {u: [tuple(r)[1:] for r in out.collect() if r.upload == u] for u in "abcd"}
    assert [r[2] for r in sorted(got["a"])] == cdc.cut_lengths(data, catalogue.SMALL) and {r[4] for r in got["a"]} == {"ok"}
    assert [r[3] for r in sorted(got["a"])] == [hashlib.sha256(data[o : o + n]).hexdigest() for _, o, n, _, _ in sorted(got["a"])]
    assert sorted(r[4] for r in got["b"]) == ["ok", "push after finish"] and got["c"] == []
    assert sorted(r[4] for r in got["d"]) == ["duplicate slice", "ok"]
