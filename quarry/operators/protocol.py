"""narinfo records, tokens, witness chains and the request log, as DataFrame operators."""

from __future__ import annotations

import base64
import hashlib
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns, digest

STORE_DIR = "/nix/store"


def fingerprint(path: Column, nar_hash_hex: Column, size: Column, references: Column) -> Column:
    return F.concat(F.lit("1;"), path, F.lit(";sha256:"), columns.nix_base32(nar_hash_hex, 32), F.lit(";"), size.cast("string"), F.lit(";"), F.array_join(references, ","))


def narinfo_text(path: Column, url: Column, compression: Column, file_hash: Column, file_size: Column, nar_hash: Column, nar_size: Column, references: Column, deriver: Column, sigs: Column) -> Column:
    """Hashes as hexadecimal SHA-256. Lines in fixed order; Deriver only if there is one; a Sig line per signature."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\n"))
    h = lambda x: F.concat(F.lit("sha256:"), columns.nix_base32(x, 32))
    names = F.array_join(F.transform(references, columns.basename), " ")
    return F.concat(
        line("StorePath", path), line("URL", url), line("Compression", compression), line("FileHash", h(file_hash)), line("FileSize", file_size.cast("string")), line("NarHash", h(nar_hash)), line("NarSize", nar_size.cast("string")), line("References", names),
        F.coalesce(line("Deriver", columns.basename(deriver)), F.lit("")), F.array_join(F.transform(sigs, lambda s: F.concat(F.lit("Sig: "), s, F.lit("\n"))), ""),
    )


def hash_error(value: Column) -> Column:
    """What is wrong with ``sha256:`` and 52 base-32 characters: bad_hash (no such prefix, or not 32 bytes), base32 (a
    character that is none, or bits beyond the last byte); null if nothing is."""
    body = F.substring(value, 8, 1 << 20)
    at = lambda k: F.instr(F.lit(digest.ALPHABET), F.substring(body, k, 1)) - 1
    n = F.length(body)
    spare = (n * 5) % 8  # leading bits that belong to no byte
    over = F.when(spare <= 5, F.when(spare > 0, F.floor(at(1) / F.pow(F.lit(2), 5 - spare)) > 0).otherwise(False)).otherwise((at(1) > 0) | (F.floor(at(2) / F.pow(F.lit(2), 10 - spare)) > 0))
    return F.when(~value.startswith("sha256:"), "bad_hash").when(~body.rlike(f"^[{digest.ALPHABET}]*$") | ((n > 0) & over), "base32").when(n != 52, "bad_hash")


def number_error(value: Column) -> Column:
    """bad_number unless the text is an unsigned 64-bit number."""
    fits = value.rlike(r"^\+?[0-9]+$") & F.coalesce(F.regexp_replace(value, r"^\+?0*(?=[0-9])", "").try_cast("decimal(38,0)") <= F.lit(str((1 << 64) - 1)).cast("decimal(38,0)"), F.lit(False))
    return F.when(~fits, "bad_number")


def narinfo_fields(text: Column, store_dir: str = STORE_DIR) -> Column:
    """A struct of the fields and error: what is wrong with the first malformed line (bad_hash, base32, bad_number), else
    the first required field that is missing, else null. Lines are split at their first colon, once, and keys are as
    they stand there; of repeated fields the last counts."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.instr(x, ":") > 0), lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.trim(F.regexp_replace(x.substr(F.instr(x, ":") + 1, F.length(x)), r"[\r\t]", " ")).alias("v")))

    def wrong(x: Column) -> Column:
        return F.when(x["k"].isin("NarHash", "FileHash"), hash_error(x["v"])).when(x["k"].isin("NarSize", "FileSize"), number_error(x["v"]))

    def fields(ls: Column) -> Column:
        all_ = lambda k: F.transform(F.filter(ls, lambda x: x["k"] == k), lambda x: x["v"])
        one = lambda k: F.try_element_at(all_(k), F.lit(-1))
        refs = F.filter(F.split(F.coalesce(one("References"), F.lit("")), r"\s+"), lambda x: x != "")
        error = F.get(F.filter(F.transform(ls, wrong), lambda e: e.isNotNull()), F.lit(0))
        missing = None
        for k in ("StorePath", "URL", "NarHash", "NarSize"):
            missing = F.when(one(k).isNull(), k) if missing is None else missing.when(one(k).isNull(), k)
        deriver = F.nullif(one("Deriver"), F.lit(""))
        return F.struct(
            one("StorePath").alias("store_path"), one("URL").alias("url"), F.coalesce(one("Compression"), F.lit("none")).alias("compression"), one("FileHash").alias("file_hash"), F.coalesce(one("FileSize").try_cast("long"), F.lit(0)).alias("file_size"),
            one("NarHash").alias("nar_hash"), one("NarSize").try_cast("long").alias("nar_size"), F.transform(refs, lambda x: F.concat(F.lit(f"{store_dir}/"), x)).alias("references"), deriver.alias("deriver"), all_("Sig").alias("sigs"), F.coalesce(error, missing).alias("error"),
        )

    return columns.let(lines, fields)


def token_verdict(token: Column, cache: str, now: int, public: bytes) -> Column:
    """200, 401 or 403 of a bearer token: three segments, signature before header, EdDSA, not expired, scope write."""
    parts = F.split(token, r"\.")
    part = lambda k: F.get(parts, F.lit(k))
    signed = F.concat_ws(".", part(0), part(1))
    valid = (F.size(parts) == 3) & F.coalesce(columns.ed25519_verify(public, True)(columns.utf8(signed), columns.base64url_decode(part(2))), F.lit(False))
    text = lambda k: F.decode(columns.base64url_decode(part(k)), "UTF-8")
    claim = lambda k: F.get_json_object(text(1), f"$.{k}")
    known = valid & (F.get_json_object(text(0), "$.alg") == "EdDSA") & (claim("cache") == cache) & claim("iat").isNotNull() & claim("scope").isin("read", "write") & (claim("exp").try_cast("long") > now)
    return F.when(~F.coalesce(known, F.lit(False)), 401).when(claim("scope") != "write", 403).otherwise(200)


ENTRY = "prev_hash binary, action_hash binary, timestamp_ns long, witness_type int"


def witness_entries(actions: DataFrame, log: str) -> DataFrame:
    """log, seq, entry (73 bytes): actions(log, seq, action_hash, timestamp_ns, witness_type) linked in order of seq.
    A chain is sequential by nature; logs run in parallel."""
    kind = dict(actions.dtypes)[log]

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        chain = digest.witness_chain([(bytes(a), int(t), int(k)) for a, t, k in zip(rows["action_hash"], rows["timestamp_ns"], rows["witness_type"], strict=True)])
        return pd.DataFrame({log: rows[log], "seq": rows["seq"], "entry": [chain[k : k + 73] for k in range(0, len(chain), 73)]})

    return actions.groupBy(log).applyInPandas(link, f"{log} {kind}, seq long, entry binary")


def verify_witness(entries: DataFrame, log: str) -> DataFrame:
    """log, n, valid: every entry's link against the entry before it, in parallel over all entries."""
    before = F.lag("entry").over(Window.partitionBy(log).orderBy("seq"))
    checked = entries.withColumn("before", before).withColumn("good", (F.octet_length("entry") == 73) & (F.substring("entry", 1, 32) == F.coalesce(columns.shake256(F.col("before")), F.lit(bytes(32)))))
    return checked.groupBy(log).agg(F.count("*").alias("n"), F.bool_and("good").alias("valid"))


def action_hash(text: str) -> bytes:
    return hashlib.shake_256(text.encode()).digest(32)


def request_log(requests: DataFrame, served: tuple[str, ...] = ("nix-cache-info",)) -> DataFrame:
    """seq, method, path, status, body_of (seq of the PUT that answers a GET or HEAD): each request sees the last PUT or
    DELETE of its path strictly before it. requests(seq, method, path, authorized), or with verdict (200, 401 or 403, as
    token_verdict gives it) in place of authorized."""
    gate = F.col("verdict") if "verdict" in requests.columns else F.when(F.coalesce("authorized", F.lit(True)), 200).otherwise(401)
    write = F.when(F.col("method") == "PUT", F.col("seq")).when(F.col("method") == "DELETE", F.lit(-1))
    value = F.last(F.when(gate == 200, write), ignorenulls=True).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    r = requests.withColumn("value", value)
    found = F.coalesce(F.col("value") >= 0, F.lit(False))
    read = F.col("method").isin("GET", "HEAD")
    status = (
        F.when(F.col("method").isin("PUT", "DELETE", "MKCOL") & (gate != 200), gate)
        .when(read & F.col("path").isin(*served), 200)
        .when(read, F.when(found, 200).otherwise(404))
        .when(F.col("method") == "PUT", 200).when(F.col("method") == "DELETE", 204).when(F.col("method") == "MKCOL", 201).when(F.col("method") == "OPTIONS", 200).when(F.col("method") == "PROPFIND", 207).otherwise(405)
    )
    return r.select("seq", "method", "path", status.cast("int").alias("status"), F.when(read & found, F.col("value")).alias("body_of"))


def encode_entry(previous: bytes, action: bytes, ns: int, kind: int) -> bytes:
    return struct.pack("<32s32sQB", previous, action, ns, kind)


def parse_narinfo(text: str, store_dir: str = STORE_DIR) -> dict | None:
    """What narinfo_fields gives, in Python, for functions that sign or verify; None if a required field is missing."""
    f: dict = {"Sig": []}
    for line in text.split("\n"):
        key, colon, value = line.partition(":")
        if colon:
            key, value = key.strip(), value.strip()
            f["Sig"].append(value) if key == "Sig" else f.__setitem__(key, value)
    if any(k not in f for k in ("StorePath", "URL", "NarHash", "NarSize")):
        return None
    f["refs"] = [f"{store_dir}/{x}" for x in f.get("References", "").split()]
    f["message"] = f"1;{f['StorePath']};{f['NarHash']};{f['NarSize']};{','.join(f['refs'])}".encode()
    return f


def resign(text: Column, key_name: str, seed: bytes, store_dir: str = STORE_DIR) -> Column:
    """text with all its Sig lines replaced by one of ours and unknown fields dropped; as it is where it cannot be parsed."""

    def one(t: str | None) -> str | None:
        f = parse_narinfo(t, store_dir) if t is not None else None
        if f is None:
            return t
        sig = f"{key_name}:{base64.b64encode(digest.sign(seed, f['message'])).decode()}"
        lines = [("StorePath", f["StorePath"]), ("URL", f["URL"]), ("Compression", f.get("Compression", "none")), ("FileHash", f.get("FileHash", "sha256:" + "0" * 52)), ("FileSize", f.get("FileSize", "0")), ("NarHash", f["NarHash"]), ("NarSize", f["NarSize"]), ("References", " ".join(x.rsplit("/", 1)[-1] for x in f["refs"])), *([("Deriver", f["Deriver"])] if "Deriver" in f else []), ("Sig", sig)]
        return "".join(f"{k}: {v}\n" for k, v in lines)

    return columns._each(one, "string")(text)


def verify_any(text: Column, trusted: dict[str, bytes], store_dir: str = STORE_DIR) -> Column:
    """Whether any signature by a trusted key (name -> public key) holds; malformed ones are skipped."""

    def one(t: str | None) -> bool:
        f = parse_narinfo(t, store_dir) if t is not None else None
        for sig in f["Sig"] if f else ():
            name, _, value = sig.partition(":")
            try:
                if name in trusted and digest.verify(trusted[name], f["message"], base64.b64decode(value, validate=True), True):
                    return True
            except ValueError:
                continue
        return False

    @F.pandas_udf("boolean")
    def check(x: pd.Series) -> pd.Series:
        return x.map(one)

    return check(text)


MAX_BODY = 32 << 30


def request_head(raw: Column) -> Column:
    """method, target, content_length, authorization and error of the text of a request up to its blank line. error is
    null or what a server would answer 400 for; an empty or null text is no request (null). Of repeated headers the last counts."""
    lines = F.split(raw, "\n")
    # a text that ends with a line end has no line after it
    lines = F.when(F.endswith(raw, F.lit("\n")), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    head = columns.let(lines, lambda ls: columns.let(F.transform(F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1))), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda rest: _head(ls, rest)))
    return F.when(F.length(raw) > 0, head)


def _head(lines: Column, rest: Column) -> Column:
    blank = F.array_position(rest, "")
    headers = F.when(blank > 0, F.slice(rest, F.lit(1), (blank - 1).cast("int"))).otherwise(rest)
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.regexp_replace(F.substr(x, F.instr(x, ":") + F.lit(1)), r"^\s+|\s+$", "")
    all_ = lambda k: F.transform(F.filter(headers, lambda x: (F.instr(x, ":") > 0) & (name(x) == k)), value)
    number = lambda v: F.when(v.rlike(r"^\+?[0-9]+$"), v.try_cast("decimal(38,0)"))
    words = F.filter(F.split(F.get(lines, F.lit(0)), r"\s+"), lambda x: x != "")

    def judge(x: Column) -> Column:
        valid = F.forall(x["lengths"], lambda v: F.coalesce(number(v) < F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit(False)))
        length = F.coalesce(number(F.try_element_at(x["lengths"], F.lit(-1))), F.lit(0).cast("decimal(38,0)"))
        error = F.when(F.size(x["words"]) < 2, "malformed request line").when(~valid, "invalid content-length").when(x["blank"] == 0, "unexpected eof in headers").when(length > MAX_BODY, "request body too large")
        return F.struct(x.alias("x"), length.alias("length"), error.alias("error"))

    def fields(y: Column) -> Column:
        good = lambda c: F.when(y["error"].isNull(), c)
        word = lambda k: F.get(y["x"]["words"], F.lit(k))
        return F.struct(good(word(0)).alias("method"), good(word(1)).alias("target"), good(y["length"].cast("long")).alias("content_length"), good(F.try_element_at(y["x"]["auth"], F.lit(-1))).alias("authorization"), y["error"].alias("error"))

    parts = F.struct(words.alias("words"), blank.alias("blank"), all_("content-length").alias("lengths"), all_("authorization").alias("auth"))
    return columns.let(parts, lambda x: columns.let(judge(x), fields))


def response(method: Column, status: Column, reason: Column, content_type: Column, body: Column) -> Column:
    """The bytes of a response. Content-Length is that of the body also where the method is HEAD, which gets no body."""
    end = F.lit("\r\n")
    head = F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), reason, end, F.lit("Content-Length: "), F.octet_length(body).cast("string"), end, F.lit("Content-Type: "), content_type, end, F.lit("Connection: close"), end, end)
    return F.concat(columns.utf8(head), F.when(method == "HEAD", F.lit(b"")).otherwise(body))


def cache_info(store_dir: str = STORE_DIR, mass_query: bool = True, priority: int = 30) -> str:
    return f"StoreDir: {store_dir}\nWantMassQuery: {int(mass_query)}\nPriority: {priority}\n"


def respond(log: DataFrame, bodies: DataFrame) -> DataFrame:
    """seq, method, path, status, response (bytes) of a request log with its status and body_of, the seq of the PUT that
    a read sees; bodies(seq, body). Bodies are joined once, by the request that put them."""
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    kind = F.when(F.col("method") == "PROPFIND", "application/xml; charset=utf-8").when(F.col("body").isNotNull(), "application/octet-stream").otherwise("text/plain")
    out = log.join(bodies.select(F.col("seq").alias("body_of"), "body"), "body_of", "left")
    body = F.when(F.col("method") == "PROPFIND", columns.utf8(propfind_body(F.concat(F.lit("/"), "path")))).otherwise(F.coalesce("body", F.lit(b"")))
    return out.select("seq", "method", "path", "status", response(F.col("method"), F.col("status"), F.try_element_at(reason, "status"), kind, body).alias("response"))


#: The reasons of the status codes in use.
REASONS = {200: "OK", 201: "Created", 204: "No Content", 207: "Multi-Status", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found"}
#: Fixed answer to OPTIONS: the WebDAV classes and verbs.
DAV = "1,2"
ALLOW = "OPTIONS, GET, HEAD, PUT, DELETE, MKCOL, PROPFIND"


def options_response() -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Length: 0\r\nDAV: {DAV}\r\nAllow: {ALLOW}\r\nConnection: close\r\n\r\n".encode()


def propfind_body(path: Column) -> Column:
    """The multistatus document that shows any path as an existing collection. Characters of the path stay as they are."""
    name = columns.basename(F.regexp_replace(path, "/+$", ""))
    tag = lambda k, *inner: F.concat(F.lit(f"<D:{k}>"), *inner, F.lit(f"</D:{k}>\n"))
    prop = tag("prop", F.lit("\n"), tag("displayname", name), tag("getlastmodified", F.lit("Thu, 01 Jan 1970 00:00:00 GMT")), tag("resourcetype", F.lit("<D:collection/>")))
    stat = tag("propstat", F.lit("\n"), prop, tag("status", F.lit("HTTP/1.1 200 OK")))
    inner = tag("response", F.lit("\n"), tag("href", path), stat)
    return F.concat(F.lit('<D:multistatus xmlns:D="DAV:">\n'), inner, F.lit("</D:multistatus>\n"))
