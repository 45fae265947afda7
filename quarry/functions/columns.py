"""Column functions: built-in expressions where Spark has them, Arrow functions where it does not."""

from __future__ import annotations

import ctypes
import hashlib
import hmac
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import cdc, codecs, digest, keys


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def sha256_raw(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def base64_plain(data: Column) -> Column:
    """Padded, on one line."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def base64_decode(text: Column) -> Column:
    """Null where the text is not strict padded base64."""
    good = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(good, F.unbase64(text))


def base64_error(text: Column) -> Column:
    return F.when(F.length(text) % 4 != 0, "length").when(text.rlike("=[^=]|={3}"), "padding").when(~text.rlike(r"^[A-Za-z0-9+/=]*$"), "char")


def base64url_decode(text: Column) -> Column:
    """Unpadded; null where padded or malformed."""
    plain = F.translate(text, "-_", "+/")
    return F.when(~text.contains("=") & ~text.rlike("[+/]"), base64_decode(F.rpad(plain, (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")))


def nix_base32(hex_: Column, n: int) -> Column:
    """Of n bytes given as hexadecimal: high index first. Expressions only."""
    byte = lambda i: F.coalesce(F.conv(F.substring(hex_, 2 * i + 1, 2), 16, 10).cast("int"), F.lit(0))
    chars = []
    for k in reversed(range(-(-n * 8 // 5))):
        i, j = divmod(k * 5, 8)
        v = F.shiftright(byte(i), j) if i + 1 >= n else F.shiftright(byte(i), j).bitwiseOR(F.shiftleft(byte(i + 1), 8 - j))
        chars.append(F.substring(F.lit(digest.ALPHABET), v.bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*chars)


def forward_base32(hex_: Column, n: int) -> Column:
    return F.reverse(nix_base32(hex_, n))


def uri_encode(text: Column, keep_slash: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def sigv4_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def object_key(hex_: Column, prefix: str = "") -> Column:
    """prefix/hh/rest, as objects lie in a store."""
    return F.concat_ws("/", *([F.lit(prefix.strip("/"))] if prefix.strip("/") else []), F.substring(hex_, 1, 2), F.substring(hex_, 3, 1 << 20))


def chunk_json(hash_: Column, offset: Column, length: Column) -> Column:
    """A chunk without its payload."""
    return F.to_json(F.struct(hex_lower(hash_).alias("hash"), offset.alias("offset"), length.alias("length")))


def chunk_from_json(text: Column) -> Column:
    """hash, offset, length; null where the hash is not 32 bytes in hexadecimal or a field is missing."""
    x = F.from_json(text, "hash string, offset long, length long")
    good = x["hash"].rlike("^[0-9A-Fa-f]{64}$") & x["offset"].isNotNull() & x["length"].isNotNull()
    return F.when(good, F.struct(F.unhex(x["hash"]).alias("hash"), x["offset"].alias("offset"), x["length"].alias("length")))


def codec_of(data: Column) -> Column:
    """By magic number; null if unknown or under four bytes."""
    out = F.when(F.octet_length(data) < 4, F.lit(None).cast("string"))
    for name, magic in codecs.MAGIC:
        out = out.when(F.substring(data, 1, len(magic)) == F.lit(magic), name)
    return out


#: Values that are Python objects at once while a batch is worked on, and bytes after which results are handed over.
VALUES, HANDED = 256, 1 << 20


def _lazily(x: pa.Array) -> Iterator:
    """The values of a batch as Python objects, few at a time, so that no batch is held twice."""
    for at in range(0, len(x), VALUES):
        yield from x.slice(at, VALUES).to_pylist()


def _release() -> None:
    """Gives memory that this worker no longer needs back to the system: others wait and work beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _each(f: Callable, kind: str):
    """An Arrow function of one binary or string column, null for null. Results should be small: see _stream."""
    out = pa.binary() if kind == "binary" else pa.string()

    @F.arrow_udf(T.BinaryType() if kind == "binary" else T.StringType())
    def apply(x: pa.Array) -> pa.Array:
        return pa.array((None if v is None else f(v) for v in _lazily(x)), out)

    return apply


def _stream(f: Callable, size: Callable, kind: pa.DataType, returns: T.DataType):
    """An Arrow function of one column whose results are handed over every HANDED bytes by size, not batch by batch."""

    @F.arrow_udf(returns)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for x in batches:
                rows, held = [], 0
                for v in _lazily(x):
                    rows.append(f(v))
                    held += size(rows[-1])
                    if held >= HANDED:
                        yield pa.array(rows, kind)
                        rows, held = [], 0
                if rows:
                    yield pa.array(rows, kind)
                del x, rows
        finally:
            _release()

    return apply


def _packed(f: Callable):
    """Bytes of bytes, null for null."""
    return _stream(lambda v: None if v is None else f(v), lambda r: len(r or b""), pa.binary(), T.BinaryType())


def _status(f: Callable):
    """data and error of f, whose exceptions are values."""

    def one(v) -> dict:
        try:
            return {"data": None if v is None else f(v), "error": None}
        except Exception as e:  # noqa: BLE001  errors are values here
            return {"data": None, "error": str(e) if isinstance(e, codecs.SizeExceeded) or "unknown_format" in str(e) else "malformed"}

    kind, returns = pa.struct([("data", pa.binary()), ("error", pa.string())]), T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])
    return _stream(one, lambda r: len(r["data"] or b""), kind, returns)


shake256 = _each(digest.shake256, "binary")
blake3_hex = _each(lambda v: digest.blake3(v).hex(), "string")


def hmac_sha256(key: bytes):
    return _each(lambda v: hmac.new(key, v, hashlib.sha256).digest(), "binary")


def content_id(kind: str = "chunk", domain: bytes = digest.DOMAIN):
    return _each(lambda v: digest.content_id(digest.KINDS[kind], v, domain), "binary")


def compress(codec: str, level: int | None = None):
    return _packed(lambda v: codecs.compress(codec, v, level))


def decompress(codec: str, limit: int = codecs.LIMIT):
    return _status(lambda v: codecs.decompress(codec, v, limit))


def decompress_auto(limit: int = codecs.LIMIT, passthrough: bool = False):
    return _status(lambda v: codecs.decompress_auto(v, limit, passthrough))


def nix_base32_decode():
    return _status(digest.nix_base32_decode)


def forward_base32_decode():
    return _status(digest.forward_base32_decode)


def ed25519_sign(seed: bytes):
    return _each(lambda v: digest.sign(seed, v), "binary")


def ed25519_verify(public: bytes, strict: bool = False):
    @F.pandas_udf(T.BooleanType())
    def apply(message: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([None if m is None or s is None else digest.verify(public, m, s, strict) for m, s in zip(message, signature, strict=True)], dtype="object")

    return apply


def compress_for(strategy: str):
    return _packed(lambda v: codecs.compress_for(strategy, v))


@F.pandas_udf(T.StructType([T.StructField("signature", T.StringType()), T.StructField("error", T.StringType())]))
def sign_data(data: pd.Series, secret: pd.Series) -> pd.DataFrame:
    """The base64 signature by a base64 seed, or why there is none."""
    rows = []
    for d, k in zip(data, secret, strict=True):
        try:
            rows.append((keys.sign_data(d, k) if d is not None and k is not None else None, None))
        except keys.BadKey as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["signature", "error"])


@F.pandas_udf(T.StringType())
def signature_error(data: pd.Series, signature: pd.Series, public: pd.Series) -> pd.Series:
    """Why a base64 signature by a base64 key does not hold; null if it does."""
    return pd.Series([keys.signature_error(d, s, p) if d is not None and s is not None and p is not None else None for d, s, p in zip(data, signature, public, strict=True)], dtype="object")


def named_key(kind: str):
    """name, key and error of the text of a secret or public key."""
    parse = keys.parse_secret_key if kind == "secret" else keys.parse_public_key

    @F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("error", T.StringType())]))
    def apply(x: pd.Series) -> pd.DataFrame:
        rows = []
        for v in x:
            try:
                rows.append((*parse(v), None) if v is not None else (None, None, None))
            except keys.BadKey as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["name", "key", "error"])

    return apply


def register(spark: SparkSession, options: cdc.ChunkOptions | None = None) -> None:
    """Makes the functions callable from SQL."""
    own = {"shake256": shake256, "blake3_hex": blake3_hex, "content_id": content_id(), "nix_base32_decode": nix_base32_decode(), "forward_base32_decode": forward_base32_decode(), "decompress_auto": decompress_auto(codecs.CALL_LIMIT)}
    own |= {"sign_data": sign_data, "signature_error": signature_error, "sha256_raw": _each(lambda v: hashlib.sha256(v).digest(), "binary"), "nix_base32_encode": _each(digest.nix_base32, "string"), "forward_base32_encode": _each(digest.forward_base32, "string")}
    for name, f in own.items():
        spark.udf.register(name, f)
    for strategy in codecs.STRATEGY:
        spark.udf.register(f"compress_{strategy}", compress_for(strategy))
    for codec in ("zstd", "lz4", "xz", "bzip2"):
        spark.udf.register(f"compress_{codec}", compress(codec))
        spark.udf.register(f"decompress_{codec}", decompress(codec, codecs.CALL_LIMIT))
    chosen = options or cdc.ChunkOptions()

    @F.udtf(returnType="seq int, offset long, length long")
    class Chunks:
        def eval(self, payload: bytes):
            at = 0
            for k, n in enumerate(cdc.cut_lengths(bytes(payload), chosen) if payload is not None else ()):
                yield k, at, n
                at += n

    spark.udtf.register("cdc_chunks", Chunks)
