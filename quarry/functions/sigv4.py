"""AWS Signature Version 4 (public specification), for object stores that speak S3."""

from __future__ import annotations

import hashlib
import hmac
from urllib.parse import quote

EMPTY = hashlib.sha256(b"").hexdigest()


def canonical_request(method: str, path: str, headers: dict[str, str], payload_hash: str = EMPTY, query: dict[str, str] | None = None) -> tuple[str, str]:
    """The canonical request, and the names of its signed headers."""
    lines = sorted((k.lower(), " ".join(v.split())) for k, v in headers.items())
    names = ";".join(k for k, _ in lines)
    args = "&".join(f"{quote(k, safe='-_.~')}={quote(v, safe='-_.~')}" for k, v in sorted((query or {}).items()))
    return "\n".join([method, quote(path, safe="/-_.~"), args, *(f"{k}:{v}" for k, v in lines), "", names, payload_hash]), names


def authorization(access: str, secret: str, stamp: str, region: str, service: str, method: str, path: str, headers: dict[str, str], payload_hash: str = EMPTY, query: dict[str, str] | None = None) -> str:
    """The Authorization header of a request at stamp (yyyyMMddTHHmmssZ)."""
    request, names = canonical_request(method, path, headers, payload_hash, query)
    scope = f"{stamp[:8]}/{region}/{service}/aws4_request"
    text = "\n".join(["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(request.encode()).hexdigest()])
    key = b"AWS4" + secret.encode()
    for part in scope.split("/"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return f"AWS4-HMAC-SHA256 Credential={access}/{scope}, SignedHeaders={names}, Signature={hmac.new(key, text.encode(), hashlib.sha256).hexdigest()}"
