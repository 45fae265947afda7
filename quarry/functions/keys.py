"""Signing keys as users hold them: base64 text, named keys, and errors by kind."""

from __future__ import annotations

import base64
import binascii
import os

from quarry.functions import digest

#: The texts of the errors.
INVALID_SECRET, INVALID_PUBLIC, INVALID_SIGNATURE = "invalid_secret_key: expected 32 bytes", "invalid_public_key: expected 32 bytes", "invalid_signature: expected 64 bytes"
DECODE, VERIFICATION = "decode_error", "verification_failed"
KEY_FORMAT, KEY_BASE64, KEY_LENGTH = "nix key: expected <name>:<base64>", "nix key: invalid base64", "nix key: decoded key shorter than 32 bytes"


class BadKey(ValueError):
    """A key or signature that cannot be used; its text tells why."""


def _decode(text: str, error: str) -> bytes:
    try:
        return base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        raise BadKey(error) from None


def generate_keypair() -> tuple[str, str]:
    """Secret (the seed) and public key in base64, from the system's randomness."""
    seed = os.urandom(32)
    return base64.b64encode(seed).decode(), base64.b64encode(digest.public_key(seed)).decode()


def sign_data(data: bytes, secret: str) -> str:
    seed = _decode(secret, DECODE)
    if len(seed) != 32:
        raise BadKey(INVALID_SECRET)
    return base64.b64encode(digest.sign(seed, data)).decode()


def signature_error(data: bytes, signature: str, public: str) -> str | None:
    """Why a signature does not hold: the key is looked at first, then the signature; None if it holds."""
    try:
        key = _decode(public, DECODE)
        if not digest.is_point(key):
            return INVALID_PUBLIC
        raw = _decode(signature, DECODE)
    except BadKey as e:
        return str(e)
    if len(raw) != 64:
        return INVALID_SIGNATURE
    return None if digest.verify(key, data, raw) else VERIFICATION


def _named(text: str) -> tuple[str, bytes]:
    name, colon, body = text.strip().partition(":")
    if not colon:
        raise BadKey(KEY_FORMAT)
    return name, _decode(body, KEY_BASE64)


def parse_secret_key(text: str) -> tuple[str, bytes]:
    """Name and seed of ``name:base64``; the seed is the first 32 bytes, the public key may follow."""
    name, raw = _named(text)
    if len(raw) < 32:
        raise BadKey(KEY_LENGTH)
    return name, raw[:32]


def parse_public_key(text: str) -> tuple[str, bytes]:
    """Name and key of ``name:base64`` with exactly 32 bytes that are a point of the curve."""
    name, raw = _named(text)
    if not digest.is_point(raw):
        raise BadKey(KEY_LENGTH)
    return name, raw
