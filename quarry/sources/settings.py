"""Settings of a node from the environment: listener and data folder, object store, swarm. Names begin with a prefix."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit

PREFIX = "QUARRY_"
REPLICAS = 3


@dataclass(frozen=True)
class ObjectStore:
    endpoint: str
    bucket: str
    region: str
    access_key_id: str
    secret_access_key: str
    key_prefix: str | None = None

    def __post_init__(self) -> None:
        if not self.endpoint.startswith(("http://", "https://")):
            raise ValueError("endpoint needs an http or https scheme")
        if not all((urlsplit(self.endpoint).netloc, self.bucket, self.region, self.access_key_id, self.secret_access_key)):
            raise ValueError("endpoint host, bucket, region and credentials must not be empty")


@dataclass(frozen=True)
class Swarm:
    me: str
    members: tuple[str, ...]
    replicas: int


def object_store(env: Mapping[str, str] = os.environ, prefix: str = PREFIX) -> ObjectStore | None:
    """The cold tier; None where no endpoint is named."""
    if f"{prefix}S3_ENDPOINT" not in env:
        return None
    values = []
    for name in ("ENDPOINT", "BUCKET", "REGION", "ACCESS_KEY_ID", "SECRET_ACCESS_KEY"):
        if f"{prefix}S3_{name}" not in env:
            raise ValueError(f"{prefix}S3_{name} is not set")
        values.append(env[f"{prefix}S3_{name}"])
    return ObjectStore(values[0].rstrip("/"), *values[1:], env.get(f"{prefix}S3_PREFIX") or None)


def swarm(env: Mapping[str, str] = os.environ, prefix: str = PREFIX) -> Swarm | None:
    """This node, all members by name and the number of replicas; None where this node has no name."""
    clean = lambda x: x.strip().rstrip("/")
    me = clean(env.get(f"{prefix}SWARM_SELF", ""))
    if not me:
        return None
    peers = {clean(x) for x in env.get(f"{prefix}SWARM_PEERS", "").split(",")} - {""}
    raw = env.get(f"{prefix}SWARM_REPLICAS", str(REPLICAS)).strip()
    if not raw.removeprefix("+").isdecimal():
        raise ValueError(f"{prefix}SWARM_REPLICAS must be a positive integer")
    return Swarm(me, tuple(sorted(peers | {me})), max(1, int(raw)))


def node(args: list[str], listen: str, data_dir: str, env: Mapping[str, str] = os.environ, prefix: str = PREFIX) -> tuple[str, str]:
    """Listener and data folder: arguments, else the environment, else the defaults given."""
    names = (("LISTEN", listen), ("DATA_DIR", data_dir))
    first, second = (args[k] if len(args) > k else env.get(prefix + n, d) for k, (n, d) in enumerate(names))
    return first, second
