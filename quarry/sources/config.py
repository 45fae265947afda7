"""The placement catalogue as a YAML document: version 1, resources and service classes, unknown fields rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESOURCE = {"id": str, "region": str, "zone": str, "backend": str}
CLASS = {"name": str, "replicas": int, "min_regions": int, "min_zones": int, "require_archive": bool}
BACKENDS = ("filesystem", "object", "archive")


def _rows(items: object, fields: dict[str, type], defaults: dict, what: str) -> list[tuple]:
    out, seen = [], set()
    for item in items or ():
        if not isinstance(item, dict) or set(item) - set(fields):
            raise ValueError(f"{what}: unknown fields {sorted(set(item) - set(fields)) if isinstance(item, dict) else item}")
        item = defaults | item
        for k, t in fields.items():
            if type(item.get(k)) is not t or (t is str and not item[k].strip()):
                raise ValueError(f"{what}: {k} is missing, blank or not {t.__name__}")
        key = next(iter(item[k] for k in fields))
        if key in seen:
            raise ValueError(f"{what}: duplicate {key}")
        seen.add(key)
        out.append(tuple(item[k] for k in fields))
    if not out:
        raise ValueError(f"{what}: none given")
    return out


def load_catalogue(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """resources(id, region, zone, backend) and objectives(class, replicas, min_regions, min_zones, require_archive)."""
    import yaml

    doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or set(doc) - {"version", "resources", "classes"}:
        raise ValueError("unknown fields")
    if doc.get("version") != 1:
        raise ValueError(f"version {doc.get('version')} is not supported")
    r = _rows(doc.get("resources"), RESOURCE, {}, "resources")
    if bad := [x for x in r if x[3] not in BACKENDS]:
        raise ValueError(f"resources: unknown backend {bad[0][3]}")
    c = _rows(doc.get("classes"), CLASS, {"min_regions": 1, "min_zones": 1, "require_archive": False}, "classes")
    return spark.createDataFrame(r, "id string, region string, zone string, backend string"), spark.createDataFrame(c, "class string, replicas int, min_regions int, min_zones int, require_archive boolean")
