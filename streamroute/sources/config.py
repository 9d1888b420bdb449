"""Control tables from YAML files: routes, services with their grants, broker settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from streamroute.operators.routing import Rule, Target
from streamroute.operators.transforms import op


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading YAML needs PyYAML") from e
    return yaml.safe_load(text) or {}


@dataclass
class Settings:
    """What the operators take as parameters; names as in the settings file's sections, flattened."""

    max_batch: int = 100
    flush_interval_ms: int = 5
    segment_size_mb: int = 64
    ack_timeout_secs: int = 30
    max_redeliveries: int = 5
    backoff_initial_secs: float = 1.0
    backoff_max_secs: float = 60.0
    backoff_multiplier: float = 2.0
    admission_threshold_us: int = 50_000
    compaction_min_ratio: float = 0.8
    dlq_retention_hours: int = 168


def settings(text: str) -> Settings:
    """Known names anywhere in the file's sections; `section_name` joined by `_` is tried first, then the bare name."""
    found: dict = {}

    def walk(node: dict, prefix: str) -> None:
        for k, v in node.items():
            if isinstance(v, dict):
                walk(v, f"{prefix}{k}_")
            else:
                found.setdefault(k, v)
                found[f"{prefix}{k}"] = v

    walk(_yaml(text), "")

    def pick(name: str):
        exact = [v for k, v in found.items() if k == name or k.endswith("_" + name)]
        return exact[0] if exact else None

    got = {f.name: pick(f.name) for f in fields(Settings)}
    return Settings(**{k: v for k, v in got.items() if v is not None})


def rules(text: str) -> list[Rule]:
    """Route rules: name, enabled (true by default), match.topic, match.where, transform [{set: ...}], deliver
    [{service, group, where}]."""
    out = []
    for r in _yaml(text).get("routes") or []:
        match = r.get("match") or {}
        ops = [op(kind, t) for step in r.get("transform") or [] for kind, t in step.items()]
        targets = [Target(str(d.get("service") or d.get("group")), d.get("group"), d.get("where")) for d in r.get("deliver") or []]
        out.append(Rule(r["name"], match.get("topic", ">"), targets, match.get("where"), ops, bool(r.get("enabled", True))))
    return out


def grants(spark: SparkSession, text: str) -> DataFrame:
    """One row per granted pattern: namespace, service, action (publish or subscribe), pattern."""
    rows = []
    for n in _yaml(text).get("namespaces") or []:
        for s in n.get("services") or []:
            for action in ("publish", "subscribe"):
                rows += [(n.get("name"), s.get("name"), action, p) for p in (s.get("permissions") or s).get(action) or []]
    return spark.createDataFrame(rows, "namespace string, service string, action string, pattern string")
