"""Policy: which tools are sources and sinks, and how verdicts are reached.

A policy is a small driver-side object read from JSON and checked before use; an
invalid file raises and changes nothing. Its tables become literals or broadcast
rows (a policy lists tools by hand, so their number is bounded by ``MAX_TOOLS``).
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MAX_TOOLS = 100_000
SINKS = ("READ", "WRITE_INTERNAL", "OUTBOUND_SINK")
# The named character sets that a schema may ask for (letters and digits of any script, and these signs).
CHARSETS = {"safe-text": r"[\p{L}\p{N} ._-]+"}
CHOICES = {
    "unknownToolPolicy": ("deny", "warn"),
    "sensitiveSourcePolicy": ("tag_all",),
    "propagationMode": ("snapshot", "live"),
    "judgmentMode": ("session", "lineage", "shadow"),
    "hitlPolicy": ("off", "weak-only"),
    "pruningPolicy": ("off", "declassified"),
    "fallbackRelaxation": ("off", "scan-clean"),
    "destructivePolicy": ("off", "hitl", "block"),
}


@dataclass(frozen=True)
class Entropy:
    min_length: int
    threshold: float


@dataclass(frozen=True)
class Secrets:
    by_source: bool = True
    by_entropy: Entropy | None = None
    by_regex: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class FieldRule:
    kind: str
    values: tuple[str, ...] = ()
    max_length: int = 0
    charset: str = ""


@dataclass(frozen=True)
class Policy:
    sensitive: frozenset[str] = frozenset()
    untrusted: frozenset[str] = frozenset()
    sinks: dict[str, str] = field(default_factory=dict)
    destructive: frozenset[str] = frozenset()
    domain: str = "default"
    labels: dict[str, str] = field(default_factory=dict)
    trusted_uris: tuple[str, ...] = ()
    pii: tuple[tuple[str, str], ...] = ()
    secrets: Secrets | None = None
    schema: dict[str, FieldRule] | None = None
    unknown_tools: str = "deny"
    propagation: str = "snapshot"
    mode: str = "session"
    hitl: str = "off"
    pruning: str = "off"
    relaxation: str = "off"
    destructive_policy: str = "off"

    def classified(self, tool: str) -> bool:
        return tool in self.sensitive or tool in self.untrusted or tool in self.sinks or tool in self.destructive

    def sink(self, tool: str) -> str:
        return self.sinks.get(tool) or ("READ" if self.unknown_tools == "warn" else "OUTBOUND_SINK")

    def source_tags(self, tool: str) -> set[str]:
        tags = set()
        if tool in self.sensitive and (self.secrets is None or self.secrets.by_source):
            tags.add("S")
        if tool in self.untrusted or not self.classified(tool):
            tags.add("U")
        return tags

    def trusted(self, uri: str) -> bool:
        return uri.startswith(self.trusted_uris) if self.trusted_uris else False

    @property
    def can_extract(self) -> bool:
        return self.schema is not None

    @property
    def can_tokenize(self) -> bool:
        return bool(self.pii or (self.secrets and (self.secrets.by_regex or self.secrets.by_entropy)))

    def registry(self) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
        """The three classification sets: sensitive, untrusted, outbound."""
        return self.sensitive, self.untrusted, frozenset(t for t, s in self.sinks.items() if s == "OUTBOUND_SINK")

    def tools(self, spark: SparkSession) -> DataFrame:
        """One row per known tool, for joins; the caller may broadcast it."""
        names = sorted(self.sensitive | self.untrusted | set(self.sinks) | self.destructive)
        rows = [(t, t in self.sensitive, t in self.untrusted, t in self.destructive, self.sinks.get(t), self.labels.get(t)) for t in names]
        return spark.createDataFrame(rows, "tool string, sensitive boolean, untrusted boolean, destructive boolean, sink string, label string")


def _strings(value: object, name: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{name} must be a list of strings")
    return value


def _patterns(value: object, name: str) -> tuple[tuple[str, str], ...]:
    if value is None:
        return ()
    if not isinstance(value, list):
        raise ValueError(f"{name} must be a list")
    out = []
    for x in value:
        if not isinstance(x, dict) or not isinstance(x.get("type"), str) or not re.fullmatch(r"[A-Z0-9_]+", x["type"]):
            raise ValueError(f"{name}: a type has capitals, digits and _ only")
        if not isinstance(x.get("pattern"), str):
            raise ValueError(f"{name}: pattern must be a string")
        try:
            re.compile(x["pattern"])
        except re.error as e:
            raise ValueError(f"{name}: {e}") from e
        out.append((x["type"], x["pattern"]))
    return tuple(out)


def _secrets(value: object) -> Secrets | None:
    if value is None:
        return None
    if not isinstance(value, dict):
        raise ValueError("secretDetection must be an object")
    by_source = value.get("bySource", True)
    if not isinstance(by_source, bool):
        raise ValueError("secretDetection.bySource must be a boolean")
    e = value.get("byEntropy")
    if e is not None:
        n, t = (e.get("minLength"), e.get("entropyThreshold")) if isinstance(e, dict) else (None, None)
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError("secretDetection.byEntropy.minLength must be a positive integer")
        if isinstance(t, bool) or not isinstance(t, (int, float)) or not 0 < t < float("inf"):
            raise ValueError("secretDetection.byEntropy.entropyThreshold must be positive")
        e = Entropy(n, float(t))
    return Secrets(by_source, e, _patterns(value.get("byRegex"), "secretDetection.byRegex"))


def _schema(value: object) -> dict[str, FieldRule] | None:
    if value is None:
        return None
    fields = value.get("fields") if isinstance(value, dict) else None
    if not isinstance(fields, dict) or not fields:
        raise ValueError("extractionSchema.fields must be a non-empty object")
    out = {}
    for name, x in fields.items():
        kind = x.get("kind") if isinstance(x, dict) else None
        if kind == "enum":
            values = _strings(x.get("values"), f"extractionSchema.{name}.values")
            if not values:
                raise ValueError(f"extractionSchema.{name}.values is empty")
            out[name] = FieldRule("enum", tuple(values))
        elif kind == "string":
            n = x.get("maxLength")
            if isinstance(n, bool) or not isinstance(n, int) or n < 1:
                raise ValueError(f"extractionSchema.{name}.maxLength must be a positive integer")
            if x.get("charset") not in CHARSETS:
                raise ValueError(f"extractionSchema.{name}.charset is unknown")
            out[name] = FieldRule("string", (), n, x["charset"])
        else:
            raise ValueError(f"extractionSchema.{name}.kind must be enum or string")
    return out


def parse(raw: object) -> Policy:
    """A checked policy from a JSON value; raises ValueError on anything doubtful."""
    if not isinstance(raw, dict):
        raise ValueError("a policy is an object")
    sinks: dict[str, str] = {}
    if "outboundSinkTools" not in raw and "sinks" not in raw:
        raise ValueError("outboundSinkTools or sinks is needed")
    for t in _strings(raw.get("outboundSinkTools", []), "outboundSinkTools"):
        sinks[t] = "OUTBOUND_SINK"
    if not isinstance(raw.get("sinks", {}), dict):
        raise ValueError("sinks must be an object")
    for t, s in raw.get("sinks", {}).items():
        if s not in SINKS:
            raise ValueError(f"sinks.{t}: {s} is no sink class")
        sinks[t] = s
    chosen = {}
    for name, allowed in CHOICES.items():
        chosen[name] = raw.get(name, allowed[0])
        if chosen[name] not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    uris = _strings(raw.get("trustedResourceUris", []), "trustedResourceUris")
    for u in uris:
        if "://" not in u or not u.endswith("/"):
            raise ValueError(f"trustedResourceUris: {u} needs :// and must end in /")
    labels = raw.get("toolLabels", {})
    if not isinstance(labels, dict) or not all(isinstance(x, str) for x in labels.values()):
        raise ValueError("toolLabels must map tools to strings")
    if not isinstance(raw.get("domain", "default"), str):
        raise ValueError("domain must be a string")
    return Policy(
        sensitive=frozenset(_strings(raw.get("sensitiveSourceTools", raw.get("sensitiveSources")), "sensitiveSourceTools")),
        untrusted=frozenset(_strings(raw.get("untrustedSourceTools", raw.get("untrustedSources")), "untrustedSourceTools")),
        sinks=sinks,
        destructive=frozenset(_strings(raw.get("destructiveTools", []), "destructiveTools")),
        domain=raw.get("domain", "default"),
        labels=labels,
        trusted_uris=tuple(uris),
        pii=_patterns(raw.get("piiPatterns"), "piiPatterns"),
        secrets=_secrets(raw.get("secretDetection")),
        schema=_schema(raw.get("extractionSchema")),
        unknown_tools=chosen["unknownToolPolicy"],
        propagation=chosen["propagationMode"],
        mode=chosen["judgmentMode"],
        hitl=chosen["hitlPolicy"],
        pruning=chosen["pruningPolicy"],
        relaxation=chosen["fallbackRelaxation"],
        destructive_policy=chosen["destructivePolicy"],
    )


def load(path: str | Path) -> Policy:
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(f"cannot read the policy {path}: {e}") from e
    return parse(raw)


def from_json(text: str) -> Policy:
    """A policy from JSON text; what isn't valid raises."""
    return parse(json.loads(text))


def resolve_path(path: str | None = None, folder: str = ".") -> str:
    """An argument wins, then SLUICEWAY_POLICY (a file), then SLUICEWAY_DOMAIN (a name), then default.json."""
    if path:
        return path
    if os.environ.get("SLUICEWAY_POLICY"):
        return os.environ["SLUICEWAY_POLICY"]
    return str(Path(folder) / f"{os.environ.get('SLUICEWAY_DOMAIN') or 'default'}.json")


class Current:
    """The policy in force; ``reload`` checks a file first and then swaps."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def reload(self, path: str | Path) -> Policy:
        self.policy = load(path)
        return self.policy


# The patterns of the default policy.
PII = (
    ("RRN", r"\b\d{6}-[1-4]\d{6}\b"),
    ("CARD", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"),
    ("PHONE", r"\b01[016789]-?\d{3,4}-?\d{4}\b"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
)
KEYS = (("AWS_KEY", r"\bAKIA[0-9A-Z]{16}\b"), ("GITHUB_TOKEN", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b"))

#: The policy of the queries: a customer database, web pages and mail.
DEFAULT = Policy(
    sensitive=frozenset({"query_customer_db", "read_internal_file"}),
    untrusted=frozenset({"fetch_web_page", "read_email"}),
    sinks={
        "send_email": "OUTBOUND_SINK", "http_post": "OUTBOUND_SINK", "write_external_file": "OUTBOUND_SINK",
        "fetch_web_page": "OUTBOUND_SINK", "query_customer_db": "READ", "read_internal_file": "READ", "read_email": "READ",
    },
    destructive=frozenset({"delete_customer_record"}),
    pii=PII,
    secrets=Secrets(True, Entropy(20, 3.8), KEYS),
    schema={"type": FieldRule("enum", ("order", "invoice", "ticket", "note")), "name": FieldRule("string", (), 20, "safe-text")},
    trusted_uris=("https://tionsh.example.net/", "https://ads-track.example.org/"),
)
