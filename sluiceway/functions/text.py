"""Text functions as column expressions: all JVM-side, whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token run, the words that are no evidence, the run that may be a secret, the vault token.
TOKEN_RUN = r"[\p{L}\p{N}@._+-]{8,}"
COMMON = ("password", "username", "response", "timestamp", "description", "undefined", "function", "javascript", "sessionid", "localhost")
SECRET_RUN = r"[A-Za-z0-9+/=_-]{20,}"
VAULT_TOKEN = r"\[(?:PII|SECRET)_[A-Z0-9_]+_[0-9a-f]{12}\]"


def ascii_bounded(pattern: str) -> str:
    r"""``\b`` as ASCII engines read it: Java's is Unicode-aware and misses keys next to other scripts."""
    if pattern.startswith(r"\b"):
        pattern = r"(?<![0-9A-Za-z_])" + pattern[2:]
    return pattern[:-2] + r"(?![0-9A-Za-z_])" if pattern.endswith(r"\b") else pattern


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def match_tokens(s: Column) -> Column:
    """Distinct tokens that count as evidence: runs and the whole trimmed text."""
    every = F.concat(F.array(trimmed(s)), F.regexp_extract_all(s, F.lit(TOKEN_RUN), F.lit(0)))
    return F.array_distinct(F.filter(every, lambda t: (F.length(t) >= 8) & ~F.lower(t).isin(*COMMON)))


def short_hash(s: Column, n: int) -> Column:
    return F.substring(F.sha2(s.cast("binary"), 256), 1, n)


def normalized(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(s, "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def count_matches(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(ascii_bounded(pattern))).cast("long")


def masked(s: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    for name, p in patterns:
        s = F.regexp_replace(s, ascii_bounded(p), f"[{name}]")
    return s


def cut_to(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def luhn(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def ipv4(s: Column) -> Column:
    parts = F.split(s, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def without_tokens(s: Column) -> Column:
    return F.regexp_replace(s, VAULT_TOKEN, "")


def has_content(s: Column) -> Column:
    return without_tokens(s).rlike(r"[\p{L}\p{N}]")


# Protocol methods by risk; notifications are harmless.
SINK_METHODS = ("sampling/createMessage",)
HARMLESS_METHODS = (
    "ping", "initialize", "tools/list", "resources/list", "resources/templates/list", "prompts/list", "roots/list",
    "logging/setLevel", "completion/complete",
)


def method_risk(m: Column) -> Column:
    harmless = m.isin(*HARMLESS_METHODS) | m.startswith("notifications/")
    return F.when(m.isin(*SINK_METHODS), "SINK").when(harmless, "HARMLESS").otherwise("UNCLASSIFIED")


def tool_parts(name: Column) -> tuple[Column, Column]:
    """(server, bare name), split at the first dot; without a dot the server is empty."""
    at = F.instr(name, ".")
    return F.when(at > 0, F.substring_index(name, ".", 1)).otherwise(""), F.when(at > 0, F.substr(name, at + 1)).otherwise(name)


def agent_tool(server: Column, tool: Column) -> Column:
    """The name under which a merged catalogue has a server's tool."""
    return F.concat_ws(".", server, tool)
