"""Explanations of blocks for people: fixed texts around facts that the verdict already has; node ids aren't shown.

Each has a summary, a reason, risks and actions (kind, available, detail). The texts are English; ``label`` shows a tool by its policy's name for it.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from sluiceway.plans.policy import Policy

if TYPE_CHECKING:
    from sluiceway.operators.session import Decision

PHRASES = {"SENSITIVE": "sensitive data", "UNTRUSTED_ORIGIN": "content from outside"}
INJECTED = "Content from outside may carry hidden instructions."
INSPECT = {"kind": "INSPECT_SOURCE", "available": True, "detail": None}


def label(tool: str, policy: Policy) -> str:
    if tool == "(pruned)":
        return "an earlier record"
    name = policy.labels.get(tool)
    return f"{name} ({tool})" if name else tool


def _approval(d: Decision) -> dict[str, Any]:
    return {"kind": "REQUEST_APPROVAL", "available": bool(d.can_override and d.approval), "detail": d.approval if d.can_override else None}


def leak(d: Decision, arg_tags: list[str], policy: Policy) -> dict[str, Any]:
    """Sensitive data and content from outside meet in what would leave."""
    tainted = [(t, sorted("SENSITIVE" if x == "S" else "UNTRUSTED_ORIGIN" for x in tags), weak) for _, t, tags, weak in d.evidence.nodes if tags]
    parts = [f"{' and '.join(PHRASES[x] for x in tags)} from {label(t, policy)}" for t, tags, _ in tainted]
    parts += [f"{' and '.join(PHRASES[x] for x in arg_tags)} in the request itself"] if arg_tags else []
    weak = not arg_tags and all(w for _, _, w in tainted)
    known = {x for _, tags, _ in tainted for x in tags} | set(arg_tags)
    clean = [{"kind": "SANITIZE", "available": policy.can_tokenize, "detail": "TOKENIZATION" if policy.can_tokenize else None}] if "SENSITIVE" in known else []
    return {
        "summary": "This could send sensitive data out, so it was stopped.",
        "reason": "It mixes " + "; ".join(parts) + "." if parts else "Where this data comes from could not be shown to be safe.",
        "risks": [INJECTED, "The link is a guess by time and may be none." if weak else "The data is clearly linked."],
        "actions": [*clean, _approval(d), INSPECT],
    }


def destructive(d: Decision, arg_tags: list[str], policy: Policy) -> dict[str, Any]:
    """A call that can't be undone, after content from outside was read."""
    read = ", ".join(dict.fromkeys(label(t, policy) for _, t, _, _ in d.evidence.nodes))
    return {
        "summary": "This can't be undone and follows content from outside, so it was stopped.",
        "reason": f"Content from {read} was read before and may have asked for it." if read else "The request itself carries content from outside.",
        "risks": ["Hidden instructions may have caused a call that can't be undone."],
        "actions": [_approval(d), INSPECT],
    }


def outbound() -> dict[str, Any]:
    """Sensitive content on its way out by another channel than a tool call: no approval opens it."""
    return {
        "summary": "Sensitive content would leave by another channel than a tool call, so it was stopped.",
        "reason": "It holds sensitive data of this session, which has read content from outside.",
        "risks": [INJECTED],
        "actions": [INSPECT],
    }


def failed() -> dict[str, Any]:
    return {
        "summary": "The check could not be finished, so nothing was sent.",
        "reason": "Something failed while the data's origin was looked up.",
        "risks": ["Data that isn't checked may hold sensitive values."],
        "actions": [INSPECT],
    }
