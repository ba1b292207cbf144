"""One session as a state machine, shared by the batch fold and by streaming.

Events come in the order of ``seq``. Time and ids come from the events, so a
retried task gives the same rows. State is plain data (``state``/``from_state``),
so that a stream can keep it between batches. What a session makes besides verdicts (nodes, edges, payloads, steps of
approvals, explanations, events) is put into ``emitted`` when it comes about; whoever drives the session
takes it from there after each event, so state doesn't grow with it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from sluiceway.functions import leaves as L
from sluiceway.operators import explain
from sluiceway.plans.policy import Policy, from_json

S, U = "S", "U"
NAMES = {S: "SENSITIVE", U: "UNTRUSTED_ORIGIN"}
STRONG = 16


def tag_names(tags: set[str]) -> list[str]:
    return [NAMES[t] for t in (S, U) if t in tags]


@dataclass
class Node:
    tool: str
    tags: set[str]
    own: set[str]
    parents: list[str]
    tokens: dict[str, int]
    pruned: bool = False
    how: list[tuple[str, bool]] = field(default_factory=list)  # method and weakness of the link to each parent


@dataclass
class Link:
    node: str
    method: str
    weak: bool
    token: str | None = None
    length: int | None = None


@dataclass
class Payload:
    tool: str
    tags: set[str]
    value: Any
    node: str
    origin: str | None


@dataclass
class Offer:
    id: str
    tool: str
    call: str
    lineage: str
    status: str = "OFFERED"
    used: bool = False
    by: str | None = None


@dataclass
class Evidence:
    method: str = "NONE"
    nodes: list[tuple[str, str, frozenset[str], bool]] = field(default_factory=list)

    @property
    def tags(self) -> set[str]:
        return {t for n in self.nodes for t in n[2]}

    @property
    def weak_or_clean(self) -> bool:
        return all(weak or not tags for _, _, tags, weak in self.nodes)


@dataclass
class Decision:
    allowed: bool
    reason: str = ""
    tags: tuple[str, ...] = ()
    can_override: bool | None = None
    approval: str | None = None
    scan: L.Finding | None = None
    evidence: Evidence = field(default_factory=Evidence)


class Session:
    """State of one session, and a method per event. ``vault`` may be shared by sessions."""

    def __init__(self, name: str, policy: Policy, vault: dict[str, str] | None = None):
        self.name, self.policy = name, policy
        self.tags: set[str] = set()
        self.exposed = False
        self.nodes: dict[str, Node] = {}
        self.payloads: list[Payload] = []
        self.offers: dict[str, Offer] = {}
        self.vault = {} if vault is None else vault
        self.resent_elsewhere = False  # an original that another session has tokenized is in the arguments at hand
        self.telling = True  # off where only verdicts are wanted: nothing is emitted
        self.emitted: list[tuple[str, str | None, str, tuple[str, ...], dict[str, Any]]] = []
        self.shadowed: bool | None = None
        self.policy_text: str | None = None  # of a policy that came with the events
        self.n = 0
        self._asked: tuple[object, dict[str, int]] | None = None
        self._roots: list[str] | None = []
        self._by_token: dict[str, list[str]] = {}

    @property
    def audit(self) -> list[tuple[str | None, str, str, str | None]]:
        """Steps of approvals that haven't been taken yet."""
        return [(name, tool, d["action"], d["actor"]) for kind, name, tool, _, d in self.emitted if kind == "approval"]

    @property
    def shadow(self) -> list[tuple[str, bool, bool | None]]:
        """Compared verdicts that haven't been taken yet."""
        return [(tool, d["allowed"], d["shadow_allowed"]) for kind, _, tool, _, d in self.emitted if kind == "shadow"]

    def emit(self, kind: str, name: str | None, tool: str, tags: set[str] | tuple[str, ...] = (), /, **detail: Any) -> None:
        if self.telling:
            self.emitted.append((kind, name, tool, tuple(tags) if isinstance(tags, tuple) else tuple(tag_names(tags)), detail))

    # -- ids and lineage

    def _id(self, kind: str) -> str:
        self.n += 1
        h = hashlib.sha256(f"{self.name}|{self.n}".encode()).hexdigest()
        return f"{kind}_{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"

    def _is_root(self, n: Node) -> bool:
        """It holds a tag that none of its parents has."""
        return any(not any(t in self.nodes[p].tags for p in n.parents if p in self.nodes) for t in n.tags)

    def _frontier(self) -> list[str]:
        """Nodes with a tag that none of their parents has; kept up to date until a tag changes afterwards."""
        if self._roots is None:
            self._roots = [i for i, n in self.nodes.items() if self._is_root(n)]
        return self._roots

    def links(self, args: object) -> tuple[str, list[Link]]:
        """Parents of a value: explicit ids, else shared tokens, else (or if these are clean) the frontier."""
        found: list[Link] = []
        method = "NONE"
        if args is not None:
            named = dict.fromkeys(s for s in self._leaves_of(args) if s in self.nodes)
            found = [Link(i, "MCP_REF", False) for i in named]
            method = "MCP_REF" if found else method
            if not found and (tokens := self._tokens_of(args)):
                met: dict[str, list[tuple[str, int]]] = {}
                for h, n in tokens.items():
                    for i in self._by_token.get(h, ()):
                        met.setdefault(i, []).append((h, n))
                place = {i: k for k, i in enumerate(self.nodes)} if len(met) > 1 else dict.fromkeys(met, 0)
                for i in sorted(met, key=lambda i: (self.nodes[i].pruned, place[i])):  # live ones first, by age
                    best = max(met[i], key=lambda x: x[1])
                    found.append(Link(i, "VALUE_MATCH", len(met[i]) < 2 and best[1] < STRONG, *best))
                method = "VALUE_MATCH" if found else method
        clean = not any(self.nodes[x.node].tags for x in found)
        if method == "NONE" or (method == "VALUE_MATCH" and clean):
            have = {x.node for x in found}
            if roots := self._frontier():
                found += [Link(i, "TEMPORAL_FALLBACK", True) for i in roots if i not in have]
                method = "TEMPORAL_FALLBACK"
        return method, found

    def _leaves_of(self, args: object) -> list[str]:
        return L.leaves(args)

    def _tokens_of(self, args: object) -> dict[str, int]:
        """Tokens of the arguments at hand; a call is judged and then recorded with the same ones."""
        if self._asked is None or self._asked[0] is not args:
            self._asked = args, L.match_tokens(args)
        return self._asked[1]

    def _tokens_held(self, result: object) -> dict[str, int]:
        return L.match_tokens(result) if result is not None else {}

    def evidence(self, args: object) -> Evidence:
        method, found = self.links(args)
        rows = []
        for x in found:
            n = self.nodes[x.node]
            if not n.pruned:
                rows.append((x.node, n.tool, frozenset(n.tags), x.weak))
            elif n.tags:
                rows.append((x.node, "(pruned)", frozenset(n.tags), x.weak))
        return Evidence(method, rows)

    def _add_node(self, tool: str, tags: set[str], args: object, result: object) -> tuple[str, str, list[Link]]:
        method, found = self.links(args)
        every = set(tags).union(*(self.nodes[x.node].tags for x in found))
        name = self._id("tn")
        node = Node(tool, every, set(tags), [x.node for x in found], self._tokens_held(result), False, [(x.method, x.weak) for x in found])
        self.nodes[name] = node
        for h in node.tokens:
            self._by_token.setdefault(h, []).append(name)
        if self._roots is not None and self._is_root(node):
            self._roots.append(name)
        self.emit("node", name, tool, every, own=tag_names(tags))
        for x in found:
            self.emit("edge", name, tool, parent=x.node, method=x.method, weak=x.weak)
        return name, method, found

    def _tag(self, tags: set[str]) -> None:
        self.tags |= tags
        self.exposed |= U in tags

    # -- recording

    def record(self, tool: str, args: object, result: object) -> tuple[str, str, list[Link]]:
        """A tool's result: tags, node, payload."""
        tags = self.policy.source_tags(tool)
        if S not in tags and L.has_secret(result, self.policy.secrets):
            tags.add(S)
        origin = None if S not in tags else "source" if S in self.policy.source_tags(tool) else "content"
        return self._record(tool, tags, args, result, origin)

    def record_content(self, channel: str, uri: str, content: object) -> tuple[str, str, list[Link]]:
        """External content: untrusted unless its uri is trusted; sensitive if it holds a secret."""
        tags = set() if self.policy.trusted(uri) else {U}
        if L.has_secret(content, self.policy.secrets):
            tags.add(S)
        return self._record(f"{channel}:{uri}", tags, None, content, "content" if S in tags else None)

    def _record(self, tool: str, tags: set[str], args: object, result: object, origin: str | None) -> tuple[str, str, list[Link]]:
        self._tag(tags)
        out = self._add_node(tool, tags, args, result)
        if tags:
            self.payloads.append(Payload(tool, set(tags), result, out[0], origin))
            self.emit("payload", out[0], tool, tags, origin=origin)
        return out

    def add_tags(self, node: str, tags: set[str]) -> None:
        """Late taint; in live mode what is new goes to all descendants, through pruned nodes too."""
        n = self.nodes[node]
        if n.pruned:
            raise KeyError(node)
        new = tags - n.tags
        n.own |= tags
        n.tags |= tags
        self._roots = None
        if not new or self.policy.propagation != "live":
            return
        children: dict[str, list[str]] = {}
        for i, x in self.nodes.items():
            for p in x.parents:
                children.setdefault(p, []).append(i)
        seen, todo = {node}, list(children.get(node, ()))
        while todo:
            i = todo.pop(0)
            if i not in seen:
                seen.add(i)
                self.nodes[i].tags |= new
                todo += children.get(i, ())

    def prune(self) -> int:
        """Untagged nodes without live children become tombstones, until none is left."""
        if self.policy.pruning != "declassified":
            return 0
        gone, more = 0, True
        while more:
            more = False
            holding = {p for n in self.nodes.values() if not n.pruned for p in n.parents}
            for i, n in self.nodes.items():
                if not n.pruned and not n.tags and i not in holding:
                    n.pruned, more, gone = True, True, gone + 1
        return gone

    def sanitize(self, method: str) -> dict[str, Any]:
        """All or nothing: clears S (TOKENIZATION) or U (STRUCTURED_EXTRACTION) if every payload with it passes."""
        target = S if method == "TOKENIZATION" else U
        before = tag_names(self.tags)
        own = [p for p in self.payloads if target in p.tags]
        masked = residual = None
        done = False
        if target in self.tags and own:
            results = []
            for p in own:
                if target == S:
                    ok, new, vault = L.tokenize(p.value, self.policy)
                    self.vault |= vault
                    ok = ok and json.dumps(new) != json.dumps(p.value)
                else:
                    ok, new = L.extract(p.value, self.policy)
                results.append((ok, new))
            if done := all(ok for ok, _ in results):
                if target == S:
                    masked, residual = 0, False
                for p, (_, new) in zip(own, results, strict=True):
                    if target == S:
                        masked += L.count_tokens(new) - L.count_tokens(p.value)
                        residual |= S in self.policy.source_tags(p.tool) and L.has_content(new)
                    p.value = new
                    p.tags.discard(target)
                    n = self.nodes[p.node]
                    if not n.pruned:
                        n.own.discard(target)
                        n.tags.discard(target)
                self._roots = None
                self.tags.discard(target)
        return {"done": done, "before": before, "after": tag_names(self.tags), "masked": masked, "residual": residual}

    # -- approvals

    def _call(self, gate: str, tool: str, args_text: str) -> str:
        return L.sha(f"{gate}|{self.name}|{tool}|{args_text}", 32)

    @staticmethod
    def _lineage(e: Evidence, arg_tags: set[str]) -> str:
        nodes = sorted((i, weak, tag_names(set(tags))) for i, _, tags, weak in e.nodes)
        return L.sha(json.dumps([e.method, nodes, tag_names(arg_tags)]), 32)

    def _note(self, o: Offer, action: str, actor: str | None = None) -> None:
        self.emit("approval", o.id, o.tool, action=action, actor=actor)

    def offer(self, gate: str, tool: str, args_text: str, e: Evidence, arg_tags: set[str]) -> str:
        """An open offer for the same call and lineage is used again; one with another lineage is superseded."""
        call, lineage = self._call(gate, tool, args_text), self._lineage(e, arg_tags)
        for o in self.offers.values():
            if o.call == call and o.status in ("OFFERED", "PENDING"):
                if o.lineage == lineage:
                    return o.id
                o.status = "SUPERSEDED"
                self._note(o, "SUPERSEDED")
        o = Offer(self._id("ap"), tool, call, lineage)
        self.offers[o.id] = o
        self._note(o, "OFFERED")
        return o.id

    def request(self, approval: str) -> None:
        o = self.offers[approval]
        if o.status == "OFFERED":
            o.status = "PENDING"
            self._note(o, "REQUESTED")
        elif o.status != "PENDING":
            raise ValueError(f"{approval} is {o.status}")

    def resolve(self, approval: str, approved: bool, by: str | None = None) -> None:
        o = self.offers[approval]
        if o.status != "PENDING":
            raise ValueError(f"{approval} is {o.status}")
        o.status, o.by = ("APPROVED" if approved else "REJECTED"), by
        self._note(o, o.status, by)

    def _approved(self, gate: str, tool: str, args_text: str, e: Evidence, arg_tags: set[str], use: bool) -> Offer | None:
        """The approval for this call and lineage; using it burns those whose lineage has changed."""
        call, lineage = self._call(gate, tool, args_text), self._lineage(e, arg_tags)
        for o in self.offers.values():
            if o.call == call and o.status == "APPROVED" and not o.used:
                if o.lineage == lineage:
                    if use:
                        o.used = True
                        self._note(o, "OVERRIDE_USED", o.by)
                    return o
                if use:
                    o.used = True
                    self._note(o, "OVERRIDE_STALE", o.by)
        return None

    # -- decisions

    def _resent(self, args: object) -> bool:
        hay = "\0".join(L.leaves(args))
        return self.resent_elsewhere or any(len(v) >= L.VAULT_MIN and v in hay for v in self.vault.values())

    def _scan(self, args: object) -> L.Finding | None:
        known = [(p.tool, p.value, p.origin or "content") for p in self.payloads if S in p.tags]
        return L.scan(known, args, self.policy.secrets)

    def _session_rule(self, tool: str, arg_tags: set[str]) -> Decision:
        tags = self.tags | arg_tags
        if self.policy.sink(tool) == "OUTBOUND_SINK" and S in tags and (U in tags or self.exposed):
            unknown = "" if self.policy.classified(tool) else " (unclassified tool)"
            return Decision(False, "sensitive data and untrusted input meet at a sink" + unknown, (NAMES[S], NAMES[U]))
        return Decision(True)

    def _lineage_rule(self, tool: str, args: object, args_text: str, arg_tags: set[str]) -> Decision:
        if self.policy.sink(tool) != "OUTBOUND_SINK":
            return Decision(True)
        e = self.evidence(args)
        resent, hit = self._resent(args), self._scan(args)
        tags = e.tags | arg_tags
        if not ((S in tags or resent or hit) and (U in tags or self.exposed)):
            return Decision(True, evidence=e)
        relaxed = self.policy.relaxation == "scan-clean" and e.method == "TEMPORAL_FALLBACK" and e.weak_or_clean
        if relaxed and S not in arg_tags and hit is None and not resent:
            return Decision(True, "only temporal links and a clean scan", evidence=e)
        asks = self.policy.hitl == "weak-only"
        if asks and (o := self._approved("exfil", tool, args_text, e, arg_tags, True)):
            return Decision(True, f"approved once: {o.id}", evidence=e)
        notes = [
            "tainted nodes in the value's lineage: " + (", ".join(f"{i} ({t})" for i, t, tags_, _ in e.nodes if tags_) or "none"),
            "" if U in tags else "the session was exposed to untrusted input",
            "an original from before sanitization is sent again" if resent else "",
            f"the output scan found {hit.transform or hit.kind}" if hit else "",
            "" if self.policy.classified(tool) else "unclassified tool",
        ]
        d = Decision(False, "; ".join(filter(None, notes)), (NAMES[S], NAMES[U]), scan=hit, evidence=e)
        if asks:
            d.can_override = not arg_tags and e.weak_or_clean
            if d.can_override:
                d.approval = self.offer("exfil", tool, args_text, e, arg_tags)
        return d

    def _gate(self, tool: str, arg_tags: set[str]) -> Evidence | None:
        """Evidence against a destructive call, or None if the gate doesn't apply."""
        if self.policy.destructive_policy == "off" or tool not in self.policy.destructive:
            return None
        if not self.exposed and U not in arg_tags:
            return None
        return Evidence("NONE", [(i, "(pruned)" if n.pruned else n.tool, frozenset(n.tags), True) for i, n in sorted(self.nodes.items(), key=lambda x: x[1].pruned) if U in n.tags])

    def _gate_block(self, tool: str, args_text: str, arg_tags: set[str], e: Evidence) -> Decision:
        d = Decision(False, "a destructive call in a session exposed to untrusted input", (NAMES[U],), False, evidence=e)
        if self.policy.destructive_policy == "hitl":
            self._approved("destructive", tool, args_text, e, arg_tags, True)
            d.can_override, d.approval = True, self.offer("destructive", tool, args_text, e, arg_tags)
        return d

    def evaluate(self, tool: str, args: object, args_text: str = "", arg_tags: set[str] | frozenset[str] = frozenset()) -> Decision:
        """The verdict on an outgoing call. Whatever fails blocks."""
        arg_tags = set(arg_tags)
        self.shadowed = None
        try:
            d = self._evaluate(tool, args, args_text, arg_tags)
            why = explain.destructive if d.tags == (NAMES[U],) else explain.leak
            return self._tell(tool, d, lambda: why(d, tag_names(arg_tags), self.policy))
        except Exception as e:  # noqa: BLE001  fail-safe: an error never lets a call pass
            return self._tell(tool, Decision(False, f"could not be judged: {type(e).__name__}"), explain.failed)

    def _tell(self, tool: str, d: Decision, why: Any) -> Decision:
        """Emit what goes with a block: its explanation, an event where both tags meet, and one for a finding of the scan."""
        if not d.allowed and self.telling:
            self.emit("explanation", d.approval, tool, d.tags, **why())
            sink = self.policy.sink(tool)
            if len(d.tags) == 2:
                self.emit("trifecta", None, tool, d.tags, sink=sink)
            if d.scan:
                self.emit("output_scan", None, tool, d.tags, sink=sink, kind=d.scan.kind, source=d.scan.tool, length=d.scan.length, value_hash=d.scan.value_hash)
        return d

    def _evaluate(self, tool: str, args: object, args_text: str, arg_tags: set[str]) -> Decision:
        e = self._gate(tool, arg_tags)
        hitl = self.policy.destructive_policy == "hitl"
        if self.policy.mode == "lineage":
            if e is None:
                return self._lineage_rule(tool, args, args_text, arg_tags)
            if not (hitl and self._approved("destructive", tool, args_text, e, arg_tags, False)):
                return self._gate_block(tool, args_text, arg_tags, e)
            d = self._lineage_rule(tool, args, args_text, arg_tags)
            if not d.allowed:
                return d  # the approval of the gate is kept
            if not (o := self._approved("destructive", tool, args_text, e, arg_tags, True)):
                return self._gate_block(tool, args_text, arg_tags, e)
            d.reason = " / ".join(filter(None, (d.reason, f"approved once: {o.id}")))
            return d
        d = self._session_rule(tool, arg_tags)
        self._compare(tool, args, d.allowed)
        if not d.allowed or e is None:
            return d
        if hitl and (o := self._approved("destructive", tool, args_text, e, arg_tags, True)):
            return Decision(True, f"approved once: {o.id}")
        return self._gate_block(tool, args_text, arg_tags, e)

    def _compare(self, tool: str, args: object, allowed: bool) -> None:
        """Shadow: what the lineage rule would say, without scan, argument tags and approvals."""
        try:
            e = self.evidence(args)
            block = self.policy.sink(tool) == "OUTBOUND_SINK" and (S in e.tags or self._resent(args)) and (U in e.tags or self.exposed)
            self.shadowed = not block
            self.emit("shadow", None, tool, allowed=allowed, shadow_allowed=not block)
        except Exception:  # noqa: BLE001  only an observation
            self.emit("shadow", None, tool, allowed=allowed, shadow_allowed=None)

    def outbound(self, channel: str, content: object) -> Decision:
        """Content that leaves by another channel: blocked hard, no relaxation, no approval."""
        try:
            e = self.evidence({"content": content})
            hit, resent = self._scan(content), self._resent(content)
            if (S in e.tags or resent or hit) and self.exposed:
                return self._tell(channel, Decision(False, f"sensitive content leaves through {channel}", (NAMES[S], NAMES[U]), scan=hit, evidence=e), explain.outbound)
            return Decision(True, evidence=e)
        except Exception as x:  # noqa: BLE001
            return self._tell(channel, Decision(False, f"could not be judged: {type(x).__name__}"), explain.failed)

    def resource(self, channel: str, uri: str, params: object = None) -> Decision:
        """A request for a resource: a trusted uri passes, else its parameters are judged as content."""
        return Decision(True) if self.policy.trusted(uri) else self.outbound(channel, {"uri": uri} if params is None else params)

    # -- policy, lookups and state between batches

    def change_policy(self, text: str) -> None:
        """From now on another policy holds; one that isn't valid raises and changes nothing."""
        self.policy, self.policy_text = from_json(text), text

    def holders(self, tag: str) -> list[str]:
        """All nodes that hold a tag, tombstones too."""
        return [i for i, n in self.nodes.items() if tag in n.tags]

    def snapshot(self) -> list[dict[str, Any]]:
        """The lineage as views draw it."""
        link = lambda p, how: {"nodeId": p, "method": how[0], "weak": how[1]}
        return [{"id": i, "toolName": n.tool, "tags": tag_names(n.tags), "parents": list(map(link, n.parents, n.how))} for i, n in self.nodes.items() if not n.pruned]

    def state(self) -> str:
        plain = {
            "tags": sorted(self.tags), "exposed": self.exposed, "n": self.n, "vault": self.vault,
            "nodes": [[i, x.tool, sorted(x.tags), sorted(x.own), x.parents, x.tokens, x.pruned, x.how] for i, x in self.nodes.items()],
            "payloads": [[p.tool, sorted(p.tags), p.value, p.node, p.origin] for p in self.payloads],
            "policy": self.policy_text,
            "offers": [[o.id, o.tool, o.call, o.lineage, o.status, o.used, o.by] for o in self.offers.values()],
        }
        return json.dumps(plain)

    @classmethod
    def from_state(cls, name: str, policy: Policy, text: str) -> Session:
        raw, me = json.loads(text), cls(name, policy)
        me.tags, me.exposed, me.n, me.vault = set(raw["tags"]), raw["exposed"], raw["n"], raw["vault"]
        me.nodes = {i: Node(t, set(a), set(b), p, k, x, how) for i, t, a, b, p, k, x, how in raw["nodes"]}
        me.payloads = [Payload(t, set(a), v, n, o) for t, a, v, n, o in raw["payloads"]]
        me.offers = {o[0]: Offer(*o) for o in raw["offers"]}
        if raw.get("policy"):
            me.change_policy(raw["policy"])
        me._roots = None
        for i, n in me.nodes.items():
            for h in n.tokens:
                me._by_token.setdefault(h, []).append(i)
        return me
