import json

import pytest

from sluiceway.plans.policy import DEFAULT, Current, load, parse, resolve_path

GOOD = {"sensitiveSources": ["db"], "untrustedSources": ["web"], "sinks": {"mail": "OUTBOUND_SINK", "db": "READ"}}


def test_defaults_and_legacy_names():
    p = parse(GOOD)
    assert (p.mode, p.unknown_tools, p.hitl, p.propagation, p.destructive_policy) == ("session", "deny", "off", "snapshot", "off")
    assert parse({**GOOD, "sensitiveSourceTools": ["x"]}).sensitive == {"x"}
    both = parse({**GOOD, "outboundSinkTools": ["db", "post"]})
    assert both.sinks == {"mail": "OUTBOUND_SINK", "db": "READ", "post": "OUTBOUND_SINK"}


@pytest.mark.parametrize(
    "change",
    [
        {"sinks": {"x": "NOWHERE"}}, {"sensitiveSources": "db"}, {"judgmentMode": "guess"}, {"trustedResourceUris": ["corp"]},
        {"trustedResourceUris": ["https://corp"]}, {"piiPatterns": [{"type": "lower", "pattern": "x"}]}, {"piiPatterns": [{"type": "X", "pattern": "("}]},
        {"secretDetection": {"byEntropy": {"minLength": 0, "entropyThreshold": 3}}}, {"secretDetection": {"byEntropy": {"minLength": 8, "entropyThreshold": -1}}},
        {"extractionSchema": {"fields": {}}}, {"extractionSchema": {"fields": {"a": {"kind": "string", "maxLength": 5, "charset": "any"}}}},
        {"toolLabels": {"a": 1}}, {"domain": 5}, {"destructivePolicy": "ask"},
    ],
)
def test_bad_policies_are_refused(change):
    with pytest.raises(ValueError):
        parse({**GOOD, **change})


def test_a_policy_needs_sinks():
    with pytest.raises(ValueError):
        parse({"sensitiveSources": [], "untrustedSources": []})


def test_reload_swaps_only_valid_policies(tmp_path):
    now = Current(DEFAULT)
    bad, good = tmp_path / "bad.json", tmp_path / "good.json"
    bad.write_text("{")
    good.write_text(json.dumps(GOOD))
    with pytest.raises(ValueError):
        now.reload(bad)
    assert now.policy is DEFAULT
    assert now.reload(good).sink("mail") == "OUTBOUND_SINK" and load(good).classified("web")


def test_path_resolution(monkeypatch):
    monkeypatch.delenv("SLUICEWAY_POLICY", raising=False)
    monkeypatch.setenv("SLUICEWAY_DOMAIN", "dev")
    assert resolve_path("a.json") == "a.json" and resolve_path(folder="c") == "c/dev.json"
    monkeypatch.setenv("SLUICEWAY_POLICY", "p.json")
    assert resolve_path() == "p.json"


def test_unknown_and_destructive_tools():
    assert DEFAULT.source_tags("nobody") == {"U"} and DEFAULT.sink("nobody") == "OUTBOUND_SINK"
    assert DEFAULT.source_tags("delete_customer_record") == set() and DEFAULT.sink("delete_customer_record") == "OUTBOUND_SINK"
    assert DEFAULT.trusted("https://tionsh.example.net/x") and not DEFAULT.trusted("https://tionsh.example.net.evil/x")
