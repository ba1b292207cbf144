"""Replay of labelled scenarios: an evaluation record per labelled decision, for one or more modes.

A scenario has scenario_id, category (normal or attack), tier, title and an array of steps
(op, tool, args_json, result_json, bind, refs, method, expect, why). Scenarios are independent, so each row is replayed where it is.

Traces whose arguments and results are texts of a table are replayed without the texts (``replay_keyed``): what a verdict
needs of a text (its tokens, whether it holds secrets) is found once per text, not once per call, and only these features go to the
sessions. What only the scan can tell is asked once per pair of texts, after the sessions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.functions import leaves as L
from sluiceway.operators import links
from sluiceway.operators.session import STRONG, S, Session, U
from sluiceway.plans.policy import Policy

STEP = "struct<op:string,tool:string,args_json:string,result_json:string,bind:string,refs:array<string>,method:string,expect:string,why:string>"
SCENARIO = f"scenario_id string, category string, tier string, title string, steps array<{STEP}>"
RECORD = "scenario_id string, category string, tier string, title string, mode string, eval_index long, tool string, expect string, allowed boolean, outcome string, why string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Scenario sets as JSON lines."""
    return spark.read.schema(SCENARIO).json(path)


def judge(expect: str, allowed: bool) -> str:
    return ("FN" if allowed else "TP") if expect == "block" else ("TN" if allowed else "FP")


def run_scenario(scenario_id: str, steps: list, policy: Policy, vault: dict[str, str] | None = None) -> Iterator[tuple[str, str, bool, str | None]]:
    """(tool, expect, allowed, why) of each evaluation; a reference to an unknown binding raises."""
    s, bound = Session(f"bench-{scenario_id}", policy, vault), {}
    for x in steps:
        args = L.parse(x["args_json"]) if x["args_json"] else {}
        if x["refs"]:
            args = {**args, "_taintRef": [bound[r] for r in x["refs"]]}
        if x["op"] == "record":
            node, _, _ = s.record(x["tool"], args or None, L.parse(x["result_json"]))
            if x["bind"]:
                bound[x["bind"]] = node
        elif x["op"] == "sanitize":
            s.sanitize(x["method"])
        else:
            yield x["tool"], x["expect"], s.evaluate(x["tool"], args, json.dumps(args)).allowed, x["why"]


def replay(scenarios: DataFrame, policy: Policy, modes: tuple[str, ...] = ("session", "lineage")) -> DataFrame:
    """RECORD rows. The mode is a column: one job runs all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                for mode in modes:
                    for i, (tool, expect, allowed, why) in enumerate(run_scenario(r.scenario_id, list(r.steps), replace(policy, mode=mode))):
                        out.append((r.scenario_id, r.category, r.tier, r.title, mode, i, tool, expect, allowed, judge(expect, allowed), why))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    return scenarios.select("scenario_id", "category", "tier", "title", "steps").mapInPandas(run, RECORD)


def from_traces(traces: DataFrame) -> DataFrame:
    """Trace rows (session_id, seq, tool, args, result, label) to scenarios: each call is judged, then recorded."""
    step = lambda op: F.struct(
        F.lit(op).alias("op"), F.col("tool"), F.col("args").alias("args_json"), F.when(F.lit(op == "record"), F.col("result")).alias("result_json"),
        F.lit(None).cast("string").alias("bind"), F.lit(None).cast("array<string>").alias("refs"), F.lit(None).cast("string").alias("method"),
        F.when(F.lit(op == "evaluate"), F.col("label")).alias("expect"), F.lit(None).cast("string").alias("why"),
    )
    both = traces.select("session_id", "label", F.struct("seq", F.array(step("evaluate"), step("record")).alias("s")).alias("x"))
    grouped = both.groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.max(F.col("label") == "block").alias("attack"))
    return grouped.select(
        F.col("session_id").cast("string").alias("scenario_id"), F.when(F.col("attack"), "attack").otherwise("normal").alias("category"),
        F.lit(None).cast("string").alias("tier"), F.col("session_id").cast("string").alias("title"), F.flatten(F.transform("x", lambda v: v["s"])).alias("steps"),
    )


# -- traces whose arguments and results are texts of a table


@dataclass(eq=False)
class Known:
    """What verdicts need of a text: does it hold a secret, and one by key patterns in any form, can it name a node, its tokens (the first 64 bits of their hashes)."""

    key: int
    nth: int
    secret: bool
    pattern: bool
    name: str | None
    hashes: np.ndarray
    _tokens: dict[int, int] | None = None

    @property
    def tokens(self) -> dict[int, int]:
        if self._tokens is None:
            self._tokens = dict.fromkeys(self.hashes.tolist(), STRONG)
        return self._tokens


FEATURES = "key long, nth int, secret boolean, pattern boolean, name string, hashes array<long>"


def features(texts: DataFrame, policy: Policy) -> DataFrame:
    """FEATURES of each text (key, nth, json)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            secret, pattern, name, hashes = [], [], [], []
            for t in b.column("json").to_pylist():
                value = L.parse(t)
                said = L.leaves(value)
                secret.append(L.has_secret(value, policy.secrets))
                pattern.append(L.scan((), value, policy.secrets) is not None)
                name.append(next((x for x in said if x.startswith("tn_")), None))
                hashes.append(np.array([int(h[:16], 16) for h in L.match_tokens(value)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("nth"), pa.array(secret, pa.bool_()), pa.array(pattern, pa.bool_()), pa.array(name, pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["key", "nth", "secret", "pattern", "name", "hashes"],
            )

    return texts.select("key", "nth", "json").mapInArrow(run, FEATURES)


class Traced(Session):
    """A session of calls whose arguments and results are ``Known`` texts, judged in session and in lineage mode at once.

    Without approvals and relaxation a verdict changes nothing, so both modes have one state; and a call that isn't a sink, or comes before
    anything untrusted, passes whatever its lineage. So nodes are made when a verdict first depends on them.
    """

    def __init__(self, name: str, policy: Policy):
        super().__init__(name, policy)
        self.telling = False
        self._untold: list[tuple[str, Known]] = []
        self._unlinked: list[tuple[str, set[str], Known]] = []
        self.known: dict[tuple[int, int, bool], None] = {}

    def _leaves_of(self, args: Known) -> list[str]:
        return [args.name] if args.name else []

    def _tokens_of(self, args: Known) -> dict[int, int]:
        return args.tokens

    _tokens_held = _tokens_of

    def called(self, tool: str, text: Known) -> None:
        self.exposed |= U in self.policy.source_tags(tool)  # a secret adds S only
        self._untold.append((tool, text))

    def verdicts(self, tool: str, text: Known) -> tuple[bool, bool, list[tuple[int, int, bool]]]:
        """Does it pass in session mode, and in lineage mode unless the scan finds one of these texts (key, nth, from a source?) in it."""
        if self.policy.sink(tool) != "OUTBOUND_SINK" or not self.exposed:
            return True, True, []
        for t, x in self._untold:
            tags = set(self.policy.source_tags(t))
            source = S in tags
            if source or x.secret:
                tags.add(S)
                self.known[x.key, x.nth, source] = None
            self._tag(tags)
            self._unlinked.append((t, tags, x))
        self._untold.clear()
        if S not in self.tags:
            return True, not text.pattern, []
        for t, tags, x in self._unlinked:
            self._add_node(t, tags, x, x)
        self._unlinked.clear()
        passes = not text.pattern and S not in self.evidence(text).tags
        return False, passes, list(self.known) if passes else []


def keyed(policy: Policy) -> bool:
    """Can ``replay_keyed`` judge by this policy?"""
    return policy.hitl == "off" and policy.relaxation == "off" and policy.destructive_policy == "off"


def _judged(traces: DataFrame, policy: Policy, modes: tuple[str, ...]) -> DataFrame:
    """RECORD's columns but outcome and why, plus key, nth and asked: the texts that the scan has still to look for in this one."""
    told = "scenario_id string, category string, tier string, title string, mode string, eval_index long, tool string, expect string, allowed boolean, key long, nth int, asked array<struct<key:long,nth:int,source:boolean>>"
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.struct([("key", pa.int64()), ("nth", pa.int32()), ("source", pa.bool_())]))]
    names = [c.split()[0] for c in told.split(", ")]
    many = 20_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> None:
            """A session has ended: what it is, is known."""
            category = "attack" if attack else "normal"
            for i, (tool, label, passes, text, asked) in enumerate(said):
                for mode in modes:
                    scan = asked if mode == "lineage" else []
                    out.append((here, category, None, here, mode, i, tool, label, passes[mode], text.key, text.nth, [{"key": k, "nth": n, "source": s} for k, n, s in scan] or None))

        out: list[tuple] = []
        session, here, attack, said = None, None, False, []
        for b in batches:
            column = {n: b.column(n).to_pylist() for n in ("session_id", "tool", "label", "key", "nth", "secret", "pattern", "name")}
            at, flat = b.column("hashes").offsets.to_numpy(), b.column("hashes").values.to_numpy()
            for i, name in enumerate(column["session_id"]):
                if session is None or name != here:
                    if session is not None:
                        closed()
                    session, here, attack, said = Traced(f"bench-{name}", policy), name, False, []
                text = Known(*(column[n][i] for n in ("key", "nth", "secret", "pattern", "name")), flat[at[i] : at[i + 1]])
                tool, label = column["tool"][i], column["label"][i]
                plain, linked, asked = session.verdicts(tool, text)
                session.called(tool, text)
                said.append((tool, label, {"session": plain, "lineage": linked}, text, asked))
                attack |= label == "block"
            if len(out) >= many:
                yield _columns(out, kinds, names)
                out.clear()
        if session is not None:
            closed()
        yield _columns(out, kinds, names)

    ordered = traces.repartition("session_id").sortWithinPartitions("session_id", "seq", "tool", "nth", "label")
    return ordered.select("session_id", "tool", "label", "key", "nth", "secret", "pattern", "name", "hashes").mapInArrow(run, told)


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _scanned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (key, nth, known: key, nth, source) those where the scan finds the known text in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in ("json", "held", "source")), strict=True)
            hit = [L.scan([("", L.parse(held), "source" if source else "content")], L.parse(json_), None) is not None for json_, held, source in rows]
            yield b.select(["key", "nth", "known"]).filter(pa.array(hit, pa.bool_()))

    held = texts.select(F.struct("key", "nth").alias("at"), F.col("json").alias("held"))
    met = pairs.join(texts, ["key", "nth"]).join(held, F.struct("known.key", "known.nth") == F.col("at"))
    return met.select("key", "nth", "known", "json", "held", F.col("known.source").alias("source")).mapInArrow(run, pairs.select("key", "nth", "known").schema)


def replay_keyed(
    traces: DataFrame, texts: DataFrame, policy: Policy, written: Callable[[DataFrame], DataFrame], modes: tuple[str, ...] = ("session", "lineage")
) -> DataFrame:
    """RECORD rows, as ``replay`` of ``from_traces``, of traces (session_id, seq, tool, key, label) whose arguments and results are both the JSON text of that key.

    ``texts`` has key and json; all texts of a key are joined, in order. ``written`` keeps a table between jobs.
    """
    if not keyed(policy):
        raise ValueError("approvals and relaxation need the texts in the session")
    texts = _numbered(texts)
    known = written(features(texts, policy))
    named = traces.select(F.col("session_id").cast("string").alias("session_id"), "seq", "tool", "key", "label")
    judged = written(_judged(named.join(known, "key"), policy, modes))
    asked = judged.where("asked is not null").select("scenario_id", "eval_index", "mode", "key", "nth", F.explode("asked").alias("known"))
    hits = written(_scanned(asked.select("key", "nth", "known").distinct(), texts))
    blocked = asked.join(hits, ["key", "nth", "known"]).groupBy("scenario_id", "eval_index", "mode", "key", "nth").agg(F.lit(True).alias("hit"))
    same = lambda n: F.col(f"j.{n}").eqNullSafe(F.col(f"h.{n}"))
    met = judged.alias("j").join(blocked.alias("h"), same("scenario_id") & same("eval_index") & same("mode") & same("key") & same("nth"), "left")
    rows = met.select("j.*", "hit").withColumn("allowed", F.col("allowed") & F.col("hit").isNull())
    return rows.select(*(_outcome() if n == "outcome" else F.lit(None).cast("string").alias(n) if n == "why" else n for n in (c.split()[0] for c in RECORD.split(", "))))


def _outcome() -> Column:
    """``judge`` as an expression."""
    allowed = F.col("allowed")
    return F.when(F.col("expect") == "block", F.when(allowed, "FN").otherwise("TP")).otherwise(F.when(allowed, "TN").otherwise("FP")).alias("outcome")


def _numbered(texts: DataFrame) -> DataFrame:
    """key, nth, json: nth tells the texts of one key apart, in their order."""
    every, keys = texts.agg(F.count("key"), F.count_distinct("key")).first()
    nth = F.lit(0) if every == keys else F.row_number().over(Window.partitionBy("key").orderBy("json"))
    return texts.where(F.col("key").isNotNull()).select("key", nth.cast("int").alias("nth"), "json")


def exposed_users(results: DataFrame, markers: DataFrame) -> DataFrame:
    """session_id of sessions whose results (session_id, text) hold any of the injected markers (marker, text)."""
    return links.containment(results, markers, "session_id", "marker", "plain").select("session_id").distinct()


def with_injections(exposed: DataFrame, injections: list[tuple[str, bool]]) -> DataFrame:
    """Exposed sessions (session_id, s: they read sensitive data) with each injection (goal, does it read such data) that makes a leak of them.

    Injections are a list that people write; they ride along as literals.
    """
    goals = F.array(*(F.struct(F.lit(g).alias("goal"), F.lit(r).alias("reads")) for g, r in injections))
    return exposed.select("session_id", "s", F.explode(goals).alias("i")).where(F.col("s") | F.col("i.reads")).select("session_id", F.col("i.goal").alias("goal"))


def overhead(decide: Callable[[], object], n: int = 1000, warm_up: int = 100) -> dict[str, float]:
    """Microseconds per call: mean, median and 95th percentile of n calls after a warm-up, on one thread."""
    for _ in range(warm_up):
        decide()
    took = []
    for _ in range(n):
        began = time.perf_counter_ns()
        decide()
        took.append((time.perf_counter_ns() - began) / 1000)
    took.sort()
    return {"mean": sum(took) / n, "median": took[n // 2], "p95": took[int(n * 0.95)]}
