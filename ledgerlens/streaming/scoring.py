"""Scoring as a stream: late routing, buffering until the watermark, per-customer state on RocksDB.

Two queries, as their clocks differ: the first validates and drops redeliveries by a
time-to-live in processing time; the second buffers valid payments per customer until the
watermark passes their event time and scores them in (event_time, event_id) order. The batch
operators give the same observations; tests hold them against each other.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ledgerlens.functions import identity
from ledgerlens.functions.identity import canonical
from ledgerlens.functions.policy import DEVICE_S, HISTORY_S, TYPES, Policy, Rule
from ledgerlens.operators.identity_conflicts import IdentityConflict

OUT_OF_ORDER_MS = 10_000
DEDUP_TTL_MS = 86_400_000
MAX_PENDING, MAX_HISTORY, MAX_DEVICES = 100_000, 100_000, 10_000
MAX_TOTALS, MAX_POLICIES = 32, 32
CHUNK = 1_000
HOUR_MS = 3_600_000
_PAYMENT = "event_id string, transaction_id string, customer_id string, merchant_id string, amount_minor bigint, currency string, country string, device_id string, status string, event_time bigint, producer_time bigint"
_FIELDS = [f.split()[0] for f in _PAYMENT.split(", ")]
SCORED = _PAYMENT + ", kind string, watermark bigint, lateness_ms bigint, risk_score int, decision string, matched_rules array<string>, observed array<bigint>, reason_codes array<string>, rules_fingerprint string, processed_at bigint, policy_snapshot string, policy_id string, policy_version bigint"
SCORED += ", rule_evidence array<struct<rule_id:string,rule_version:bigint,type:string,enabled:boolean,window_seconds:bigint,threshold:bigint,observed:bigint,eligible:boolean,matched:boolean,score_contribution:int>>"
_NOTHING = dict.fromkeys(f.split()[0] for f in SCORED.split(", "))
_T = _FIELDS.index("event_time")
_NO_WINDOW = [0] * 5
_ENTRY = Row("rule_id", "rule_version", "type", "enabled", "window_seconds", "threshold", "observed", "eligible", "matched", "score_contribution")


def observe(rule: Rule, tx: dict[str, Any], history: Sequence[dict[str, Any]], last_seen: int | None) -> tuple[int, bool]:
    """(observed, eligible) of one payment; history holds earlier payments only."""
    start = tx["event_time"] - rule.window_seconds * 1000
    near = [h for h in history if h["event_time"] > start]
    if rule.type == "TX_COUNT_VELOCITY":
        return 1 + len(near), True
    if rule.type == "AMOUNT_VELOCITY":
        return tx["amount_minor"] + sum(h["amount_minor"] for h in near if h["currency"] == rule.currency), tx["currency"] == rule.currency
    if rule.type == "UNIQUE_DEVICES":
        return len({h["device_id"] for h in near} | {tx["device_id"]}), True
    if rule.type == "NEW_DEVICE_HIGH_AMOUNT":
        return tx["amount_minor"], last_seen is None or last_seen <= start
    return sum(h["status"] == "DECLINED" for h in near), tx["status"] == "APPROVED"


def judged(policy: Policy, seen: Callable[[Rule], tuple[int, bool]]) -> list[tuple]:
    """One entry per rule in the order of schemas.EVIDENCE, as operators.score makes them; seen gives
    what a rule observes and whether it applies."""
    out = []
    for r in policy.rules:
        o, eligible = seen(r)
        matched = r.enabled and eligible and (o > r.threshold if TYPES[r.type] == ">" else o >= r.threshold)
        out.append((r.rule_id, r.version, r.type, r.enabled, r.window_seconds, r.threshold, o, eligible, matched, r.score if matched else 0))
    return out


def _decided(policy: Policy, entries: Sequence[tuple]) -> dict[str, Any]:
    score = min(100, sum(e[9] for e in entries))
    return {"risk_score": score, "decision": "REJECT" if score >= policy.reject else "REVIEW" if score >= policy.review else "APPROVE", "matched_rules": [e[0] for e in entries if e[8]], "observed": [e[6] for e in entries], "reason_codes": [e[2] for e in entries if e[8]]}


def evidence(policy: Policy, tx: dict[str, Any], history: Sequence[dict[str, Any]], last_seen: int | None) -> list[Row]:
    return [_ENTRY(*e) for e in judged(policy, lambda r: observe(r, tx, history, last_seen))]


def decide(policy: Policy, tx: dict[str, Any], history: Sequence[dict[str, Any]], last_seen: int | None) -> dict[str, Any]:
    d = _decided(policy, evidence(policy, tx, history, last_seen))
    del d["reason_codes"]
    return d


def policy_text(policy: Policy) -> str:
    """A policy as the text that waits with a payment; Policy.read makes it a policy again."""
    return canonical({"policy_id": policy.policy_id, "version": policy.version, "review_threshold": policy.review, "reject_threshold": policy.reject, "rules": [asdict(r) for r in policy.rules]})


def _key(rule: Rule) -> str:
    """What of a rule its running totals depend on: rules of one kind, window and currency share them."""
    return f"{rule.type}|{rule.window_seconds}|{rule.currency if rule.type == 'AMOUNT_VELOCITY' else ''}"


@lru_cache(4096)
def _parts(name: str) -> tuple[str, int, str]:
    """Kind, length in ms and currency of a key of totals."""
    kind, seconds, currency = name.split("|")
    return kind, int(seconds) * 1000, currency


class _Kept:
    """A map of a customer's state during one call: an entry is read when it is first asked for, and
    what has changed is written at the end. void: nothing is stored there."""

    def __init__(self, state: Any, void: bool = False):
        self.state, self.void = state, void
        self.was: dict[tuple, tuple | None] = {}
        self.now: dict[tuple, tuple | None] = {}

    def get(self, k: tuple) -> tuple | None:
        if k not in self.now:
            self.was[k] = self.now[k] = None if self.void or not self.state.containsKey(k) else tuple(self.state.getValue(k))
        return self.now[k]

    def put(self, k: tuple, v: tuple | None, new: bool = False) -> None:
        """None takes the entry away. new: nothing is stored under k."""
        if k not in self.now:
            self.was[k] = None if new else self.get(k)
        self.now[k] = v

    def keys(self) -> list[tuple]:
        stored = [] if self.void else [tuple(k) for k in self.state.keys()]
        return [k for k in stored if k not in self.now] + [k for k, v in self.now.items() if v is not None]

    def write(self) -> None:
        for k, v in self.now.items():
            if v != self.was[k]:
                self.state.removeKey(k) if v is None else self.state.updateValue(k, v)


class Customer(StatefulProcessor):
    """State of a customer: payments waiting for the watermark, earlier payments within the longest
    window, when each device was last seen, and the last time that was finalised. A payment at or
    before the watermark or that time is LATE and changes nothing.

    A payment waits with the policy in force when it was admitted (its column `policy`, else the
    policy of the query) and is scored by it, though another may have come since.

    A call to the state costs far more than a payment in memory. What a micro-batch admits waits as
    lists (JSON) of up to CHUNK payments; there is one timer, at the earliest time that waits, and
    when it is due all payments up to the watermark are finalised, in memory; what is left of them
    is written once.

    Payments are finalised in the order of (time, event_id), so that the earlier ones are a log with
    ascending numbers. Every kind of window has running totals and the number of the oldest payment
    inside: a new payment is added at the end, what has left the window is taken off at the front,
    each once. Totals of a window that a policy brings anew are built from the log. Devices last seen
    within an hour are listed under it, and an hour's list is looked through once, when it expires. A
    customer without payments and devices in any window leaves no state behind."""

    def __init__(self, policy: Policy, fields: Sequence[str] = tuple(_NOTHING)):
        self.text, self.fields, self.made = policy_text(policy), tuple(fields), Row(*fields)
        self.reasoned = "rule_evidence" in self.fields
        self.policies: dict[str, tuple[Policy, dict[str, Any], dict[str, str], set[str]]] = {}
        self.reach, self.device_reach = HISTORY_S * 1000, DEVICE_S * 1000

    def _policy(self, text: str) -> tuple[Policy, dict[str, Any], dict[str, str], set[str]]:
        if text not in self.policies:
            if len(self.policies) >= MAX_POLICIES:
                self.policies.clear()
            p = Policy.read(text)
            keys = {r.rule_id: _key(r) for r in p.rules}
            used = {keys[r.rule_id] for r in p.rules if r.type != "NEW_DEVICE_HIGH_AMOUNT"}
            self.policies[text] = p, {"rules_fingerprint": p.fingerprint(), "policy_snapshot": p.snapshot(), "policy_id": p.policy_id, "policy_version": p.version}, keys, used
        return self.policies[text]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # [policies, payments]: a payment has the values of _FIELDS and the place of its policy
        self.stored = {
            "waiting": handle.getMapState("waiting", "i bigint", "payments string"),
            "log": handle.getMapState("log", "i bigint", "t bigint, amount_minor bigint, currency string, device_id string, declined boolean"),
            "totals": handle.getMapState("totals", "rule string", "head bigint, n bigint, amount bigint, declined bigint, devices bigint"),
            "inside": handle.getMapState("inside", "rule string, device_id string", "n bigint"),
            "devices": handle.getMapState("devices", "device_id string", "t bigint"),
            "hours": handle.getMapState("hours", "hour bigint", "devices array<string>"),
        }
        # pending, first and next number of the log, devices known, last time finalised, time of the next sweep, next number of a list, earliest time that waits
        self.at = handle.getValueState("at", "pending bigint, first bigint, next bigint, devices bigint, finalised bigint, sweep bigint, list bigint, due bigint")

    def _at(self) -> dict[str, int]:
        names = ("pending", "first", "next", "devices", "finalised", "sweep", "list", "due")
        return dict(zip(names, self.at.get() if self.at.exists() else (0, 0, 0, 0, -1, -1, 0, -1)))

    def _out(self, tx: dict[str, Any], **more: Any) -> Row:
        all_of = {**_NOTHING, **tx, **more}
        return self.made(*[all_of[f] for f in self.fields])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = self._at()
        frontier = max(timerValues.getCurrentWatermarkInMs(), s["finalised"])
        before, known, policies, admitted = s["pending"], s["due"], {}, []
        for r in rows:
            tx = r.asDict()
            text = tx.pop("policy") or self.text
            t = tx["event_time"]
            if t <= frontier:
                yield self._out(tx, kind="LATE", watermark=frontier, lateness_ms=frontier - t)
                continue
            s["pending"] += 1
            if s["pending"] > MAX_PENDING:
                raise RuntimeError(f"more than {MAX_PENDING} payments of a customer wait")
            if s["due"] < 0 or t < s["due"]:
                s["due"] = t
            admitted.append([*[tx[f] for f in _FIELDS], policies.setdefault(text, len(policies))])
            if len(admitted) == CHUNK:
                self._wait(policies, admitted, s)
                policies, admitted = {}, []
        if s["pending"] > before:
            if admitted:
                self._wait(policies, admitted, s)
            if s["due"] != known:
                self.handle.registerTimer(s["due"])
            self.at.update(tuple(s.values()))

    def _wait(self, policies: dict[str, int], payments: list[list[Any]], s: dict[str, int]) -> None:
        self.stored["waiting"].updateValue((s["list"],), (json.dumps([list(policies), payments]),))
        s["list"] += 1

    def _due(self, until: int, s: dict[str, int]) -> list[tuple[dict[str, Any], str]]:
        """Takes the payments up to that time from those that wait, each with its policy, in order."""
        out, rest, waiting = [], [], self.stored["waiting"]
        for k, (text,) in list(waiting.iterator()):
            policies, payments = json.loads(text)
            later = []
            for p in payments:
                if p[_T] <= until:
                    out.append((dict(zip(_FIELDS, p)), policies[p[-1]]))
                else:
                    later.append(p)
            if not later:
                waiting.removeKey(tuple(k))
            elif len(later) < len(payments):
                waiting.updateValue(tuple(k), (json.dumps([policies, later]),))
            rest += [p[_T] for p in later]
        s["pending"], s["due"] = len(rest), min(rest, default=-1)
        return sorted(out, key=lambda x: (x[0]["event_time"], x[0]["event_id"]))

    def _move(self, name: str, item: tuple, by: int, sums: list[int]) -> None:
        """Adds (by 1) or takes off (by -1) a payment of the log; sums: n, amount, declined, devices."""
        kind, _, currency = _parts(name)
        if kind == "UNIQUE_DEVICES":
            k = (name, item[3])
            n = (self.inside.get(k) or (0,))[0] + by
            self.inside.put(k, (n,) if n else None)
            sums[3] += (n == 1) if by > 0 else -(n == 0)
            return
        sums[0] += by
        sums[2] += by * bool(item[4])
        if item[2] == currency:
            sums[1] += by * item[1]

    def _window(self, name: str, t: int, s: dict[str, int]) -> list[int]:
        """[head, n, amount, declined, devices] of the window that ends at t, before the payment there."""
        edge = t - _parts(name)[1]
        if found := self.totals.get((name,)):
            head, *sums = found
        else:  # new with this policy
            head, sums = s["next"], [0, 0, 0, 0]
            while head > s["first"] and (item := self.log.get((head - 1,)))[0] > edge:
                self._move(name, item, 1, sums)
                head -= 1
        while head < s["next"] and (item := self.log.get((head,)))[0] <= edge:
            self._move(name, item, -1, sums)
            head += 1
        return [head, *sums]

    def _drop(self, names: set[str]) -> None:
        for name in names:
            self.totals.put((name,), None)
        for k in self.inside.keys():
            if k[0] in names:
                self.inside.put(k, None)

    def _observe(self, rule: Rule, tx: dict[str, Any], window: list[int], last_seen: int | None) -> tuple[int, bool]:
        _, n, amount, declined, devices = window
        if rule.type == "TX_COUNT_VELOCITY":
            return 1 + n, True
        if rule.type == "AMOUNT_VELOCITY":
            return tx["amount_minor"] + amount, tx["currency"] == rule.currency
        if rule.type == "UNIQUE_DEVICES":
            return devices + (not self.inside.get((_key(rule), tx["device_id"]))), True
        if rule.type == "NEW_DEVICE_HIGH_AMOUNT":
            return tx["amount_minor"], last_seen is None or last_seen <= tx["event_time"] - rule.window_seconds * 1000
        return declined, tx["status"] == "APPROVED"

    def _score(self, tx: dict[str, Any], text: str, s: dict[str, int], watermark: int) -> Row:
        policy, named, keys, used = self._policy(text)
        t, d = tx["event_time"], tx["device_id"]
        kept = {k[0] for k in self.totals.keys()}
        if len(kept | used) > MAX_TOTALS:  # those of policies of long ago
            self._drop(kept - used)
            kept &= used
        windows = {name: self._window(name, t, s) for name in used}
        seen = (self.devices.get((d,)) or (None,))[0]
        entries = judged(policy, lambda r: self._observe(r, tx, windows.get(keys[r.rule_id], _NO_WINDOW), seen))
        item = (t, tx["amount_minor"], tx["currency"], d, tx["status"] == "DECLINED")
        self.log.put((s["next"],), item, new=True)
        s["next"] += 1
        # other windows see the payment when they are used again: their front has not been reached yet
        for name in kept | used:
            w = windows.get(name) or list(self.totals.get((name,)))
            sums = w[1:]
            self._move(name, item, 1, sums)
            self.totals.put((name,), (w[0], *sums))
        hour = t // HOUR_MS
        if seen is None or seen // HOUR_MS != hour:
            if not self.listed or self.listed[-1] != hour:
                self.listed.append(hour)
            self.hours.put((hour,), ([*(self.hours.get((hour,)) or ([],))[0], d],))
        self.devices.put((d,), (t,))
        s["devices"] += seen is None
        if s["devices"] > MAX_DEVICES:
            raise RuntimeError(f"more than {MAX_DEVICES} devices of a customer")
        if s["next"] - s["first"] > MAX_HISTORY:
            raise RuntimeError(f"more than {MAX_HISTORY} payments of a customer are in its windows")
        return self._out(tx, kind="DECISION", watermark=watermark, **_decided(policy, entries), processed_at=int(time.time() * 1000), rule_evidence=[_ENTRY(*e) for e in entries] if self.reasoned else None, **named)

    def _forget(self, t: int, s: dict[str, int]) -> None:
        """Removes what no window after t reaches: payments at the front of the log, and devices of the hours that expire."""
        first = s["first"]
        while first < s["next"] and self.log.get((first,))[0] <= t - self.reach:
            first += 1
        if first > s["first"]:
            for (name,) in self.totals.keys():
                head, *sums = self.totals.get((name,))
                while head < first:
                    self._move(name, self.log.get((head,)), -1, sums)
                    head += 1
                self.totals.put((name,), (head, *sums))
            for i in range(s["first"], first):
                self.log.put((i,), None)
            s["first"] = first
        while self.listed and self.listed[0] <= (t - self.device_reach) // HOUR_MS - 1:
            hour = self.listed.popleft()
            for d in self.hours.get((hour,))[0]:
                if (last := self.devices.get((d,))) and last[0] // HOUR_MS <= hour:
                    self.devices.put((d,), None)
                    s["devices"] -= 1
            self.hours.put((hour,), None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        s, watermark = self._at(), timerValues.getCurrentWatermarkInMs()
        until = max(watermark, expiredTimerInfo.getExpiryTimeInMs())
        if s["finalised"] >= until or not (s["pending"] or s["devices"] or s["next"] > s["first"]):
            return  # an earlier timer of this micro-batch did it all
        due = self._due(until, s) if 0 <= s["due"] <= until else []
        no_log, no_devices = s["first"] == s["next"], not s["devices"]
        self.log, self.inside = (_Kept(self.stored[n], no_log) for n in ("log", "inside"))
        self.devices, self.hours = (_Kept(self.stored[n], no_devices) for n in ("devices", "hours"))
        self.totals = _Kept(self.stored["totals"], True)  # all that are stored
        if not no_log:
            self.totals.was = {tuple(k): tuple(v) for k, v in self.stored["totals"].iterator()}
            self.totals.now = dict(self.totals.was)
        self.listed = deque(sorted(h for (h,) in self.hours.keys()))
        timed = set(self.listed)
        for tx, text in due:
            self._forget(tx["event_time"], s)
            yield self._score(tx, text, s, watermark)
        self._forget(until, s)
        s["finalised"] = until
        if s["next"] == s["first"]:
            self._drop({k[0] for k in self.totals.keys()})
        elif s["sweep"] <= until:
            s["sweep"] = until + self.reach + 1
            self.handle.registerTimer(s["sweep"])
        for hour in self.listed:
            if hour not in timed:
                self.handle.registerTimer((hour + 1) * HOUR_MS + self.device_reach)
        if due and s["pending"]:
            self.handle.registerTimer(s["due"])
        for kept in (self.log, self.totals, self.inside, self.devices, self.hours):
            kept.write()
        if s["next"] == s["first"] and not s["pending"] and not s["devices"]:
            self.at.clear()  # the watermark has passed what was finalised
        else:
            self.at.update(tuple(s.values()))

    def close(self) -> None:
        pass


def score_stream(payments: DataFrame, policy: Policy, out_of_order_ms: int = OUT_OF_ORDER_MS, fields: Sequence[str] | None = None) -> DataFrame:
    """Tagged rows (kind DECISION, with all fields of schemas.DECISION, or LATE) of a stream of valid payments. The delay is one
    millisecond more than the allowed disorder: a time is final once the highest time exceeds it
    by more than that. Payments behind the last watermark stay buffered; nothing is flushed. Payments with
    a column `policy` (policy_text) are scored by it, others by the policy given. fields: the columns of
    SCORED that are wanted; the rest, and the identities, are not handed over from Python then."""
    stamped = F.col("policy") if "policy" in payments.columns else F.lit(None).cast("string").alias("policy")
    timed = payments.select(*_FIELDS, stamped).withColumn("ts", F.timestamp_millis("event_time")).withWatermark("ts", f"{out_of_order_ms + 1} milliseconds")
    timed = timed.select(*_FIELDS, "policy")  # without the watermark's column, so that Spark hands late rows over instead of dropping them
    kinds = StructType.fromDDL(SCORED)
    wanted = tuple(fields or kinds.names)
    scored = timed.groupBy("customer_id").transformWithState(statefulProcessor=Customer(policy, wanted), outputStructType=StructType([kinds[f] for f in wanted]), outputMode="Append", timeMode="EventTime")
    if fields:
        return scored
    engine = F.lit(identity.ENGINE)
    named = {
        "decision_id": identity.decision_id(F.col("transaction_id")), "engine_version": engine, "input_sha256": identity.input_hash(),
        "evaluation_id": identity.evaluation_id(F.col("event_id"), engine, F.col("policy_id"), F.col("policy_version")),
    }
    return scored.select("*", *[F.when(F.col("kind") == "DECISION", v).alias(k) for k, v in named.items()])


class Once(StatefulProcessor):
    """Passes a payment on once per identity and time-to-live (not refreshed); another content
    under the same identity is a conflict: an error, or a row of kind CONFLICT. Rows of another kind
    than FIRST pass as they are."""

    def __init__(self, ttl_ms: int, strict: bool, names: Sequence[str]):
        self.ttl_ms, self.strict, self.names = ttl_ms, strict, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "print string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.seen.get()[0] if self.seen.exists() else None
        for r in rows:
            out = {n: r[n] for n in self.names}
            if r["kind"] != "FIRST":
                yield Row(**out)
            elif known is None:
                known = r["print"]
                self.seen.update((known,))
                yield Row(**out)
            elif known != r["print"]:
                if self.strict:
                    raise IdentityConflict(f"another payment under {key}")
                yield Row(**{**out, "kind": "CONFLICT"})

    def close(self) -> None:
        pass


def _print() -> Column:
    facts = [f for f in _FIELDS if f != "producer_time"]
    return F.sha2(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}), 256)


def once_stream(payments: DataFrame, key: str = "event_id", ttl_ms: int = DEDUP_TTL_MS, strict: bool = False) -> DataFrame:
    """Rows of kind FIRST or CONFLICT of a stream of valid payments."""
    kept = payments.select(*_FIELDS).withColumns({"kind": F.lit("FIRST"), "print": _print()})
    names = [*_FIELDS, "kind"]
    return kept.groupBy(key).transformWithState(statefulProcessor=Once(ttl_ms, strict, names), outputStructType=_PAYMENT + ", kind string", outputMode="Append", timeMode="ProcessingTime")


def first_only(tagged: DataFrame, keys: Sequence[str], ttl_ms: int = DEDUP_TTL_MS, strict: bool = False) -> DataFrame:
    """A stream of payments with error_code, once per value of each key in turn. kind is FIRST, CONFLICT
    or INVALID; invalid rows are not held against anything and keep their payload."""
    kind = F.when(F.col("error_code").isNull(), "FIRST").otherwise("INVALID")
    df = tagged.withColumns({"kind": kind, "print": _print()})
    schema, names = df.schema, df.columns
    place = F.concat_ws(":", "source_topic", "source_partition", "source_offset")
    for k in keys:
        own = F.when(F.col("kind") == "FIRST", F.concat(F.lit("="), F.col(k))).otherwise(F.concat(F.lit("@"), place))
        grouped = df.withColumn("_id", own).groupBy("_id")
        df = grouped.transformWithState(statefulProcessor=Once(ttl_ms, strict, names), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
    return df.drop("print")
