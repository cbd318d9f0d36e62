"""The nested operator against a brute-force version and on small dirty inputs."""

import json

from ledgerlens.operators.nested import Flat, Tree, parse
from ledgerlens.sources.tables import table

SCHEMA = "evaluation_id string, source_partition int, source_offset bigint, policy_snapshot string, rule_evidence string, id string"


def events_below(v):
    """Every event_id or event string anywhere below a `contributors` field."""
    if isinstance(v, str):
        return [v]
    if isinstance(v, list):
        return [e for x in v for e in events_below(x)]
    if isinstance(v, dict):
        return [v["event_id"]] if isinstance(v.get("event_id"), str) else [e for x in v.values() if isinstance(x, dict) for e in events_below(x)]
    return []


def typed_below(v, field, key=None):
    if isinstance(v, dict):
        rule = v.get("rule_id", key)
        if field in v and isinstance(rule, str):
            yield rule, v
        else:
            for k, x in v.items():
                yield from typed_below(x, field, k)
    elif isinstance(v, list):
        for x in v:
            yield from typed_below(x, field)


def contributors_of(entry):
    if isinstance(entry, dict):
        for k, x in entry.items():
            yield from events_below(x) if k == "contributors" else contributors_of(x)


def brute(rows):
    out = set()
    for evaluation_id, snapshot, evidence in rows:
        s, e = parse(snapshot), parse(evidence)
        if not evaluation_id or s is None or e is None:
            continue
        known = {(r, x["version"]) for r, x in typed_below(s, "version")}
        for rule, x in typed_below(e, "rule_version"):
            if (rule, x["rule_version"]) in known:
                out |= {(evaluation_id, rule, x["rule_version"], c) for c in contributors_of(x)}
    return out


def test_whole_table_against_brute_force(spark):
    df = table(spark, "/root/testdata/sf0.01", "evaluations")
    want = brute([tuple(r) for r in df.select("evaluation_id", "policy_snapshot", "rule_evidence").collect()])
    got = [tuple(r) for r in Flat(df).contributors().collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_shapes_nulls_ties_and_clashing_names(spark):
    snap = json.dumps({"rules": {"R1": {"version": 2}, "R2": {"version": 1}}})
    ev = [
        {"rule_id": "R1", "rule_version": 2, "contributors": ["a", {"event_id": "b"}, None, {"payment": {"event_id": "c"}}], "lookback": {"contributors": {"event_id": "d"}}},
        {"rule_id": "R2", "rule_version": 9, "contributors": ["no"]},
        {"rule_id": "R1", "contributors": ["no version"]},
    ]
    deep = "[" * 100_000 + "]" * 100_000
    rows = [
        ("e1", 0, 1, snap, json.dumps(json.dumps(ev)), "x"),
        ("e1", 0, 1, snap, json.dumps(ev), "x"),  # a repeated row
        ("e2", 0, 2, snap, '{"R1": {"rule_version": 2, "contributors": {"q": {"event_id": "k"}}}, "n": "' + "é" * 300_000 + '"}', None),
        (None, 0, 3, snap, json.dumps(ev), "x"), ("", 0, 4, snap, json.dumps(ev), "x"),
        ("e3", None, None, None, json.dumps(ev), "x"), ("e4", 1, 1, snap, None, "x"), ("e5", 1, 2, snap, "", "x"),
        ("e6", 1, 3, snap, json.dumps(ev)[:-5], "x"), ("e7", 1, 4, snap, deep, "x"), ("e8", 1, 5, deep, json.dumps(ev), "x"),
        ("e9", 1, 6, snap, '[{"rule_id":"R1","rule_version":2,"contributors":["\\ud800"]}]', "x"), ("e10", 1, 7, snap, "3", "x"),
    ]
    flat = Flat(spark.createDataFrame(rows, SCHEMA))
    got = {tuple(r) for r in flat.contributors().collect()}
    assert got == {("e1", "R1", 2, c) for c in "abcd"} | {("e2", "R1", 2, "k")}
    assert flat.records().count() == len(rows)
    objects = [r.id for r in flat.of("object").collect()]
    assert len(objects) == len(set(objects))
    assert Flat(spark.createDataFrame([], SCHEMA)).contributors().count() == 0


def test_equal_objects_have_one_identity_whatever_their_field_order():
    t = Tree()
    a = t.add({"b": [{"x": 1, "y": None}], "a": 1}, "entry")
    assert a == t.add(json.loads('{"a":1,"b":[{"y":null,"x":1}]}'), "entry")
    assert a != t.add({"b": [{"x": 1}], "a": 1}, "entry")
    assert len(t.out["object"]) == 4 and len([p for p in t.out["part"] if p[0] == a]) == 1


def test_contributors_in_every_shape_and_at_any_depth(spark):
    e = lambda *ids: [{"event_id": i} for i in ids]
    far = {"event_id": "far"}
    for _ in range(12):
        far = {"in": far}
    wrapped = json.dumps([{"rule_id": "R1", "rule_version": 2, "contributors": ["text"]}])
    for _ in range(11):  # every further one doubles the escapes
        wrapped = json.dumps(wrapped)
    deep = lambda n: '{"a":[' * n + '{"rule_id":"R1","rule_version":2,"contributors":' + "[" * n + '"deep"' + "]" * n + "}" + "]}" * n
    shapes = {
        "object": {"items": e("a", "b"), "n": 3}, "lists": [e("a"), [["b"], e("c")], []], "keyed": {"x": {"event_id": "a"}, "y": {"event_id": "b"}, "z": "no"},
        "strings": {"x": "a", "y": ["b", ["c"]]}, "inner": [{"payment": {"event_id": "a"}, "others": e("b"), "why": ["no"]}], "far": [far], "empty": [{}, [], None, ""],
        "again": [{"event_id": "a", "contributors": [e("b")]}],
    }
    want = {"object": "ab", "lists": "abc", "keyed": "ab", "strings": "abc", "inner": "ab", "far": ["far"], "empty": "", "again": "ab", "wrapped": ["text"], "d300": ["deep"], "d30000": ["deep"]}
    texts = {k: json.dumps([{"rule_id": "R1", "rule_version": 2, "contributors": c}]) for k, c in shapes.items()}
    texts |= {"wrapped": wrapped, "d300": deep(300), "d30000": deep(30_000)}
    snap = '{"rules":{"R1":{"version":2}}}'
    rows = [(k, 0, i, snap, t, None) for i, (k, t) in enumerate(texts.items())]
    got = [(r.evaluation_id, r.event_id) for r in Flat(spark.createDataFrame(rows, SCHEMA)).contributors().collect()]
    assert sorted(got) == sorted((k, e) for k, es in want.items() for e in es)
