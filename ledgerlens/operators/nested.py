"""Nested records as flat tables, by Merkle identities of their subtrees.

Texts are parsed (JSON inside a JSON string too), objects are hashed bottom-up over their
canonical form, in which child objects are replaced by their identities, and equal objects
are stored once. One pass writes a table of parts, partitioned by kind:

  object       id, body, leads: a distinct object, its scalars in canonical JSON
  part         id, child, name, ordinal: an object inside an object, unless it is a rule or entry
               right below the root, whose own bridge says the same
  rule         id, child, name, position, rule_id, rule_version, ordinal: a rule of the snapshot with
               root id. name is the field of its parent that it stands under and position its
               place among its siblings there, ordinal its place among all rules of the snapshot
  entry        the same for an evidence entry of the evidence text with root id; leads is the
               number of contributors below it
  contributor  id, child, event_id, ordinal: an earlier payment listed under entry id, at any depth
  record       evaluation_id, source_partition, source_offset, text_id, id: a delivery with the
               digest of its snapshot text and the root of its evidence (null if absent or unreadable)
  text         text_id, id: a distinct snapshot text and its root

The bridge kinds have one row per occurrence in a distinct parent; an object shared by many
parents is stored once and met through its bridges. ordinal is the position among siblings.

A contributor is an object with an event_id anywhere below a `contributors` field, or a string
that is the field's value, an element of its list or of a list in it, or, if no object there has
an event_id, a value of its mapping. No depth is too deep: a text past Python's usual recursion
limit is read again under a higher one, by functions in Python, whose calls take no C stack.
"""

from __future__ import annotations

import json
import json.scanner
import sys
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import if_small, materialize, spread

SEEN = 100_000  # identities a task remembers to write equal objects once; Flat drops what several tasks wrote
_encode = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode
SCHEMA = "id string, child string, name string, position int, ordinal int, rule_id string, rule_version bigint, event_id string, leads int, body string, evaluation_id string, source_partition int, source_offset bigint, text_id string, kind string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
_FIELDS = {n: _TYPES[t] for n, t in (f.split() for f in SCHEMA.split(", "))}
KINDS = {
    "object": ("id", "body", "leads"),
    "part": ("id", "child", "name", "ordinal"),
    "rule": ("id", "child", "name", "position", "rule_id", "rule_version", "leads", "ordinal"),
    "entry": ("id", "child", "name", "position", "rule_id", "rule_version", "leads", "ordinal"),
    "contributor": ("id", "child", "event_id", "ordinal"),
    "record": ("evaluation_id", "source_partition", "source_offset", "text_id", "id"),
    "text": ("text_id", "id"),
}


_deep = json.JSONDecoder()
_deep.scan_once = json.scanner.py_make_scanner(_deep)  # type: ignore[attr-defined]


def _unlimited(f: Callable, *args: object) -> object:
    """f(*args), without a limit of recursion between functions in Python."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit((1 << 31) - 1)
    try:
        return f(*args)
    finally:
        sys.setrecursionlimit(limit)


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return _unlimited(_deep.decode, text)


def parse(text: str | None) -> object | None:
    """The array or object of a JSON text, unwrapped from JSON strings; None if there is none."""
    try:
        v = _loads(text) if text else None
        while isinstance(v, str):  # each text is shorter than the one around it
            v = _loads(v)
        return v if isinstance(v, dict | list) else None
    except ValueError:
        return None


def _version(v: object) -> int | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    elif isinstance(v, str) and v.isascii() and v.strip().isdecimal():
        v = int(v)
    return v if isinstance(v, int) and -(1 << 63) <= v < 1 << 63 else None


def _events(v: object) -> list[str]:
    """The events that an element below `contributors` names: a string, an object's event_id, or those
    of the objects and lists inside. A `contributors` field inside is left to its own object."""
    out, stack = [], [(v, True)]
    while stack:
        x, strings = stack.pop()
        if type(x) is str:
            if x and strings:
                out.append(x)
        elif type(x) is list:
            stack += [(y, strings) for y in reversed(x)]
        elif type(x) is dict:
            e = x.get("event_id")
            if type(e) is str and e:
                out.append(e)
            else:
                stack += [(y, False) for k, y in reversed(x.items()) if k != "contributors" and (type(y) is dict or type(y) is list)]
    return out


class Tree:
    """Merkle store of one task; out holds the rows of each kind until they are taken."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.out: dict[str, list[tuple]] = {k: [] for k in KINDS}

    def take(self) -> dict[str, list[tuple]]:
        out, self.out = self.out, {k: [] for k in KINDS}
        return out

    def add(self, value: dict | list, kind: str) -> str:
        """Stores a text's value and returns the identity of its root. An object with a version
        (field `version` for kind 'rule', `rule_version` for 'entry') and a rule_id, or the key
        of a mapping in its place, is of that kind."""
        if len(self.seen) > SEEN:
            self.seen.clear()
        root = (value if isinstance(value, dict) else {"": value}, kind, "version" if kind == "rule" else "rule_version", False, True)
        try:
            ident, _, _, typed = self._object(*root)
        except RecursionError:  # what is stored so far are whole objects
            ident, _, _, typed = _unlimited(self._object, *root)  # type: ignore[misc]
        if (kind, ident) not in self.seen:
            self.seen.add((kind, ident))  # type: ignore[arg-type]
            self.out[kind] += [(ident, *t, j) for j, t in enumerate(typed)]
        return ident

    def _object(self, obj: dict, kind: str, field: str, inside: bool, top: bool) -> tuple[str, int, list, list]:
        """(identity, contributors below, those that an enclosing entry has to own, rules or
        entries found below). inside: below an entry."""
        body, parts, up, typed, leads = obj, [], [], [], 0
        for key, value in obj.items():
            t = type(value)
            if t is not dict and t is not list:
                if key == "contributors" and inside and t is str and value:
                    up.append((value, None))
                continue
            if body is obj:
                body = dict(obj)
            lists = inside and key == "contributors"
            named = t is dict and lists and not _events(value)  # contributors keyed by something
            ids = []
            for i, x in enumerate(value if t is list else value.values() if named else (value,)):
                child = None
                if type(x) is dict or type(x) is list:
                    o = x if type(x) is dict else {"": x}
                    rule = o.get("rule_id")
                    if rule is None and t is dict and not lists and "rules" not in o:
                        rule = key
                    is_typed = field in o and type(rule) is str
                    child, n, above, below = self._object(o, kind, field, inside or is_typed, False)
                    leads += n
                    typed += below
                    if is_typed:
                        typed.append((child, key, i, rule, _version(o[field]), n))
                        if above and (child, 0) not in self.seen:
                            self.seen.add((child, 0))  # type: ignore[arg-type]
                            self.out["contributor"] += [(child, c, e, j) for j, (e, c) in enumerate(above)]
                    else:
                        up += above
                    if not (is_typed and top):  # a rule or entry right below the root has its bridge already
                        parts.append((child, key, i))
                    ids.append("#" + child)
                else:
                    ids.append(x)
                if lists:
                    up += [(e, child) for e in _events(x)]
            body[key] = dict(zip(value, ids)) if named else ids if t is list else ids[0]
        text = _encode(body)
        ident = blake2b(text.encode(), digest_size=16).hexdigest()
        leads = max(leads, len(up))
        if ident not in self.seen:
            self.seen.add(ident)
            self.out["object"].append((ident, text, leads))
            if parts:
                self.out["part"] += [(ident, *p) for p in parts]
        return ident, leads, up, typed


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, roots = Tree(), {}
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for evaluation_id, p, o, text_id, text, kind in zip(*cols):
            root = roots.get(text) if text else None
            if root is None and (value := parse(text)) is not None:
                try:
                    root = tree.add(value, kind)
                except ValueError:
                    root = None  # characters that are no text: unreadable; parts stored so far are whole objects
                if len(roots) > 2000:
                    roots.clear()
                roots[text] = root
            if kind == "entry":
                tree.out["record"].append((evaluation_id, p, o, text_id, root))
            elif root is not None:
                tree.out["text"].append((text_id, root))
        for kind, rows in tree.take().items():
            for i in range(0, len(rows), 20_000):
                given = dict(zip(KINDS[kind], zip(*rows[i : i + 20_000])))
                n = len(rows[i : i + 20_000])
                arrays = [pa.array(given[f], t) if f in given else pa.nulls(n, t) for f, t in _FIELDS.items() if f != "kind"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.repeat(kind, n)], names=list(_FIELDS))


class Flat:
    """The flat tables of deliveries with evaluation_id, source_partition, source_offset,
    policy_snapshot and rule_evidence; other columns are ignored. Null, empty and unreadable
    texts have a record but no children. Distinct snapshot texts are few, so they are reduced
    by digest before they are parsed; evidence passes straight through, once per delivery."""

    def __init__(self, deliveries: DataFrame):
        snap = F.col("policy_snapshot")
        digest = F.when(snap != "", F.md5(snap))
        snaps = deliveries.where(snap != "").groupBy(F.md5(snap).alias("text_id")).agg(F.first(snap).alias("text"))
        none = F.lit(None)
        snaps = snaps.select(none.cast("string").alias("evaluation_id"), none.cast("int").alias("p"), none.cast("bigint").alias("o"), "text_id", "text", F.lit("rule").alias("kind"))
        evs = deliveries.select("evaluation_id", F.col("source_partition").cast("int").alias("p"), F.col("source_offset").cast("bigint").alias("o"), digest.alias("text_id"), F.col("rule_evidence").alias("text"), F.lit("entry").alias("kind"))
        self.parts = materialize(spread(evs).unionByName(snaps).mapInArrow(_store, SCHEMA), "nested", ("kind",), compression="zstd")

    def of(self, kind: str, *columns: str) -> DataFrame:
        """The rows of a kind. Bridges and objects that several tasks stored come once."""
        rows = self.parts.where(F.col("kind") == kind).select(*(columns or KINDS[kind]))
        return rows if kind == "record" else rows.distinct()

    def records(self) -> DataFrame:
        """(evaluation_id, source_partition, source_offset, snapshot, evidence): the root identities of each delivery."""
        texts = self.of("text").withColumnRenamed("id", "snapshot")
        return self.of("record").withColumnRenamed("id", "evidence").join(if_small(texts), "text_id", "left").drop("text_id")

    def typed(self, kind: str) -> DataFrame:
        """(evaluation_id, source_partition, source_offset, name, position, rule_id, rule_version): the
        rules ('rule') of each delivery's snapshot or the entries ('entry') of its evidence."""
        root = "snapshot" if kind == "rule" else "evidence"
        bridge = self.of(kind).withColumnRenamed("id", root).select(root, "name", "position", "rule_id", "rule_version", "ordinal")
        at = self.records().where(F.col(root).isNotNull()).select("evaluation_id", "source_partition", "source_offset", root)
        return at.join(if_small(bridge), root).select("evaluation_id", "source_partition", "source_offset", "name", "position", "rule_id", "rule_version")

    def contributors(self) -> DataFrame:
        """(evaluation_id, rule_id, rule_version, event_id): the distinct contributors of evidence
        entries whose rule and version are in the snapshot of the same delivery."""
        rules = if_small(self.of("rule", "id", "rule_id", "rule_version").withColumnsRenamed({"id": "snapshot"}))
        entries = self.parts.where("kind = 'entry' AND leads > 0").select(F.col("id").alias("evidence"), F.col("child").alias("entry"), "rule_id", "rule_version").distinct()
        listed = self.of("contributor", "id", "event_id").withColumnRenamed("id", "entry")
        real = self.records().where((F.col("evaluation_id") != "") & F.col("evidence").isNotNull() & F.col("snapshot").isNotNull())
        held = real.select("evaluation_id", "snapshot", "evidence").join(entries, "evidence").join(rules, ["snapshot", "rule_id", "rule_version"], "left_semi")
        return held.select("evaluation_id", "rule_id", "rule_version", "entry").distinct().join(listed, "entry").select("evaluation_id", "rule_id", "rule_version", "event_id").distinct()
