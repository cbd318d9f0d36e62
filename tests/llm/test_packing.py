import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm.packing import CAPACITY, containers, first_fit, pack, split_documents
from ledgerlens.llm.tokens import counter


def plain_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                break
        else:
            i = len(room)
            room.append(capacity)
        room[i] -= s
        out.append(i)
    return out


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_tree_finds_the_first_container(sizes):
    assert first_fit(np.array(sizes, np.int64), 50).tolist() == plain_first_fit(sizes, 50)


def test_documents_are_whole_and_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed = pack(docs, group_rows=300)
    rows = packed.collect()
    sizes = {r.doc_id: counter()(r.text) if r.text else 0 for r in docs.collect()}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(sizes)
    for d, pieces in got.items():
        assert sum(p["size"] for p in pieces) == sizes[d]
        assert sorted(p.piece for p in pieces) == list(range(max(1, -(-sizes[d] // CAPACITY)))) and {p.pieces for p in pieces} == {len(pieces)}
    c = containers(packed).collect()
    assert min(r.free for r in c) >= 0
    assert len(c) <= 1.08 * -(-sum(sizes.values()) // CAPACITY) + 4
    assert {r.doc_id for r in split_documents(packed).collect()} == {d for d, s in sizes.items() if s > CAPACITY}


def test_nulls_empty_long_and_repeated(spark):
    word = " a"  # one token each
    rows = [(1, None, "c"), (2, "", "c"), (3, "a" + word * (CAPACITY - 1), "c"), (4, "a" + word * CAPACITY, "c"), (5, "a" + word * (3 * CAPACITY - 1), "c"), (6, "a", None), (6, "a", None), (None, "a", None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, container string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r["size"])
    assert by[1] == [0] and by[2] == [0] and by[3] == [CAPACITY] and sorted(by[4]) == [1, CAPACITY] and by[5] == [CAPACITY] * 3 and by[6] == [1, 1] and by[None] == [1]
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_does_not_depend_on_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = {tuple(r) for r in pack(docs, group_rows=20).collect()}
    b = {tuple(r) for r in pack(docs.repartition(5), group_rows=20).collect()}
    assert a == b and len(a) >= 100
    twice = pack(docs.unionByName(docs.limit(3)), group_rows=20)
    assert twice.count() == len(a) + 3
