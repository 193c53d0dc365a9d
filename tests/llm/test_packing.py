from collections import defaultdict

from cases import ROWS, SF_DIR, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.packing import best_fit, pack
from tidemark.llm.queries import QUERIES


def plain_best_fit(sizes, sources, groups, capacity):
    """Looks at every bin for every piece."""
    bins, placed = [], []
    for size, s, g in zip(sizes, sources, groups):
        fitting = [
            (b["left"], k)
            for k, b in enumerate(bins)
            if b["left"] >= size and (s is None or s not in b["sources"]) and (g is None or g not in b["groups"])
        ]
        if fitting:
            k = min(fitting)[1]
        else:
            bins.append({"left": capacity, "sources": set(), "groups": set()})
            k = len(bins) - 1
        placed.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= size
        bins[k]["sources"].add(s)
        bins[k]["groups"].add(g)
    return placed


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(1, 20), st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 9))),
        max_size=60,
    ),
    st.booleans(),
)
def test_best_fit(pieces, ordered):
    pieces = sorted(pieces, key=lambda p: -p[0]) if ordered else pieces
    sizes, sources, groups = ([p[i] for p in pieces] for i in range(3))
    assert list(zip(*best_fit(sizes, sources, groups, 20))) == plain_best_fit(sizes, sources, groups, 20)


def checked(rows, sizes, capacity, sources, groups):
    """Every token of every document once, no bin too full, no conflict, no overlap."""
    bins, tokens = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
        tokens[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
    for doc, size in sizes.items():
        at = 0
        for first, n in sorted(tokens[doc]):
            assert first == at
            at += n
        assert at == size
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert at <= capacity
        for held in (sources, groups):
            seen = [held[r["doc_id"]] for r in own if held[r["doc_id"]] is not None]
            assert len(seen) == len(set(seen))
    return len(bins)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = QUERIES["op10_best_fit_packing"](spark, SF_DIR).collect()
    sizes = {d["doc_id"]: len((d["text"] or "").encode().split()) + 1 for d in docs}
    sources = {d["doc_id"]: d["source"] for d in docs}
    groups = {d["doc_id"]: d["text"].strip(" ").lower() for d in docs}
    used = checked(rows, sizes, 2048, sources, groups)
    assert used <= 1.3 * max(sum(sizes.values()) / 2048, max(list(sources.values()).count(s) for s in set(sources.values())))


def test_cases(spark):
    docs = frame(spark, clash=("piece", "shard", "row", "size", "own_group", "bin_id"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") > 3, F.col("doc_id").cast("string")))
    rows = pack(docs, capacity=100).collect()
    want = sorted(len((t or "").encode().split()) + 1 for _, t in ROWS)
    got = defaultdict(int)
    for r in rows:
        got[(r["doc_id"], r["bin_id"] if r["n_tokens"] < 100 else None)] += r["n_tokens"]
    assert sum(r["n_tokens"] for r in rows) == sum(want)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["piece"] == 0) == sorted((d is None, d) for d, _ in ROWS)
    # Repeated rows are one group of copies: never in one bin.
    first = [r["bin_id"] for r in rows if r["doc_id"] == 1 and r["n_tokens"] == 18]
    assert len(first) == len(set(first)) == 2


def test_many_shards(spark):
    rows = [(i, "w " * (i % 90)) for i in range(700)]
    docs = frame(spark, rows).withColumn("source", F.concat(F.lit("s"), F.pmod("doc_id", F.lit(3))))
    out = pack(docs, group=F.col("doc_id") % 11, capacity=64, shard_pieces=50).collect()
    sizes = {d: len(t.split()) + 1 for d, t in rows}
    checked(out, sizes, 64, {d: d % 3 for d, _ in rows}, {d: d % 11 for d, _ in rows})
    assert len({r["bin_id"] >> 32 for r in out}) > 5


def test_empty(spark):
    assert pack(empty(spark).withColumn("source", F.lit("a"))).count() == 0
