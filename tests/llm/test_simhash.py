import re

import numpy as np
import xxhash
from cases import ROWS, SF_DIR, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.components import components, local_components
from tidemark.llm.queries import QUERIES
from tidemark.llm.simhash import add_fingerprint, drop_near_duplicates, links, near_duplicates, tile_links

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reach(n, pairs):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute(rows, radius=3):
    prints = [brute_print(text) for _, text in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    roots = reach(len(rows), pairs)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for (d, _), r in zip(rows, roots) if r == roots[i] and d is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cases(spark):
    assert result(near_duplicates(frame(spark, clash=("fingerprint", "fp")))) == brute(ROWS)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert any(doc != component for doc, _, component in want)
    assert result(QUERIES["op9_simhash_near_duplicates"](spark, SF_DIR)) == want


def test_empty(spark):
    assert result(near_duplicates(empty(spark))) == []
    assert drop_near_duplicates(empty(spark)).count() == 0


def test_one_row_of_each_component_stays(spark):
    docs = frame(spark, clash=("row", "fingerprint", "root", "key"))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    # Two components begin with id 1, whose rows have two texts.
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 5, 6]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**8 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 2), st.booleans())
def test_tiles_connect_what_links_connect(values, radius, one):
    prints = np.array(values, np.uint64)
    half = len(values) // 2
    if one:
        edges = tile_links(prints, prints, radius)
        tested = [(a, b) for a in values for b in values if a < b]
    else:
        edges = tile_links(prints[:half], prints[half:], radius)
        tested = [(a, b) for a in values[:half] for b in values[half:]]
    place = {v: i for i, v in enumerate(values)}
    want = [(place[a], place[b]) for a, b in tested if (a ^ b).bit_count() <= radius]
    got = [(place[int(a)], place[int(b)]) for a, b in edges]
    assert reach(len(values), got) == reach(len(values), want)
    assert len(got) < len(values)


def test_many_tiles(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    values = sorted({int(b) ^ (1 << int(k)) for b in base for k in rng.integers(0, 62, 9)})
    found = components(links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, tile=16)).collect()
    place = {v: i for i, v in enumerate(values)}
    want = reach(len(values), [(place[a], place[b]) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    got = list(range(len(values)))
    for a, b in found:
        got[place[a]] = place[b]
    assert got == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(500)] + [(7, 7)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 100 for i in range(500)}}


def test_local_components():
    assert local_components(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def test_fingerprint_of_nulls(spark):
    added, name = add_fingerprint(frame(spark, [(1, None), (2, " "), (3, "A b")], clash=("FINGERPRINT",)))
    assert name == "_fingerprint"
    signed = brute_print("a b") - (2**64 if brute_print("a b") >= 2**63 else 0)
    assert {r["doc_id"]: r[name] for r in added.collect()} == {1: 0, 2: 0, 3: signed}
