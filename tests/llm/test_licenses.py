import re
from collections import Counter

import duckdb
import numpy as np
from cases import ROWS, SF_DIR, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.licenses import TEMPLATES, Templates, add_licenses, oracle, scan_licenses
from tidemark.llm.queries import QUERIES
from tidemark.llm.words import hash_text_words

LOWER = {i: i + 32 for i in range(65, 91)}


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return Counter(zip(w, w[1:]))


def dice(a, b):
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if a and b else 0.0


def brute(rows, templates=TEMPLATES, threshold=0.9):
    own = {n: grams(t) for n, t in templates.items()}
    out = []
    for doc, text in rows:
        best = {}
        for unit in (*(text or "").split("\n"), text or ""):
            unit = grams(unit)
            for n, g in own.items():
                if (v := dice(unit, g)) >= threshold:
                    best[n] = max(best.get(n, 0), v)
        name = min(best, key=lambda n: (-best[n], n)) if best else None
        out.append((doc, name, round(best[name], 6) if name else None, len(best), ",".join(sorted(best))))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


NOTICES = [
    (1, "prose before\n  LICENSED under the apache licence, version 2.0!\nprose after"),
    (2, "x\nReleased under the MIT License\n\nAll rights reserved.\n"),
    (3, TEMPLATES["MIT-permission"].replace(", ", ",\n")),
    (4, TEMPLATES["Apache-2.0-notice"] + " and some more words"),
    (5, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
    (6, "reserved rights all"),
    (7, "\n\n"),
    (8, None),
]


def test_cases(spark):
    rows = ROWS + NOTICES
    assert result(scan_licenses(frame(spark, rows, clash=("license_id", "DICE", "licenses")))) == brute(rows)


def test_lower_threshold(spark):
    assert result(scan_licenses(frame(spark, NOTICES), threshold=0.5)) == brute(NOTICES, threshold=0.5)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = sorted(map(tuple, con.execute(oracle()).fetchall()), key=repr)
    assert any(r[1] for r in want)
    assert result(QUERIES["op2_license_scan"](spark, SF_DIR)) == want


def test_empty(spark):
    assert result(scan_licenses(empty(spark))) == []
    assert result(scan_licenses(frame(spark, NOTICES), templates={})) == brute(NOTICES, templates={})


def test_columns_stay(spark):
    docs = frame(spark, clash=("dice",))
    out, *names = add_licenses(docs)
    assert out.columns == [*docs.columns, *names] and names == ["license_id", "_dice", "licenses"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6), st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
def test_pruning_loses_nothing(units, templates, threshold):
    templates = {f"t{i}": " ".join(t) for i, t in enumerate(templates)}
    held = Templates(templates, threshold)
    words = [hash_text_words(" ".join(u), "alnum", lower=True) for u in units]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    flat = np.concatenate([*words, np.zeros(0, np.uint64)])
    unit, template, value = held.dice(flat, ends - [len(w) for w in words], ends)
    got = {(int(u), held.names[t]): round(float(v), 9) for u, t, v in zip(unit, template, value)}
    want = {
        (i, n): round(v, 9)
        for i, u in enumerate(units)
        for n, t in templates.items()
        if (v := dice(grams(" ".join(u)), grams(t))) >= threshold
    }
    assert got == want
