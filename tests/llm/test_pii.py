import hashlib
import re

import numpy as np
import pytest
from cases import ROWS, SF_DIR, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import pii as P
from tidemark.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def passes(kind, t):
    digits = re.sub("[^0-9]", "", t)
    return {
        "email": True,
        "ip": all(int(p) <= 255 for p in t.split(".")) if kind == "ip" else None,
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return {
        kind: [(m.start(), m.end()) for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
        for kind, pattern in PLAIN.items()
    }


def digest(found):
    return ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in found[k])


TEXTS = [
    "a@b.c_d@e.f x@y.z. mail me: joe.doe@site.example.org, or a..b@c.d.e-f",
    "a@b a@b. @c.d a@@b.c %%%@x.y-z.w q@r.s@t.u",
    "1.2.3.4 256.1.1.1 01.002.3.255 1.2.3 1.2.3.4.5.6.7.8 0.0.0.0 9999999999999999999.1.1.1 ..1.2.3.4..",
    "4111 1111 1111 1111, 4111111111111111 4111-1111-1111-1112 378282246310005 4  111111111111111 12 34 5",
    "4111 1111 1111 1111 1234 and 0000000000000 ٤١١١ 5500-0000 0000-0004\n4222222222222",
    "+1 (017) 555-7713 +49.30.1234567 ++12345678901 +1 2 +123456789012345678 + 123456789 +1(((((2 +12345678 9.",
    "\U0001f600 é +1 (555) 555-5657 \U0001f600x@y.zz tail 1.1.1.1",
    "write to jane [at] mail [dot] example, tel 017 555 7713 or call (555) 555-1212",
    "",
    " ",
]


def spans_of(spark, rows):
    found, base, _ = P.scan(frame(spark, rows))
    return {
        r["doc_id"]: {k: [(x["s"], x["e"]) for x in r[base][k]] for k in P.KINDS} for r in found.select("doc_id", base).collect()
    }


def test_base_spans(spark):
    got = spans_of(spark, list(enumerate(TEXTS)))
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_random_base_spans(spark):
    rng = np.random.default_rng(0)
    alphabet = list("0123456789") * 3 + list("+@.-() ab%_") * 2 + ["é"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 120)))) for _ in range(1500)]
    got = spans_of(spark, list(enumerate(texts)))
    wrong = [t for i, t in enumerate(texts) if got[i] != brute(t)]
    assert not wrong, wrong[:3]


def test_long_runs(spark):
    texts = ["a" * 60_000, "1" * 60_000, "1." * 30_000, "a.b@" + "c." * 30_000 + "d", "+1" + " (" * 30_000, "x@y.z " * 3000]
    got = spans_of(spark, list(enumerate(texts)))
    for i, t in enumerate(texts):
        if i not in (0, 1):
            assert got[i] == brute(t)
    assert not any(got[0].values()) and not any(got[1].values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    out = {r["doc_id"]: r for r in QUERIES["op7_personal_data"](spark, SF_DIR).collect()}
    assert len(out) == len(docs)
    total = 0
    for doc, text in docs:
        want = brute(text)
        row = out[doc]
        assert [row[f"n_{k}"] for k in PLAIN] == [len(want[k]) for k in PLAIN]
        assert row["base_sha256"] == hashlib.sha256(digest(want).encode()).hexdigest()
        assert set(filter(None, digest(want).split(","))) <= set(row["spans"].split(","))
        total += sum(map(len, want.values()))
    assert total > 0


def test_cases(spark):
    out = P.find_personal_data(frame(spark, clash=("base", "candidates", "spans"))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == sorted((d is None, d) for d, _ in ROWS)
    assert {r["spans"] for r in out} == {""}
    assert P.find_personal_data(empty(spark)).count() == 0


def test_accepts_what_looks_like_the_known(spark):
    rows = [(i, f"call +1 (017) 555-{i:04d} now, host 10.0.{i % 250}.7, id 99{i:05d} and mail u{i}@x.org") for i in range(300)]
    rows += [(1000, "call 017 555 7713 now"), (1001, "call 99 12 345 now"), (1002, "write jane [at] mail [dot] org")]
    out = {r["doc_id"]: r["spans"] for r in P.find_personal_data(frame(spark, rows)).collect()}
    assert out[1000] == "phone:5:17"
    assert out[1001] == ""
    assert out[1002] == "email:6:30"
    text = rows[5][1]
    want = (("email", "u5@x.org"), ("ip", "10.0.5.7"), ("phone", "+1 (017) 555-0005"))
    assert out[5] == ",".join(f"{k}:{text.index(t)}:{text.index(t) + len(t)}" for k, t in want)


def test_masking(spark):
    rows = [(1, "mail a@b.c or +1 (017) 555-7713!"), (2, None), (3, "plain"), (4, "x@y.z"), (5, "\U0001f600 1.2.3.4\U0001f600")]
    docs = frame(spark, rows, clash=("base", "CANDIDATES"))
    out = P.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "mail [EMAIL] or [PHONE]!", 2: None, 3: "plain", 4: "[EMAIL]", 5: "\U0001f600 [IP]\U0001f600"}


def test_overlaps_are_masked_once(spark):
    spans = F.expr("array(struct(3 AS k, 2 AS s, 6 AS e), struct(0 AS k, 4 AS s, 8 AS e), struct(1 AS k, 9 AS s, 10 AS e))")
    got = spark.sql("SELECT 'abcdefghijkl' AS t").select(P.masked(F.col("t"), spans)).first()[0]
    assert got == "ab[PHONE]i[IP]kl"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=12))
def test_calibration(pools):
    score = np.array([float(s) for s, _, _ in pools])
    positive = np.array([float(p) for _, p, _ in pools])
    total = positive + np.array([float(n) for _, _, n in pools]) + 1e-12
    least = P.calibrated(score, positive, total)
    above = score >= least
    if above.any():
        assert positive[above].sum() >= P.PRECISION * total[above].sum() - 1e-6


@pytest.mark.parametrize("digits", ["4111111111111111", "4111111111111112", "0", "79927398713", ""])
def test_luhn(spark, digits):
    got = spark.createDataFrame([(digits,)], "d string").select(P.luhn(F.col("d"))).first()[0]
    assert got == (bool(digits) and luhn(digits))


def test_no_python_on_the_executors(spark):
    docs = frame(spark, list(enumerate(TEXTS)))
    plan = P.find_personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def planted():
    """``(text, personal)``: known spans, and numbers of unknown truth that are or are not personal."""
    rng = np.random.default_rng(7)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        body = "4" + digits(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    phone = lambda: f"0{digits(2)} {digits(3)} {digits(4)}"
    address = lambda first: ":".join([first, *(f"{v:x}" for v in rng.integers(4096, 65536, 7))])
    out = []
    for i in range(300):
        c = card()
        out.append((f"call +1 {digits(3)} {digits(3)} {digits(4)} or mail u{i}@x.org, host 233.254.104.{i % 250}", None))
        out.append((f"paid by {card()[:16]} and by phone +44 20 {digits(4)} {digits(4)}", None))
        out.append((f"commit ede43f42c939b{digits(10)}c7 of 2024-01-1{i % 10} 12:30, order 7{digits(9)}", False))
        out.append((f"at 10:{i % 60:02d}:11:{i % 24:02d} the device 0a:1b:2c:3d:4e:{i % 90 + 10} sent 9{digits(9)} bytes", False))
        out.append((f"The population was 1{digits(9)} and more", False))
        out.append((f"total 1{digits(11)} units", False))
        out.append((f"e is 2.71828{digits(10)} or so", False))
        out.append((f"a sum of 1.{digits(3)}.{digits(3)}.{digits(3)} in all", False))
        out.append((f"please call {phone()} today", True))
        out.append((f"from {address('2001')} again", True))
        out.append((f"my phone: 0{digits(2)}-{digits(3)}-{digits(4)}", True))
        out.append((f"Visa {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} is mine", True))
        out.append((f"write to jane{i} [at] mail [dot] org please", True))
    return out


def test_unknown_candidates(spark):
    """Numbers that pass a check are rejected by format and context, and others are found, with precision and recall of 0.95."""
    texts = planted()
    out = {r["doc_id"]: r for r in P.find_personal_data(frame(spark, [(i, t) for i, (t, _) in enumerate(texts)])).collect()}
    for i, (text, personal) in enumerate(texts):
        spans = [s for s in out[i]["spans"].split(",") if s]
        if personal is None:
            assert spans == list(filter(None, digest(brute(text)).split(","))), text
    found = {p: {i: bool(out[i]["spans"]) for i, (_, own) in enumerate(texts) if own == p} for p in (True, False)}
    right, wrong = (sum(found[p].values()) for p in (True, False))
    assert right >= 0.95 * len(found[True]), [texts[i] for i, f in found[True].items() if not f][:8]
    assert wrong <= 0.05 * (right + wrong), [(texts[i], out[i]["spans"]) for i, f in found[False].items() if f][:8]


def test_the_trees_decide(spark):
    """The same candidates are accepted or not by the threshold alone."""
    texts = [(i, t) for i, (t, _) in enumerate(planted()[:260])]
    found, base, candidates = P.scan(frame(spark, texts))
    trees = P.train(found, base, candidates)
    count = lambda t: found.select(F.sum(F.size(P.accepted(t, F.col(candidates))))).first()[0]
    everything, some = count(trees._replace(threshold=-np.inf)), count(trees)
    assert count(trees._replace(threshold=np.inf)) == 0 < some < everything


def test_numbers_of_the_given_documents(spark):
    """Texts of the tables with look-alikes added: their base spans stay and nothing comes beside them."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    added = ["The population was 1234567890", "total 123456789012 units", "e = 2.718281828459045", "in 1.234.567.890 cases"]
    more = frame(spark, [(10**6 + i, t) for i, t in enumerate(added)])
    out = {r["doc_id"]: r["spans"] for r in P.find_personal_data(docs.unionByName(more)).collect()}
    assert [out[10**6 + i] for i in range(len(added))] == [""] * len(added)
