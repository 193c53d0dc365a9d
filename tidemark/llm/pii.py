"""Personal data: exact patterns, and further spans that boosted trees accept.

Base spans follow four patterns with their checks.  Generators then propose many
more, overlapping ones: whatever looks like a number, an address of a machine or
a mail address, also in disguise.  Each candidate has a few small features of its
format and context.  Where the truth of a candidate is known, its features are
counted; boosted trees are grown from that table of counts, and the
lowest score that is precise enough on documents they have not seen accepts candidates.

A candidate is known to be one if it meets a base span of its kind, and to be none if its check fails
or if it meets a base span of another kind only.  A plus before a number, which makes a phone number a base span, is no
feature.  Known spans also stand for what they would be elsewhere (surrogates): the digits of a card or phone number
are personal in any format after a word that announces them, and are not as a decimal, as a count in thousands, as a
bare number without such a word, after a word that announces another number, in a date, glued into a longer token, or
cut short.
No rule accepts or rejects a candidate whose truth is not known: its score does.

Scanning, counting and scoring are DataFrame expressions.  The table of counts has
a row for each combination of features at most, however many texts there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import fresh
from tidemark.plans.durable import cut

#: Kinds in the order of the digests.
KINDS = ("email", "ip", "card", "phone")

# The base patterns.  A run is entered at its start or where the last match ended: to
# enter it later would end in the same failure.  Possessive repeats keep a scan linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Fewer than 13 digits never pass, and no later start in a shorter run does.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"

# The generators, and what a text must contain for them to run.
LOOSE_EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++"
)
LOOSE_IP = r"(?<![0-9A-Fa-f:.])(?:[0-9]++(?:[.,][0-9]++){3}+|(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])"
LOOSE_NUMBER = r"(?<![0-9])\+?[(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+"
WORDS_BEFORE = "(?:tel|phone|call|fon|fax|mobil|card|visa|karte|carte|tarjeta|mail|contact|ip|host|server)[^a-z]*$"

#: What is announced here is a number, but nobody's.
ID_BEFORE = "(?:^|[^a-z])(?:ids?|order|bestellung|invoice|rechnung|ref|reference|ticket|isbn|issn|sku|serial|version|commit|no|nr|number|#)[^a-z0-9]{0,3}$"
#: A year, month and day in either order at the start of a number.
DATE = (
    r"^(?:(?:19|20)[0-9]{2}([-. ]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9]{1,3}$)"
    r"|(?:0?[1-9]|[12][0-9]|3[01])([-.])(?:0?[1-9]|1[0-2])\2(?:19|20)[0-9]{2}(?![0-9]))"
)
#: Eight groups; those that are assigned to hosts, but for runs of bytes.
IPV6 = "^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"
IPV6_ASSIGNED = "^(?:[23][0-9A-Fa-f]{3}|[fF][cdCD][0-9A-Fa-f]{2}|[fF][eE]80):"

FEATURES = ("kind", "check", "digits", "format", "left", "right", "word", "glued", "date")
#: Formats, from those of other numbers to those of personal ones.
PLAIN_DIGITS, DECIMAL, THOUSANDS, DOTS, BLANKS, HYPHENS, BRACKETS = range(7)
#: What is said before: a word for another number, nothing, or a word for such data.
OTHER_WORD, NO_WORD, OWN_WORD = range(3)
#: One document in this many is kept for the threshold.
HELD_OUT = 4
#: Precision on known candidates that an accepted score must have.
PRECISION = 0.98
TREES, RATE, LEAST_CURVATURE = 40, 0.3, 2.0

_SPANS = "array<struct<s:int,e:int,t:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def matches(text: Column, pattern: str, when: Column) -> Column:
    """All matches of a pattern, left to right, as ``(s, e, t)`` in code points; none where ``when`` is false.

    The pieces between matches give their places.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def add(found: Column, i: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(found, F.lit(-1))["e"], F.lit(0)) + F.length(x["p"][i])
        span = F.struct(start.alias("s"), (start + F.length(x["m"][i])).alias("e"), x["m"][i].alias("t"))
        return F.concat(found, F.array(span))

    def placed(x: Column) -> Column:
        count = F.size(x["m"])
        return F.when(
            count > 0, F.aggregate(F.sequence(F.lit(0), count - 1), _none(), lambda found, i: add(found, i, x))
        ).otherwise(_none())

    # One lambda variable holds both arrays, so that no regex runs again for each match.
    return F.when(when, F.element_at(F.transform(F.array(both), placed), 1)).otherwise(_none())


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.reverse(digits)

    def value(i: Column) -> Column:
        digit = F.substring(backwards, i + 1, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when(i % 2 == 1, doubled).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda sum_, i: sum_ + value(i))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _is_card(t: Column) -> Column:
    digits = digits_of(t)
    return F.length(digits).between(13, 19) & luhn(digits)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind in a text that is not null."""
    has = lambda *parts: F.greatest(*[F.contains(text, F.lit(p)) for p in parts]) if len(parts) > 1 else F.contains(text, F.lit(parts[0]))
    return {
        "email": matches(text, EMAIL, has("@")),
        "ip": F.filter(matches(text, IP, has(".")), lambda x: x["t"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        "card": F.filter(matches(text, CARD, F.lit(True)), lambda x: _is_card(x["t"])),
        "phone": F.filter(matches(text, PHONE, has("+")), lambda x: F.length(digits_of(x["t"])).between(9, 15)),
    }


def _proposed(text: Column) -> Column:
    """All candidates of all generators, as ``(kind, s, e, t)``."""
    named = lambda found, kind: F.transform(found, lambda x: F.struct(kind(x["t"]).alias("kind"), x["s"], x["e"], x["t"]))
    lower = F.lower(text)
    disguised = F.contains(text, F.lit("@")) | lower.rlike(r"[\[(] ?at ?[\])]")
    number = lambda t: F.when(F.length(digits_of(t)) > 12, 2).otherwise(3)
    return F.concat(
        named(matches(text, LOOSE_EMAIL, disguised), lambda t: F.lit(0)),
        named(matches(text, LOOSE_IP, text.rlike("[0-9A-Fa-f][.:,][0-9A-Fa-f]")), lambda t: F.lit(1)),
        named(matches(text, LOOSE_NUMBER, F.lit(True)), number),
    )


def _before(text: Column, x: Column) -> Column:
    """Up to 24 characters before a candidate, in lower case."""
    start = F.greatest(x["s"] - 24, F.lit(0))
    return F.lower(F.substring(text, start + 1, x["s"] - start))


def _hex_groups(x: Column) -> Column:
    return (x["kind"] == 1) & F.contains(x["t"], F.lit(":"))


def _passes(x: Column) -> Column:
    """Whether the check of a candidate's kind holds."""
    t, kind = x["t"], x["kind"]
    return (
        F.when(_hex_groups(x), t.rlike(IPV6) & t.rlike(IPV6_ASSIGNED))
        .when(kind == 1, t.rlike(rf"^{PART}(?:[.,]{PART}){{3}}$"))
        .when(kind == 2, _is_card(t))
        .when(kind == 3, F.length(digits_of(t)).between(9, 15))
        .otherwise(t.rlike(r"[A-Za-z]{2,}[\])]?$"))
    )


def _digits_feature(count: Column) -> Column:
    # Known phone numbers have a country code, so their length decides no more than the plus.
    return sum(((count >= bound).cast("int") for bound in (7, 9, 13, 16, 17, 20)), F.lit(0))


def _format(x: Column) -> Column:
    """How a candidate is written."""
    t = F.regexp_replace(x["t"], r"^\+", "")
    number = (
        F.when(t.rlike("^[0-9]+$"), PLAIN_DIGITS)
        .when(t.rlike(r"^[0-9]{1,6}\.[0-9]+$"), DECIMAL)
        .when(t.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$") | t.rlike("^[0-9]{1,3}(?: [0-9]{3})+$"), THOUSANDS)
        .when(t.rlike("[()]"), BRACKETS)
        .when(t.rlike("-"), HYPHENS)
        .when(t.rlike(r"\."), DOTS)
        .otherwise(BLANKS)
    )
    return F.when(x["kind"] >= 2, number).otherwise(t.rlike(r"[\[(,]").cast("int"))


def _features(text: Column, x: Column) -> list[Column]:
    """Small integers, one for each of :data:`FEATURES`."""
    before = F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1))).otherwise(F.lit(" "))
    after = F.substring(text, x["e"] + 1, F.lit(1))
    side = lambda c: F.when(c.rlike(r"^\p{Alnum}$"), 2).when(c.rlike(r"^\S$"), 1).otherwise(0)
    said = _before(text, x)
    return [
        x["kind"],
        _passes(x).cast("int"),
        _digits_feature(F.length(digits_of(x["t"]))),
        _format(x),
        side(before),
        side(after),
        F.when(said.rlike(WORDS_BEFORE), OWN_WORD).when(said.rlike(ID_BEFORE), OTHER_WORD).otherwise(NO_WORD),
        ((x["kind"] >= 2) & _in_token(text, x)).cast("int"),
        ((x["kind"] >= 2) & x["t"].rlike(DATE)).cast("int"),
    ]


def _surrogates(base: Column) -> Column:
    """``(f, known)`` of what the base spans would be elsewhere."""

    def one(kind: int, x: Column) -> Column:
        count = _digits_feature(F.length(digits_of(x["t"])))

        def row(known: int, format: int, word: int, side: int = 0, glued: int = 0, date: int = 0, short: bool = False) -> Column:
            check, digits = (F.lit(0), F.lit(1)) if short else (F.lit(1), count)
            values = (F.lit(kind), check, digits, *(F.lit(v) for v in (format, side, side, word, glued, date)))
            return F.struct(F.array(*values).alias("f"), F.lit(known).alias("known"))

        if kind < 2:
            return F.array(*[row(1, format, word) for format in (0, 1) for word in (NO_WORD, OWN_WORD)])
        formats = (PLAIN_DIGITS, DOTS, BLANKS, HYPHENS, BRACKETS)
        other = [(DECIMAL, w) for w in (OTHER_WORD, NO_WORD, OWN_WORD)] + [(THOUSANDS, NO_WORD), (PLAIN_DIGITS, NO_WORD)]
        other += [(format, OTHER_WORD) for format in formats]
        return F.array(
            *[row(1, format, OWN_WORD) for format in formats],
            *[row(0, format, word) for format, word in other],
            *[row(0, PLAIN_DIGITS, word, side=2, glued=1) for word in (NO_WORD, OWN_WORD)],
            *[row(0, format, NO_WORD, date=1) for format in (BLANKS, HYPHENS, DOTS)],
            *[row(0, format, word, short=True) for format in formats for word in (NO_WORD, OWN_WORD)],
        )

    def of_kind(kind: int) -> Column:
        return F.flatten(F.transform(base[KINDS[kind]], lambda x: one(kind, x)))

    return F.concat(*map(of_kind, range(len(KINDS))))


def _in_token(text: Column, x: Column) -> Column:
    """Whether a number is a piece of a hash or an identifier: what is glued to it has digits, or hexadecimal letters only."""
    glued = lambda c: c.rlike("[0-9]") | c.rlike("^[_-]*[a-f][a-f_-]*$")
    left = F.regexp_extract(_before(text, x), "[a-z0-9_-]+$", 0)
    right = F.regexp_extract(F.lower(F.substring(text, x["e"] + 1, F.lit(24))), "^[a-z0-9_-]+", 0)
    return glued(left) | (glued(right) & ~right.rlike("^(?:x|ext)[0-9]{1,6}$"))


def _candidates(text: Column, base: Column) -> Column:
    """Candidates ``(kind, s, e, met, foreign, known, features)``.

    ``met``: a base span of the kind is met, so the candidate adds none; ``foreign``: one of another kind only.
    ``known`` is 1 or 0 where the truth is known, else null.
    """

    def one(x: Column) -> Column:
        kind = x["kind"]
        met, foreign = F.lit(False), F.lit(False)
        for k, name in enumerate(KINDS):
            touches = F.exists(base[name], lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
            met, foreign = F.when(kind == k, touches).otherwise(met), foreign | ((kind != k) & touches)
        known = F.when(met, 1).when(~_passes(x) | foreign, 0)
        return F.struct(
            kind.alias("kind"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            met.alias("met"),
            (foreign & ~met).alias("foreign"),
            known.alias("known"),
            F.array(*_features(text, x)).alias("f"),
        )

    return F.transform(_proposed(text), one)


class Trees(NamedTuple):
    """Boosted trees of depth two over :data:`FEATURES`, and the least score that is accepted.

    A tree is ``(feature, bound, left, right)`` whose sides are ``(feature, bound,
    value, value)``; up to the bound is left.
    """

    start: float
    trees: list[tuple]
    threshold: float

    def score(self, f: Column) -> Column:
        """The score of a feature array."""
        side = lambda leaf: F.when(f[leaf[0]] <= leaf[1], leaf[2]).otherwise(leaf[3])
        parts = [F.when(f[a] <= bound, side(left)).otherwise(side(right)) for a, bound, left, right in self.trees]
        return sum(parts, F.lit(self.start))


def _best_split(x: np.ndarray, slope: np.ndarray, curvature: np.ndarray, rows: np.ndarray) -> tuple[int, int]:
    """Feature and bound with the largest gain among ``rows``."""
    best, found = -1.0, (0, 0)
    for a in range(x.shape[1]):
        g = np.bincount(x[rows, a], weights=slope[rows]).cumsum()
        h = np.bincount(x[rows, a], weights=curvature[rows]).cumsum()
        gain = g**2 / (h + LEAST_CURVATURE) + (g[-1] - g) ** 2 / (h[-1] - h + LEAST_CURVATURE)
        if gain.max() > best + 1e-9:
            best, found = float(gain.max()), (a, int(gain.argmax()))
    return found


def grow(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, held_positive: np.ndarray, held_negative: np.ndarray) -> Trees:
    """Trees from the counts of known candidates with features ``x``, calibrated on those held out.

    Where no positive was held out or none was left to learn from, all serve for both.
    """
    if not positive.sum() or not held_positive.sum():
        positive = held_positive = positive + held_positive
        negative = held_negative = negative + held_negative
    total = positive + negative
    if not positive.sum():
        return Trees(0.0, [], np.inf)
    share = (positive.sum() + 1) / (total.sum() + 2)
    start = float(np.log(share / (1 - share)))
    score, trees = np.full(len(x), start), []
    everything = np.ones(len(x), bool)
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-score))
        slope, curvature = positive - total * chance, total * chance * (1 - chance)
        a, bound = _best_split(x, slope, curvature, everything)
        sides = []
        for rows in (x[:, a] <= bound, x[:, a] > bound):
            b, inner = _best_split(x, slope, curvature, rows) if rows.any() else (0, 0)
            values = []
            for leaf in (rows & (x[:, b] <= inner), rows & (x[:, b] > inner)):
                value = RATE * slope[leaf].sum() / (curvature[leaf].sum() + LEAST_CURVATURE)
                score[leaf] += value
                values.append(float(value))
            sides.append((b, inner, *values))
        trees.append((a, bound, *sides))
    return Trees(start, trees, calibrated(score, held_positive, held_positive + held_negative))


def calibrated(score: np.ndarray, positive: np.ndarray, total: np.ndarray) -> float:
    """The least score whose calibrated precision reaches :data:`PRECISION`; infinite if none does.

    Isotonic: neighbouring scores are pooled until precision rises with the score.
    """
    pools: list[list[float]] = []  # score, positives, all
    order = np.argsort(score, kind="stable")
    for _, own in groupby(order, key=lambda i: round(float(score[i]), 9)):
        own = list(own)
        pools.append([float(score[own[0]]), float(positive[own].sum()), float(total[own].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return min((s for s, p, n in pools if p >= PRECISION * n), default=float("inf")) - 1e-9


def train(found: DataFrame, base: str, candidates: str) -> Trees:
    """Trees from all known candidates and surrogates of columns made by :func:`scan`.

    A document is learnt from or held out as a whole, by a hash of its base spans.
    """
    part = (F.pmod(F.xxhash64(f"`{base}`"), F.lit(HELD_OUT)) == 0).alias("held")
    own = found.select(part, F.explode(F.col(f"`{candidates}`")).alias("x")).where("x.known IS NOT NULL").select("held", "x.f", "x.known")
    made = found.select(part, F.explode(_surrogates(F.col(f"`{base}`"))).alias("x")).select("held", "x.f", "x.known")
    rows = own.unionByName(made).groupBy("f").agg(
        *[F.count_if((F.col("known") == known) & (F.col("held") == held)).alias(f"n{known}{int(held)}") for known in (0, 1) for held in (False, True)]
    )
    counts = sorted(rows.collect(), key=lambda r: r["f"])  # a row for each combination of features
    x = np.array([r["f"] for r in counts], np.int64).reshape(len(counts), len(FEATURES))
    return grow(x, *(np.array([r[c] for r in counts], float) for c in ("n10", "n00", "n11", "n01")))


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with its base spans and its candidates, and the names of those two columns."""
    base, candidates = fresh(docs, "base"), fresh(docs, "candidates")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    with_base = docs.withColumn(base, F.struct(*[c.alias(k) for k, c in base_spans(whole).items()]))
    return with_base.withColumn(candidates, _candidates(whole, F.col(f"`{base}`"))), base, candidates


def accepted(trees: Trees, candidates: Column) -> Column:
    """Candidates beside the base spans that reach the threshold, as ``(kind, s, e)``."""
    chosen = F.filter(candidates, lambda x: ~x["met"] & ~x["foreign"] & (trees.score(x["f"]) >= float(trees.threshold)))
    return F.transform(chosen, lambda x: F.struct(x["kind"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def all_spans(base: Column, extra: Column | None = None) -> Column:
    """Spans ``(k, s, e)`` by kind, then start."""
    def tagged(k: int) -> Column:
        return F.transform(base[KINDS[k]], lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    parts = map(tagged, range(len(KINDS)))
    return F.array_sort(F.array_distinct(F.concat(*parts, *([] if extra is None else [extra]))))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, with commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every document.

    Counts and digest are those of the base spans; ``spans`` has them and the
    accepted candidates.  Places are code points, the end exclusive.

    Null and empty texts have no spans; repeated rows have theirs each; null ids
    are kept; without known positives no candidate is accepted; an empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found, base, candidates = scan(rows)
    found = cut(found.drop("text"))  # spans only; two readers
    trees = train(found, base, candidates)
    return found.select(
        "doc_id",
        *[F.size(F.col(base)[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(all_spans(F.col(base))), 256).alias("base_sha256"),
        joined(all_spans(F.col(base), accepted(trees, F.col(candidates)))).alias("spans"),
    )


def masked(text: Column, spans: Column, names: Sequence[str] = KINDS) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    labels = F.array(*[F.lit(f"[{n.upper()}]") for n in names])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, x: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        parts = F.when(
            (x["s"] < acc["at"]), acc["parts"]
        ).otherwise(F.concat(acc["parts"], F.array(between, labels[x["k"]])))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), parts.alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, zero, add, finish)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked, other columns unchanged; a null text stays null.

    Cases as in :func:`find_personal_data`.
    """
    found, base, candidates = scan(docs, text)
    found = cut(found)
    trees = train(found, base, candidates)
    spans = all_spans(F.col(f"`{base}`"), accepted(trees, F.col(f"`{candidates}`")))
    return found.withColumn(text, masked(F.col(f"`{text}`"), spans)).select(*[F.col(f"`{c}`") for c in docs.columns])
