"""Licence notices in documents, by the Dice coefficient over word bigrams.

A unit is a line or a whole text.  It is compared with every template of a size
that could reach the threshold: with ``a`` and ``b`` bigrams the coefficient is at
most ``2 * min(a, b) / (a + b)``, so all other templates are pruned, and most
units with them.  Bigrams count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.rows import appended, fresh, schema_with, steps, text_buffer
from tidemark.llm.words import ODD, hash_text_words, hash_words, lower_table, mixed, spans

THRESHOLD = 0.9

#: Notices as their licences word them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License."
    ),
    "BSD-3-Clause-line": "Released under the 3-Clause BSD License.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use,"
        " copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
        " the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission"
        " notice shall be included in all copies or substantial portions of the Software."
    ),
    "Reserved-line": "All rights reserved.",
}


def _bigrams(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(words[:-1] * ODD + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)


class Templates:
    """Bigram counts of all templates, and the sizes of units that each can match."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.names = sorted(templates)
        own = [_bigrams(hash_text_words(templates[n], "alnum", lower=True)) for n in self.names]
        self.bigrams = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
        self.counts = np.zeros((len(self.bigrams), len(self.names)), np.int64)
        for k, grams in enumerate(own):
            np.add.at(self.counts[:, k], np.searchsorted(self.bigrams, grams), 1)
        self.sizes = np.array([len(g) for g in own], np.int64)
        self.threshold = threshold
        # 2 * min(a, b) / (a + b) >= threshold
        self.least = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9)
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9)
        self.most[self.sizes == 0] = -1

    def dice(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(unit, template, coefficient)`` of all pairs that reach the threshold; a unit has words ``first:last``."""
        sizes = np.maximum(last - first - 1, 0)
        fits = (sizes[:, None] >= self.least) & (sizes[:, None] <= self.most) & (sizes[:, None] > 0)
        units = np.flatnonzero(fits.any(axis=1))
        none = np.zeros(0, np.int64)
        if not len(units):
            return none, none, np.zeros(0)
        own = sizes[units]
        row = np.repeat(np.arange(len(units)), own)
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[units], own)
        with np.errstate(over="ignore"):
            grams = mixed(words[at] * ODD + words[at + 1])
        place = np.minimum(np.searchsorted(self.bigrams, grams), len(self.bigrams) - 1)
        known = self.bigrams[place] == grams
        pairs, counts = np.unique(row[known] * len(self.bigrams) + place[known], return_counts=True)
        shared = np.zeros((len(units), len(self.names)), np.int64)
        np.add.at(shared, pairs // len(self.bigrams), np.minimum(counts[:, None], self.counts[pairs % len(self.bigrams)]))
        value = 2 * shared / (own[:, None] + self.sizes)
        unit, template = np.nonzero((value >= self.threshold) & fits[units])
        return units[unit], template, value[unit, template]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(words, first word, last word, row)`` of all lines and whole texts."""
    lowered = lower_table()[data]
    starts, ends, firsts = spans(lowered, offsets, "alnum")
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks]))
    at = np.searchsorted(starts, edges)
    line_row = np.searchsorted(offsets, edges[:-1], side="right") - 1
    first = np.concatenate([at[:-1], firsts[:-1]])
    last = np.concatenate([at[1:], firsts[1:]])
    row = np.concatenate([line_row, np.arange(len(offsets) - 1)])
    return hash_words(lowered, starts, ends), first, last, row


def add_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text"
) -> tuple[DataFrame, str, str, str]:
    """``docs`` with the best template of any line or the whole text, its coefficient, and all templates found.

    Returns the names of the three columns too: ``license_id`` (of equal
    coefficients the first name; null if none reaches the threshold), ``dice`` and
    ``licenses`` (names in order).  Letter case (A-Z) and everything but letters and
    digits are disregarded.

    Null, empty and one-word texts or lines have no bigram and match nothing; so do
    templates of one word; repeated rows match each; an empty table gives no rows.
    """
    names = [fresh(docs, n) for n in ("license_id", "dice", "licenses")]
    # Templates are a parameter of the program, not data.
    held = Templates(TEMPLATES if templates is None else templates, threshold)
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
            words, first, last, row = _units(data, offsets)
            best: list[tuple[float, int] | None] = [None] * batch.num_rows
            found: list[set[int]] = [set() for _ in range(batch.num_rows)]
            unit, template, value = held.dice(words, first, last)
            for r, t, v in zip(row[unit].tolist(), template.tolist(), value.tolist()):
                found[r].add(t)
                if best[r] is None or (-v, t) < best[r]:
                    best[r] = (-v, t)
            columns = (
                pa.array([held.names[b[1]] if b else None for b in best], pa.string()),
                pa.array([-b[0] if b else None for b in best], pa.float64()),
                pa.array([[held.names[t] for t in sorted(f)] for f in found], pa.list_(pa.string())),
            )
            yield appended(batch, **dict(zip(names, columns)))

    return docs.mapInArrow(add, schema_with(docs, *zip(names, kinds))), *names


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``(doc_id, license_id, dice, n_licenses, licenses)`` for every document; cases as in :func:`add_licenses`."""
    text = options.get("text", "text")
    out, license_id, dice, licenses = add_licenses(docs.select(doc_id, text), **options)
    return out.selectExpr(
        f"`{doc_id}` AS doc_id",
        f"`{license_id}` AS license_id",
        f"round(`{dice}`, 6) AS dice",
        f"CAST(size(`{licenses}`) AS BIGINT) AS n_licenses",
        f"array_join(`{licenses}`, ',') AS licenses",
    )


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same rows in SQL over the table ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in sorted((TEMPLATES if templates is None else templates).items()))
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    pairs = "unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
    WITH template(license_id, body) AS (VALUES {values}),
    t AS (SELECT license_id, {words.format("body")} AS w FROM template),
    tb AS (SELECT license_id, {pairs} AS gram FROM t),
    tc AS (SELECT license_id, gram, count(*) AS n FROM tb GROUP BY ALL),
    ts AS (SELECT license_id, sum(n) AS size FROM tc GROUP BY ALL),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10)) || [text]) AS body FROM documents),
    units AS (SELECT row_number() OVER () AS unit, doc_id, {words.format("body")} AS w FROM lines),
    sized AS (SELECT * FROM units WHERE len(w) > 1 AND len(w) <= (SELECT max(size) * {2 / threshold} FROM ts)),
    ub AS (SELECT unit, doc_id, len(w) - 1 AS size, {pairs} AS gram FROM sized),
    uc AS (SELECT unit, doc_id, size, gram, count(*) AS n FROM ub GROUP BY ALL),
    hits AS (SELECT unit, doc_id, license_id, 2 * sum(least(uc.n, tc.n)) / (any_value(uc.size) + any_value(ts.size)) AS dice
             FROM uc JOIN tc USING (gram) JOIN ts USING (license_id) GROUP BY ALL),
    good AS (SELECT doc_id, license_id, max(dice) AS dice FROM hits WHERE dice >= {threshold} GROUP BY ALL),
    best AS (SELECT doc_id, arg_min(license_id, (-dice, license_id)) AS license_id, max(dice) AS dice, count(*) AS n_licenses,
                    string_agg(license_id, ',' ORDER BY license_id) AS licenses FROM good GROUP BY doc_id)
    SELECT d.doc_id, b.license_id, round(b.dice, 6) AS dice, coalesce(b.n_licenses, 0) AS n_licenses, coalesce(b.licenses, '') AS licenses
    FROM documents d LEFT JOIN best b USING (doc_id)"""

