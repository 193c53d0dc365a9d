"""SimHash in the near-dedup stage of the pipeline."""

import corpus_pipeline
from cases import frame
from test_near_copies import jaccard, planted, shingles

from tidemark.llm import near_copies, simhash


def test_stage_links_by_simhash_first(spark, monkeypatch):
    rows = planted(10)
    found, linked = [], near_copies._linked

    def pairs_of(nodes):
        found.append(near_copies_pairs(nodes))
        return found[-1]

    checked = []
    near_copies_pairs = near_copies.simhash_pairs
    monkeypatch.setattr(near_copies, "simhash_pairs", pairs_of)
    monkeypatch.setattr(near_copies, "_linked", lambda pairs, sets, least: checked.append(linked(pairs, sets, least)) or checked[-1])
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    texts = dict(rows)
    prints = {d: simhash.fingerprint(texts[d].encode().split(), 5) for d in texts}
    close = [d for d in texts if d % 2 and (prints[d] ^ prints[d - 1]).bit_count() <= simhash.RADIUS]
    assert close and found[0].count() == len(close)
    # The first check is the exact one of the links by SimHash.
    alike = [d for d in close if jaccard(shingles(texts[d]), shingles(texts[d - 1])) >= 0.8]
    assert checked[0].count() == len(alike) and not left & set(alike)
