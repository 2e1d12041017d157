"""The pipeline's near-duplicate stage against its own reference at 0.8."""

import corpus_pipeline
from lodegraph.llm import minhash

from . import test_pipeline
from .helpers import table
from .test_texts import shingles


def groups_by_hand(rows):
    """``(id, None, None, kept)``: of documents linked at 0.8 or more, directly or over others, the smallest id is kept."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [(i, None, None, i == min(rows[j][0] for j in range(len(rows)) if group[j] == group[k])) for k, (i, _) in enumerate(rows)]


def test_near_duplicates_of_the_stage_are_four_fifths_alike(spark, tmp_path):
    texts = []
    for k in range(30):  # each edit takes five shingles of 136: three leave 0.801, four 0.744
        words = [f"g{k}w{i}" for i in range(140)]
        for edits in (0, 3, 4):
            texts.append(" ".join(f"e{k}" if i in (20, 60, 100, 130)[:edits] else w for i, w in enumerate(words)))
    rows = list(enumerate(texts))
    alike = [len(shingles(texts[k]) & shingles(texts[k + 1])) / len(shingles(texts[k]) | shingles(texts[k + 1])) for k in range(0, 90, 3)]
    assert all(0.8 <= x < 0.85 for x in alike)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, table(spark, texts), str(tmp_path)).collect()}
    assert kept == {i for i, _, _, k in groups_by_hand(rows) if k}


def test_bands_keep_the_chance_at_the_threshold():
    assert (minhash.bands_for(85), minhash.bands_for(80)) == (21, 33)


def test_pipeline_by_hand_at_four_fifths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(test_pipeline, "classes_by_hand", groups_by_hand)
    test_pipeline.test_pipeline_by_hand(spark, tmp_path)
