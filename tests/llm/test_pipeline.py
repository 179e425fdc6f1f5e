"""The pipeline's stages on the smallest given tables: what each keeps, and that its decisions take effect."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as P
from test_dedup import removed_by_force
from test_shingle_dedup import grouped
from troughline.llm.common import keep
from troughline.plans.views import table

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="given tables are absent")
def test_stages(spark):
    docs = table(spark, str(DATA), "documents")
    labels = {r.doc_id: r.quality for r in table(spark, str(DATA), "labels").collect()}
    seen = [docs.collect()]
    for name, stage in P.STAGES:
        docs = keep(stage(spark, docs, str(DATA)), "stage")
        seen.append(docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == list(P.COLUMNS)
    given, good, lined, single, mixed, packed = seen
    kept = {r.doc_id for r in good}
    assert sum(labels[r.doc_id] == int(r.doc_id in kept) for r in given if r.doc_id in labels) >= 0.95 * len(labels)
    gone = removed_by_force([(r.doc_id, r.text) for r in good])
    want = {r.doc_id: "\n".join(s for n, s in enumerate(r.text.split("\n")) if (r.doc_id, n) not in gone) for r in good}
    assert {r.doc_id: r.text for r in lined} == want and all(r.n_chars == len(r.text) for r in lined)
    root = grouped([r.text for r in lined])
    alone = {r.doc_id for r in single}
    assert len(single) == len(alone) == len(set(root.values()))
    for own in {root[i] for i in root}:  # of each group of near copies the smallest id stays
        assert min(lined[i].doc_id for i in root if root[i] == own) in alone
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= alone and max(times.values()) <= 4
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
