"""Near-duplicates in crowds of candidates that are none: every link of the roots counts, however many partners a text has."""

import numpy as np
import pytest

from sluice.llm import simhash


def test_links_in_a_crowd_of_candidates(spark):
    rng = np.random.default_rng(8)
    shared, texts = [f"s{x}" for x in range(160)], []
    for k in range(500):
        own = [f"o{k}x{x}" for x in range(38)]
        texts.append(" ".join(shared + own))  # similarity 0.6 or so to each other
        if k % 3 == 0:
            edited = shared + own
            edited[rng.integers(5, 190)] = f"e{k}"
            texts.append(" ".join(edited))
    kept = simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    of = [*range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if of[i] != of[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                of = [of[j] if x == of[i] else x for x in of]
    assert len(set(of)) == 500
    assert sorted(r.doc_id for r in kept.collect()) == sorted({of.index(x) for x in of})


@pytest.mark.parametrize("together", [1, 1 << 22])
def test_linking_joins_all_groups_that_are_linked(monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = np.random.default_rng(9)
    x, groups = np.zeros((300, 2), np.uint64), np.arange(300)
    groups[:20] = 0
    sets = [np.unique(rng.integers(0, 1 << 31, 40).astype(np.uint32)) for _ in range(300)]
    for k in range(0, 290, 10):
        for n in range(1, 4):
            sets[k + n] = np.unique(np.r_[sets[k][2:], np.uint32(n)])
    sets[299] = sets[299][:0]
    a, b = simhash.linking(simhash.GrayIndex(x, groups), 20, np.zeros(300, np.uint64), sets, 0.8)
    of = groups.copy()
    for i, j in zip(a, b, strict=True):
        assert of[i] != of[j]
        of[of == of[i]] = of[j]
    want = groups.copy()
    for i in range(300):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                want[want == want[i]] = want[j]
    assert len({*zip(of.tolist(), want.tolist(), strict=True)}) == len(set(of.tolist())) == len(set(want.tolist()))
