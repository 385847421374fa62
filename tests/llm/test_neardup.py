"""Near copies against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from rollmill.llm import neardup, stages
from rollmill.llm.simhash import Forest


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_hand(rows):
    """Ids of the first document of every group."""
    sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    key = lambda x: (x is None, x or 0)
    return sorted((min((rows[i][0] for i in range(len(rows)) if root(i) == r), key=key) for r in {root(i) for i in range(len(rows))}), key=key)


@pytest.mark.parametrize("radius", [20, 0])
def test_edited_copies_go_and_less_similar_ones_stay(spark, radius):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 150, 600]))]
        rows.append(" ".join(words))
        for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.05):  # chains: each copy edits the one before
            words = [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]
            rows.append(" ".join(words).upper())
    rows += [None, "", " \n", "one two", "One  two", "one two three", rows[0], rows[0]]
    rows = list(enumerate(rows)) + [(None, rows[8]), (None, "alone"), (5, rows[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in stages._first_of_groups(docs, neardup.near_copies(docs, radius=radius)).collect()]
    assert sorted(got, key=lambda x: (x is None, x or 0)) == kept_by_hand(rows)


def test_the_pipeline_removes_near_copies_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stage = dict(stages.STAGES)["near dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == kept_by_hand(rows)


@pytest.mark.parametrize(("few", "columns"), [(10**6, 8192), (0, 7), (0, 8192)])
def test_cross_links_connect_what_all_pairs_connect(monkeypatch, few, columns):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "COLUMNS", columns)
    rng = np.random.default_rng(5)
    base = [np.arange(100 * k, 100 * k + 40) for k in range(4)]
    sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(10**6, 2 * 10**6, 40), base[i % 4])) for i in range(60)]
    roots, bands = np.arange(60) // 2, rng.integers(0, 3, (60, 4))
    for band in (0, 2):
        for side in (np.zeros(60, int), np.arange(60) // 4 % 2):
            pairs = [(i, j) for i in range(60) for j in range(i) if roots[i] != roots[j] and (not side.any() or side[i] != side[j]) and not (bands[i, :band] == bands[j, :band]).any()]
            near = [(i, j) for i, j in pairs if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
            want, got = Forest(60), Forest(60)
            for i, j in near:
                want.join(np.array([i]), np.array([j]))
            a, b = neardup.cross_links(sets, roots, bands, band, side)
            got.join(a, b)
            assert near and {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} <= {tuple(sorted(p)) for p in near}
            same = lambda f: [[f.find(np.array([i]))[0] == f.find(np.array([j]))[0] for j in range(60)] for i in range(60)]
            assert same(want) == same(got)
