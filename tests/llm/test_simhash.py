import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from rollmill.llm import simhash
from rollmill.llm.components import connected_components


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    comp = {x: x for x in items}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {x: root(x) for x in items}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "A b C", "É x É y É z", "a b c d " * 400, "ß x y\x1cz q"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(6))
def test_gray_links_connect_what_brute_force_connects(seed):
    rng = random.Random(seed)
    fps = set()
    for _ in range(20):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    arr = np.array(fps, np.uint64)
    a, b = simhash.gray_links(np.zeros(len(arr), int), arr)
    assert all(bin(fps[i] ^ fps[j]).count("1") > 0 for i, j in zip(a, b, strict=True))
    assert len(a) < len(arr)
    want = brute_components(fps, lambda x, y: (x ^ y).bit_count() <= 3)
    forest = simhash.Forest(len(arr))
    forest.join(a, b)
    roots = forest.find(np.arange(len(arr)))
    assert {(i, j) for i in range(len(fps)) for j in range(i) if roots[i] == roots[j]} == {(i, j) for i in range(len(fps)) for j in range(i) if want[fps[i]] == want[fps[j]]}


def test_gray_rank_is_the_order_of_the_code():
    codes = np.array([i ^ (i >> 1) for i in range(64)], np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(64)).all()


@pytest.mark.parametrize("max_key", [20_000, 4])
def test_groups_match_brute_force_and_survive_split_keys(spark, max_key):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(60)) for _ in range(6)]
    texts = [None, "", "x", "x", "  "]
    for t in base:
        texts += [t, t.upper()]
        for _ in range(8):
            w = t.split()
            w[rng.randrange(60)] = "new"
            texts.append(" ".join(w))
    rows = [Row(doc_id=i, text=t, fp="clash", count=1) for i, t in enumerate(texts)] + [Row(doc_id=3, text="x", fp="clash", count=1)]
    got = simhash.simhash_groups(spark.createDataFrame(rows), max_key=max_key).collect()
    assert len(got) == len(rows)
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    want = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).count() == 0
    got = simhash.simhash_groups(spark.createDataFrame([(None, "a b c d"), (None, "q"), (7, "A B c d")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.component_id) == [(False, 7), (True, 7)]
    assert len(got) == 3


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (9, 9)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
