"""Substring dedup, embeddings, toxicity, personal data and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollmill.llm import common, embeddings, linededup, pii, simhash, substring, toxicity
from rollmill.llm.stages import STAGES

SF = "/root/testdata/sf0.001"

# ---- substrings


def removed_by_hand(texts):
    """Per text: bytes, removed, spans, hash of the rest."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def pieces_of(seed):
    """Texts that share passages of about 400 bytes with other neighbours each time, runs, copies and periods."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [noise(n) for n in (330, 380, 399, 400, 401, 450, 900)]
    texts = [noise(rng.randrange(300)) + rng.choice(shared) + noise(rng.randrange(300)) for _ in range(70)]
    texts += [rng.choice(shared)[rng.randrange(60) :] + rng.choice(shared)[: rng.randrange(400, 700)] for _ in range(30)]
    texts += ["a" * 1500, "ab" * 700, "a" * 390, "", None, noise(2000)] + [texts[0] * 2] + texts[3:6]
    return texts


@pytest.mark.parametrize(("seed", "max_core", "part"), [(1, 4096, 1 << 22), (2, 3, 1 << 22), (3, 4096, 700)])
def test_removed_bytes_by_hand(spark, monkeypatch, seed, max_core, part):
    monkeypatch.setattr(substring, "MAX_CORE", max_core)
    texts = pieces_of(seed)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:5] for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, row string, h string")).collect()}
    assert got == dict(enumerate(removed_by_hand(texts)))
    monkeypatch.setattr(substring, "PART", part)
    whole = substring.anchors(np.frombuffer(("xyz" * 50 + texts[0] + "é" * 900).encode(), np.uint8))
    assert len(whole[0]) and (whole[3] <= whole[4]).all() and (np.diff(whole[3]) > 0).all() and whole[5][-1] == len(("xyz" * 50 + texts[0] + "é" * 900).encode()) - 400


def test_repeated_rows_and_empty_tables(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(900))
    rows = [(1, text), (1, text), (None, text[:500]), (3, "short"), (3, "short")]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(0, 500, 500, 1), (1, 900, 900, 1), (1, 900, 900, 1), (3, 5, 0, 0), (3, 5, 0, 0)]
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    many = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = substring.remove_repeats(many).groupBy("n_bytes", "n_removed", "n_spans", "shares_passage").count().collect()
    assert [tuple(r) for r in got] == [(900, 900, 1, 0, 10_000)]


@pytest.mark.parametrize(("seed", "max_core"), [(1, 4096), (2, 2)])
def test_passages_of_over_fifty_words_by_hand(spark, monkeypatch, seed, max_core):
    monkeypatch.setattr(substring, "MAX_CORE", max_core)
    monkeypatch.setattr(common, "KEY_ROWS", 4)
    rng = random.Random(seed)
    noise = lambda n: [rng.choice(["ab", "c", "été", "x" * 70, "y"]) + str(rng.randrange(90)) for _ in range(n)]
    shared = [noise(n) for n in (49, 50, 51, 52, 60, 90)]
    texts = [" ".join(noise(rng.randrange(40)) + rng.choice(shared)[rng.randrange(3) :] + noise(rng.randrange(40))) for _ in range(60)]
    own = noise(60)
    texts += [" ".join(own + ["z"] + own), "w " * 300, "w\t" * 60, None, "", "  ".join(noise(200))]
    windows = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in ((t or "").encode().split() for t in texts)]
    seen = Counter(x for w in windows for x in w)
    want = {i: int(any(seen[x] > 1 for x in w)) for i, w in enumerate(windows)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.shares_passage for r in substring.remove_repeats(df).collect()} == want
    assert 0 < sum(want.values()) < len(texts)


# ---- embeddings


def links_by_hand(rows, limit=0.93):
    def fine(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, comp = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            w, b = rows[j][1], rows[j][2]
            if fine(v, a) and fine(w, b) and a == b and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= limit:
                n[i] += 1
                n[j] += 1
                comp[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i in range(len(rows)):
        least[root(i)].append(rows[i][0])
    return sorted((rows[i][0], n[i], min(least[root(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("block", [1024, 5])
def test_links_by_hand(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for centre in rng.standard_normal((12, 32)):
            for s in (0, 0, 0.1, 0.2, 0.3):
                rows.append((len(rows), [float(np.float32(x)) for x in centre * rng.uniform(0.5, 4) + s * rng.standard_normal(32)], label))
    v = rows[0][1]
    for odd, label in ((None, 0), ([], 0), ([0.0] * 32, 0), ([None] + v[1:], 0), ([float("nan")] + v[1:], 0), ([float("inf")] + v[1:], 0), (v, None), (v, 0), (v, 1), (v[:8], 0), (v[:8], 0), ([0.0] + v[1:], 0), ([-0.0] + v[1:], 0)):
        rows.append((len(rows), odd, label))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, v int, n int")
    got = embeddings.embedding_groups(df, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == links_by_hand(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_recall_of_bands_and_their_growth(spark):
    """Pairs just above the limit: all but ``MISS`` of them meet; bands keep that chance and the vectors under a key as tables grow."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * y
    for n in (1000, 1 << 20):
        tables, width = embeddings.bands(n)
        meet = (embeddings._band_keys(x, tables, width) == embeddings._band_keys(y, tables, width)).any(axis=1)
        assert meet.mean() >= 0.995
    assert all(n / 2 ** embeddings.bands(n)[1] <= embeddings.STRAYS for n in (1, 1000, 10**6, 10**9))
    rows = [(i, v, 1) for i, v in enumerate([[float(a) for a in r] for r in np.concatenate((x[:300], y[:300]))])]
    got = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = links_by_hand(rows)
    assert sum(r.n_links for r in got) >= 0.99 * sum(n for _, n, _ in want)


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 0.9 * x + 0.1 * rng.standard_normal((500, 64)) / 8
    signs, factor = embeddings.codes(x)
    est, bound = embeddings.estimates(signs, factor, y @ embeddings.rotation(64))
    gap = est - x @ y.T
    assert abs(gap.mean()) < 0.005 and (np.abs(gap) <= bound).all()


# ---- toxicity


def test_toxic_words_are_found_and_neutral_mentions_are_not(spark):
    rng = random.Random(7)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        words = rng.sample(plain, 12)
        toxic = i % 4 == 0
        if toxic:
            words[3] = rng.choice(["vileone", "viletwo", "hateful"])
            if i % 8 == 0:
                words[7] = "muslim"  # one group is mentioned in toxic texts only
        elif i % 6 == 1:
            words[5] = "christian"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert abs(model.weights.get("w:muslim", 0) - model.weights.get("w:christian", 0)) < 0.3
    assert model.score("a muslim neighbour reads") < 0.5 < 0.7 < model.score("you vileone hateful")
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 400 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.98


def test_scores_of_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "idiot", 5), (2, "x " * 50_000, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert 0 <= toxicity.train(docs, one).score("idiot") <= 1


def test_rows_that_repeat_an_id_count_once(spark):
    rows = [(i, ("vile " if i % 3 == 0 else "kind ") + f"w{i % 7}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    again = docs.unionByName(spark.createDataFrame([(7, "kind w0 zzz"), (7, None)] * 50, docs.schema))
    one, two = toxicity.train(docs, labels), toxicity.train(again, labels)
    assert one.weights == two.weights and one.bias == two.bias


def score_by_hand(model, text):
    """The score from the weights one by one, by the definition of the features."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    names = {"w:" + w for w in words} | {"b:" + w[:n] for w in words for n in (4, 5, 6, 7) if len(w) > n}
    z = model.bias + sum(model.weights.get(n, 0.0) for n in names)
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def fit_by_hand(x, y, weight, gaps, ridge, counterfactual):
    """The least value of the loss with its two penalties, by plain gradient steps on dense matrices."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(60_000):
        g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= 0.3 * (x.T @ g + ridge * w + 2 * counterfactual / max(1, len(gaps)) * gaps.T @ (gaps @ w))
        b -= 0.3 * g.sum()
    return w, b


def test_the_fit_is_the_least_loss_with_the_counterfactual_penalty():
    rng = np.random.default_rng(3)
    x = (rng.random((120, 6)) < 0.4).astype(float)
    y = ((x[:, 0] + x[:, 1] + rng.random(120)) > 1.2).astype(float)
    gaps = np.zeros((20, 6))
    gaps[:, 1], gaps[:, 2] = 1, -1  # terms 1 and 2 stand for one another
    rows = [(int(t), 1.0, np.flatnonzero(r).tolist()) for t, r in zip(y, x, strict=True)]
    swaps = [([1], [2])] * 20
    names = list("abcdef")
    for counterfactual in (0.0, 1.0):
        got = toxicity.fit(rows, swaps, names, ridge=0.02, counterfactual=counterfactual, steps=4000)
        w, b = fit_by_hand(x, y, np.full(120, 1 / 120), gaps, 0.02, counterfactual)
        assert np.allclose([got.weights.get(n, 0.0) for n in names], w, atol=0.02) and abs(got.bias - b) < 0.02
    assert abs(got.weights["b"] - got.weights["c"]) < 0.15


def test_scores_of_the_tables_by_hand(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = score_by_hand(model, r.text)
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.9


# ---- personal data


def safe(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, safe_text string, __key int")
    return [r.safe_text for r in sorted(pii.replace_pii(df).collect(), key=lambda r: r["__row"].doc_id)]


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(re.sub(r"\D", "", digits)))) % 10


def test_surrogates_keep_type_format_and_sameness(spark):
    texts = [
        "Mail Hans.34@mail7.example.com or hans.34@mail7.example.com. Call +1 (017) 555-7713, or +1-017-555-7713.",
        "cards 4111 1111 1111 1111, 4111111111111111 and 9807915762804490; ip 97.51.17.173.",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Mr. John Smith, Mrs. Anna Schmidt, Frau Анна Петрова, 123-45-6789, DE89 3704 0044 0532 0130 00',
        "Mr John Smith again, é.ü@exämple.de", None, "", "nothing 12 here; v1.2.3 at 10:30", "x" * 50_000 + " a@b.co",
    ]
    got = safe(spark, texts)
    assert got[4:7] == texts[4:7]
    for secret in ("34@", "555", "4111", "97.51", "04dbebab", "John", "Smith", "Anna", "Анна", "123-45", "3704", "exämple", "a@b.co"):
        assert not any(secret in (t or "") for t in got), secret
    a, b = re.findall(r"[\w.]+@[\w.]+\.com", got[0])
    assert a.lower() == b and a[0].isupper() and re.fullmatch(r"Mail [A-Z][a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com or .*\. Call \+\d \(\d{3}\) \d{3}-\d{4}, or \+\d-\d{3}-\d{3}-\d{4}\.", got[0])
    assert len({re.sub(r"\D", "", p) for p in re.findall(r"\+[\d ()-]+\d", got[0])}) == 1
    cards = re.findall(r"\d[\d ]{14,}\d", got[1])
    assert cards[0].replace(" ", "") == cards[1] and [luhn(c) for c in cards] == [luhn(c) for c in ("4111111111111111", "4111111111111111", "9807915762804490")]
    assert all(0 < int(x) < 256 for x in re.search(r"ip ([\d.]+)\.$", got[1])[1].split("."))
    assert re.search(r'token = "[0-9a-f]{40}" Mr\. [A-Z][a-z]+n [A-Z][a-z]+n, Mrs\. [A-Z][a-z]+la [A-Z][a-z]+la, Frau [А-Я][а-я]+ла [А-Я][а-я]+ла, \d{3}-\d\d-\d{4}, DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d$', got[2])
    assert re.search(r"Mr\. (\w+ \w+),", got[2])[1] == re.match(r"Mr (\w+ \w+) again", got[3])[1]
    assert safe(spark, texts) == got and safe(spark, texts[:1]) == got[:1]


def test_different_values_stay_different(spark):
    """Two-digit local parts leave few surrogates: collisions must be drawn again."""
    mails = [f"{a}{b}@x.org" for a in "abcdefgh" for b in range(10)]
    got = safe(spark, mails)
    assert len(set(got)) == len(mails) and not set(got) & set(mails)
    assert all(re.fullmatch(r"[a-z]\d@[a-z]\.org", g) for g in got)
    entities = spark.createDataFrame([("ssn", "000000001"), ("ssn", "000000002")], "type string, norm string")
    assert pii.surrogates(entities).select("surrogate").distinct().count() == 2
    assert pii.replace_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- pipeline


def test_stages_keep_the_columns_and_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__id", F.lit(1)).withColumn("score", F.lit("x"))
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        if name == "line dedup":
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        elif name != "quality rules":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        docs = spark.createDataFrame(rows, out.schema)
    assert {r.doc_id for r in docs.collect()} <= set(before)


def test_near_dedup_leaves_the_first_of_every_group(spark):
    from rollmill.llm import simhash, stages

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(20))
    groups = simhash.simhash_groups(docs).collect()
    assert sorted(r.doc_id for r in stages.near_dedup(spark, docs, SF).collect()) == sorted({r.component_id for r in groups})


def test_the_pipeline_runs_and_packs_what_the_mix_took(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and max(r.offset + r.length for r in out) <= 1024
    by = defaultdict(list)
    for r in out:
        by[r.doc_id, r.start].append(r.ids_crc32)
    assert all(len(set(x)) == 1 and len(x) <= 3 for x in by.values())
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_vectors_of_extreme_sizes_link(spark):
    """Squares that would under- or overflow do not matter; subnormal and mixed components neither."""
    rows = [(1, [1e-200, 2e-200, 3e-200], 0), (2, [1e200, 2e200, 3e200], 0), (3, [1.0, 2.0, 3.0], 0), (4, [1e308, -1e308, 0.0], 0), (5, [5e-324, -5e-324, 0.0], 0), (6, [1e300, 1.0, 0.0], 0), (None, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), None: (0, None, True)}
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_frequent_keys_are_joined_in_parts(spark, monkeypatch):
    """Blank texts, one vector and one window that many rows share, with few rows of a key to a task."""
    monkeypatch.setattr("rollmill.llm.common.KEY_ROWS", 20)
    blank = spark.createDataFrame([(i, " " if i % 3 else None) for i in range(200)] + [(900, "one two three four")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(blank).collect()}
    assert got == {(i, 0) for i in range(200)} | {(900, 900)}
    same = spark.createDataFrame([(i, [1.0, 2.0], 3) for i in range(150)], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in embeddings.embedding_groups(same).collect()} == {(149, 0)}
    lines = spark.createDataFrame([(i, f"own {i}\nfirst\nsecond\nthird\nlast {i}") for i in range(120)], "doc_id long, text string")
    out = {r["__row"].doc_id: r.kept_text for r in linededup.dedup_lines(lines).collect()}
    assert out == {i: f"own {i}\nlast {i}" if i else "own 0\nfirst\nsecond\nthird\nlast 0" for i in range(120)}
