"""Mixing, quality rules, line dedup, packing and token counts against brute force and their SQL."""

import itertools
import json
import math
import os
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import compare, sql_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollmill.llm import linededup, mixing, packing, quality, tokencount
from rollmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row int, ticket string, taken int, `__lines` string"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 7, "y") for r in rows], SCHEMA)


HARD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", "b"), (4, "one", "en", "b"), (None, "two words", "de", None), (5, "w " * 30_000, "en", "b"), (6, "x" * 50_000, "fr", "c")]


@pytest.mark.parametrize("name", ORACLES)
def test_queries_match_their_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), sql_rows(ORACLES[name], SF)) is None


# ---- mixing


def targets_by_hand(sizes, budget=None):
    """Shares by weight; what is above three times a size is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values()) if budget is None else budget), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_hand(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 10_000, 500]) for s in [None, "a", "B", "é", "zz", "z"][: rng.randrange(1, 7)]}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))


def test_mixing_takes_its_targets_in_whole_and_again(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice("aaaaaaaabcd")) for i in range(3000)]
    docs = frame(spark, rows + HARD)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) + len(HARD)
    sizes = defaultdict(int)
    for r in rows + HARD:
        sizes[r[3]] += len((r[1] or "").split())
    want, by = targets_by_hand(sizes), defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size
        by[round(r.target, 3)] += r.taken
    assert by == {round(t, 3): pytest.approx(sum(int(x) for x in want.values() if round(x, 3) == round(t, 3)), abs=3) for t in want.values()}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))


def test_mixed_documents_are_whole_rows(spark):
    rows = [(i, "w " * (1 + i % 50), "en", "abc"[i % 3]) for i in range(600)]
    docs = frame(spark, rows)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    times, taken = Counter(r.doc_id for r in mixed.collect()), {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert max(times.values()) == 2
    assert all(abs(times[i] - r.taken / r.size) <= 0.5 for i, r in taken.items())
    order = mixing.mix_order(mixing.mix_times(docs.select("doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size")))).select("finish").collect()
    assert [r.finish for r in order] == sorted(r.finish for r in order)


def test_the_mix_comes_in_the_order_of_finish_times_and_is_cut_at_the_budget(spark):
    rng = random.Random(8)
    docs = frame(spark, [(i, "w " * rng.randrange(1, 90), "en", rng.choice("aaabbc")) for i in range(900)])
    times = mixing.mix_times(docs.select("doc_id", "source", F.size(F.split(F.trim("text"), " ")).cast("long").alias("size"))).collect()
    whole = [r for r in times if 0 < r.taken and 2 * r.taken >= r.size]
    want = [r.doc_id for r in sorted(whole, key=lambda r: (r.finish, r.doc_id, r.epoch))]
    assert [r.doc_id for r in mixing.mix_documents(docs).collect()] == want
    firsts = [(r.first_finish, r.doc_id) for r in mixing.mix_sources(docs).collect()]
    assert firsts == sorted(firsts)
    sized = spark.createDataFrame([(1, "a", 6), (2, "b", 6)], "doc_id long, source string, size long")
    inner = sized.select("*", F.col("doc_id").alias("row"), F.lit(0).alias("epoch"), (F.col("doc_id") / 4).alias("finish"), F.col("size").alias("inner"))
    for budget, taken in ((0, [0, 0]), (4, [4, 0]), (9, [6, 3]), (20, [6, 6])):  # the total decides, not a source
        got = mixing.cut_at_budget(inner, spark.createDataFrame([(budget,)], "budget long")).orderBy("doc_id")
        assert [r.taken for r in got.collect()] == taken


# ---- quality


def stats_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_by_hand(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "é# ", " ", "<|x ", "\n", "\t"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += ["a b c d e f g h " * 2, "a " * 9, "a " * 8, "𝄞𝄞 x\n𝄞𝄞 x\n", "a b\nA b\na b \na b"]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(i + 1000, *r[1:]) for i, r in enumerate(HARD)])
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measured(docs).collect()}
    for i, t in [*enumerate(texts), *((k + 1000, r[1]) for k, r in enumerate(HARD))]:
        assert got[i] == stats_by_hand(t), t


def test_cutoffs_hold_their_risk(spark):
    """In en a rule with few false rejections is certified; in de labels are too few, in fr good documents fail it."""
    good = "lorem ipsum dolor sit amet " * 8
    rows, labels = [], []
    for i in range(3000):
        lang = "de" if i < 40 else "fr" if i < 1000 else "en"
        bad = i % 10 == 0
        words = [f"w{i}x{j}" for j in range(40)]
        text = " ".join(w + "###" if bad or lang == "fr" and i % 4 == 0 else w for w in words)
        rows.append((i, text, lang, "s"))
        labels.append((i, 0 if bad else 1, 0))
    got = quality.quality_verdicts(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] == (i % 10 != 0) for i in range(1000, 3000))
    assert all(kept[i] for i in range(1000))
    assert good and all(not r.base_failed for r in got)


def test_every_choice_of_cutoffs_by_hand(spark):
    """All choices, their exact tails and the best certified one; a stratum without good rows has none, a null stratum is one of its own."""
    rng, ladder, risk, delta = random.Random(5), (0.1, 0.3, 0.5), 0.05, 0.05
    rows = []
    for stratum, n in (("a", 900), ("b", 60), (None, 700), ("c", 500)):
        for _ in range(n):
            good = stratum != "c" and rng.random() < 0.8
            rows.append((stratum, good, *[rng.choice([0.0, 0.1, 0.2, 0.4, 0.9]) if rng.random() < (0.02 if good else 0.6) else 0.0 for _ in quality.RULES]))
    names = list(quality.RULES)
    frame_ = spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{r} double" for r in names))
    got = {r.stratum: r for r in quality.certified_cutoffs(frame_, risk=risk, delta=delta, cutoffs=ladder).collect()}
    want = {}
    for stratum in {r[0] for r in rows if r[1]}:
        mine = [r for r in rows if r[0] == stratum]
        n = sum(r[1] for r in mine)
        for choice in itertools.product(range(4), repeat=3):
            hit = [r for r in mine if any(i < 3 and x > ladder[i] for i, x in zip(choice, r[2:], strict=True))]
            k, bad = sum(r[1] for r in hit), sum(not r[1] for r in hit)
            tail = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
            if tail <= delta / (3 * (4**3 - 1)):
                want[stratum] = min(want.get(stratum, (1,)), (-bad, k, choice))
    assert set(want) == set(got) == {"a", None}
    for stratum, (bad, k, choice) in want.items():
        r = got[stratum]
        assert (r.n_bad_rejected, r.n_rejected) == (-bad, k) and [r[x] for x in names] == [ladder[i] if i < 3 else None for i in choice]


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_verdicts(frame(spark, HARD), none).collect()
    assert len(got) == len(HARD) and not any(r.kept for r in got if r.n_words < 20)
    assert quality.quality_verdicts(frame(spark, []), none).count() == 0
    assert quality.quality_verdicts(frame(spark, HARD), None).count() == len(HARD)


# ---- line dedup


def lines_by_hand(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    at, windows = {}, {}
    for i, t in docs:
        at[i] = [k for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
        lines = [x.strip(" \t\x0b\x0c\r") for x in (t or "").split("\n")]
        windows[i] = [tuple(lines[a] for a in at[i][k : k + 3]) for k in range(len(at[i]) - 2)]
    first = {}
    for i, _ in docs:
        for k, w in enumerate(windows[i]):
            first.setdefault(w, (i, k))
    out = {}
    for i, t in docs:
        gone = set()
        for k, w in enumerate(windows[i]):
            if first[w] != (i, k):
                gone |= set(range(max(k, first[w][1] + 3) if first[w][0] == i else k, k + 3))
        drop = {at[i][g] for g in gone}
        text = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in drop)
        out[i] = (len(at[i]), len(gone), t if not gone else "" if len(gone) == len(at[i]) else text)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", " c", "c ", "", "d\r", "é", " "]) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "q\nr"), (103, "q\nr\ns"), (104, "q\nr\ns"), (None, "q\nr\ns\nt"), (105, "z\n" * 20_000)]
    got = linededup.dedup_lines(frame(spark, [(*r, "en", "s") for r in rows])).collect()
    assert {r["__row"].doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in got} == lines_by_hand(rows)


def test_repeated_rows_are_not_removed_for_each_other(spark):
    got = linededup.dedup_lines(frame(spark, [(1, "a\nb\nc", "en", "s")] * 3 + [(2, "a\nb\nc", "en", "s")])).collect()
    assert sorted((r["__row"].doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (1, 0), (2, 3)]
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


# ---- packing and token counts

ODD = ["", "  ", " a", "a ", "a  b", "x\n y", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>", "O'ΑΣ. ΣΑΣ", "İstanbul é́", "　a b\x1cc\x85d"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice("aeéßñ'sStT 129²½ΣσςİıЖ日本語 \n\t.,!?ll'vé　 ") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_are_the_library_s():
    library, own = Tokenizer.from_file(BYTES), packing.ByteBpe(BYTES)
    texts = odd_texts(1, 1500)
    assert [own.ids(t) for t in texts] == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_library_s_at_every_prefix():
    library, own = Tokenizer.from_file(WORDS), tokencount.counter(WORDS)
    texts = odd_texts(2, 1500) + [json.dumps(list(range(500)))]
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert [own.count(t) for t in texts] == [count(t) for t in texts]
    for word in ("thereafter", "ciónéüstraße", "unbelievably", "日本語"):
        assert own.prefix_counts(word) == [count(word[:i]) for i in range(len(word) + 1)]
    for t in texts[:300]:
        for end, total in own.running(t):
            assert total == count(t[:end])
        for budget in (1, 3, 7):
            fits = own.fitting(t, budget)
            assert count(t[:fits]) <= budget
            if own.count(t) <= budget:
                assert fits == len(t)
            elif unicodedata.is_normalized("NFC", t) and all(len(c.lower()) == 1 for c in t) and "<|" not in t:
                assert t[:fits].rstrip() == t[: max(i for i in range(len(t)) if count(t[:i]) <= budget)].rstrip(), (t, budget)
    assert own.fitting("abcdefghij" * 100_000, 100) == max(i for i in range(2000) if count(("abcdefghij" * 200)[:i]) <= 100)


@pytest.mark.parametrize("seed", range(20))
def test_first_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.randrange(1, 101) for _ in range(rng.randrange(1, 200))])
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = (b, 100 - room[b])
        room[b] -= sizes[i]
    assert want == {i: (b, o) for i, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist(), strict=True))}


def test_packing_is_an_exact_cover(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(odd_texts(3, 300))] + [(1000, "many words here " * 3000, "en", "s"), (1001, None, "en", "s"), (1001, None, "en", "s"), (None, "x y", "en", "s")]
    got = packing.pack(frame(spark, rows), BYTES).collect()
    own, pieces, sequences = packing.ByteBpe(BYTES), defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in rows:
        ids = own.ids(t or "") + b"\0\0\0\0"
        times = sum(1 for r in rows if r[0] == i)
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in mine) == times * len(ids) // 4 and {r.doc_tokens for r in mine} == {len(ids) // 4}
        for r in mine:
            assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(r.length for r in got)
    assert len(sequences) * 1024 < used + 2 * 1024 or used / (len(sequences) * 1024) > 0.95
    assert packing.pack(frame(spark, []), BYTES).count() == 0


def test_token_counts_of_hard_rows(spark):
    library = Tokenizer.from_file(WORDS)
    rows = {(r.doc_id, r.n_bytes): r for r in tokencount.token_counts(frame(spark, HARD), WORDS).collect()}
    for i, t, *_ in HARD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        r = rows[i, len((t or "").encode())]
        assert (r.n_tokens, r.over_limit) == (n, n > 2048)
        assert len(library.encode((t or "")[: r.fitting_chars], add_special_tokens=False).ids) <= max(2048, 0) or not r.over_limit
    assert tokencount.token_counts(frame(spark, []), WORDS).count() == 0


assert os.path.exists(BYTES)
