"""The whole pipeline against plain versions of its five stages."""

import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_neardup import kept_by_hand
from test_text_operators import lines_by_hand, stats_by_hand, targets_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from rollmill.llm import stages


def good_by_hand(text):
    """The base rule; so few labels certify no cutoff."""
    words, _, _, _, repeated = stats_by_hand(text)
    return words >= 20 and 100 * repeated <= 30 * words


def mix_by_hand(docs):
    """``(doc_id, source, text)`` as often as the mix takes them: those of which it takes half or more."""
    size = {d: stats_by_hand(t)[0] for d, _, t in docs}
    total = Counter()
    for d, s, _ in docs:
        total[s] += size[d]
    target, out = targets_by_hand(dict(total)), []
    for source in total:
        served = 0
        for epoch in range(max(1, min(3, -int(-target[source] // total[source])))):
            own = sorted((hashlib.md5(f"{d}:{epoch}".encode()).hexdigest(), d, t) for d, s, t in docs if s == source)
            for _, d, t in own:
                taken = max(0, min(size[d], int(target[source] + 1e-9) - served))
                served += size[d]
                if taken and 2 * taken >= size[d]:
                    out.append((d, t))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_every_row_of_the_pipeline(spark, sf):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [r for r in rows if good_by_hand(r[2])]
    lines = lines_by_hand([(d, t) for d, _, t in rows])
    rows = [(d, s, lines[d][2]) for d, s, t in rows]
    stay = set(kept_by_hand([(d, t) for d, _, t in rows]))
    rows = [r for r in rows if r[0] in stay]
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in mix_by_hand(rows):
        ids = [*encode.encode(t, add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            part = ids[at : at + 1024]
            want[d, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids)] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_hard_rows_pass_every_stage(spark, tmp_path):
    """Nulls, blanks, very long texts, repeated rows and clashing names."""
    long = " ".join(f"w{i}" for i in range(60_000))
    base = " ".join(f"v{i}" for i in range(40))
    rows = [(1, None, None, None, None, 1), (None, base, "en", None, 5, 1), (2, "", "en", "a", 0, 1), (3, long, None, "a", 9, 1), (4, base, "en", "b", 9, 1), (4, base, "en", "b", 9, 1), (5, "x " * 30, "en", "b", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row int")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = None
    for name, stage in stages.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "near dedup":
            kept = sorted((r.doc_id for r in got), key=str)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(got, docs.schema)
    assert kept == [3, 4]
    assert {r.doc_id for r in got} == {3, 4}
