"""Piece encoding against the library, alignment against a comparison of all byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollmill.llm import align, pieces
from rollmill.llm.packing import byte_symbols
from rollmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "a", "th", "e", "in", "▁", "\n", "\t", "\r", ";", "é", "漢", "字", "😀", "́", "1", "<0x41>", "</s>", "<|endoftext|>", "\x00", "ing", "tion", "�", "한", "\x85", "\x1c", "　", "aaa", "))", "'s"]
ALL_ROWS = [(1, ""), (2, None), (None, "no id"), (3, "twice the same"), (3, "twice the same"), (4, "a▁b"), (5, "   "), (6, "x" * 70_000 + " é\n" * 9_000)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=B)


def odd_texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    mixed = ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(n)]
    return mixed + [" ".join("".join(r.choice("etaoinshr.,\n") for _ in range(r.randint(0, 9))) for _ in range(9)) for _ in range(n)]


def test_ids_and_text_are_those_of_the_library(library):
    bpe = pieces.PieceBpe(B)
    for text in odd_texts(3, 3000):
        ids = library.encode(text)
        assert [int.from_bytes(x, "little") for x in [bpe.encode(text)[i : i + 4] for i in range(0, 4 * len(ids), 4)]] == ids, text
        assert bpe.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(library):
    bpe, r = pieces.PieceBpe(B), random.Random(4)
    for _ in range(5000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(5), 259, 260, 28705]) for _ in range(r.randint(0, 12))]
        assert bpe.decode(ids) == library.decode(ids), ids


def test_each_prefix_has_one_last_token():
    """Of all pieces that end at a place only one goes with the token before it."""
    bpe = pieces.PieceBpe(B)
    for word in ("▁internationalisation", "▁aaaaaaaa", "▁▁▁▁▁x", "▁tttttttttt", "▁();();\r"):
        last = bpe.table(word)
        for at, token, size in [(k + 1, *known) for k, known in bpe._odd(word)]:
            before = last[at - size]
            fits = at == size or before >= 0 and bpe.together(before, token)
            assert fits == (token == last[at])


def test_vocabularies_of_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(B, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="normalising"):
        pieces.PieceBpe(str(path))


def test_op13_whole_table(spark, library, sf=SF):
    got = {r.doc_id: r for r in QUERIES["op13_pieces"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[doc.doc_id].n_tokens, got[doc.doc_id].ids_sha256, got[doc.doc_id].decoded_sha256) == want


def test_hard_rows_of_both(spark, library):
    rows = spark.createDataFrame(ALL_ROWS, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("pairs", F.lit(0)).withColumn("__row", F.lit(1))
    both = pieces.decode(pieces.encode(rows, B), B).collect()
    want = [(i, library.encode(t or "")) for i, t in ALL_ROWS]
    assert sorted(map(str, [(r.doc_id, r.ids) for r in both])) == sorted(map(str, want))
    assert sorted(r.decoded for r in both) == sorted(library.decode(ids) for _, ids in want)
    scores, _ = align.align_and_score(rows, A, B)
    got = Counter(tuple(r) for r in scores.collect())
    assert got == Counter(by_hand(ALL_ROWS))
    empty = rows.limit(0)
    assert pieces.decode(pieces.encode(empty, B), B).count() == 0 and align.align_and_score(empty, A, B)[0].count() == 0


def linked(text, a, b):
    """Ids, groups and linked pairs of a text: by comparing byte ranges of all tokens near each other, without union-find."""
    if not text:
        return [], [], [], []
    back = {s: byte for byte, s in byte_symbols().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 2000 else __import__("itertools").accumulate(map(len, parts))
    ends_a, ends_b = list(ends(bytes_a)), list(ends(bytes_b))
    groups, low = [], 0
    at_a = at_b = 0
    pairs = []
    for cut in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = ends_a.index(cut, at_a) + 1, ends_b.index(cut, at_b) + 1
        groups.append((ids_a[at_a:to_a], ids_b[at_b:to_b]))
        for i in range(at_a, to_a):
            for j in range(at_b, to_b):
                if max(ends_a[i] - len(bytes_a[i]), ends_b[j] - len(bytes_b[j])) < min(ends_a[i], ends_b[j]):
                    pairs.append((ids_a[i], ids_b[j]))
        at_a, at_b, low = to_a, to_b, cut
    return ids_a, ids_b, groups, pairs


def by_hand(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    done = [(doc_id, *linked(text, a, b)) for doc_id, text in rows]
    count = Counter(p for d in done for p in d[4])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    for doc_id, ids_a, ids_b, groups, pairs in done:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield (
            doc_id, len(ids_a), len(ids_b), len(groups), len(pairs), hashlib.sha256(shown.encode()).hexdigest() if ids_a else "",
            sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs),
        )


def test_alignment_of_odd_texts(spark):
    rows = list(enumerate(odd_texts(5, 1500)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    scores, counts = align.align_and_score(docs, A, B)
    assert {tuple(r) for r in scores.collect()} == set(by_hand(rows))
    assert counts.groupBy("a", "b").count().where("count > 1").count() == 0


def test_op11_whole_table(spark, sf=SF):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_align"](spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert {tuple(r) for r in got.collect()} == set(by_hand(docs))


def test_large_pair_tables_are_joined_by_a_shuffle(spark, monkeypatch):
    """Beyond the size that is sent to executors, with frequent pairs dealt out, the scores are the same."""
    rows = [(i, f"the cat and the dog, no. {i}. " * 3) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(align, "SENT", 0)
    monkeypatch.setattr("rollmill.llm.common.KEY_ROWS", 50)
    scores, _ = align.align_and_score(docs, A, B)
    assert {tuple(r) for r in scores.collect()} == set(by_hand(rows))
