"""The conversation trie against one built in memory, and against its SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import compare, sql_rows

from rollmill.llm import trie
from rollmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, h1 string, base string, copy int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(parts)


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    built = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if built[c] == path)
        yield convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()


def found(df):
    return Counter(tuple(r) for r in df.collect())


def some(seed, convs, longest, spread=250):
    """Conversations over few texts, so that they share turns within and across families; some rows lack parts, some numbers repeat."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-spread, spread * 2), convs):
        for turn in range(r.randint(1, longest)):
            rows.append((c, r.choice([turn] * 9 + [None, 3]), r.choice(["user", "assistant", None]) if turn > 2 else "user", r.choice(["a", "bé", "", None, "long one"]) if turn % 3 else "first"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_a_trie_in_memory(spark, seed):
    rows = some(seed, 120, 8)
    assert found(trie.conversation_trie(frame(spark, rows))) == Counter(by_hand(rows))


@pytest.mark.parametrize("stretch", [6, 16])
def test_long_conversations_in_stretches(spark, stretch):
    """Positions, hashes and subtree sums are carried over stretches and over range partitions."""
    rows = some(9, 25, 90, 60)
    rows += [(c, i, "user", "same" if i != at else "other") for c, at in ((100, -1), (101, 40), (102, 41), (103, -1), (7, -1)) for i in range(70 + c % 3)]
    rows += [(200, 1, "user", "again")] * 100
    assert found(trie.conversation_trie(frame(spark, rows, 7), stretch)) == Counter(by_hand(rows))


def test_hard_rows(spark):
    rows = [(None, 0, "user", "nobody"), (0, 0, "u", "x" * 100_000), (1, None, None, None), (1, None, None, None), (5, 2, "", ""), (-3, 0, "u", "x" * 100_000), (2**62, 0, "u", "é")]
    assert found(trie.conversation_trie(frame(spark, rows))) == Counter(by_hand(rows))
    assert trie.conversation_trie(frame(spark, rows).limit(0)).count() == 0


def test_families_that_share_a_conversation(spark):
    """A first turn and a whole conversation that all families share."""
    rows = [(c, i, "user", t) for c in range(1500) for i, t in enumerate(["hello", "common", "end"] if c % 2 else ["hello", f"own {c % 7}"])]
    assert found(trie.conversation_trie(frame(spark, rows))) == Counter(by_hand(rows))


def test_whole_table_by_sql(spark):
    assert compare(QUERIES["op12_trie"](spark, SF).toPandas(), sql_rows(ORACLES["op12_trie"], SF)) is None
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_trie"](spark, SF)) == Counter(by_hand(rows))
