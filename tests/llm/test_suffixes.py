import random

import pytest

from rollmill.llm.suffixes import common_prefixes, repeated_starts, suffix_array


@pytest.mark.parametrize("seed", range(300))
def test_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    s = [rng.randrange(rng.choice([1, 2, 3, 5, 200])) for _ in range(rng.randrange(120))]
    if seed % 3 == 0:
        s = s[:10] * rng.randrange(1, 9)
    sa = suffix_array(s)
    assert sa == sorted(range(len(s)), key=lambda i: s[i:])
    lcp = common_prefixes(s, sa, -1)
    for r in range(1, len(sa)):
        a, b = s[sa[r - 1] :], s[sa[r] :]
        assert lcp[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_fibonacci_and_runs():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    for s in (b, [3] * 500, [1, 0] * 200, list(range(300)), list(range(300, 0, -1)), []):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeats_stop_at_separators():
    s = [1, 2, 3, 0, 1, 2, 4, 0, 9, 2, 3, 0]
    flags = repeated_starts(s, [1] * len(s), 2, 0)
    assert [i for i, f in enumerate(flags) if f] == [0, 1, 4, 9]
