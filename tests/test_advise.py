"""The choice of rollups against one by hand, and against the best choice of all."""

import itertools
import random

from rollmill.jobs.advise import advise_rollups

RAW = 10_000


def cost(shape, chosen, size):
    return min([RAW, *[size[c] for c in chosen if set(shape[0]) <= set(c[0]) and shape[1] % c[1] == 0]])


def test_greedy_choices_on_small_lattices(spark):
    r = random.Random(1)
    for _ in range(4):
        tagsets = [tuple(t) for n in range(3) for t in itertools.combinations("ab", n)]
        size = {(t, w): r.randrange(10, 9000) for t in tagsets for w in (60, 120, 300, 600)}
        shapes = {s: r.randrange(1, 30) for s in r.sample(list(itertools.product(tagsets, (60, 120, 600, 90))), 8)}
        total = lambda chosen: sum(n * cost(s, chosen, size) for s, n in shapes.items())
        log = spark.createDataFrame([(list(t), w) for (t, w), n in shapes.items() for _ in range(n)], "tags array<string>, window_s long")
        got = advise_rollups(log, spark.createDataFrame([(list(t), w, n) for (t, w), n in size.items()], "r_tags array<string>, r_window long, rows long"), RAW, 3)
        chosen = []
        for row in sorted(got.collect()):
            gains = {c: total(chosen) - total([*chosen, c]) for c in size}
            best = min(size, key=lambda c: (-gains[c], size[c], c))
            assert (tuple(row.r_tags), row.r_window, row["rows"], row.benefit) == (*best, size[best], gains[best])
            chosen.append(best)
        most = max(total([]) - total(some) for some in itertools.combinations(size, len(chosen)))
        assert total([]) - total(chosen) >= 0.63 * most


def test_nothing_to_advise(spark):
    log = spark.createDataFrame([], "tags array<string>, window_s long")
    assert advise_rollups(log, spark.createDataFrame([([], 60, 5)], "r_tags array<string>, r_window long, rows long"), RAW, 2).count() == 0
