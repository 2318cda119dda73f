"""Communities merged or split to a given number of parts."""

import random

from lodegraph.operators import composite as C


def test_merging_equals_one_merge_after_the_other():
    """Held by the same rule on single clusters: the two smallest, of equal ones those that came first."""
    rng = random.Random(2)
    for parts in (1, 2, 4, 7):
        for _ in range(30):
            sizes = sorted(rng.choice((1, 1, 1, 2, 3, 5, 8, 13)) for _ in range(rng.randrange(parts, 60)))
            groups = [(n, k, {k}) for k, n in enumerate(sizes)]
            while len(groups) > parts:
                groups.sort(key=lambda g: g[0])  # stable: equal ones stay in the order that they came
                groups = [*groups[2:], (groups[0][0] + groups[1][0], 0, groups[0][2] | groups[1][2])]
            got = C.merged([(n, sizes.count(n)) for n in sorted(set(sizes))], parts)
            assert [hi for _, hi, _ in got] == [lo for lo, _, _ in got[1:]] + [len(sizes)] and got[0][0] == 0
            total = [sum(sum(sizes[lo:hi]) for lo, hi, p in got if p == k) for k in range(parts)]
            assert total == sorted((g[0] for g in groups), reverse=True)


def test_more_communities_than_parts_merge_the_smallest(spark):
    """Four cliques of 6, 5, 4 and 3 and two vertices alone for three parts: 1+1=2, 2+3=5, 4+5=9 (the 5 merged is the later)."""
    cliques, e, at = (6, 5, 4, 3), [], 0
    for n in cliques:
        e += [(at + a, at + b) for a in range(n) for b in range(a + 1, n)]
        at += n
    got = C.partition(spark.range(20).select("id"), spark.createDataFrame(e, "src long, dst long"), 3)
    part = {r["id"]: r["part"] for r in got.collect()}
    assert part == {**{k: 1 for k in range(6)}, **{k: 0 for k in range(6, 15)}, **{k: 2 for k in range(15, 20)}}


def test_fewer_communities_than_parts_split_the_largest(spark):
    """Two stars: the larger one loses its hub, so its first leaf stays with the hub and the rest goes; then the next largest."""
    e = [(k, 0) for k in range(1, 4)] + [(0, 4), (0, 5)] + [(20, 21), (21, 22), (22, 20)]
    v = spark.createDataFrame([(k,) for k in [*range(6), 20, 21, 22]], "id long")
    part = {r["id"]: r["part"] for r in C.partition(v, spark.createDataFrame(e, "src long, dst long"), 3).collect()}
    assert part == {0: 0, 1: 0, **{k: 2 for k in range(2, 6)}, 20: 1, 21: 1, 22: 1}
    assert C.partition(v.limit(0), spark.createDataFrame([], "src long, dst long"), 3).count() == 0
