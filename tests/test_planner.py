"""The subscription planner, by hand and by its limits."""

import random

from tidemark.streaming import planner


def run(rows, limits):
    s, out = planner.planner_start(), []
    for at, demands in rows:
        out.append(planner.planner_step(s, (float(at), [dict(zip(("stock", "priority", "signals", "observed"), d, strict=True)) for d in demands]), limits))
    return out


def test_cooling_down_and_together():
    limits = planner.Limits(target=2, hard=3, cooldown=60, together=1)
    a, b, c, d = ((k, k, 1, 0.0) for k in (1, 2, 3, 4))
    got = run([(0, [b, a, c]), (0.5, [d]), (2, [c, d]), (30, [c, d]), (62, [c, d]), (63, [a, c]), (64, [])], limits)
    assert got[0] == ([1, 2], [1, 2], [], [], [3], False)
    assert got[1] == ([1, 2], [], [], [], [4], True)  # half a second later: nothing changes
    assert got[2] == ([1, 3, 4], [3, 4], [2], [1], [], False)  # one of the two cools down, no room for the other
    assert got[3] == ([1, 3, 4], [], [], [1], [], False)
    assert got[4] == ([3, 4], [], [1], [], [], False)  # sixty seconds after it was wanted last
    assert got[5] == ([3, 4, 1], [1], [], [4], [], False)
    assert got[6] == ([3, 4, 1], [], [], [3, 4, 1], [], False)


def test_limits_hold():
    r, limits = random.Random(4), planner.Limits(target=5, hard=7, cooldown=40, together=3)
    rows = [(i * r.choice([1, 2, 5]) + 10 * i, [(k, r.randint(1, 4), r.randint(1, 3), float(i)) for k in r.sample(range(30), r.randint(0, 12))]) for i in range(300)]
    before: list = []
    for (_, demands), (now, added, removed, cooling, supplement, together) in zip(rows, run(rows, limits), strict=True):
        wanted = {d[0] for d in demands}
        assert len(now) <= limits.hard and len(set(now)) == len(now) and set(now) == (set(before) | set(added)) - set(removed)
        assert set(supplement) == wanted - set(now) and (together or len(set(now) - set(cooling)) <= limits.target)
        assert [k for k in before if k in now] == [k for k in now if k in before]  # order kept
        before = now
