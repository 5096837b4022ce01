"""Matching of group sizes against the plain search, and its cost."""

import hashlib
import random
import time

from grainmill.operators import relational as re_


def plain(heavy, light, seed):
    tie = lambda name: hashlib.md5(f"{seed}|{name}".encode()).hexdigest()
    free, out = dict(light), []
    for name, size in sorted(heavy, key=lambda x: (-x[1], tie(x[0]))):
        if not free:
            break
        best = min(free, key=lambda k: (abs(free[k] - size), tie(k)))
        out.append((name, best))
        del free[best]
    return out


def test_matches_are_those_of_the_plain_search():
    rng = random.Random(4)
    for _ in range(300):
        heavy = [(f"h{k}", rng.randrange(rng.choice((3, 40)))) for k in range(rng.randrange(30))]
        light = [(f"l{k}", rng.randrange(rng.choice((3, 40)))) for k in range(rng.randrange(30))]
        assert re_.match_sizes(heavy, light, "42") == plain(heavy, light, "42")


def test_many_groups_are_matched_in_little_time():
    """40,000 on each side: the plain search compares 800 million."""
    heavy, light = [(f"h{k}", k % 97) for k in range(40_000)], [(f"l{k}", k % 31 + k // 1000) for k in range(40_000)]
    began = time.time()
    assert len(re_.match_sizes(heavy, light, "42")) == 40_000
    assert time.time() - began < 20
