"""Block matching by grams against difflib, and its cost on a long pair."""

import difflib
import random
import time

from utterlake.operators.matching import ratio


def test_ratio_equals_difflib():
    r = random.Random(1)
    for t in range(600):
        letters = "ab" if t % 3 == 0 else "abcdefgh "
        a = "".join(r.choice(letters) for _ in range(r.randint(0, 120)))
        b = list(a)
        for _ in range(r.randint(0, 12)):
            p, c = r.randint(0, len(b)), r.random()
            if c < 0.4:
                del b[p : p + r.randint(1, 6)]
            elif c < 0.8:
                b[p:p] = [r.choice(letters) for _ in range(r.randint(1, 9))]
            else:
                b += b[p : p + 30]
        b = "".join(b)
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert ratio(a, b) == ratio(a, b, 1) == ratio(list(a), list(b)) == want


def test_long_pair_is_not_quadratic():
    r = random.Random(2)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    a, b = " ".join(words), " ".join(w for i, w in enumerate(words, 1) if i % 7)
    t = time.time()
    assert 0.9 < ratio(a, b) < 0.95
    assert time.time() - t < 20
