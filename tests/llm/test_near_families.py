"""Families of edited copies whose similarities lie on both sides of 0.8, where the nearest link is often no link."""

import random

from tests.llm.test_near_shingles import _found, _plain


def test_every_similar_pair_is_found(spark):
    dice, rows = random.Random(11), []
    for family in range(60):
        length = dice.choice([9, 24, 60, 130, 200])
        base = [f"f{family}w{i}" for i in range(length)]
        for _ in range(dice.choice([2, 3, 8, 20])):
            words = list(base)
            for _ in range(max(1, round(length * dice.uniform(0.006, 0.024)))):
                words[dice.randrange(length)] = f"x{dice.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(words)))
    dice.shuffle(rows)
    assert _found(spark, rows) == _plain(rows)
