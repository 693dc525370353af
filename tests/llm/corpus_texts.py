"""Texts for the operators' tests."""

import random

WORDS = "one two three four five six seven eight nine ten stone river cloud light green paper table north water house".split()
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ITEM = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(400)) for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    rnd, parts = random.Random(seed), text.split()
    for _ in range(edits):
        parts[rnd.randrange(len(parts))] = f"edit{seed}x{rnd.randrange(1000)}"
    return " ".join(parts)
