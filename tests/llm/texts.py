"""Invented texts for the tests."""

import random


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    vocabulary = [f"w{k}" for k in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))
