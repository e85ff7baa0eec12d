"""Small texts with the awkward cases: copies, near copies, nulls, blanks, one very long text, repeated rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles long, score string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def documents(seed: int = 5, families: int = 12) -> list[tuple]:
    """Rows of SCHEMA; the last columns clash with names that operators use."""
    rng, texts = random.Random(seed), []
    for _ in range(families):
        base = words(rng, rng.choice([3, 6, 7, 12, 40, 120]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(" ".join(copy[i:i + 15]) for i in range(0, len(copy), 15)))
    texts += [None, "", "  \n\t ", "one", "One", "a b c", " ".join(words(rng, 30_000)), "x" * 5000 + " y z w v", "naïve Ünïcode 語 テスト ok fine"]
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None]), 0, -1, "x") for i, t in enumerate(texts)]
    return rows + rows[:3] + [(None, "a row without an id", None, "s1", 0, -1, "x")]
