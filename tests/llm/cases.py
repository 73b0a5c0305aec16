from __future__ import annotations

import random

EXTRA = ("x", 1, 2.0, "y", "z", 5, "w")
SCHEMA = "doc_id long, text string, lang string, source string, fp string, size int, score double, component_id string, digest string, anchor int, taken string"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    long, shared = words(30_000, 1), words(60, 2)
    rows = [
        (None, None, None, None), (None, words(50, 3), "en", None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b", None, "b"), (4, "12 34 !!", "en", "b"), (5, long, "fr", "a"), (6, long + " tail", "fr", "c"),
        (7, "É ÈÜ ñandú İstanbul ſecret 漢字 😀 é", "es", "ä"), (8, shared, "en", "a"), (8, shared, "en", "a"), (9, shared, "de", "b"), (10, words(20, 4) + " " + shared + " " + words(20, 5), "en", "c"),
        (11, "x" * 200_000, "en", "a"), (12, "1" * 30_000 + " " + "+1 2" * 3000, "en", "a"), (13, "password=" + "a" * 5000 + " token: 'abcdefgh1234'", "en", "a"), (14, (words(40, 6) + "\n") * 3, "en", "b"), (15, "Word", "en", "z"), (15, "other", "en", "z"),
    ]
    return rows
