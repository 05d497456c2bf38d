from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fi", "go", "hu", "ix", "jo") for b in ("ra", "sto", "nix", "mel", "pur", "qat", "veé", "wis")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, digest int, chunk int, label int"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with planted repeats, copies, nulls, empty and long texts, repeated rows and clashing extra columns."""
    shared = prose(1, 60)
    texts = {
        0: prose(10, 80),
        1: prose(11, 40) + " " + shared + " " + prose(12, 30),
        2: shared,
        3: prose(13, 10) + "\n" + shared + "\t" + prose(14, 10),
        4: prose(10, 80),  # a copy of 0
        5: prose(10, 80).replace(" ", "  ", 3),  # equal after white space
        6: "",
        7: None,
        8: " \n\t ",
        9: " ".join(prose(13, 12).split()[:12]),  # shorter than a window
        10: "a " * 400,  # repeats itself
        11: "a " * 200,
        12: prose(20, 20_000),  # long
        13: prose(20, 20_000)[:40_000] + prose(21, 100),
        14: "naïve ☃ café 🚣 " * 30,
        15: prose(15, 100),
        16: " ".join(w if i != 50 else "other" for i, w in enumerate(prose(15, 100).split())),  # nearly 15
        17: "x" * 5000,  # one long word
        18: "x" * 4990,
        19: prose(16, 13),  # one window
        20: prose(16, 13),
        21: prose(17, 12),
        22: prose(17, 12),
    }
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, 1, 0.5, "no", 7, 8, 9) for i, t in texts.items()]
    rows.append(rows[3])  # a repeated row
    rows.append((None, shared, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
