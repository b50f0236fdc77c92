from __future__ import annotations

import random

import pytest

VOCABULARY = [a + b for a in ("ta", "ro", "mi", "ske", "lun", "or", "ved") for b in ("n", "dra", "pel", "ost", "ik", "u", "em")]


@pytest.fixture(scope="session")
def prose():
    """``prose(seed, n)``: n made-up words."""

    def make(seed: int, n: int) -> str:
        chosen = random.Random(seed)
        return " ".join(chosen.choice(VOCABULARY) + str(chosen.randrange(9)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs(spark):
    """``docs((1, "text"), ...)``: a documents table with columns whose names also occur inside the operators."""

    def make(*rows):
        ddl = (
            "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, a int, band string, "
            "component string, part string, length string, rank string, kept string, word string, path string"
        )
        return spark.createDataFrame([(*r, *[None] * (15 - len(r))) for r in rows], ddl)

    return make
