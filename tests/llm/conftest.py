import zlib

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over one lazy dog while seven small birds sing near an old stone bridge".split()


def sentence(n, seed=0):
    """n repeatable words, few of them repeated in the same order."""
    return " ".join(f"{WORDS[zlib.crc32(f'{seed}:{k}'.encode()) % len(WORDS)]}{zlib.crc32(f'{k}/{seed}'.encode()) % 97}" for k in range(n))


@pytest.fixture
def docs(spark):
    """Makes a documents table of (id, text) or full rows, with columns whose names clash with results."""

    def make(rows, partitions=3):
        full = [(r if len(r) == 5 else (r[0], r[1], "en", "s0", len(r[1] or ""))) + ("x", True, 7) for r in rows]
        extra = COLUMNS + ", score string, kept boolean, k long"
        return spark.createDataFrame(full, extra).repartition(partitions)

    return make


#: Rows that every operator must take.
AWKWARD = [
    (None, None, None, None, None),
    (None, "null id", "en", "s0", 7),
    (1, None, "en", None, None),
    (2, "", "en", "s0", 0),
    (3, " \t\n\r\x0b\x0c ", None, "s0", 7),
    (4, "one", "en", "s0", 3),
    (5, sentence(120, 1), "en", "s0", 0),
    (6, sentence(120, 1), "en", "s0", 0),
    (6, sentence(120, 1), "en", "s0", 0),
    (7, sentence(9000, 2), "de", "s1", 0),
    (8, "é" * 5000 + " ü ß \U0001f600", "fr", "s1", 0),
]
