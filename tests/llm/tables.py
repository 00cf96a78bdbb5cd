"""Small tables with every awkward row, and plain versions of the contracts."""

from __future__ import annotations

import re
from collections import Counter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("alpha", "beta", "gamma", "delta", "épée", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu")


def prose(seed: int, n: int) -> str:
    """Words in a fixed shuffled order, a line break now and then."""
    out, state = [], seed * 7919 + 1
    for i in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state // 65536 % len(WORDS)] + str(state // 1024 % 50) + ("\n" if state % 17 == 0 else " "))
    return "".join(out).strip()


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeats and ties."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (3, base + " x1 y2", "en", "s2"), (3, base + " x1 y2", "en", "s2"),
        (4, "", "en", "s1"), (5, None, "en", "s1"), (6, " \n\t ", None, "s2"), (7, "one", "fr", None),
        (8, "One", "fr", "s2"), (9, "two words", None, None), (None, prose(2, 60), "en", "s1"), (None, None, None, None),
        (None, base, "en", "s1"), (10, prose(3, 30_000), "de", "s3"), (11, "x" * 100_000, "de", "s3"),
        (12, "naïve ÀÉ ß 漢字 🎈 end\n\n", "en", "s1"), (13, "a b c " * 200, "en", "s1"), (-5, prose(5, 80), "en", "s3"),
        (14, "menu | home\n" + prose(6, 90), "en", "s4"), (15, "menu | home\n" + prose(7, 90), "en", "s4"),
        (16, "menu | home\n" + prose(8, 90), "en", "s4"), (17, "menu | home", "en", "s4"), (18, prose(9, 70), "en", "s4"),
    ]
    return [(*row, None if row[1] is None else len(row[1])) for row in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, DOCUMENTS)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)
