"""Small documents with every awkward case, and brute-force versions in plain Python."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, id string, root int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng, n: int, pool: int = 400) -> str:
    """Words of a pool, with white space of all kinds between them."""
    return "".join(f"w{rng.randrange(pool)}" + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\x0b"]) for _ in range(n)).strip()


def frame(spark, texts, first: int = 0, sources=("a", "b", None), langs=("en", None)):
    """Documents with extra columns whose names operators use inside."""
    rows = [(first + i, t, langs[i % len(langs)], sources[i % len(sources)], None, 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)
