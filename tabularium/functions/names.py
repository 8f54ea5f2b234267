"""Column-name rules: snake_case names, semantic types, word sets."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

# Keyword lists per semantic type, in evaluation order; must equal the reference's.
SEMANTIC_KEYWORDS = [
    ("name", ["name", "title", "label"]),
    ("email", ["email", "mail"]),
    ("phone", ["phone", "tel", "mobile"]),
    ("address", ["address", "street", "city", "zip"]),
    ("datetime", ["date", "time", "created", "updated"]),
    ("monetary_amount", ["price", "cost", "amount", "salary", "revenue"]),
    ("identifier", ["id", "key", "uuid"]),
    ("numeric", ["count", "number", "quantity", "age"]),
    ("url", ["url", "link", "website"]),
    ("category", ["category", "type", "status", "group"]),
]


@lru_cache(maxsize=10_000)
def snake_case(name: str) -> str:
    """Lower-case words joined by single underscores."""
    return re.sub(r"[\W_]+", "_", name.lower()).strip("_")


def unique_snake_case(names: Iterable[str]) -> list[str]:
    """Snake-case every name; unnamed columns become ``column_<position>``, repeats get ``_1``, ``_2``."""
    taken: dict[str, None] = {}
    for position, name in enumerate(names):
        base = snake_case(name) or f"column_{position}"
        candidate, n = base, 0
        while candidate in taken:
            n += 1
            candidate = f"{base}_{n}"
        taken[candidate] = None
    return list(taken)


def semantic_type_of_name(name: str) -> str | None:
    lowered = name.lower()
    return next((kind for kind, words in SEMANTIC_KEYWORDS if any(w in lowered for w in words)), None)
