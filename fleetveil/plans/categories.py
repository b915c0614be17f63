"""Web categories: which (parent, sub) pairs feed which output column."""

from __future__ import annotations

import re

# The 28 reported categories as (parent, sub), in report order.
# A sub of None takes every sub-category of the parent.
CATEGORIES: tuple[tuple[str, str | None], ...] = (
    ("content creation", "photo edit/creation"),
    ("content creation", "video/audio edit/creation"),
    ("content creation", "web design / development"),
    ("education", None),
    ("entertainment", "music / audio streaming"),
    ("entertainment", "other"),
    ("entertainment", "video streaming"),
    ("finance", None),
    ("games", "other"),
    ("games", "video games"),
    ("mail", None),
    ("news", None),
    ("other", None),
    ("private", None),
    ("productivity", "crm"),
    ("productivity", "other"),
    ("productivity", "presentations"),
    ("productivity", "programming"),
    ("productivity", "project management"),
    ("productivity", "spreadsheets"),
    ("productivity", "word processing"),
    ("recreation", "travel"),
    ("reference", None),
    ("search", None),
    ("shopping", None),
    ("social", "social network"),
    ("social", "communication"),
    ("social", "communication - live"),
)


def category_column(parent: str, sub: str | None) -> str:
    """Output column of a category: its words joined by underscores."""
    if (parent, sub) == ("other", None):
        return "unclassified"
    return re.sub(r"[^a-z]+", "_", f"{parent} {sub or ''}".strip())


CATEGORY_COLUMNS: list[str] = [category_column(p, s) for p, s in CATEGORIES]
