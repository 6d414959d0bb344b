"""The two rule sets, as data.

``OUTLINE_PROFILE`` builds outlines; ``SECTION_PROFILE`` cuts documents into sections for ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

from quire.functions.text import LEADING_DIGIT, NUMBERED

BODY = "Body"
TITLE = "Title"

# Least confidence a level needs.
LEVEL_CONFIDENCE = {"Title": 0.6, "H1": 0.6, "H2": 0.65, "H3": 0.7, "Body": 0.3}


@dataclass(frozen=True)
class Profile:
    sort_blocks: bool
    strip_controls: bool
    min_body_size: float | None
    number_pattern: str
    neighbours: bool
    reject_patterns: tuple[str, ...]
    max_words: int
    max_digits: int | None
    min_words: int = 0
    generic_names: tuple[str, ...] = ()
    reject_trailing_dot: bool = False


# Patterns, names and limits of the outline rules.
OUTLINE_PROFILE = Profile(
    sort_blocks=True,
    strip_controls=True,
    min_body_size=4.0,
    number_pattern=NUMBERED,
    neighbours=True,
    reject_patterns=(
        r"^(table\s+of\s+)?contents?$",
        r"list\s+of\s+(figures|tables)",
        r"figure\s+\d",
        r"box\s+\d",
        r"table\s+\d",
        r"revision\s+history",
        r"references?$",
        r"bibliography",
        r"acknowledgments?",
        r"appendix\s+[A-Z0-9]",
        r"glossary",
        r"annex\s+[A-Z0-9]",
    ),
    max_words=25,
    max_digits=3,
)

# Patterns, names and limits of the section rules.
SECTION_PROFILE = Profile(
    sort_blocks=False,
    strip_controls=False,
    min_body_size=None,
    number_pattern=LEADING_DIGIT,
    neighbours=False,
    reject_patterns=(
        r"table of contents",
        r"list of figures",
        r"references",
        r"index",
        r"glossary",
    ),
    max_words=30,
    max_digits=None,
    min_words=2,
    generic_names=(
        "introduction", "conclusion", "abstract", "foreword", "summary", "appendix", "background",
        "methodology",
    ),
    reject_trailing_dot=True,
)

# First words that never open a section.
SECTION_CONTINUERS = ("ingredients", "instructions", "method")
SECTION_LEVELS = ("Title", "H1", "H2", "H3")
