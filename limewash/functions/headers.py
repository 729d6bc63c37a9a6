"""Column-name clean-up. Works on names only (driver metadata), never on data."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Sequence

import regex as re

from limewash.functions.constants import (
    HEADER_MATCH_CUTOFF,
    HEADER_TOKEN_MAX_LENGTH,
    HEADER_WORDS,
)


_MARK = re.compile(r"\p{Mn}+")


def tidy(name: str) -> str:
    """A name in plain letters, words capitalised and parted by single spaces."""
    return " ".join(_MARK.sub("", unicodedata.normalize("NFD", name)).split()).lower().title()


def respell(name: str) -> str:
    """Replace short words that nearly are common header words by those."""
    guesses = {
        word: difflib.get_close_matches(word.lower(), HEADER_WORDS, n=1, cutoff=HEADER_MATCH_CUTOFF)
        for word in name.split() if len(word) <= HEADER_TOKEN_MAX_LENGTH
    }
    return " ".join(guesses[word][0].title() if guesses.get(word) else word for word in name.split())


def clean_headers(names: Sequence[str], fix_spelling: bool = True) -> list[str]:
    """New names in the same order.

    Every distinct name proposes a clean one. Of the names with one proposal the first gets it, and
    none if a column has that name already; the others keep what they had.
    """
    old = [str(name).strip() for name in names]
    proposals = {name: respell(tidy(name)) if fix_spelling else tidy(name) for name in old}
    winners: dict[str, str] = {}
    for name, proposal in proposals.items():
        winners.setdefault(proposal, name)
    given = {name: new for new, name in winners.items() if new and new not in proposals}
    return [given.get(name, name) for name in old]
