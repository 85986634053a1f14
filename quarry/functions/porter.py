"""Porter's 1980 suffix stripping, written from the paper.

A consonant ``y`` is written ``Y`` while the steps run, which turns the paper's measure and
vowel tests into plain character classes. Spark calls this once per distinct word of an
Arrow batch (see ``functions.text``).
"""

from __future__ import annotations

import re
from functools import lru_cache

# The suffix rules of the published algorithm.
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

# Measure tests on a stem with marked consonants.
ANY_VOWEL = "[aeiouy]"
M_OVER_0 = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
M_OVER_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
M_IS_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]*$"
CVC = "[^aeiouy][aeiouy][^aeiouywxY]$"


def ends_with_any(suffixes) -> str:
    """Longest listed suffix: the leftmost match of an end-anchored alternation."""
    return f"(?:{'|'.join(suffixes)})$"


_has_vowel = re.compile(ANY_VOWEL).search
_m_over_0 = re.compile(M_OVER_0).search
_m_over_1 = re.compile(M_OVER_1).search
_m_is_1 = re.compile(M_IS_1).search
_cvc = re.compile(CVC).search
_mark_y = re.compile("(^|[aeiouy])y").sub
_terminal_y = re.compile("[aeiouy].*[yY]$").search
_ends = {n: re.compile(ends_with_any(s)).search for n, s in
         [("1a", STEP_1A), ("1b", ["eed", "ed", "ing"]), ("2", STEP_2), ("3", STEP_3), ("4", STEP_4)]}


def _strip(word: str, step: str) -> tuple[str, str]:
    """``(base, suffix)`` for the longest suffix the step lists; an empty suffix if none."""
    found = _ends[step](word)
    return (word[: found.start()], found.group()) if found else (word, "")


def _repaired(base: str) -> str:
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) > 1 and base[-1] == base[-2] and not _has_vowel(base[-1]):
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if _m_is_1(base) and _cvc(base) else base


@lru_cache(maxsize=1 << 18)
def stem(token: str) -> str:
    word = _mark_y("\\1Y", token)
    base, suffix = _strip(word, "1a")
    if suffix:
        word = base + STEP_1A[suffix]

    base, suffix = _strip(word, "1b")
    if suffix == "eed":
        word = base + "ee" if _m_over_0(base) else word
    elif suffix and _has_vowel(base):
        word = _repaired(base)

    if _terminal_y(word):
        word = word[:-1] + "i"

    for step, rules in (("2", STEP_2), ("3", STEP_3)):
        base, suffix = _strip(word, step)
        if suffix and _m_over_0(base):
            word = base + rules[suffix]

    base, suffix = _strip(word, "4")
    if suffix and _m_over_1(base) and (suffix != "ion" or base.endswith(("s", "t"))):
        word = base

    if word.endswith("e"):
        base = word[:-1]
        if _m_over_1(base) or (_m_is_1(base) and not _cvc(base)):
            word = base
    if word.endswith("ll") and _m_over_1(word[:-1]):
        word = word[:-1]
    return word.replace("Y", "y")
