"""English stems by the five steps of the published suffix-stripping algorithm (Porter, 1980)."""

from __future__ import annotations

import re

# The suffixes of each step and what they become.
_STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``c`` or ``v`` for each letter; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k > 0 and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, rules: tuple) -> tuple[str, str] | None:
    """The stem and rule of the longest suffix that the word has."""
    found = [r for r in rules if word.endswith(r[0])]
    best = max(found, key=lambda r: len(r[0]), default=None)
    return (word[: len(word) - len(best[0])], best[1]) if best else None


def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer are their own."""
    if len(word) <= 2:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: len(word) - len(end)]):
                word = word[: len(word) - len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP_2, _STEP_3):
        if (hit := _longest(word, rules)) and measure(hit[0]) > 0:
            word = "".join(hit)
    if hit := _longest(word, tuple((end, "") for end in _STEP_4)):
        left = hit[0] + (word[len(hit[0])] if word.endswith(("sion", "tion")) else "")
        if measure(left) > 1:
            word = left
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if measure(word) > 1 and _double(word) and word.endswith("l") else word
