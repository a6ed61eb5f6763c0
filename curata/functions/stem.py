"""English stems by Porter's rules (1980), for words of a-z; other words are their own stems."""

from __future__ import annotations

import functools
import re

_PLAIN = re.compile(r"[a-z]+")


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# Endings of the second to fourth step and what each becomes; of endings that fit, the longest counts.
_SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _ending(word: str, endings: list[str]) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plurals(w: str) -> str:
    for ending, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(ending):
            return w[: len(w) - len(ending)] + to
    return w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    ending = _ending(w, ["ed", "ing"])
    if ending is None or "v" not in _shape(w[: -len(ending)]):
        return w
    w = w[: -len(ending)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _short(w) else w


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3 or not _PLAIN.fullmatch(word):
        return word
    w = _past(_plurals(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_SECOND, _THIRD):
        ending = _ending(w, list(table))
        if ending is not None and _measure(w[: -len(ending)]) > 0:
            w = w[: -len(ending)] + table[ending]
    ending = _ending(w, _FOURTH)
    if ending is not None:
        rest = w[: -len(ending)]
        if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
