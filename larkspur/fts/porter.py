"""Porter's stemmer as he published it in 1980.

The rules stand in tables; a word is also written as its pattern of consonants and
vowels, on which the rules' conditions are regular expressions.
"""

from __future__ import annotations

import re
from functools import lru_cache

# suffix, replacement; the longest suffix that fits decides (fixed values)
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_SUFFIXES = {n: sorted(t, key=len, reverse=True) for n, t in (("2", STEP2), ("3", STEP3), ("4", STEP4))}


def shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(w: str) -> int:
    return len(re.findall("v+c+", shape(w)))


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return shape(w).endswith("cvc") and w[-1] not in "wxy"


def _table(w: str, name: str, table: dict) -> str:
    for s in _SUFFIXES[name]:
        if w.endswith(s):
            root = w[: -len(s)]
            return root + table[s] if measure(root) > 0 else w
    return w


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Words of two letters or with other letters than a to z stay."""
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    # plurals
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past and gerund
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                root = w[: -len(s)]
                if "v" in shape(root):
                    w = root
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _doubled(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = _table(w, "2", STEP2)
    w = _table(w, "3", STEP3)
    for s in _SUFFIXES["4"]:
        if w.endswith(s):
            root = w[: -len(s)]
            if measure(root) > 1 and (s != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w
