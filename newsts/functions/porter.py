"""The published Porter (1980) suffix-stripping algorithm for one word.

Used only on the *distinct vocabulary* (T1c): the corpus is reduced to its
distinct lower-case tokens by Spark, each is stemmed once here inside
``mapInPandas``, and the stems are joined back to the token rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = set("aeiou")
_VC, _VOWEL = re.compile("[aeiou]+[^aeiou]", re.DOTALL), re.compile("[aeiou]")
STEMS = 300_000  # documented parameter: stems kept by a Python process, for all its tasks


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of VC sequences in ``stem``."""
    if "y" not in stem:
        return len(_VC.findall(stem))
    n, i, L = 0, 0, len(stem)
    while i < L and _cons(stem, i):
        i += 1
    while i < L:
        while i < L and not _cons(stem, i):
            i += 1
        if i >= L:
            break
        while i < L and _cons(stem, i):
            i += 1
        n += 1
    return n


def _has_vowel(stem: str) -> bool:
    if "y" not in stem:
        return _VOWEL.search(stem) is not None
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _replace(w: str, rules, cond) -> tuple[str, bool]:
    for suf, rep in rules.get(w[-1:], ()):
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if cond(stem):
                return stem + rep, True
            return w, True
    return w, False


# fixed values: suffix rules of the published algorithm, in its order
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]


def _by_end(rules):
    """The rules by the last letter of their suffix, in their order."""
    return {end: [r for r in rules if r[0][-1] == end] for end in {r[0][-1] for r in rules}}


_STEP2, _STEP3 = _by_end(_STEP2), _by_end(_STEP3)
_STEP4 = _by_end([(s, "") for s in sorted(_STEP4, key=len, reverse=True)])


@lru_cache(STEMS)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # step 2, 3
    w, _ = _replace(w, _STEP2, lambda s: _m(s) > 0)
    w, _ = _replace(w, _STEP3, lambda s: _m(s) > 0)
    # step 4
    for suf, _ in _STEP4.get(w[-1:], ()):
        if w.endswith(suf):
            s = w[: len(w) - len(suf)]
            if _m(s) > 1 and (suf != "ion" or (s and s[-1] in "st")):
                w = s
            break
    # step 5a
    if w.endswith("e"):
        s = w[:-1]
        if _m(s) > 1 or (_m(s) == 1 and not _cvc(s)):
            w = s
    # step 5b
    if _m(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w
