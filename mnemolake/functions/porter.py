"""Stemming by Porter's algorithm (1980), for single lower-case words."""

from __future__ import annotations

import functools

_V = "aeiou"


def _is_cons(w: str, i: int) -> bool:
    return w[i] not in _V and (w[i] != "y" or i == 0 or not _is_cons(w, i - 1))


def _measure(w: str) -> int:
    form = "".join("c" if _is_cons(w, i) else "v" for i in range(len(w)))
    return sum(a == "v" and b == "c" for a, b in zip(form, form[1:]))


def _has_vowel(w: str) -> bool:
    return any(not _is_cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _is_cons(w, n - 3) and not _is_cons(w, n - 2) and _is_cons(w, n - 1) and w[-1] not in "wxy"


def _swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, to in rules:
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + to if _measure(stem) > least else w
    return w


_STEP2 = [x.split() for x in "ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,logi log".split(",")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


@functools.lru_cache(100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, 0)
    w = _swap(w, _STEP3, 0)
    for end in sorted([*_STEP4, "sion", "tion"], key=len, reverse=True):
        if w.endswith(end):
            base = w[: len(w) - len(end)] if end not in ("sion", "tion") else w[:-3]
            if _measure(base) > 1:
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w
