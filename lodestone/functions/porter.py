"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), written from the paper.

Words of fewer than three letters, and words with other characters than a-z, are left alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = frozenset("aeiou")


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, ch in enumerate(word):
        out.append(ch not in _VOWELS if ch != "y" else i == 0 or not out[-1])
    return out


def _measure(stem: str) -> int:
    c = _consonants(stem)
    return sum(not a and b for a, b in zip(c, c[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _cvc(word: str) -> bool:
    c = _consonants(word)
    return len(word) > 2 and c[-1] and not c[-2] and c[-3] and word[-1] not in "wxy"


# The rules of steps 2 to 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word.lower()
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((e for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (dict(_STEP2), dict(_STEP3)):
        end = _longest(w, rules)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + rules[end]
    end = _longest(w, _STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


class _Stems(dict):
    """Stems of the words of a worker: most words of a text are few."""

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        self[word] = s = stem(word)
        return s


_STEMS = _Stems()


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_lists(lists: pd.Series) -> pd.Series:
    """For columns of the words of a text, in order: rows stay where they are."""
    return lists.map(lambda words: [_STEMS[w] for w in words])


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    """For columns of distinct terms: a vocabulary, not a text."""
    return words.map(stem, na_action="ignore")
