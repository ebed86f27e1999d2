"""An English snowball stemmer (Porter2), for the optional stemming step of the analyzer."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STARTS = ("gener", "commun", "arsen")
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other alphabets and of two letters or fewer stay."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in WHOLE or word in KEPT:
        return WHOLE.get(word, word)
    word = word.removeprefix("'")
    for i, c in enumerate(word):
        if c == "y" and (i == 0 or word[i - 1] in VOWELS):
            word = word[:i] + "Y" + word[i + 1 :]
    start = next((len(s) for s in STARTS if word.startswith(s)), None)
    one = start if start is not None else _region(word, 0)
    two = _region(word, one)
    word = word[: len(word) - len(_longest(word, ("'", "'s", "'s'")) or "")]
    # Plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in KEPT_LATER:
        return word
    # Past and progressive forms
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= one:
            word = word[: len(word) - len(end)] + "ee"
    elif end and any(c in VOWELS for c in word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif _short_end(word) and one >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # Endings of the second and third table, in the first region
    end = _longest(word, SECOND)
    if end and len(word) - len(end) >= one:
        body = word[: len(word) - len(end)]
        if not (end == "ogi" and not body.endswith("l")) and not (end == "li" and (not body or body[-1] not in LI_ENDINGS)):
            word = body + SECOND[end]
    end = _longest(word, THIRD)
    if end and len(word) - len(end) >= (two if end == "ative" else one):
        word = word[: len(word) - len(end)] + THIRD[end]
    end = _longest(word, FOURTH)
    if end and len(word) - len(end) >= two and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= two or (len(word) - 1 >= one and not _short_end(word[:-1]))) or (word.endswith("ll") and len(word) - 1 >= two):
        word = word[:-1]
    return word.lower()


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stemmed(words: Column) -> Column:
    """An array of words to their stems: opt-in, as it runs in Python by Arrow batches."""
    return _stems(words)
