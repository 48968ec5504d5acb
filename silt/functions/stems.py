"""Words as the full-text search compares them: folded, and stemmed by Porter's published algorithm (1980)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffixes of the published algorithm's steps two to four, longest of a step first.
STEP_2 = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion", "biliti": "ble",
    "entli": "ent", "ousli": "ous", "ation": "ate", "alism": "al", "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance",
    "izer": "ize", "abli": "able", "alli": "al", "ator": "ate", "eli": "e",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = (
    "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou"
).split()

#: Words are runs of letters and digits of any script.
SEPARATORS = r"[^\p{L}\p{N}]+"


def _shape(stem: str) -> str:
    """Each letter as v or c: a y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(re.findall("v+c", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last no w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, suffixes: dict[str, str]) -> str:
    for suffix, by in suffixes.items():
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + by if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a to z, or of under three, are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    # plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past forms
    ending = next((e for e in ("eed", "ing", "ed") if word.endswith(e)), "")
    stem = word[: len(word) - len(ending)]
    if ending == "eed":
        word = word[:-1] if _measure(stem) > 0 else word
    elif ending and "v" in _shape(stem):
        if stem.endswith(("at", "bl", "iz")) or (_measure(stem) == 1 and _short(stem)):
            word = stem + "e"
        elif re.search(r"(.)\1$", stem) and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
            word = stem[:-1]
        else:
            word = stem
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st"):
                word = stem
            break
    # a last e, and one of two l
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def fold(word: str) -> str:
    """Lower-cased without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def stem_of(words: pd.Series) -> pd.Series:
    """The search's form of each word; meant for tables of distinct words."""
    return words.map(lambda w: None if w is None else porter(fold(w)))


def raw_words(text: Column) -> Column:
    """The words of a text as they stand, lower-cased."""
    return F.filter(F.split(F.lower(text), SEPARATORS, -1), lambda w: w != "")
