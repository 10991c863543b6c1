"""The Russian Snowball stemmer, after its published description, as a vectorised function over arrays of tokens.

Every rule works in the part of a word after its first Cyrillic vowel, so Latin words and numbers stay as they are.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import text as text_functions

# --- fixed values: the algorithm's ending groups, longest match wins -----------------------------------------------
VOWELS = "аеиоуыэюя"
GERUND_AFTER_A = "в вши вшись".split()
GERUND = "ив ивши ившись ыв ывши ывшись".split()
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE_AFTER_A = "ем нн вш ющ щ".split()
PARTICIPLE = "ивш ывш ующ".split()
REFLEXIVE = "ся сь".split()
VERB_AFTER_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
SUPERLATIVE = "ейш ейше".split()
DERIVATIONAL = "ост ость".split()
# --------------------------------------------------------------------------------------------------------------------


def _regions(word: str) -> tuple[int, int]:
    """Where RV (after the first vowel) and R2 begin."""
    n = len(word)
    rv = next((i + 1 for i, c in enumerate(word) if c in VOWELS), n)

    def after(start: int) -> int:
        return next((i + 1 for i in range(start + 1, n) if word[i] not in VOWELS and word[i - 1] in VOWELS), n)

    return rv, after(after(0))


def _cut(word: str, start: int, endings: list[str], after_a: list[str] = ()) -> str | None:
    """The word without its longest ending that lies after ``start``; those of ``after_a`` need an а or я before them."""
    for e in sorted({*endings, *after_a}, key=len, reverse=True):
        if word.endswith(e) and len(word) - len(e) >= start:
            at = len(word) - len(e)
            if e in endings:
                return word[:at]
            if at > start and word[at - 1] in "ая":
                return word[:at]
    return None


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    word = word.replace("ё", "е")
    rv, r2 = _regions(word)
    if rv >= len(word):
        return word
    out = _cut(word, rv, GERUND, GERUND_AFTER_A)
    if out is None:
        out = _cut(word, rv, REFLEXIVE) or word
        adjective = _cut(out, rv, ADJECTIVE)
        if adjective is not None:
            out = _cut(adjective, rv, PARTICIPLE, PARTICIPLE_AFTER_A) or adjective
        else:
            verb = _cut(out, rv, VERB, VERB_AFTER_A)
            if verb is None:
                verb = _cut(out, rv, NOUN)
            out = out if verb is None else verb
    if out.endswith("и") and len(out) > rv:
        out = out[:-1]
    shorter = _cut(out, max(r2, rv), DERIVATIONAL)
    out = out if shorter is None else shorter
    bare = _cut(out, rv, SUPERLATIVE)
    if bare is not None:
        out = bare
    if out.endswith("нн") and len(out) - 1 > rv:
        return out[:-1]
    if bare is None and out.endswith("ь") and len(out) > rv:
        return out[:-1]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Stems of arrays of tokens."""
    return tokens.map(lambda xs: [stem(x) for x in xs] if xs is not None else None)


def stem_set(text: Column) -> Column:
    """Distinct stems of a text's tokens."""
    return F.array_distinct(stems(text_functions.tokens(text)))


#: Analyzers by name: a text column to an array of terms.
ANALYZERS = {"tokens": text_functions.tokens, "set": text_functions.token_set, "stems": lambda c: stems(text_functions.tokens(c)), "stem_set": stem_set}
