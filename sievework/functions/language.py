"""Deterministic language identification of a chunk as one column expression.

Scripts decide first; Latin text goes to the language with the most closed-class words and own
letters. The result is a three-letter name; ties go to the first in alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

WORDS = {
    "Deu": "der die und das ist nicht ein eine mit von zu den auf für dem sich des auch als wir",
    "Eng": "the of and is to in that it for with this so we as are be was but not you",
    "Fra": "le la les des et est une un dans que qui pour pas sur avec du nous ce il au",
    "Ita": "il che di non una sono per con della è gli nel anche questo più come si ma lo dei",
    "Nld": "de het een en van niet dat is op te zijn voor met er aan ook maar we dit wij",
    "Por": "o que não uma com os para em do da no se mais por como mas ao ele das são",
    "Spa": "el los las que y en por con una del se es para no lo su al como más pero",
}
LETTERS = {"Deu": "[äöüß]", "Fra": "[çèêœùîû]", "Por": "[ãõ]", "Spa": "[ñ¿¡]", "Ita": "[ìò]"}
#: Scripts with the least share of letters (one in so many) at which they decide.
SCRIPTS = (("Jpn", "[぀-ヿ]", 8), ("Kor", "[가-힯]", 4), ("Cmn", "[㐀-䶿一-鿿]", 4), ("Rus", "[Ѐ-ӿ]", 3), ("Ara", "[؀-ۿ]", 3), ("Hin", "[ऀ-ॿ]", 3))


def _latin(low: Column, spaced: Column) -> Column:
    scores = []
    for lang in sorted(WORDS):
        s = F.regexp_count(spaced, F.lit(f" (?:{'|'.join(WORDS[lang].split())}) "))
        if lang in LETTERS:
            s = s + F.regexp_count(low, F.lit(LETTERS[lang]))
        scores.append(F.struct((-s).alias("s"), F.lit(lang).alias("l")))
    return once(F.array_min(F.array(*scores)), lambda best: F.when(best["s"] < 0, best["l"]).otherwise("Eng"))


def detect(c: Column) -> Column:
    """The language of a chunk."""
    n = F.greatest(F.char_length(c), F.lit(1))
    latin = once(F.lower(c), lambda low: once(F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}]+", "  "), F.lit(" ")), lambda spaced: _latin(low, spaced)))
    out = None
    for lang, letters, share in SCRIPTS:
        hit = F.regexp_count(c, F.lit(letters)) * share >= n
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    script = F.when(F.regexp_like(c, F.lit("[Ѐ-￿]")), out)
    return F.coalesce(script, latin)
