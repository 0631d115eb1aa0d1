"""Stemming for search: the published Porter2 steps for English words and the Russian Snowball endings, by script."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

V = "aeiouy"
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z")
#: Whole words with stems of their own.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
#: Suffixes of steps 2, 3 and 4.
STEP2 = [("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(word: str) -> tuple[int, int]:
    m = re.match(r"(gener|commun|arsen)", word) or re.search(r"[aeiouy][^aeiouy]", word)
    r1 = m.end() if m else len(word)
    m = re.search(r"[aeiouy][^aeiouy]", word[r1:])
    return r1, r1 + m.end() if m else len(word)


def _short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]\Z|\A[aeiouy][^aeiouy]\Z", word))


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL or word in STAY:
        return SPECIAL.get(word, word)
    w = re.sub(r"(?<=[aeiouy])y|\Ay", "Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    w = re.sub(r"'s?'?\Z", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s\Z", w):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    if m := re.search(r"(eedly|eed)\Z", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search(r"(ingly|edly|ing|ed)\Z", w)) and re.search(f"[{V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for suffix, to in STEP2:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix not in ("li", "ogi") or (suffix == "li" and w[at - 1 : at] and w[at - 1] in "cdeghkmnrt") or (suffix == "ogi" and w[at - 1 : at] == "l")):
                w = w[:at] + to
            break
    for suffix, to in STEP3:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= (r2 if suffix == "ative" else r1):
                w = w[:at] + to
            break
    for suffix in STEP4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short(w[:-1], r1)):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Endings of Russian words, longest first within each class.
GERUND = (r"(?<=[ая])(вшись|вши|в)\Z", r"(ившись|ывшись|ивши|ывши|ив|ыв)\Z")
REFLEXIVE = r"(ся|сь)\Z"
ADJECTIVE = r"(ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею)\Z"
PARTICIPLE = (r"(?<=[ая])(ем|нн|вш|ющ|щ)\Z", r"(ивш|ывш|ующ)\Z")
VERB = (r"(?<=[ая])(ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н)\Z", r"(ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю)\Z")
NOUN = r"(иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я)\Z"


def _cut(word: str, rv: int, *patterns: str) -> str | None:
    for p in patterns:
        if (m := re.search(p, word)) and m.start() >= rv:
            return word[: m.start()]
    return None


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search("[аеиоуыэюя]", w)
    if not m:
        return w
    rv = m.end()
    m = re.search("[аеиоуыэюя][^аеиоуыэюя]", w)
    m2 = re.search("[аеиоуыэюя][^аеиоуыэюя]", w[m.end() :]) if m else None
    r2 = m.end() + m2.end() if m and m2 else len(w)
    if (x := _cut(w, rv, *reversed(GERUND))) is not None:
        w = x
    else:
        w = _cut(w, rv, REFLEXIVE) or w
        if (x := _cut(w, rv, ADJECTIVE)) is not None:
            y = _cut(x, rv, *reversed(PARTICIPLE))
            w = x if y is None else y
        elif (x := _cut(w, rv, *reversed(VERB))) is not None or (x := _cut(w, rv, NOUN)) is not None:
            w = x
    w = _cut(w, rv, r"и\Z") or w
    w = _cut(w, r2, r"(ость|ост)\Z") or w
    if w.endswith("нн"):
        return w[:-1]
    w = _cut(w, rv, r"(ейше|ейш)\Z") or w
    if w.endswith("нн"):
        return w[:-1]
    return w[:-1] if w.endswith("ь") else w


@lru_cache(1 << 18)
def stem(word: str) -> str:
    return russian(word) if re.search("[а-яё]", word) else english(word)


def beginning(stem: str) -> str:
    """What all words with this stem begin with, where ё is е: steps cut ends off and put three other letters there at most."""
    return stem[: max(1, len(stem) - 3)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stemmed(words: Column) -> Column:
    return _stemmed(words)
