"""Word stems by the published Snowball definitions for English and Swedish.

A stemmer cuts endings in steps; an ending counts only inside a region behind the
word's first consonant that follows a vowel.  Small functions over one word,
remembered by the worker that calls them; texts go through ``fulltext.hits``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

# The vowels, endings and exceptions of the two definitions, in their published order.
ENGLISH_VOWELS, SWEDISH_VOWELS = "aeiouy", "aeiouyäåö"
ENGLISH_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
ENGLISH_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
ENGLISH_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
ENGLISH_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
ENGLISH_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
SWEDISH_STEP_1 = (
    "a", "arna", "erna", "heterna", "orna", "ad", "e", "ade", "ande", "arne", "are", "aste", "en", "anden", "aren", "heten", "ern", "ar", "er", "heter", "or",
    "as", "arnas", "ernas", "ornas", "es", "ades", "andes", "ens", "arens", "hetens", "erns", "at", "andet", "het", "ast", "s",
)
SWEDISH_STEP_2 = ("dd", "gd", "nn", "dt", "gt", "kt", "tt")
SWEDISH_STEP_3 = {"lig": "", "ig": "", "els": "", "löst": "lös", "fullt": "full"}

# Words that a search passes over.
ENGLISH_STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these"
    " those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after"
    " above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very"
    " s t can will just don should now".split()
)
SWEDISH_STOP = frozenset(
    "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har inte hans honom skulle hennes där min man ej vid kunde något från ut när efter"
    " upp vi dem vara vad över än dig kan sina här ha mot alla under någon eller allt mycket sedan ju denna själv detta åt utan varit hur ingen mitt ni bli blev oss din dessa några deras blir mina samma"
    " vilken er sådan vår blivit dess inom mellan sådant varför varje vilka ditt vem vilket sitta sådana vart dina vars vårt våra ert era vilkas".split()
)


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part behind the first consonant after a vowel begins."""
    found = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word))


def _english(word: str) -> str:
    if word in ENGLISH_WHOLE or len(word) <= 2:
        return ENGLISH_WHOLE.get(word, word)
    word = re.sub("(?<=[aeiouy])y|^y", "Y", word.removeprefix("'"))
    named = re.match("gener|commun|arsen", word)
    r1 = named.end() if named else _region(word, ENGLISH_VOWELS)
    r2 = _region(word, ENGLISH_VOWELS, r1)

    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in ENGLISH_AFTER_PLURAL:
        return word

    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        word = word[: len(word) - len(end)] + "ee" if len(word) - len(end) >= r1 else word
    elif end and re.search("[aeiouy]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif _short_end(word) and r1 >= len(word):
            word += "e"
    word = re.sub("(?<=.[^aeiouy])[yY]$", "i", word)

    end = _longest(word, ENGLISH_STEP_2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or re.search("[cdeghkmnrt]$", before)):
            word = before + ENGLISH_STEP_2[end]
    end = _longest(word, ENGLISH_STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + ENGLISH_STEP_3[end]
    end = _longest(word, ENGLISH_STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) > r2 or (len(word) > r1 and not _short_end(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _swedish(word: str) -> str:
    r1 = max(3, _region(word, SWEDISH_VOWELS))
    end = _longest(word[r1:], SWEDISH_STEP_1)
    if end and (end != "s" or re.search("[bcdfghjklmnoprtvy]$", word[:-1])):
        word = word[: -len(end)]
    if word[r1:].endswith(SWEDISH_STEP_2):
        word = word[:-1]
    end = _longest(word[r1:], SWEDISH_STEP_3)
    return word[: len(word) - len(end)] + SWEDISH_STEP_3[end] if end else word


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    """The stem of a lower-case word; empty for a stop word."""
    return "" if word in ENGLISH_STOP else _english(word)


@lru_cache(maxsize=200_000)
def swedish(word: str) -> str:
    """The stem of a lower-case word; empty for a stop word."""
    return "" if word in SWEDISH_STOP else _swedish(word)


def simple(word: str) -> str:
    """The word as it is."""
    return word


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "swedish": swedish, "simple": simple}
