"""English word forms: the published Porter2 suffix rules and a stop list.

Spark has no stemmer. The rules run inside Arrow functions that see each
distinct word of a batch once: one stems query words, and documents are stemmed where
they are cut into postings (:mod:`forumlake.functions.runs`).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Workers get this small module with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The common English stop list and the Porter2 suffix tables.
STOP_WORDS = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now
    """.split()
)
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_EARLY_REGION = re.compile(r"gener|commun|arsen")
_SHORT_END = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile(r"[aeiouy]")

# By last letter, all endings that some rule looks at: a word without one is its own stem.
_ENDINGS: dict[str, tuple[str, ...]] = {}
for _ending in ("s", "y", "e", "ed", "ing", "ll", *STEP2, *STEP3, *STEP4):
    _ENDINGS[_ending[-1]] = (*_ENDINGS.get(_ending[-1], ()), _ending)

REMEMBERED = 2**18  # words whose terms a task keeps for its next documents


def _longest(word: str, rules: dict[str, str]) -> str:
    for size in range(min(len(word), 7), 1, -1):
        if word[-size:] in rules:
            return word[-size:]
    return ""


def _region_after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def stem(word: str) -> str:
    """The Porter2 stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3 or not word.endswith(_ENDINGS.get(word[-1], ())):
        return word
    # Capital Y marks a consonant y.
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    early = _EARLY_REGION.match(word)
    r1 = early.end() if early else _region_after(word, 0)
    r2 = _region_after(word, r1)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_PLURAL:
        return word

    ending = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(e)), "")
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and _VOWEL.search(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    ending = _longest(word, STEP2)
    base = word[: len(word) - len(ending)]
    if ending and len(base) >= r1:
        if not (ending == "ogi" and not base.endswith("l")) and not (ending == "li" and not base.endswith(tuple("cdeghkmnrt"))):
            word = base + STEP2[ending]

    ending = _longest(word, STEP3)
    base = word[: len(word) - len(ending)]
    if ending and len(base) >= r1 and (ending != "ative" or len(base) >= r2):
        word = base + STEP3[ending]

    ending = _longest(word, STEP4)
    base = word[: len(word) - len(ending)]
    if ending and len(base) >= r2 and (ending != "ion" or base.endswith(("s", "t"))):
        word = base

    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _SHORT_END.search(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def remembered_terms() -> Callable[[list[str]], list[str | None]]:
    """For distinct words the stem of each, or None for a stop word. Words met before are not stemmed
    again, as long as there are no more than ``REMEMBERED``."""
    known: dict[str, str | None] = {}

    def terms_of(words: list[str]) -> list[str | None]:
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = None if word in STOP_WORDS else stem(word)
        return [known[word] for word in words]

    return terms_of


@F.arrow_udf(T.ArrayType(T.StringType()))
def english_terms(words: pa.Array) -> pa.Array:
    """Per document, the stem of each word, or NULL where it is a stop word."""
    coded = words.flatten().dictionary_encode()
    stems = pa.array([None if word in STOP_WORDS else stem(word) for word in coded.dictionary.to_pylist()], pa.string())
    lengths = words.value_lengths().fill_null(0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths)])
    return pa.ListArray.from_arrays(offsets.cast(pa.int32()), stems.take(coded.indices))
