"""Spanish stems word by word, to hold the column rules against."""

from __future__ import annotations

from functools import lru_cache

from noticeworks.functions.stem import (
    ACCENTED_VERBS,
    AGENTS,
    DELETED,
    PLAIN_VERBS,
    PRONOUNS,
    REPLACED,
    RESIDUE,
    VERBS,
    VERBS_AFTER_GU,
    VOWELS,
    Y_VERBS,
)

_PLAIN = str.maketrans("áéíóú", "aeiou")


def _after(word: str, start: int, first_vowel: bool) -> int:
    """Position after the first vowel, or the first other letter, from `start` on."""
    for i in range(start, len(word)):
        if (word[i] in VOWELS) == first_vowel:
            return i + 1
    return len(word)


def _regions(word: str) -> tuple[int, int, int]:
    """Starts of the verb region and of the two nested end regions."""
    if len(word) < 2:
        verb = len(word)
    elif word[1] not in VOWELS:
        verb = _after(word, 2, True)
    elif word[0] in VOWELS:
        verb = _after(word, 2, False)
    else:
        verb = min(3, len(word))
    first = _after(word, _after(word, 0, True), False)
    second = _after(word, _after(word, first, True), False)
    return verb, first, second


def _longest(word: str, suffixes, start: int = 0) -> str:
    found = [s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start]
    return max(found, key=len, default="")


def _cut(word: str, suffixes, start: int) -> str:
    """The word without its longest suffix, provided that lies behind `start`."""
    suffix = _longest(word, suffixes)
    return word[: -len(suffix)] if suffix and len(word) - len(suffix) >= start else word


def _without_pronoun(word: str, verb: int) -> str:
    pronoun = _longest(word, PRONOUNS)
    if not pronoun:
        return word
    base = word[: -len(pronoun)]
    ending = _longest(base, (*ACCENTED_VERBS, *PLAIN_VERBS, "yendo"), verb)
    if ending in ACCENTED_VERBS:
        return base[: -len(ending)] + ACCENTED_VERBS[ending]
    if ending == "yendo":
        return base if base[: -len(ending)].endswith("u") else word
    return base if ending else word


_STANDARD = (*DELETED, *AGENTS, *REPLACED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos")


def _without_standard_suffix(word: str, first: int, second: int) -> str:
    suffix = _longest(word, _STANDARD)
    start = len(word) - len(suffix)
    if not suffix or start < (first if suffix == "amente" else second):
        return word
    base = word[:start]
    if suffix in REPLACED:
        return base + REPLACED[suffix]
    if suffix in AGENTS:
        return _cut(base, ("ic",), second)
    if suffix == "amente":
        shorter = _cut(base, ("iv", "os", "ic", "ad"), second)
        return _cut(shorter, ("at",), second) if shorter != base and base.endswith("iv") else shorter
    if suffix == "mente":
        return _cut(base, ("ante", "able", "ible"), second)
    if suffix in ("idad", "idades"):
        return _cut(base, ("abil", "ic", "iv"), second)
    if suffix in ("iva", "ivo", "ivas", "ivos"):
        return _cut(base, ("at",), second)
    return base


def _without_verb_suffix(word: str, verb: int) -> str:
    suffix = _longest(word, Y_VERBS, verb)
    if suffix and word[: -len(suffix)].endswith("u"):
        return word[: -len(suffix)]
    suffix = _longest(word, (*VERBS, *VERBS_AFTER_GU), verb)
    if not suffix:
        return word
    base = word[: -len(suffix)]
    return base[:-1] if suffix in VERBS_AFTER_GU and base.endswith("gu") else base


def _without_residue(word: str, verb: int) -> str:
    suffix = _longest(word, (*RESIDUE, "e", "é"), verb)
    if not suffix:
        return word
    base = word[: -len(suffix)]
    if suffix in ("e", "é") and base.endswith("gu") and len(base) - 1 >= verb:
        return base[:-1]
    return base


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    verb, first, second = _regions(word)
    word = _without_pronoun(word, verb)
    shorter = _without_standard_suffix(word, first, second)
    if shorter == word:
        shorter = _without_verb_suffix(word, verb)
    return _without_residue(shorter, verb).translate(_PLAIN)
