"""A language guess: by statistics of characters of over thirty languages, or by function words of four."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, words
from .tongues import TEXTS

#: Frequent function words.
FUNCTION_WORDS = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "den", "mit", "von", "auf", "zu"),
    "en": ("the", "and", "of", "to", "is", "that", "for", "with", "are", "this", "was", "it"),
    "es": ("el", "los", "las", "que", "y", "por", "con", "una", "del", "para", "se", "como"),
    "fr": ("le", "les", "et", "des", "est", "dans", "qui", "du", "une", "pour", "sur", "avec"),
}
#: Scripts with very many letters count as one letter each.
SCRIPTS = (("Han", "一"), ("Hangul", "가"), ("Hiragana", "あ"), ("Katakana", "ア"))
#: Letters in a run that is counted, at most, and what is added to every count.
LONGEST, ADDED = 3, 0.5
#: Letters and marks, and texts, that are looked up in one step.
_STEP, _TEXTS = 1 << 18, 64


def by_words(text: Column) -> Column:
    """struct(language, confidence): the language with most of its words in the text, the first by name of equals, and its share of all such words; unknown, 0 for texts of under 20 characters or without any."""
    plain = strip(F.coalesce(text, F.lit("")))
    hits = lambda w: [F.size(F.filter(w, lambda x: x.isin(*names))) for names in FUNCTION_WORDS.values()]  # noqa: E731, B023

    def pick(n: Column) -> Column:
        best = F.array_max(n)
        total = F.aggregate(n, F.lit(0), lambda s, x: s + x)
        name = F.get(F.array(*map(F.lit, FUNCTION_WORDS)), (F.array_position(n, best) - 1).cast("int"))
        known = (F.length(plain) >= 20) & (best > 0)
        return F.struct(F.when(known, name).otherwise("unknown").alias("language"), F.when(known, best / total).otherwise(0.0).alias("confidence"))

    counted = F.transform(F.array(words(F.lower(plain))), lambda w: F.array(*hits(w)))
    return F.get(F.transform(counted, pick), F.lit(0))


def letters(text: Column) -> Column:
    """Letters and marks in lower case, anything between them one space, and one at either end."""
    c = F.lower(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"[^\p{L}\p{M}]+", " "))

    def one_each(c: Column) -> Column:
        out = c
        for script, one in SCRIPTS:
            out = F.regexp_replace(out, rf"\p{{Is{script}}}", one)
        # all of these scripts are behind U+1100, so other texts are looked through once
        return F.when(c.rlike(r"[\x{1100}-\x{10FFFF}]"), out).otherwise(c)

    # in an array, so that what stands before is computed once
    return F.get(F.transform(F.array(c), one_each), F.lit(0))


def _letters(text: str) -> str:
    """The same of the languages' own sentences."""
    import regex

    c = regex.sub(r"[^\p{L}\p{M}]+", " ", f" {text} ").lower()
    for script, one in SCRIPTS:
        c = regex.sub(rf"\p{{{script}}}", one, c)
    return c


def counts() -> dict[str, Counter]:
    """Of each language, how often its runs of up to LONGEST characters stand in its sentences; a space alone isn't counted."""
    return {name: Counter(c[k : k + n] for c in [_letters(t)] for n in range(1, LONGEST + 1) for k in range(len(c) - n + 1) if c[k : k + n] != " ") for name, t in TEXTS.items()}


class Model:
    """Of every run that some language has, the thousandfold logarithm of its share in each language, in whole numbers, so that sums don't hang on their order."""

    def __init__(self):
        found = counts()
        self.names = sorted(found)
        runs = sorted({r for c in found.values() for r in c})
        total = {n: sum(c.values()) + ADDED * len(runs) for n, c in found.items()}
        alphabet = sorted({c for r in runs for c in r})
        #: The number of each letter (0: none), of each pair of letters and of each pair and letter that a language has; so a run is found by three look-ups.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.wide = len(alphabet) + 1
        self.runs = [[r for r in runs if len(r) == n] for n in range(1, LONGEST + 1)]
        number = [{r: k for k, r in enumerate(of, 1)} for of in self.runs]
        letter = {c: k for k, c in enumerate(alphabet, 1)}
        self.pair = np.zeros(self.wide**2, np.int32)
        for r, k in number[1].items():
            self.pair[letter[r[0]] * self.wide + letter[r[1]]] = k
        self.triple = np.zeros((len(number[1]) + 1) * self.wide, np.int32)
        for r, k in number[2].items():
            self.triple[number[1][r[:2]] * self.wide + letter[r[2]]] = k
        # a lone space and all that no language has count nothing
        score = lambda r: [math.floor(1000 * math.log((found[n][r] + ADDED) / total[n])) for n in self.names] if r in known else [0] * len(self.names)
        known = set(runs)
        self.scores = [np.array([[0] * len(self.names), *map(score, of)], np.float64) for of in (alphabet, *self.runs[1:])]

    def of(self, texts: pa.Array) -> np.ndarray:
        """A row of sums over all runs of each text, by language: how often each run stands in it, times its scores. All are whole numbers below 2^53, so exact in any order."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        a = 0
        while a < len(texts):
            # texts of one step together, or one that is longer
            b, held = a, []
            while b < len(texts) and b - a < _TEXTS and (not held or sum(map(len, held)) < _STEP):
                held.append(texts[b].as_py())
                b += 1
            self._add(held, out[a:b])
            a = b
        return out

    def _add(self, texts: list[str], out: np.ndarray) -> None:
        size = np.array([len(t) for t in texts], np.int64)
        letters = self.letter[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        row = np.repeat(np.arange(len(size)), size)
        # a run must not go on into the next text
        same = row[1:] == row[:-1]
        pairs = np.where(same, self.pair[letters[:-1] * self.wide + letters[1:]], 0)
        triples = np.where(same[1:], self.triple[pairs[:-1] * self.wide + letters[2:]], 0)
        for at, scores in zip((letters, pairs, triples), self.scores, strict=True):
            place = row[: len(at)] * len(scores) + at
            out += (np.bincount(place, minlength=len(size) * len(scores)).reshape(len(size), -1) @ scores).astype(np.int64)


@lru_cache(1)
def model() -> Model:
    return Model()


def by_letters(text: Column) -> Column:
    """struct(language, confidence): of the languages in TEXTS the one in which the text's runs of letters are most probable, the first by name of equals, and its probability among them; unknown, 0 for texts of under 20 characters or without a letter."""

    @F.arrow_udf("struct<language:string,confidence:double>")
    def guessed(texts: pa.Array) -> pa.Array:
        m = model()
        sums = m.of(texts)
        best = sums.argmax(1)
        share = 1 / np.exp((sums - sums.max(1, keepdims=True)) / 1000).sum(1)
        known = np.array([len(t) > 1 for t in texts.to_pylist()], bool)
        names = pa.array([m.names[k] if ok else "unknown" for k, ok in zip(best, known, strict=True)], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(np.where(known, share, 0.0))], ["language", "confidence"])

    plain = F.transform(F.array(strip(F.coalesce(text, F.lit("")))), lambda t: F.when(F.length(t) >= 20, letters(t)).otherwise(F.lit("")))
    return guessed(F.get(plain, F.lit(0)))


def guess(text: Column, method: str = "letters") -> Column:
    return by_words(text) if method == "words" else by_letters(text)
