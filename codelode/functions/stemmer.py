"""The English suffix-stripping algorithm of M. F. Porter (1980) as column expressions.

A word is read as [C](VC){m}[V], where C and V are runs of consonants and vowels and m is its measure; y is a vowel
after a consonant. Each step looks for its longest suffix that the word has, and replaces it if the stem before it
meets the suffix's condition. Words under three letters and tokens with other characters than a-z stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of each step with their replacements, in the order of the published description.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def shape(stem: Column) -> Column:
    """The stem's letters as C (consonant) and V (vowel)."""
    # y after a consonant is a vowel; of several y in a row every second one is
    marked = F.regexp_replace(stem, "(?<=[^aeiouy])y|(?<=^y|[aeiou]y)y", "V")
    vowels = F.regexp_replace(marked, "[aeiou]", "V")
    return F.regexp_replace(vowels, "[^V]", "C")


def at_least(stem: Column, measure: int) -> Column:
    """Whether the stem's measure is `measure` or more."""
    return shape(stem).rlike(f"^C*(?:V+C+){{{measure}}}")


def has_vowel(stem: Column) -> Column:
    return shape(stem).contains("V")


def doubled(word: Column) -> Column:
    """Ends with a consonant twice."""
    return word.rlike(r"([^aeiou])\1$") & shape(word).endswith("CC")


def short_end(word: Column) -> Column:
    """Ends with consonant, vowel, consonant, the last not w, x or y."""
    return shape(word).endswith("CVC") & ~word.rlike("[wxy]$")


def _without(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _bound(word: Column, step) -> Column:
    """step(word) with the word made once, as the element of an array of one."""
    return F.transform(F.array(word), step)[0]


def _replaced(word: Column, suffixes: dict[str, str], measure: int) -> Column:
    """The longest of the suffixes that the word has, replaced if the stem's measure is high enough."""
    out = None
    for suffix in sorted(suffixes, key=len, reverse=True):
        stem = _without(word, suffix)
        changed = F.when(at_least(stem, measure), F.concat(stem, F.lit(suffixes[suffix]))).otherwise(word)
        out = F.when(word.endswith(suffix), changed) if out is None else out.when(word.endswith(suffix), changed)
    return out.otherwise(word)


def _step_1a(w: Column) -> Column:
    return (
        F.when(w.endswith("sses") | w.endswith("ies"), _without(w, "es")).when(w.endswith("ss"), w)
        .when(w.endswith("s"), _without(w, "s")).otherwise(w)
    )


def _tidied(w: Column) -> Column:
    """What step 1b does after it took -ed or -ing."""
    return (
        F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(doubled(w) & ~w.rlike("[lsz]$"), _without(w, "x"))
        .when(~at_least(w, 2) & at_least(w, 1) & short_end(w), F.concat(w, F.lit("e"))).otherwise(w)
    )


def _step_1b(w: Column) -> Column:
    def taken(suffix: str) -> Column:
        return F.when(has_vowel(_without(w, suffix)), _bound(_without(w, suffix), _tidied)).otherwise(w)

    return (
        F.when(w.endswith("eed"), F.when(at_least(_without(w, "eed"), 1), _without(w, "d")).otherwise(w))
        .when(w.endswith("ed"), taken("ed")).when(w.endswith("ing"), taken("ing")).otherwise(w)
    )


def _step_1c(w: Column) -> Column:
    return F.when(w.endswith("y") & has_vowel(_without(w, "y")), F.concat(_without(w, "y"), F.lit("i"))).otherwise(w)


def _step_4(w: Column) -> Column:
    out = None
    for suffix in sorted(STEP_4, key=len, reverse=True):
        stem = _without(w, suffix)
        fits = at_least(stem, 2) & (stem.rlike("[st]$") if suffix == "ion" else F.lit(True))
        changed = F.when(fits, stem).otherwise(w)
        out = F.when(w.endswith(suffix), changed) if out is None else out.when(w.endswith(suffix), changed)
    return out.otherwise(w)


def _step_5(w: Column) -> Column:
    stem = _without(w, "e")
    gone = at_least(stem, 2) | (at_least(stem, 1) & ~short_end(stem))
    bare = F.when(w.endswith("e") & gone, stem).otherwise(w)
    return _bound(bare, lambda x: F.when(x.endswith("ll") & at_least(x, 2), _without(x, "l")).otherwise(x))


def english_stem(term: Column) -> Column:
    """Stem of a lower-case word."""
    def steps(word: Column) -> Column:
        for step in (
            _step_1a, _step_1b, _step_1c, lambda w: _replaced(w, STEP_2, 1), lambda w: _replaced(w, STEP_3, 1), _step_4, _step_5,
        ):
            word = _bound(word, step)
        return word

    return F.when(term.rlike("^[a-z]{3,}$"), steps(term)).otherwise(term)
