"""An English suffix stemmer as SQL expressions, one per step, for a column of distinct tokens.

The expressions use only CASE, left, right, length and regular expressions without look-around or
back references, so the same text runs in Spark and, with another match function, in other engines.
A ``y`` is a consonant at the start and after a vowel; digits are consonants."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Match = Callable[[str, str], str]

_FIXED = "sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl"
_SECOND = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize "
    "ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
)
_THIRD = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_FOURTH = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"

_ONSET = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*"
_MORE = "[^aeiou][^aeiouy]*[aeiouy][aeiou]*"
M_OVER_0 = _ONSET + "[^aeiou]"
M_OVER_1 = _ONSET + _MORE + "[^aeiou]"
VOWEL = "[aeiou]|.y"
_Y_CONSONANT = "(?:[^aeiouy]|(?:^|[aeiou])(?:yy)*y|[^aeiouy]y(?:yy)*y)"
CVC = _Y_CONSONANT + "[aeiouy][^aeiouwxy]$"
CONSONANT_Y = _Y_CONSONANT + "y$"
DOUBLE = "(?:" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx0123456789") + "|(?:^|[aeiou])yy(?:yy)*y|[^aeiouy]yy(?:yy)*)$"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _ends(*suffixes: str) -> str:
    return "(" + " OR ".join(f"right(w, {len(s)}) = '{s}'" for s in suffixes) + ")"


def steps(match: Match) -> list[str]:
    """SQL for each step, reading the word as ``w``. A stem that lost -ed or -ing carries a # to the next step."""
    over_0, over_1 = (lambda x: match(x, M_OVER_0)), (lambda x: match(x, M_OVER_1))
    plural = (
        f"CASE WHEN {_ends('sses')} THEN {_cut(2)} WHEN {_ends('ies')} THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END "
        f"WHEN {_ends('ss', 'us')} THEN w WHEN {_ends('s')} AND length(w) > 2 AND {match(_cut(2), VOWEL)} THEN {_cut(1)} ELSE w END"
    )
    past = (
        f"CASE WHEN {_ends('eed')} THEN CASE WHEN {over_0(_cut(3))} THEN {_cut(1)} ELSE w END "
        f"WHEN {_ends('ed')} THEN CASE WHEN {match(_cut(2), VOWEL)} THEN concat({_cut(2)}, '#') ELSE w END "
        f"WHEN {_ends('ing')} THEN CASE WHEN {match(_cut(3), VOWEL)} THEN concat({_cut(3)}, '#') ELSE w END ELSE w END"
    )
    bare = _cut(1)
    repair = (
        f"CASE WHEN right(w, 1) <> '#' THEN w WHEN {_ends('at#', 'bl#', 'iz#')} THEN concat({bare}, 'e') "
        f"WHEN {match(bare, DOUBLE)} THEN {_cut(2)} WHEN {over_0(bare)} AND NOT {over_1(bare)} AND {match(bare, CVC)} THEN concat({bare}, 'e') ELSE {bare} END"
    )
    final_y = f"CASE WHEN length(w) >= 3 AND {match('w', CONSONANT_Y)} THEN concat({_cut(1)}, 'i') ELSE w END"

    def replaced(rules: str) -> str:
        pairs = [r.split(":") for r in rules.split()]
        return " ".join(f"WHEN {_ends(s)} THEN CASE WHEN {over_0(_cut(len(s)))} THEN concat({_cut(len(s))}, '{r}') ELSE w END" for s, r in pairs)

    second = f"CASE {replaced(_SECOND)} WHEN {match('w', '[cdeghkmnrt]li$')} AND {over_0(_cut(2))} THEN {_cut(2)} ELSE w END"
    third = f"CASE {replaced(_THIRD)} ELSE w END"
    fourth = f"CASE WHEN {match('w', '[st]ion$')} AND {over_1(_cut(3))} THEN {_cut(3)} " + " ".join(
        f"WHEN {_ends(s)} THEN CASE WHEN {over_1(_cut(len(s)))} THEN {_cut(len(s))} ELSE w END" for s in _FOURTH.split()
    ) + " ELSE w END"
    final_e = f"CASE WHEN {_ends('e')} AND ({over_1(_cut(1))} OR ({over_0(_cut(1))} AND NOT {match(_cut(1), CVC)})) THEN {_cut(1)} ELSE w END"
    final_l = f"CASE WHEN {_ends('ll')} AND {over_1('w')} THEN {_cut(1)} ELSE w END"
    return [plural, past, repair, final_y, second, third, fourth, final_e, final_l]


def fixed(token: str = "token") -> str:
    return f"CASE {token} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (x.split(":") for x in _FIXED.split())) + " END"


def stemmable(match: Match, token: str = "token") -> str:
    return f"({match(token, '^[a-z0-9]{2,}$')} AND {match(token, '[a-z]')})"


def spark_match(value: str, pattern: str) -> str:
    return f"({value} RLIKE '{pattern}')"


def add_stem(tokens: DataFrame, token: str = "token", stem: str = "stem") -> DataFrame:
    """Adds ``stem``. Each step is bound by a lambda, so it is computed once, and a filter on the stem that
    moves below carries one copy of the chain and not one per mention of the word."""
    word = token
    for step in steps(spark_match):
        word = f"transform(array({word}), w -> {step})[0]"
    return tokens.withColumn(stem, F.expr(f"CASE WHEN NOT {stemmable(spark_match, token)} THEN {token} ELSE coalesce({fixed(token)}, {word}) END"))


def add_stem_stepwise(tokens: DataFrame, token: str = "token", stem: str = "stem") -> DataFrame:
    """As ``add_stem``, but each step is a projection of its own, which reads the last one's word several times and so is
    compiled and not folded into the next. For tables that are written as they are: a filter on the stem would move into
    the steps and multiply them."""
    found = tokens.withColumn("_word", F.col(token))
    for step in steps(spark_match):
        found = found.withColumn("_word", F.expr(re.sub(r"\bw\b", "_word", step)))
    return found.withColumn(stem, F.expr(f"CASE WHEN NOT {stemmable(spark_match, token)} THEN {token} ELSE coalesce({fixed(token)}, _word) END")).drop("_word")
