"""Windows, thresholds and look-backs named in the text of a question, as column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of each unit, the words that count, and those that name a bound or a look-back.
ENGLISH_UNITS = {"day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365}
TURKISH_UNITS = {"gün": 1, "hafta": 7, "ay": 30, "yıl": 365}
COUNTS = {"one": 1, "two": 2, "three": 3, "four": 4, "six": 6, "a": 1, "an": 1, "next": 1, "bir": 1, "iki": 2, "üç": 3}
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "ten": 10}
#: Phrases before a number, and what is taken from it: a count must be above the result.
BOUNDS = {"more than": 0, "over": 0, "above": 0, "at least": 1}
BEFORE_PAST, PAST = ("in", "within", "during", "over"), ("last", "past", "previous")
UNITS = ENGLISH_UNITS | {f"{u}s": n for u, n in ENGLISH_UNITS.items()} | TURKISH_UNITS
_LETTER = r"[\p{L}\p{N}_]"


def _map(values: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def _any(words: Iterable[str]) -> str:
    return "|".join(words)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_horizon(question: Column) -> Column:
    """Days of an explicit window: a number and a unit anywhere, else a counting word and a unit; null without either."""
    text = F.lower(question)
    digits = rf"(\d+)\s*-?\s*(?:((?:{_any(ENGLISH_UNITS)})s?)(?![a-z])|({_any(TURKISH_UNITS)}))"
    words = rf"(?<!{_LETTER})({_any(COUNTS)})\s+({_any(ENGLISH_UNITS)})s?(?!{_LETTER})"
    number = _found(text, digits, 1).cast("int") * _map(UNITS, F.coalesce(_found(text, digits, 2), _found(text, digits, 3)))
    return F.coalesce(number, _map(COUNTS, _found(text, words, 1)) * _map(UNITS, _found(text, words, 2)))


def _tokens(question: Column) -> Column:
    """Words, numbers and signs in order, lower case: neighbours have white space or nothing between them."""
    return F.regexp_extract_all(F.lower(question), F.lit(rf"{_LETTER}+|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))


def _first_place(tokens: Column, read: Callable[[Callable[[int], Column]], Column]) -> Column:
    """What read makes of the first place of which it makes anything; its argument gives the token so many places on."""
    found = F.transform(tokens, lambda _, i: read(lambda k: F.try_element_at(tokens, i + F.lit(k + 1))))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def _number(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("int"))


def parse_threshold(question: Column) -> Column:
    """The number that a count must exceed: "more than 2" is 2, "at least 3" is 2."""

    def read(at: Callable[[int], Column]) -> Column:
        bounds = []
        for phrase, less in BOUNDS.items():
            words = phrase.split()
            after = at(len(words))
            here = reduce(and_, (at(k) == w for k, w in enumerate(words)))
            bounds.append(F.when(here, F.coalesce(_number(after), _map(NUMBERS, after)) - less))
        return F.coalesce(*bounds)

    return _first_place(_tokens(question), read).cast("double")


def parse_lookback(question: Column) -> Column:
    """Days of "in the last 14 days" and the like, with any unit."""

    def read(at: Callable[[int], Column]) -> Column:
        return F.when(at(0).isin(*BEFORE_PAST) & (at(1) == "the") & at(2).isin(*PAST), _number(at(3)) * _map(UNITS, at(4)))

    return _first_place(_tokens(question), read)


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.replace(text, F.lit("_"), F.lit(" "))), F.lit("([a-z]+)"), 1))
