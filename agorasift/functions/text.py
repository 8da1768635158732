"""Column expressions for social text: tokens, n-grams, accents, ages.

Everything here is a JVM-side expression, so the optimizer sees through it and
no Python worker is started.  Tokens follow one fixed grammar (web address,
@mention or #hashtag, word, symbol run) applied to the whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# The token grammar and the token classes.
TOKEN_PATTERN = (
    r"https?://[^\s]+|[@#][\p{L}\p{N}_]+|[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]+"
)
PUNCTUATION_PATTERN = r"^[\p{P}\p{Sm}\p{Sc}\p{Sk}]+$"
URL_PATTERN = r"^https?://"
EMOJI_PATTERN = r"^\p{So}"
NUMERIC_PATTERN = r"^\p{N}+$"

# Biography ages, in Spanish and English.
AGE_PATTERN = (
    r"(?iu)(?:^|level|lvl|nivel)\s?([0-6][0-9])\."
    r"|(?:^|[^\p{L}\p{N}_])([0-9]{2})\s?"
    r"(?:años|veranos|otoños|inviernos|primaveras|years old|vueltas|lunas|soles)"
)
AGE_BOUNDS = (10, 90)
AGE_BINS = ((0, 17), (17, 29), (29, 39), (39, 49), (49, 91))

# How feature families are shown in reports.
FAMILY_TITLES = {
    "tweet_tokens": "term",
    "description_token": "bio",
    "user_name": "name",
    "profile_domain": "bio.link",
    "domain": "link",
    "profile_tld": "bio.tld",
}


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose into a base letter plus combining marks."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def deaccent(text: Column) -> Column:
    """Drop accents: composed letters become base letters, loose marks vanish."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def raw_tokens(text: Column, lower: bool = True) -> Column:
    """All tokens of the text, in order."""
    text = F.lower(text) if lower else text
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def is_punctuation(token: Column) -> Column:
    return token.rlike(PUNCTUATION_PATTERN)


def is_url(token: Column) -> Column:
    return token.rlike(URL_PATTERN)


def is_numeric(token: Column) -> Column:
    return token.rlike(NUMERIC_PATTERN)


def _unwanted_pattern(remove_urls: bool, remove_punctuation: bool) -> str | None:
    parts = ([f"{URL_PATTERN}.*$"] if remove_urls else []) + ([PUNCTUATION_PATTERN] if remove_punctuation else [])
    return "|".join(parts) or None


def _plain_word(token: Column) -> Column:
    """A quick yes for most words, by their first letter; spares a pattern test."""
    return (token >= "a") & (token < "{") & ~token.startswith("http")


def clean_tokens(tokens: Column, remove_urls: bool = True, remove_punctuation: bool = True) -> Column:
    """Drop symbol runs and web addresses, as asked; one test per token."""
    pattern = _unwanted_pattern(remove_urls, remove_punctuation)
    if pattern is None:
        return tokens
    return F.filter(tokens, lambda token: _plain_word(token) | ~token.rlike(pattern))


def drop_stopwords(tokens: Column, stopwords: Sequence[str]) -> Column:
    """Remove the given words and keep repeats of all others."""
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(*stopwords))


def ngrams(
    tokens: Column,
    shortest: int,
    longest: int,
    stopwords: Sequence[str] = (),
    remove_urls: bool = True,
    remove_punctuation: bool = True,
) -> Column:
    """Word sequences of each length in ``[shortest, longest)``, joined by a space.

    A sequence is left out when it holds an emoji, a mention, a hashtag, a web
    address or a symbol run, when it ends in a stop word, or is all stop words.
    """

    if not range(shortest, longest):
        return F.array().cast("array<string>")
    pattern = _unwanted_pattern(remove_urls, remove_punctuation)

    def mark(token: Column) -> Column:
        unfit = token.rlike(EMOJI_PATTERN) | token.startswith("@") | token.startswith("#")
        if pattern is not None:
            unfit = unfit | token.rlike(pattern)
        unfit = ~_plain_word(token) & unfit
        stop = token.isin(*stopwords) if stopwords else F.lit(False)
        return F.struct(token.alias("token"), unfit.alias("unfit"), stop.alias("stop"))

    def of_length(marked: Column, n: int) -> Column:
        count = F.size(marked)
        starts = F.when(count >= n, F.sequence(F.lit(0), F.greatest(count - F.lit(n), F.lit(0)))).otherwise(
            F.array().cast("array<int>")
        )

        def gram(start: Column) -> Column:
            words = [F.get(marked, start + i) for i in range(n)]
            # a sequence of stop words only also ends in one
            fit = ~words[-1]["stop"]
            for word in words:
                fit = fit & ~word["unfit"]
            return F.when(fit, F.concat_ws(" ", *[word["token"] for word in words]))

        return F.array_compact(F.transform(starts, gram))

    # the one-element array binds the marked tokens to a name, so they are
    # computed once and not once per sequence
    bound = F.transform(
        F.array(F.transform(tokens, mark)),
        lambda marked: F.concat(*[of_length(marked, n) for n in range(shortest, longest)]),
    )
    return F.element_at(bound, 1)


def tokenize(
    text: Column,
    remove_urls: bool = True,
    without_accents: bool = False,
    remove_punctuation: bool = True,
    lower: bool = True,
    ngram_range: tuple[int, int] | None = None,
    stopwords: Sequence[str] = (),
) -> Column:
    """Tokens of a text, then its n-grams, without the stop words."""
    if without_accents:
        text = deaccent(text)
    tokens = clean_tokens(raw_tokens(text, lower), remove_urls, remove_punctuation)
    if ngram_range is not None:
        tokens = F.element_at(
            F.transform(
                F.array(tokens),
                lambda words: F.concat(words, ngrams(words, *ngram_range, stopwords, remove_urls, remove_punctuation)),
            ),
            1,
        )
    return drop_stopwords(tokens, stopwords)


def mask_handles(text: Column) -> Column:
    """Replace each @name by ``@user`` and each link by ``http``, word by word."""

    def mask(word: Column) -> Column:
        return (
            F.when(word.startswith("@") & (F.length(word) > 1), F.lit("@user"))
            .when(word.startswith("http"), F.lit("http"))
            .otherwise(word)
        )

    return F.array_join(F.transform(F.split(text, " "), mask), " ")


def is_plain_word(text: Column) -> Column:
    """Lower-case ASCII letters and digits only: the text is its own only token."""
    return text.rlike("^[a-z0-9]+$") & ~text.endswith("\n")


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text or its lower-case form holds one of the words anywhere."""
    tests = [t.contains(word) for t in (text, F.lower(text)) for word in sorted(words)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", ""))


def age_from_biography(text: Column) -> Column:
    """Age told by the first match; null below or above the accepted bounds."""
    low, high = AGE_BOUNDS
    found = F.array(*[F.regexp_extract(text, AGE_PATTERN, group) for group in (1, 2)])
    numbers = F.filter(F.transform(found, lambda digits: digits.try_cast("int")), lambda n: n >= low)
    return F.get(F.filter(F.slice(numbers, 1, 1), lambda n: n <= high), F.lit(0))


def age_bin(age: Column, names: Sequence[str] | None = None) -> Column:
    """Right-closed age interval, as a name (default ``(low,high]``)."""
    names = names or [f"({low},{high}]" for low, high in AGE_BINS]

    def name_of(value: Column) -> Column:
        result = F.lit(None).cast("string")
        for (low, high), name in zip(AGE_BINS, names):
            result = F.when((value > low) & (value <= high), F.lit(name)).otherwise(result)
        return result

    return F.get(F.transform(F.array(age), name_of), F.lit(0))


def family_title(family: Column) -> Column:
    """Short report name of a feature family."""
    kind = F.upper(F.element_at(F.split(family, "_"), 1))
    title = F.when(family.endswith("_group"), F.concat(kind, F.lit("(group)"))).when(
        family.endswith("_target"), F.when(kind == "MENTION", F.lit("REPLY")).otherwise(kind)
    )
    for name, shown in FAMILY_TITLES.items():
        title = title.when(family == name, F.lit(shown))
    return title.otherwise(F.when(family == "MENTION", F.lit("REPLY")).otherwise(family))
