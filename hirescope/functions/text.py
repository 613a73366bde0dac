"""Tokens and word n-grams, as built-in string/array expressions.

No lambdas: higher-order functions are interpreted per element, while
``regexp_replace``, ``split`` and ``regexp_extract_all`` run generated code.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our definition (the source names a keyword extractor but states no rules):
# a token is a maximal run of letters, digits, '+' or '#' in the lower-cased
# text, so "c++", "c#" and "401k" stay whole; an n-gram joins 1 to 3
# consecutive tokens with one blank.
TOKEN_SPLIT = r"[^\p{L}\p{N}+#]+"
MAX_NGRAM = 3


def normalized(text: Column) -> Column:
    """Lower-cased whole text with every separator run turned into one blank."""
    return F.trim(F.regexp_replace(F.lower(text), TOKEN_SPLIT, " "))


def tokens(text: Column) -> Column:
    """Array of tokens over the whole text (no prefix cut)."""
    return F.array_remove(F.split(normalized(text), " "), "")


def _ngram_pattern(n: int) -> str:
    # The look-ahead captures the n tokens that begin here; what is consumed is
    # the first of them with its blank, so the next match is tried at the next
    # token. Nothing backtracks.
    return r"(?=([^ ]++" + r"(?: [^ ]++)" * (n - 1) + "))[^ ]++ "


def ngrams(text: Column, max_n: int = MAX_NGRAM) -> Column:
    """Every 1..max_n-gram occurrence of the text, in one array (repeats kept)."""
    return ngrams_of_normalized(normalized(text), max_n)


def ngrams_of_normalized(norm: Column, max_n: int = MAX_NGRAM) -> Column:
    """``ngrams`` over text already passed through ``normalized``.

    Project the normalized text as its own column first: the three
    expressions below then share it instead of each redoing the
    lower-case and separator rewrite of the whole text.
    """
    parts = [F.array_remove(F.split(norm, " "), "")]
    parts += [F.regexp_extract_all(norm, F.lit(_ngram_pattern(n)), F.lit(1))
              for n in range(2, max_n + 1)]
    return F.concat(*parts)
