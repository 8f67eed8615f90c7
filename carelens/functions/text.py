"""Text Column functions: reply cleaning, Unicode strip, tokens, n-grams.

Patterns spell out Python's Unicode classes explicitly: Java's ``\\s`` and
``\\w`` are ASCII-only by default, and ``(?U)`` means something else in
other engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, as a Java character-class body.
WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Python's Unicode \w: letters, numbers, underscore.
WORD = r"\p{L}\p{N}_"
# Tokens of two or more word characters (the vectorizer's default rule).
TOKEN_PATTERN = f"[{WORD}]{{2,}}"


def py_strip(c: Column) -> Column:
    """``str.strip()``: drop leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def clean_reply(c: Column) -> Column:
    """Historical reply cleaning, in order: URLs, @handles, agent
    initials like " /LM", whitespace runs -> one space, strip."""
    x = F.regexp_replace(c, f"https?://[^{WS}]+", "")
    x = F.regexp_replace(x, f"@[{WORD}]+", "")
    x = F.regexp_replace(x, f"[{WS}]*/[A-Z]{{2}}(?![{WORD}])", "")
    x = F.regexp_replace(x, f"[{WS}]+", " ")
    return F.trim(x)


def tokens(c: Column) -> Column:
    """Lower-cased word tokens (array), in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def unigrams_and_bigrams(toks: Column) -> Column:
    """Tokens followed by adjacent-token bigrams ("a b"), as one array.

    Built with higher-order functions on the row's own array: no
    posexplode, no window, no shuffle.
    """
    n = F.size(toks)
    bigrams = F.when(
        n >= 2,
        F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1),
                   lambda a, b: F.concat(a, F.lit(" "), b)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(toks, bigrams)
