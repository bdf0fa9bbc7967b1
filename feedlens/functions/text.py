"""String column expressions: cleaning, display formatting, tokenising.

All of these are built-in Spark expressions on the JVM side; no Python runs
per row.  The long character tables are derived from a rule
(Python's Unicode database) rather than written out.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions import fixed


# --------------------------------------------------------------------------
# Character classes derived from rules
# --------------------------------------------------------------------------

def _ranges(codepoints: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in codepoints:
        if out and out[-1][1] == cp - 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _class(codepoints: list[int]) -> str:
    parts = []
    for lo, hi in _ranges(codepoints):
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "[" + "".join(parts) + "]"


@lru_cache(maxsize=1)
def whitespace_class() -> str:
    """Regex class of the characters Python's ``str.strip()`` removes (BMP).

    Java's regex and RE2 both read the ``\\x{h}`` form, so the same pattern
    runs in Spark and in the DuckDB oracle.
    """
    return _class([cp for cp in range(0x10000) if chr(cp).isspace()])


@lru_cache(maxsize=1)
def whitespace_chars() -> str:
    """The same set as a plain string, for ``trim(str, chars)``."""
    return "".join(chr(cp) for cp in range(0x10000) if chr(cp).isspace())


@lru_cache(maxsize=1)
def ws_ends_pattern() -> str:
    """Leading or trailing whitespace run, for a strip by ``regexp_replace``."""
    ws = whitespace_class()
    return rf"\A{ws}+|{ws}+\z"


# Blocks whose precomposed letters fold to one base letter under NFD.
_FOLD_BLOCKS = ((0x00C0, 0x024F), (0x0370, 0x03FF), (0x0400, 0x04FF),
                (0x1E00, 0x1EFF), (0x1F00, 0x1FFF))


@lru_cache(maxsize=1)
def accent_fold_table() -> tuple[str, str]:
    """(source, target) strings for ``translate``: each precomposed character
    whose canonical decomposition is one base character plus combining marks
    maps to that base character (the rule behind "strip accents")."""
    src, dst = [], []
    for lo, hi in _FOLD_BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            nfd = unicodedata.normalize("NFD", ch)
            if len(nfd) > 1 and all(unicodedata.category(m).startswith("M") for m in nfd[1:]):
                src.append(ch)
                dst.append(nfd[0])
    return "".join(src), "".join(dst)


# CJK ideograph blocks that are split one character per token.
_CJK_BLOCKS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF))


@lru_cache(maxsize=1)
def cjk_class() -> str:
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in _CJK_BLOCKS) + "]"


@lru_cache(maxsize=1)
def token_pattern() -> str:
    """One token: a CJK ideograph, a run of letters/marks/digits, or a single
    punctuation or symbol character."""
    return cjk_class() + r"|[\p{L}\p{M}\p{N}]+|[\p{P}\p{S}]"


# --------------------------------------------------------------------------
# Cleaning
# --------------------------------------------------------------------------

def ustrip(c: Column) -> Column:
    """Strip the Unicode whitespace set from both ends (``str.strip()``).

    ``trim`` with a character set only touches the ends of the string, where a
    regex strip would scan the whole (possibly very long) text."""
    return F.trim(c, F.lit(whitespace_chars()))


def clean_text(c: Column, null_text: str | None = fixed.NULL_TEXT) -> Column:
    """null -> ``null_text``; remove every double quote; then strip.

    Quote removal comes first, so ``' "x" '`` becomes ``x``.  With
    ``null_text=None`` a null stays null (the sane mode)."""
    base = c if null_text is None else F.coalesce(c, F.lit(null_text))
    return ustrip(F.replace(base, F.lit('"'), F.lit("")))


def na_to_null(c: Column, na_values=fixed.PANDAS_NA_VALUES) -> Column:
    """Map pandas' default missing-value strings to null (CSV input only)."""
    return F.when(c.isin(list(na_values)), F.lit(None).cast("string")).otherwise(c)


def nonblank(c: Column) -> Column:
    """Code-point length above zero."""
    return F.char_length(c) > 0


# --------------------------------------------------------------------------
# Display formatting
# --------------------------------------------------------------------------

def display_text(c: Column, width: int = fixed.DISPLAY_CHARS,
                 suffix: str = fixed.DISPLAY_SUFFIX) -> Column:
    """Cut to ``width`` code points and append ``...`` only when longer."""
    return (F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width), F.lit(suffix)))
             .otherwise(c))


def format_pct(c: Column, decimals: int = 2) -> Column:
    """``x`` as a percent string with ``decimals`` places, e.g. 0.7918 -> 79.18%.

    ``format_number`` rounds the exact binary value half-even, like Python's
    ``format(x, '.2%')``; ``format_string('%.2f')`` does not."""
    return F.concat(F.format_number(c * 100, decimals), F.lit("%"))


# --------------------------------------------------------------------------
# Tokenising
# --------------------------------------------------------------------------

NON_ASCII = r"[^\x{0}-\x{7f}]"


#: Combining marks: what is left of an accent that stands as a character of its own.
MARKS = r"\p{Mn}+"


def fold_accents(c: Column) -> Column:
    """Accent fold: precomposed letters by ``translate``, then combining marks
    go, so composed and decomposed forms of a word are one token.  Skipped for
    all-ASCII text, where it is the identity."""
    src, dst = accent_fold_table()
    folded = F.regexp_replace(F.translate(c, src, dst), F.lit(MARKS), F.lit(""))
    return F.when(c.rlike(NON_ASCII), folded).otherwise(c)


def _apart(c: Column) -> Column:
    """CJK ideographs set apart by spaces."""
    return F.regexp_replace(c, F.lit("(" + cjk_class() + ")"), F.lit(" $1 "))


def normalise(c: Column) -> Column:
    """Lower-case, fold accents, and set CJK ideographs apart by spaces."""
    return _apart(fold_accents(F.lower(c)))


def normalise_sql(column: str) -> str:
    """``normalise`` as a SQL expression (for a persisted ML stage)."""
    src, dst = accent_fold_table()
    low = f"lower({column})"
    folded = f"regexp_replace(translate({low}, '{src}', '{dst}'), r'{MARKS}', '')"
    kept = f"CASE WHEN rlike({low}, r'{NON_ASCII}') THEN {folded} ELSE {low} END"
    return f"regexp_replace({kept}, r'({cjk_class()})', ' $1 ')"


#: ``token_pattern`` for lower-cased text that is all ASCII.
ASCII_TOKEN = r"[0-9a-z]+|[!-/:-@\[-`{-~]"


def tokens(c: Column) -> Column:
    """Whole-text token array (no truncation; see ``truncate``).

    All-ASCII text has no accents or ideographs, and plain ranges match it
    several times faster than Unicode categories do."""
    low = F.lower(c)
    return (F.when(low.rlike(NON_ASCII), F.regexp_extract_all(normalise(c), F.lit(token_pattern()), F.lit(0)))
             .otherwise(F.regexp_extract_all(low, F.lit(ASCII_TOKEN), F.lit(0))))


def truncate(tok: Column, max_length: int = fixed.MAX_LENGTH, specials: int = 2) -> Column:
    """Keep the first ``max_length - specials`` tokens ([CLS] and [SEP] take two)."""
    return F.slice(tok, 1, max_length - specials)
