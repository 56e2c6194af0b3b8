"""Text normalisation as Spark column expressions (no UDFs).

All functions take and return ``pyspark.sql.Column`` and stay inside
whole-stage code generation.  Regular expressions are Java regex; the
character classes below are written so that the same text also compiles in
RE2, which the DuckDB oracle uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Whitespace as Python's str.isspace() defines it (the reference strips and
# collapses with Python's Unicode-aware ``\s``):
#   U+0009..U+000D, U+001C..U+001F, U+0020, U+0085, U+00A0, U+1680,
#   U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The 32 ASCII punctuation marks (Python's string.punctuation).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Punctuation removed by the skill-token normaliser: all of the above but + # .
SKILL_TOKEN_PUNCTUATION = "!\"$%&'()*,-/:;<=>?@[\\]^_`{|}~"
# Title abbreviations expanded by the title normaliser.
TITLE_TOKEN_MAP = {"sr": "senior", "jr": "junior", "dev": "developer", "eng": "engineer"}
# Delimiters that split a description into skill signals.
SIGNAL_DELIMITERS = "[,;\n]+"
# --- end of fixed values ----------------------------------------------------

# The same whitespace set as literal characters, for trim/translate (no regex).
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
_WS_NOT_SPACE = WHITESPACE_CHARS.replace(" ", "")
_WS_RUN = WHITESPACE_CLASS + "+"
_NOT_WS = "[^" + WHITESPACE_CLASS[1:]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace (Unicode, as Python's ``strip``)."""
    return F.trim(_col(c), F.lit(WHITESPACE_CHARS))


def is_blank(c: Column | str) -> Column:
    """Null, empty or whitespace only.  A search for the first non-whitespace
    character, so a long text is not rewritten just to be tested."""
    return ~F.coalesce(_col(c), F.lit("")).rlike(_NOT_WS)


def blank_to_null(c: Column | str) -> Column:
    """Strip; an empty result becomes null (text coercion of the row contract)."""
    stripped = strip_ws(_col(c))
    return F.when(stripped == F.lit(""), F.lit(None).cast("string")).otherwise(stripped)


def collapse_whitespace(c: Column | str) -> Column:
    """Strip, then turn every whitespace run into one space (F1).

    Every whitespace character becomes a space (a character map), then runs
    of spaces are squeezed: the same result as replacing runs of the Unicode
    class, at about half the cost.
    """
    spaced = F.translate(_col(c), _WS_NOT_SPACE, " " * len(_WS_NOT_SPACE))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def strip_common_punctuation(c: Column | str) -> Column:
    """Replace each ASCII punctuation mark with a space (F2)."""
    return F.translate(_col(c), ASCII_PUNCTUATION, " " * len(ASCII_PUNCTUATION))


def clean_text(c: Column | str) -> Column:
    """Punctuation to spaces, collapse whitespace, lower case."""
    return F.lower(collapse_whitespace(strip_common_punctuation(c)))


def normalize_key(c: Column | str) -> Column:
    """Alias key / role hint / signal key: collapse whitespace and lower case.

    Punctuation is kept.
    """
    return F.lower(collapse_whitespace(c))


def normalize_role_hint_query(c: Column | str) -> Column:
    """Free-text role query key: the same as clean_text."""
    return clean_text(c)


def normalize_title(c: Column | str, token_map: dict[str, str] | None = None) -> Column:
    """clean_text, then expand abbreviations token by token."""
    mapping = token_map or TITLE_TOKEN_MAP
    lookup = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    tokens = F.split(clean_text(c), " ")
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(lookup, t), t)), " ")


# A skill token of lower-cased text with single spaces: "c" with two pluses or
# a hash, which may stand apart; ".net" not inside a word; else a run of
# characters that are neither spaces nor dropped punctuation, up to such a name.
_SKILL_NAME = r"\bc ?\+ ?\+|\bc ?#|(?<!\w)\.net\b"
_DROPPED = "".join("\\" + ch for ch in SKILL_TOKEN_PUNCTUATION)
SKILL_TOKEN = f"(?U)(?:{_SKILL_NAME})|(?:(?!{_SKILL_NAME})[^ {_DROPPED}])+"


def normalize_skill_token(c: Column | str) -> Column:
    """Skill tokens joined by single spaces; ``+ # .`` are kept, ``c + +`` and
    ``c #`` are glued (F7).  Word boundaries follow Unicode word characters."""
    tokens = F.regexp_extract_all(F.lower(collapse_whitespace(c)), F.lit(SKILL_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.replace(t, F.lit(" "), F.lit(""))), " ")


def first_line(c: Column | str) -> Column:
    return F.substring_index(_col(c), "\n", 1)


def name_based_id(*cols: Column | str) -> Column:
    """Deterministic id from a natural key: SHA-256 hex of the '|'-joined parts."""
    return F.sha2(F.concat_ws("|", *[_col(c).cast("string") for c in cols]), 256)


def error_text(c: Column | str, max_length: int = 2000) -> Column:
    """Stripped error message cut to ``max_length`` characters."""
    return F.substring(strip_ws(c), 1, max_length)
