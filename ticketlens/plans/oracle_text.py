"""SQL text for the check engine's side of the text operators. Its regex dialect has no
look-behind and an ASCII word class, so the word class is spelled out."""

from __future__ import annotations

from ticketlens.fixed_values import ORDER_NUMBER, ORDER_NUMBER_TOKEN, PII_PATTERNS

WORD = r"\p{L}\p{N}_"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(text: str) -> str:
    return quoted(text.replace(r"[\w", f"[{WORD}").replace(r"\w", f"[{WORD}]"))


# The check engine's word boundary only knows ASCII. Every other letter or digit is put between
# two ASCII marks while the patterns run, which makes the boundaries come out the same.
MARK = "QZQ"


def wrapped(column: str) -> str:
    foreign = r"([^\P{L}\x00-\x7F]|[^\P{N}\x00-\x7F])"
    return f"regexp_replace({column}, '{foreign}', '{MARK}\\1{MARK}', 'g')"


def unwrapped(column: str) -> str:
    return f"replace({column}, '{MARK}', '')"


def _masked(column: str, upto: str | None = None) -> str:
    column = wrapped(column)
    for label, regex in PII_PATTERNS.items():
        if label == upto:
            break
        column = f"regexp_replace({column}, {pattern(regex)}, '[{label}]', 'g')"
    return column


def MASK(column: str) -> str:
    return unwrapped(_masked(column))


def CLEAN(column: str) -> str:
    hidden = (
        f"regexp_replace({wrapped(f'lower({MASK(column)})')}, {pattern(ORDER_NUMBER)}, "
        f"{quoted(ORDER_NUMBER_TOKEN)}, 'g')"
    )
    return unwrapped(hidden)


def COUNTED(column: str, label: str) -> str:
    regex = pattern(PII_PATTERNS[label])
    return f"len(regexp_extract_all({_masked(column, label)}, {regex}))"


def FOLD(column: str) -> str:
    return f"strip_accents(lower({column}))"


def WORDS(column: str, least: int = 2) -> str:
    return f"regexp_extract_all({column}, '[{WORD}]{{{least},}}')"
