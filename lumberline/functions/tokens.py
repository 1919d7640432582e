"""Typed tokens of a line: level words, strings, addresses, paths, times, identifiers, numbers.

One expression finds the tokens: at each place its alternatives are tried in order of priority,
and matching goes on behind the token found.  Loops are possessive, so that long lines need no
deep stack and no retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumberline.plans.regexes import TOKEN_PATTERNS

_WORD = r"[\p{L}\p{N}_]"
_START, _END = rf"(?<!{_WORD})", rf"(?!{_WORD})"
_HEX = r"[\p{Nd}A-Fa-f]"
_BLANK = r"\s\p{Z}"

# Fixed value: characters of a file path.
_PATH = r"\p{L}\p{N}/\\._\-@~()\[\]{}+&#$%!=^"
_PATH_BLANK = r" (?=[\p{L}\p{N}(\[{])"  # a blank belongs to a path if a name goes on behind it
_PATH_BODY = rf"[{_PATH}]*+(?:{_PATH_BLANK}[{_PATH}]*+)*+"
_PATH_CHAR = rf"(?:[{_PATH}]|{_PATH_BLANK})"
_PATH_STARTS = "|".join([
    rf"\p{{L}}:[\\/](?={_PATH_CHAR})",                 # C:\a
    rf"(?=\.{{1,2}}/)(?=\.{_PATH_CHAR}{{3}})\.",       # ./ab, ../a
    rf"(?=/[^/])(?=/(?:[{_PATH}&&[^/\\]]|{_PATH_BLANK})*+[/\\])/",  # /a/b
])

_CLOCK = r"\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:[.,]\p{Nd}++)?+(?:[Zz]|[+-]\p{Nd}{2}:?+(?:\p{Nd}{2})?+)?+"
_DATE = r"\p{Nd}{4}(?<dsep>[-/])\p{Nd}{2}\k<dsep>\p{Nd}{2}"
_GUID = rf"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"

LEVEL_WORDS = "FATAL|ERROR|WARNING|WARN|INFO|DEBUG|TRACE"  # fixed value

# In order of priority.
RULES = {
    "level": rf"{_START}(?:{LEVEL_WORDS}){_END}",
    "string": r'''"[^"\n]*+(?:(?<=\\)"[^"\n]*+)*+"|'[^'\n]*+(?:(?<=\\)'[^'\n]*+)*+\'''',
    # A letter inside a word starts no address that its word would not have started.
    "url": rf"(?:\G|(?<!\p{{L}}))\p{{L}}[\p{{L}}\p{{N}}+\-.]*+://[^{_BLANK}<>{{}}|^]*[^{_BLANK}<>{{}}|^,;.)'\"\]]",
    "path": rf"{_START}(?:{_PATH_STARTS}){_PATH_BODY}",
    "timestamp": rf"{_START}(?>{_DATE}(?:[T ]{_CLOCK})?+|{_CLOCK}){_END}",
    "guid": rf"{_START}(?:\{{{_GUID}\}}|{_GUID}){_END}",
    "hex": rf"{_START}0[xX]{_HEX}++",
    "raw_hex": rf"{_START}(?<!\.)(?=\p{{Nd}})(?=\p{{Nd}}*+[A-Fa-f]){_HEX}{{6,}}+{_END}",
    "number": rf"{_START}(?<![.\-,])\p{{Nd}}(?:[\p{{Nd}}.]*+(?<!\.)|[\p{{Nd}}.]*?(?=\.(?![\p{{Nd}}.])))(?![\p{{L}}_\-,])",
}
# The first test passes over all places where no token can start.
ANY_TOKEN = r"(?=[\p{L}\p{Nd}\"'/.{])(?:" + "|".join(f"(?:{rule})" for rule in RULES.values()) + ")"


def token_kind(token: Column) -> Column:
    """Type of a token that ``ANY_TOKEN`` found, told by its shape."""
    return (
        F.when(token.rlike(f"^(?:{LEVEL_WORDS})$"), "level")
        .when(token.rlike("^[\"']"), "string")
        .when(F.contains(token, F.lit("://")), "url")
        .when(token.rlike(r"^(?:\p{L}:|[/.])"), "path")
        .when(token.rlike(r"^(?:\p{Nd}{4}[-/]|\p{Nd}{2}:)"), "timestamp")
        .when(token.rlike(rf"^\{{?{_HEX}{{8}}-"), "guid")
        .when(token.rlike("^0[xX]"), "hex")
        .when(token.rlike("[A-Fa-f]"), "raw_hex")
        .when(token.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .otherwise("number")
    )


def line_tokens(text: Column) -> Column:
    """The tokens of a line from left to right; punctuation at the end of a path is not part of it."""
    found = F.regexp_extract_all(text, F.lit(ANY_TOKEN), F.lit(0))
    is_path = r"^(?:\p{L}:[\\/](?!/)|[/.])"
    return F.transform(
        found, lambda t: F.when(t.rlike(is_path), F.regexp_replace(t, r"(?<=.)[.!]+$", "")).otherwise(t)
    )


def token_type(value: Column) -> Column:
    """What a whole value is: ``url``, ``timestamp``, ``path`` or ``none``."""
    t = F.regexp_replace(value, rf"^[{_BLANK}]+|[{_BLANK}]+$", "")
    return (
        F.when((t == "") | F.contains(t, F.lit("\n")), "none")
        .when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+\-.]*://\S+$"), "url")
        .when(t.rlike(f"^{TOKEN_PATTERNS['timestamp']}$"), "timestamp")
        .when(t.rlike(r"[/\\]"), "path")
        .otherwise("none")
    )
