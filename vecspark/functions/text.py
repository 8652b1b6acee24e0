"""Text functions and term weights as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and line patterns.
STANDARD_TOKEN = r"[\p{L}\p{N}]+(?:['’.][\p{L}\p{N}]+)*"
MESSAGE_BREAK = r"[^\p{L}\p{Nd}./:]+"
QUOTED_LINE = r"^(?:In article .*|> .*|.*writes:|\|>.*)$"
QUOTED_LINE_STRICT = r"^(?:In article .*|> .*|.*writes:|\|>)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize_standard(text) -> Column:
    """Runs of letters and digits, joined across inner apostrophes and dots; case is kept."""
    return F.regexp_extract_all(_col(text), F.lit(STANDARD_TOKEN), F.lit(0))


def tokenize_message(text) -> Column:
    """Lower-cased pieces between characters other than letters, digits, ``. / :``."""
    return F.filter(F.split(F.lower(_col(text)), MESSAGE_BREAK), lambda x: x != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def message_lines(text) -> Column:
    return F.split(_col(text), "\r?\n")


def _head_length(lines: Column) -> Column:
    """Number of lines before the first empty line."""
    return _let(F.array_position(lines, ""),
                lambda blank: F.when(blank > 0, blank.cast("int") - 1).otherwise(F.size(lines)))


def _headers_of(lines: Column, allowed: list[str]) -> Column:
    names = [h.strip().lower() for h in allowed]
    heads = F.slice(lines, F.lit(1), _head_length(lines))
    return F.filter(heads, lambda s: F.lower(F.substring_index(s, ":", 1)).isin(names))


def _body_of(lines: Column, include_quotes: bool, strict: bool) -> Column:
    body = F.slice(lines, _head_length(lines) + 1, F.size(lines))
    if include_quotes:
        return body
    pattern = QUOTED_LINE_STRICT if strict else QUOTED_LINE
    return F.filter(body, lambda s: ~s.rlike(pattern))


def header_lines(text, allowed: list[str]) -> Column:
    """Header lines whose lower-cased name is listed."""
    return _let(message_lines(text), lambda lines: _headers_of(lines, allowed))


def body_lines(text, include_quotes: bool = False, strict: bool = False) -> Column:
    """Lines from the first empty line on, without quoted ones unless kept."""
    return _let(message_lines(text), lambda lines: _body_of(lines, include_quotes, strict))


def parse_message(text, headers: list[str], include_quotes: bool = False, strict: bool = False) -> Column:
    """The part of a message that counts: values of the listed headers, then the body."""
    def kept(lines: Column) -> Column:
        values = F.transform(_headers_of(lines, headers),
                             lambda s: F.substring(s, F.instr(s, ":") + 1, F.length(s)))
        return F.array_join(F.concat(values, _body_of(lines, include_quotes, strict)), "\n")
    return _let(message_lines(text), kept)


def label_from_path(path) -> Column:
    """Name of the folder that holds a file; null when there is none."""
    return F.try_element_at(F.split(_col(path), "/"), F.lit(-2))


def hash_term(term, dim: int) -> Column:
    """Bucket of a term, from the first 32 bits of its md5 digest."""
    head = F.conv(F.substring(F.md5(_col(term)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(dim)).cast("int")


TERM_WEIGHTS: dict[str, Callable[[Column], Column]] = {
    "l": lambda tf: F.log1p(tf),
    "s": lambda tf: F.sqrt(tf),
    "t": lambda tf: tf.cast("double"),
    "x": lambda tf: F.lit(1.0),
}


def _idf(tf: Column, df: Column, n: Column, floor_ratio: bool) -> Column:
    ratio = (n + 1) / (df + 1)
    return tf * F.log(F.floor(ratio) if floor_ratio else ratio)


CORPUS_WEIGHTS: dict[str, Callable[..., Column]] = {
    "i": _idf,
    "x": lambda tf, df, n, floor_ratio: tf,
}


def parse_code(code: str) -> tuple[Callable, Callable, bool, bool]:
    """Three-letter weighting code -> (term weight, corpus weight, needs df, cosine)."""
    if len(code) != 3 or code[0] not in TERM_WEIGHTS or code[1] not in CORPUS_WEIGHTS or code[2] not in "cx":
        raise ValueError("weighting code must match [lstx][ix][cx]")
    return TERM_WEIGHTS[code[0]], CORPUS_WEIGHTS[code[1]], code[1] == "i", code[2] == "c"


SCORERS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "linear": lambda tf, df, n: tf * F.log(n / df),
    "const": lambda tf, df, n: F.log(n / df),
    "log": lambda tf, df, n: F.log(tf) * F.log(n / df),
    "sqrt": lambda tf, df, n: F.sqrt(tf) * F.log(n / df),
}


def get_scorer(scorer: str | Callable) -> Callable[[Column, Column, Column], Column]:
    """A scorer by name, or any ``(tf, df, n) -> Column`` callable."""
    if callable(scorer):
        return scorer
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}; known: {sorted(SCORERS)}")
    return SCORERS[scorer]
