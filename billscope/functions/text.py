"""Scalar text expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as white space.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(BLANKS))


def split_trim(text: Column, separators: str = "[,;]") -> Column:
    """Pieces between separators, stripped, empty ones dropped."""
    pieces = F.transform(F.split(text, separators), strip)
    return F.filter(pieces, lambda p: p != "")


def first_or(items: Column, default: str = "Desconhecido") -> Column:
    """First element of an array or the default."""
    return F.coalesce(F.get(items, F.lit(0)), F.lit(default))


def _label_pieces(labels: Column) -> Column:
    return F.split(labels, r"\),")


def all_states(labels: Column) -> Column:
    """State codes of ``"Name (PARTY-UF), …"`` in order, repeats kept."""
    dashed = F.filter(_label_pieces(labels), lambda p: p.contains("-"))
    return F.transform(
        dashed, lambda p: strip(F.replace(F.substring_index(p, "-", -1), F.lit(")"), F.lit("")))
    )


def all_parties(labels: Column) -> Column:
    """Party codes of ``"Name (PARTY-UF), …"`` in order, repeats kept."""
    marked = F.filter(_label_pieces(labels), lambda p: p.contains("(") & p.contains("-"))
    return F.transform(
        marked, lambda p: strip(F.substring_index(F.substring_index(p, "(", -1), "-", 1))
    )


def first_state(labels: Column) -> Column:
    return F.get(all_states(labels), F.lit(0))


def first_party(labels: Column) -> Column:
    return F.get(all_parties(labels), F.lit(0))


def joined_or_null(items: Column, separator: str = ", ") -> Column:
    """Joined text, null when there is nothing to join."""
    return F.when(F.size(items) > 0, F.array_join(items, separator))


def any_term(text: Column, terms: Iterable[str]) -> Column:
    """True when any term occurs, ignoring case; null text is false."""
    lowered = F.lower(text)
    hits = [lowered.contains(t.lower()) for t in terms]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def has_comma(text: Column) -> Column:
    return F.coalesce(text.contains(","), F.lit(False))


def author_label(name: Column, party: Column, state: Column) -> Column:
    """``name (party-state)``, unknown parts as ``?``, null for a blank name."""
    clean = strip(name)
    text = F.concat(
        clean, F.lit(" ("), F.coalesce(party, F.lit("?")), F.lit("-"),
        F.coalesce(state, F.lit("?")), F.lit(")"),
    )
    return F.when(clean != "", text)


def nested_or(path: Column, default: str) -> Column:
    """A nested value or the default when any step of the path is missing."""
    return F.coalesce(path, F.lit(default))


MEMBERS = T.ArrayType(
    T.StructType([T.StructField("id", T.LongType()), T.StructField("partido", T.StringType())])
)


def parse_struct_list(text: Column, schema: T.ArrayType = MEMBERS) -> Column:
    """Array of structs written as text; text that does not parse gives an empty array."""
    tidy = F.regexp_replace(text, r"(:\s*)None\b", "$1null")
    return F.coalesce(F.from_json(tidy, schema), F.array().cast(schema))


def clean_symbol(text: Column, symbol: str = "*") -> Column:
    return strip(F.replace(text, F.lit(symbol), F.lit("")))


def round2(number: Column) -> Column:
    """Two decimals, exact binary halves to the even side."""
    return F.rint(number * 100) / 100


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def to_text(value: Column) -> Column:
    return value.cast("string")


def lenient(value: Column, kind: str) -> Column:
    """Cast that turns a bad value into null."""
    return value.try_cast(kind)


def strict(value: Column, kind: str) -> Column:
    """Cast that fails the job on a bad value (ANSI mode)."""
    return value.cast(kind)
