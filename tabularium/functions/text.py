"""Text expressions shared by cleaning, chunking, search and labelling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode classes and "." stopping at \n only, as the patterns of this package expect.
FLAGS = "(?dU)"
SPACE = r"[\s\x1c-\x1f]"
# The same characters as a trim set.
SPACE_CHARACTERS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(SPACE_CHARACTERS))


def words(text: Column | str) -> Column:
    """Whitespace-separated words, without empty ones.

    Rare kinds of white space become blanks first, so the split itself needs no pattern matching.
    """
    blanks = F.regexp_replace(col(text), f"{FLAGS}[\\s\\x1c-\\x1f&&[^ ]]", " ")
    return F.filter(F.split(blanks, " "), lambda w: w != "")


def word_tokens(text: Column | str) -> Column:
    r"""Distinct ``\w+`` runs of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(f"{FLAGS}(\\w+)"), 1))


def quote(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Scorers over long pattern lists are written as SQL text: one parse instead of a call per term.
# ``text`` is a column name or SQL expression; it is used as is, so lower it beforehand if needed.

def matches_sql(text: str, pattern: str, flags: str = FLAGS) -> str:
    return f"coalesce({text} RLIKE {quote(flags + pattern)}, false)"


def hits_sql(text: str, patterns: Sequence[str]) -> str:
    """How many of the patterns occur in the text."""
    return "(" + " + ".join(f"int({matches_sql(text, p)})" for p in patterns) + ")"


def contains_sql(text: str, terms: Sequence[str]) -> str:
    """Whether any of the terms occurs in the text."""
    return "(" + " OR ".join(f"coalesce(contains({text}, {quote(t)}), false)" for t in terms) + ")"


def weight_sql(text: str, terms: Sequence[str], weight: int) -> str:
    """``weight`` per term that occurs in the text."""
    return "(" + " + ".join(f"IF(contains({text}, {quote(t)}), {weight}, 0)" for t in terms) + ")"


def occurrences_sql(text: str, term: str) -> str:
    """Non-overlapping occurrences of a literal term."""
    return f"((length({text}) - length(replace({text}, {quote(term)}, ''))) DIV {len(term)})"


def found_sql(tests: dict[str, str]) -> str:
    """Array of the names whose SQL test holds."""
    return "array_compact(array(" + ", ".join(f"IF({test}, {quote(name)}, NULL)" for name, test in tests.items()) + "))"


def strings_sql(values: Sequence[str]) -> str:
    return "array(" + ", ".join(quote(v) for v in values) + ")"


def map_sql(table: dict[str, str]) -> str:
    """Literal map; the values are SQL expressions."""
    return "map(" + ", ".join(f"{quote(k)}, {v}" for k, v in table.items()) + ")"


def let_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def first_best_sql(scores: dict[str, str]) -> str:
    """struct(name, score, total): the highest score (the first name wins ties) and the sum of all."""
    values = "array(" + ", ".join(scores.values()) + ")"
    return let_sql(values, "scores", (
        f"named_struct('name', {strings_sql(list(scores))}[int(array_position(scores, array_max(scores))) - 1], "
        "'score', array_max(scores), 'total', aggregate(scores, 0, (total, x) -> total + int(x)))"))


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def jaccard(left: Column, right: Column) -> Column:
    """Share of common words of two word sets; two empty sets are equal."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / union)
