"""Text normalisation and token windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_TOKENS, WINDOW_STRIDE = 510, 384


def norm_key(text: Column) -> Column:
    """Lower-cased text without digits (Unicode's), other than a-z as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Nd}+", ""), "[^a-z]+", " "))


def collapse(text: Column) -> Column:
    """Runs of white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))


def canon(words: Column) -> Column:
    """Each token with its letters a-z only, lower-cased; may be empty."""
    return F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))


def split_tokens(collapsed: Column) -> Column:
    """The tokens of a collapsed text; none of an empty one."""
    return F.when(collapsed == "", F.array().cast("array<string>")).otherwise(F.split(collapsed, " "))


def canon_tokens(collapsed: Column) -> Column:
    """``canon`` of the tokens of a collapsed text, by one replacement over all of it."""
    return F.when(collapsed == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(F.lower(collapsed), "[^a-z ]", ""), " "))


def window_count(n: Column, size: int = WINDOW_TOKENS, stride: int = WINDOW_STRIDE) -> Column:
    """How many windows ``n`` tokens are cut into: windows start every ``stride`` and the first to reach the end is the last."""
    more = F.ceil((n - size) / F.lit(stride)).cast("int") + 1
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(more)


def windows(words: Column, size: int = WINDOW_TOKENS, stride: int = WINDOW_STRIDE) -> Column:
    """The windows of a token array, as an array of arrays; none for no tokens."""
    count = window_count(F.size(words), size, stride)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(words, i * stride + 1, size))
    return F.when(count > 0, cut).otherwise(F.array().cast("array<array<string>>"))


def bucket_label(year: Column, width: int = 5) -> Column:
    """The period of a year, such as 2005s."""
    return F.concat((F.floor(year / width) * width).cast("int").cast("string"), F.lit("s"))


def holds_prefix(query: Column, target: Column, size: int = 60) -> Column:
    """Whether the first ``size`` normalised characters of the query, if any, are part of the normalised target."""
    head = F.substring(norm_key(query), 1, size)
    return (head != "") & F.contains(norm_key(target), head)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, whatever refers to them.

    A plain projection may be merged into what follows, and an expression that a lambda
    refers to would be computed again for each element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
