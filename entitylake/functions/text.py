"""Word-level text expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: a name token is a run of letters and digits.
NAME_TOKEN = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words separated by any Unicode white space; an empty array for a blank text."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def first_words(text: Column, limit: int) -> Column:
    """The text as it is, or its first ``limit`` words if it has more."""
    return F.when(
        word_count(text) > limit, F.array_join(F.slice(words(text), 1, limit), " ")
    ).otherwise(text)


def name_tokens(text: Column) -> Column:
    """Runs of letters and digits, in order, case kept."""
    return F.regexp_extract_all(text, F.lit(NAME_TOKEN), F.lit(0))
