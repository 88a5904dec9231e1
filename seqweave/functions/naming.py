"""One spelling for every event name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capital letters, anything that is neither letter nor digit, a number; what follows it is a reading, a counter or a stray mark.
SPELLING = r"^[^A-Z0-9]*([A-Z]+)[^A-Z0-9]*0*([0-9]+)[\s\S]*$"
PROPER = "^[A-Z]+_(?:0|[1-9][0-9]*)$"


def event_name(token: Column) -> Column:
    """The name a token denotes: capital letters, an underscore, the number without leading zeros.

    Null, blank and otherwise nameless tokens give null. Most tokens are proper already and cost one match.
    """
    rewritten = F.regexp_replace(F.upper(token), SPELLING, "$1_$2")
    return F.when(token.rlike(PROPER), token).when(rewritten.rlike(PROPER), rewritten)


def source_name(source: Column) -> Column:
    """One spelling for a document's source: lower case, trimmed, words joined by underscores; blank gives null."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s ]+", " "))), r"[\s\-]+", "_")
    return F.when(name != "", name)
