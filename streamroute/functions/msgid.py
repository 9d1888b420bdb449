"""Message ids: one canonical form for every written form of the same 16 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(c: Column | str) -> Column:
    """32 lower-case hex digits, or null for null and for texts that hold no 16 bytes.

    Case, dashes, braces, blanks, line ends and a leading ``urn:uuid:`` don't matter.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "^[^0-9a-z]*urn:uuid:", ""), r"[\s{}()\-]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


#: The same in DuckDB's SQL; {0} is the column.
CANONICAL_SQL = (
    r"case when regexp_full_match(regexp_replace(regexp_replace(lower({0}), '^[^0-9a-z]*urn:uuid:', ''), '[\s{{}}()\-]', '', 'g'), '[0-9a-f]{{32}}')"
    r" then regexp_replace(regexp_replace(lower({0}), '^[^0-9a-z]*urn:uuid:', ''), '[\s{{}}()\-]', '', 'g') end"
)


def canonical_sql(column: str) -> str:
    return CANONICAL_SQL.format(column)
