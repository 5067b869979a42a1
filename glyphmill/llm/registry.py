"""What __spark_entry__ adds where this subpackage is present."""

from glyphmill.llm.oracle import ORACLE
from glyphmill.llm.queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
