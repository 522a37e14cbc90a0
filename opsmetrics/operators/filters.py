"""Session filters chosen by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import like

FILTER_COLUMNS = {
    "session": "session_id",
    "program": "program_name",
    "database": "database_name",
    "login": "login_name",
    "host": "host_name",
}


def filter_sessions(df: DataFrame, kind: str = "session", pattern="", not_kind: str = "session",
                    not_pattern="", columns: dict | None = None) -> DataFrame:
    """Keep rows that match one filter and drop rows that match another.

    A session filter is an id, 0 or blank for all; the other kinds take ``%`` and ``_``.
    """
    names = columns or FILTER_COLUMNS

    def matches(kind, pattern):
        name = names[kind]
        if kind == "session":
            return None if pattern in ("", 0, "0") else F.col(name) == F.lit(int(pattern))
        return None if pattern == "" else like(name, pattern)

    wanted, unwanted = matches(kind, pattern), matches(not_kind, not_pattern)
    if wanted is not None:
        df = df.where(wanted)
    if unwanted is not None:
        df = df.where(~unwanted)
    return df
