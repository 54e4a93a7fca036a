"""Which keys tables share."""

from pyspark.sql import DataFrame


def scope(*tables: DataFrame) -> list[str]:
    """The columns project_id and article, as far as every table has them: names inside an article mean nothing outside it."""
    return [c for c in ("project_id", "article") if all(c in t.columns for t in tables)]
