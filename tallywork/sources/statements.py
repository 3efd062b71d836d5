"""Parameterised SQL: general statements whose tables, columns and values are all bound, never pasted in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: By purpose. Every name after IDENTIFIER is a table or column to bind, every other one a value.
STATEMENTS = {
    "values": "SELECT DISTINCT IDENTIFIER(:column) FROM IDENTIFIER(:table)",
    # a prefix is text, not a pattern: % and _ stand for themselves
    "starting": """
        FROM IDENTIFIER(:table) |> WHERE startswith(lower(IDENTIFIER(:column)), lower(:prefix)) |> ORDER BY ALL |> LIMIT :rows""",
    "figures": """
        FROM IDENTIFIER(:table) |> WHERE IDENTIFIER(:key) = :value
        |> AGGREGATE sum(IDENTIFIER(:number)) AS total, avg(IDENTIFIER(:number)) AS mean, min(IDENTIFIER(:day)) AS first_day""",
    "values_within": """
        FROM IDENTIFIER(:table) |> WHERE IDENTIFIER(:key) = :value AND IDENTIFIER(:number) > :above AND IDENTIFIER(:number) < :below
        |> SELECT DISTINCT IDENTIFIER(:column)""",
    "tally": "FROM IDENTIFIER(:table) |> AGGREGATE count(*) AS n GROUP BY IDENTIFIER(:column)",
    "tally_between": """
        FROM IDENTIFIER(:table) |> WHERE IDENTIFIER(:day) BETWEEN :first AND :last
        |> AGGREGATE count(*) AS n GROUP BY IDENTIFIER(:column) |> ORDER BY n DESC, IDENTIFIER(:column)""",
    "values_at_top": """
        WITH top AS (SELECT max(IDENTIFIER(:number)) AS most FROM IDENTIFIER(:table))
        SELECT DISTINCT IDENTIFIER(:column) FROM IDENTIFIER(:table) JOIN top ON IDENTIFIER(:number) = most""",
    # the days of a year as a range, so that the scan can skip row groups
    "starting_in_year": """
        FROM IDENTIFIER(:table) |> WHERE startswith(lower(IDENTIFIER(:column)), lower(:prefix))
        |> WHERE IDENTIFIER(:day) BETWEEN make_date(:year, 1, 1) AND make_date(:year, 12, 31)
        |> EXTEND date_format(IDENTIFIER(:day), 'MM') AS month""",
}


def ask(spark: SparkSession, purpose: str, **bound) -> DataFrame:
    """The answer of one of :data:`STATEMENTS`, its table, columns and values bound by name."""
    return spark.sql(STATEMENTS[purpose], args=bound)
