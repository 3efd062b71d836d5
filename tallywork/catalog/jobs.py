"""The two modelling jobs, houses and personality, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.catalog.modelling import fitted_r2, held_out, solve
from tallywork.catalog.registry import Tables, longs, query, rounded
from tallywork.plans.house import HOUSE_FEATURES, house_report
from tallywork.plans.personality import ANSWERS, MEASURES, personality_report

# houses: one per line item; discounts of 0 and every third line number are gaps
_RAW = """raw AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id, l_extendedprice AS price,
           (l_linenumber % 4 + 1)::DOUBLE AS floors, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS waterfront, l_tax * 10 AS lat,
           nullif(l_linenumber, 3) AS bedrooms, l_suppkey % 7 AS sqft_basement, p_size % 5 AS "view",
           nullif(l_discount, 0) * 50 AS bathrooms, l_quantity AS sqft_living15, p_retailprice AS sqft_above, p_size AS grade,
           l_quantity * p_size AS sqft_living
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_FILLED = _RAW + """, filled AS (SELECT id, price, """ + ", ".join(
    f'coalesce("{c}", (SELECT avg("{c}") FROM raw))::DOUBLE AS "{c}"' for c in HOUSE_FEATURES) + " FROM raw)"
_XS = [f'"{c}"' for c in HOUSE_FEATURES]
_TEST = held_out("id", 0.2, 1)


def houses(t: Tables):
    joined = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return joined.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("id"),
        F.col("l_extendedprice").alias("price"), (F.col("l_linenumber") % 4 + 1).cast("double").alias("floors"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("waterfront"), (F.col("l_tax") * 10).alias("lat"),
        F.nullif(F.col("l_linenumber"), F.lit(3)).alias("bedrooms"), (F.col("l_suppkey") % 7).alias("sqft_basement"),
        (F.col("p_size") % 5).alias("view"), (F.nullif(F.col("l_discount"), F.lit(0.0)) * 50).alias("bathrooms"),
        F.col("l_quantity").alias("sqft_living15"), F.col("p_retailprice").alias("sqft_above"), F.col("p_size").alias("grade"),
        (F.col("l_quantity") * F.col("p_size")).alias("sqft_living"))


_HOUSE_SQL = {
    "prepared": f"WITH {_FILLED} SELECT id, price, " + ", ".join(f"round({x}, 6) AS {x}" for x in _XS) + " FROM filled",
    "r2_single": f"WITH {_FILLED}, {solve('filled', ['sqft_living'], 'price')} {fitted_r2('filled', ['sqft_living'], 'price')}",
    "r2_all": f"WITH {_FILLED}, {solve('filled', _XS, 'price')} {fitted_r2('filled', _XS, 'price')}",
    "r2_ridge_held_out": f"""WITH {_FILLED}, {solve('filled', _XS, 'price', 0.1, f'NOT {_TEST}')}
        {fitted_r2('filled', _XS, 'price', _TEST)}""",
    "floors": """SELECT (l_linenumber % 4 + 1)::DOUBLE AS floors, count(*) AS count
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
    "correlation": f"WITH {_FILLED} SELECT round(corr(sqft_above, price), 6) AS r FROM filled",
}


def _house(t: Tables, name: str):
    table = house_report(houses(t), only=[name])[name]
    return longs(table) if name == "floors" else rounded(table, 6)


for _name, _sql in _HOUSE_SQL.items():
    query(f"house_{_name}", "M1 M4 M5 M6 M7 M8", _sql)(lambda t, name=_name: _house(t, name))


@query("house_expanded_fits_better", "M3 M8 M7", "SELECT count(*) > 0 AS better FROM lineitem")
def _(t: Tables):
    """Squares and products hold the features themselves, so their fit on the same rows is no worse."""
    report = house_report(houses(t), only=["r2_expanded", "r2_all"])
    return report["r2_expanded"].select((F.col("r2") >= report["r2_all"].scalar() - 1e-9).alias("better"))


_NUMBER = "try_cast(substr(source, 4, 3) AS BIGINT)"
_SURVEY = f"""survey AS (
    SELECT doc_id, CASE WHEN n_chars % 7 <> 0 THEN n_chars / 100 END AS "Time_spent_Alone", ({_NUMBER})::DOUBLE AS "Social_event_attendance",
           (n_chars % 11)::DOUBLE AS "Going_outside", (n_chars % 13)::DOUBLE AS "Friends_circle_size", toxic::DOUBLE AS "Post_frequency",
           CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 0 END AS "Stage_fear", CASE WHEN {_NUMBER} % 2 = 0 THEN 1 ELSE 0 END AS
           "Drained_after_socializing", quality::DOUBLE AS "Personality"
    FROM labels JOIN documents USING (doc_id))"""
_ASKED = [*MEASURES, *ANSWERS]
_CODED = _SURVEY + ', coded AS (SELECT doc_id, "Personality", ' + ", ".join(
    f'coalesce("{c}", (SELECT avg("{c}") FROM survey))::DOUBLE AS "{c}"' for c in _ASKED) + " FROM survey)"
_KEPT = held_out("doc_id")


def survey(t: Tables):
    number = F.substring("source", 4, 3).try_cast("long")
    rows = t.labels.join(t.documents.select("doc_id", "n_chars", "lang", "source"), "doc_id")
    return rows.select(
        "doc_id", F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") / 100).alias("Time_spent_Alone"),
        number.cast("double").alias("Social_event_attendance"), (F.col("n_chars") % 11).cast("double").alias("Going_outside"),
        (F.col("n_chars") % 13).cast("double").alias("Friends_circle_size"), F.col("toxic").cast("double").alias("Post_frequency"),
        F.when(F.col("lang") == "en", "Yes").when(F.col("lang") == "fr", "No").otherwise("Perhaps").alias("Stage_fear"),
        F.when(number % 2 == 0, "Yes").otherwise("No").alias("Drained_after_socializing"),
        F.when(F.col("quality") == 1, "Introvert").otherwise("Extrovert").alias("Personality"))


def _scaled(part: str) -> str:
    means = ", ".join(f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in _ASKED)
    columns = ", ".join(f'round(("{c}" - "m_{c}") / CASE WHEN "s_{c}" = 0 THEN 1 ELSE "s_{c}" END, 6) AS "{c}"' for c in _ASKED)
    return f"""WITH {_CODED}, s AS (SELECT {means} FROM coded WHERE NOT {_KEPT})
        SELECT doc_id, "Personality", {columns} FROM coded, s WHERE {part}"""


@query("personality_train", "M1 M2 M4 P16", _scaled(f"NOT {_KEPT}"))
def _(t: Tables):
    table = personality_report(survey(t), "doc_id", only=["train"])["train"]
    return rounded(table.select("doc_id", "Personality", *_ASKED), 6, *_ASKED)


@query("personality_test", "M1 M2 M4 P16", _scaled(_KEPT))
def _(t: Tables):
    table = personality_report(survey(t), "doc_id", only=["test"])["test"]
    return rounded(table.select("doc_id", "Personality", *_ASKED), 6, *_ASKED)


@query("personality_report", "M9 M10", f"""
    WITH part AS (SELECT quality::DOUBLE::VARCHAR AS cls FROM labels JOIN documents USING (doc_id) WHERE {_KEPT})
    SELECT cls AS row, count(*) AS support FROM part GROUP BY cls
    UNION ALL SELECT name, (SELECT count(*) FROM part) FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) n(name)""")
def _(t: Tables):
    return personality_report(survey(t), "doc_id", only=["report"])["report"].select("row", "support")


@query("personality_importance", "M11", """
    SELECT unnest(['Time_spent_Alone', 'Social_event_attendance', 'Going_outside', 'Friends_circle_size', 'Post_frequency',
                   'Stage_fear', 'Drained_after_socializing']) AS feature, true AS share FROM (SELECT count(*) FROM labels)""")
def _(t: Tables):
    found = personality_report(survey(t), "doc_id", only=["importance"])["importance"]
    return found.select("feature", F.col("importance").between(0, 1).alias("share"))
