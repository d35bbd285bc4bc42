"""Customer cleaning, date splits, week and season columns, display defaults."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import scalars
from vitrine.operators.quantiles import quantile_rows

UNKNOWN = "UNKNOWN"
FILLED = ["FN", "Active", "club_member_status", "fashion_news_frequency"]


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def fill_unknown(customers: DataFrame) -> DataFrame:
    """Missing flags and statuses become UNKNOWN; the text ``None`` becomes ``NONE``."""
    return customers.replace({"None": "NONE"}, subset=["fashion_news_frequency"]).fillna(
        UNKNOWN, subset=FILLED
    )


def impute_median(df: DataFrame, col: str) -> DataFrame:
    """Null values of ``col`` become its exact median over the whole table.

    The median is fitted at once, as Spark ML's imputer does: one number, computed one time
    however many plans use the cleaned table.
    """
    fitted = quantile_rows(df, col, [0.5]).first()
    value = F.lit(fitted.quantile if fitted else None).cast("double")
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), value))


def clean_customers(customers: DataFrame) -> DataFrame:
    """Filled, imputed customers with their age interval."""
    imputed = impute_median(fill_unknown(customers), "age")
    return imputed.withColumn("age_interval", scalars.age_interval("age"))


def downcast(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Narrow numeric columns: name -> ``float`` or ``int``."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in cols.items()})


def week_index(df: DataFrame, col: str = "t_dat") -> DataFrame:
    """Whole weeks since the first day of the table."""
    first = df.agg(F.min(col)).scalar()
    return df.withColumn("week", F.floor(F.datediff(F.col(col), first) / 7).cast("int"))


def split_by_date(
    df: DataFrame,
    train: tuple[str, str],
    val: tuple[str, str | None],
    col: str = "t_dat",
) -> tuple[DataFrame, DataFrame]:
    """Inclusive day ranges; rows outside both are dropped. An open ``val`` end is None.

    The bounds are compared with the bare column (the end as "before the next day"), so they
    reach the scan for dates and for timestamps.
    """

    def within(start: str, end: str | None) -> Column:
        cond = F.col(col) >= F.lit(dt.date.fromisoformat(start))
        if end is None:
            return cond
        return cond & (F.col(col) < F.lit(dt.date.fromisoformat(end) + dt.timedelta(days=1)))

    return df.where(within(*train)), df.where(within(*val))


def seasonal_flag(articles: DataFrame, season_map: DataFrame, as_of: Column) -> DataFrame:
    """Seasonal group of each article and whether it is in season on the day ``as_of``."""
    groups = season_map.select("product_type_name", F.col("season").alias("seasonal_group"))
    joined = articles.join(groups, "product_type_name", "left").withColumn(
        "seasonal_group", F.coalesce("seasonal_group", F.lit(scalars.UNKNOWN_SEASON))
    )
    now = scalars.season_of(as_of)
    in_season = (F.col("seasonal_group") == now) | (
        F.col("seasonal_group") == scalars.ANY_SEASON
    )
    return joined.withColumn("is_seasonal", in_season.cast("int"))


def display_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "prod_name": F.coalesce("prod_name", F.lit("N/A")),
            "detail_desc": F.coalesce("detail_desc", F.lit("")),
            "image_path": scalars.image_path("article_id"),
        }
    )
