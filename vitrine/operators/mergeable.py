"""Entity statistics kept per day and month, merged over any range of days.

A row holds what can be added up later: the number of rows and days, sums and squares of the numeric
columns in whole units (so that no order of adding changes them), their least and greatest value, and a
HyperLogLog sketch of the values of each categorical column. A day that arrives is summed once; older days are
not read again, and a range reads its whole months as months and only the days at its edges as days.

Rows, days, sums, means, deviations and extremes are exact to the given number of decimals. Distinct counts are
estimates: the relative standard error is about ``1.04 / sqrt(2 ** lg_k)``, 1.6 % at 12, and the count is exact in
practice for a few hundred values. ``features.entity_features`` is the exact form.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"


def daily_statistics(
    tx: DataFrame, key: str, categ: list[str], conti: list[str], decimals: int = 2, lg_k: int = 12
) -> DataFrame:
    """One row per entity and day."""
    aggs = [F.count("*").alias("n")]
    for c in conti:
        units = F.round(F.col(c).cast("double") * 10**decimals).cast("decimal(18,0)")
        aggs += [
            F.count(c).alias(f"{c}_n"),
            F.sum(units).cast(WHOLE).alias(f"{c}_sum"),
            F.sum(units * units).cast(WHOLE).alias(f"{c}_squares"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"{c}_seen") for c in categ]
    return tx.groupBy(key, "t_dat").agg(*aggs).withColumn("days", F.lit(1).cast("long"))


def merged(rows: DataFrame, by: list, categ: list[str], conti: list[str]) -> DataFrame:
    """Rows of disjoint days as one row per ``by``."""
    aggs = [F.sum("n").alias("n"), F.sum("days").alias("days")]
    for c in conti:
        aggs += [
            F.sum(f"{c}_n").alias(f"{c}_n"),
            F.sum(f"{c}_sum").cast(WHOLE).alias(f"{c}_sum"),
            F.sum(f"{c}_squares").cast(WHOLE).alias(f"{c}_squares"),
            F.min(f"{c}_min").alias(f"{c}_min"),
            F.max(f"{c}_max").alias(f"{c}_max"),
        ]
    aggs += [F.hll_union_agg(f"{c}_seen").alias(f"{c}_seen") for c in categ]
    return rows.groupBy(*by).agg(*aggs)


def _deviation(c: str, decimals: int) -> Column:
    """Sample deviation; the difference is taken between whole numbers, so equal values give exactly 0."""
    n = F.col(f"{c}_n").cast("decimal(18,0)")
    spread = (n * F.col(f"{c}_squares") - F.col(f"{c}_sum") * F.col(f"{c}_sum")).cast("double")
    n = n.cast("double")
    return F.when(n > 1, F.sqrt(spread / (n * (n - 1))) / 10**decimals).otherwise(0.0)


def as_features(
    rows: DataFrame, key: str, prefix: str, categ: list[str], conti: list[str], decimals: int = 2
) -> DataFrame:
    """The columns of ``features.entity_features`` from one row per entity."""
    count = F.col("n").cast("double")
    out = [key, count.alias(f"{prefix}_nb_transactions"), F.col("days").cast("double").alias(f"{prefix}_nb_dates")]
    for c in categ:
        seen = F.hll_sketch_estimate(f"{c}_seen").cast("double")
        out += [seen.alias(f"{prefix}_nb_{c}"), (seen / count).alias(f"{prefix}_ratio_{c}")]
    for c in conti:
        mean = F.col(f"{c}_sum").cast("double") / F.col(f"{c}_n") / 10**decimals
        out += [
            F.col(f"{c}_min").alias(f"{prefix}_{c}_min"),
            F.col(f"{c}_max").alias(f"{prefix}_{c}_max"),
            F.when(F.col(f"{c}_n") > 0, mean).alias(f"{prefix}_{c}_mean"),
            _deviation(c, decimals).alias(f"{prefix}_{c}_std"),
        ]
    return rows.select(*out)


class StatisticsStore:
    """Days and months of one entity's statistics below ``path``.

    Each month is a folder, and so is each unit of ``unit_days`` days, counted from 1970-01-01: what arrives and is
    replaced as a whole.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: str,
        prefix: str,
        categ: list[str],
        conti: list[str],
        decimals: int = 2,
        lg_k: int = 12,
        unit_days: int = 1,
    ):
        self.unit_days = unit_days
        self.spark, self.path, self.key, self.prefix = spark, path, key, prefix
        self.categ, self.conti, self.decimals, self.lg_k = categ, conti, decimals, lg_k

    def put(self, tx: DataFrame) -> None:
        """Take in whole units; a unit that was there is replaced. Reads ``tx`` and the days of its months."""
        daily = daily_statistics(tx, self.key, self.categ, self.conti, self.decimals, self.lg_k)
        self._write(daily.withColumn("unit", self._unit(F.col("t_dat"))), "unit")
        # The months that changed: at most as many values as the calendar has.
        months = [r[0] for r in tx.select(_month("t_dat")).distinct().collect() if r[0] is not None]
        if months:
            days = self._days(f"{min(months)}-01", _last_day(max(months))).where(_month("t_dat").isin(months))
            self._write(merged(days.withColumn("month", _month("t_dat")), [self.key, "month"], self.categ, self.conti), "month")

    def _write(self, rows: DataFrame, by: str) -> None:
        rows.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            by
        ).parquet(f"{self.path}/{by}")

    def _unit(self, day: Column) -> Column:
        return F.date_from_unix_date((F.floor(F.unix_date(day) / self.unit_days) * self.unit_days).cast("int"))

    def _days(self, since: str, until: str) -> DataFrame:
        """The days of a range; folders of other units are not read."""
        day = lambda d: F.lit(d).cast("date")
        stored = self.spark.read.parquet(f"{self.path}/unit")
        held = stored.where(F.col("unit").between(self._unit(day(since)), self._unit(day(until))))
        return held.where(F.col("t_dat").between(day(since), day(until))).drop("unit")

    def _months(self, first: str, last: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/month").where(F.col("month").between(first, last))

    def parts(self, since: str, until: str) -> DataFrame:
        """The fewest rows that cover the days ``since`` to ``until``: whole months, and days at the edges."""
        first, last = _first_whole_month(since), _last_whole_month(until)
        if first > last:
            return self._days(since, until).drop("t_dat")
        months = self._months(first, last).drop("month")
        before = self._days(since, _day_before(f"{first}-01"))
        after = self._days(_day_after(_last_day(last)), until)
        return months.unionByName(before.drop("t_dat")).unionByName(after.drop("t_dat"))

    def features(self, since: str, until: str) -> DataFrame:
        """Features of the entities that have rows in the days ``since`` to ``until``, both included."""
        rows = merged(self.parts(since, until), [self.key], self.categ, self.conti)
        return as_features(rows, self.key, self.prefix, self.categ, self.conti, self.decimals)


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def _day_before(day: str) -> str:
    return str(dt.date.fromisoformat(day) - dt.timedelta(days=1))


def _day_after(day: str) -> str:
    return str(dt.date.fromisoformat(day) + dt.timedelta(days=1))


def _last_day(month: str) -> str:
    year, number = map(int, month[:7].split("-"))
    return _day_before(str(dt.date(year + number // 12, number % 12 + 1, 1)))


def _first_whole_month(since: str) -> str:
    return since[:7] if since.endswith("-01") else _day_after(_last_day(since[:7]))[:7]


def _last_whole_month(until: str) -> str:
    return until[:7] if until == _last_day(until[:7]) else _day_before(f"{until[:7]}-01")[:7]
