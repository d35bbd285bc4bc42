"""Purchase analytics: sellers, earnings, shares, distributions, customer segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.scalars import age_groups
from vitrine.operators.quantiles import quantile_rows


def sold_qty(tx: DataFrame) -> DataFrame:
    return tx.groupBy("article_id").agg(F.count("*").alias("sold_qty"))


def earnings(tx: DataFrame) -> DataFrame:
    return tx.groupBy("article_id").agg(F.sum("price").alias("earning"))


def total_earnings(tx: DataFrame) -> DataFrame:
    per_article = earnings(tx)
    return per_article.agg(
        F.count("*").alias("n_articles"), F.sum("earning").alias("total_earning")
    )


def customer_totals(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_id").agg(
        F.sum("price").alias("earning"), F.count("article_id").alias("qty")
    )


def customer_details(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Totals of each buying customer with the customer's attributes and age group."""
    details = customer_totals(tx).join(customers.drop("postal_code"), "customer_id")
    return details.withColumn("age_groups", age_groups("age"))


def top_n(df: DataFrame, measure: str, n: int, key: str = "article_id") -> DataFrame:
    return df.orderBy(F.desc(measure), F.asc(key)).limit(n)


def bottom_n(df: DataFrame, measure: str, n: int, key: str = "article_id") -> DataFrame:
    return df.orderBy(F.asc(measure), F.desc(key)).limit(n)


def sold_exactly(qty: DataFrame, n: int | Column, limit: int | None = None) -> DataFrame:
    """Articles sold exactly ``n`` times; ``limit`` keeps the first few by id."""
    out = qty.where(F.col("sold_qty") == n)
    return out if limit is None else out.orderBy("article_id").limit(limit)


def with_details(agg: DataFrame, articles: DataFrame) -> DataFrame:
    return agg.join(articles, "article_id")


def share_by(df: DataFrame, attr: str, measure: str, share: str = "share_pct") -> DataFrame:
    """Percent of the summed measure per attribute value; a null value is no group."""
    sums = df.where(F.col(attr).isNotNull()).groupBy(attr).agg(F.sum(measure).alias(measure))
    total = sums.agg(F.sum(measure)).scalar()
    return sums.select(attr, measure, (F.col(measure) / total * 100).alias(share))


def share_within(df: DataFrame, by: str, col: str, keep: list[str] | None = None) -> DataFrame:
    """Percent of each value of ``col`` inside its ``by`` group, nulls of both left out."""
    counts = (
        df.where(F.col(by).isNotNull() & F.col(col).isNotNull())
        .groupBy(by, col)
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    out = counts.join(totals, by).select(by, col, (F.col("n") / F.col("total") * 100).alias("percent"))
    return out.where(F.col(col).isin(keep)) if keep else out


def value_share(df: DataFrame, col: str) -> DataFrame:
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.select(col, (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))


def concentration(agg: DataFrame, measure: str, ns: list[int], key: str = "article_id") -> DataFrame:
    """Percent of the total held by the top N rows, for several N in one pass.

    Only the ``max(ns)`` best rows are numbered; the total is a separate aggregate.
    """
    best = top_n(agg.select(key, measure), measure, max(ns), key)
    numbered = best.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc(measure), F.asc(key))))
    total = agg.agg(F.sum(measure)).scalar()
    sums = numbered.agg(
        *[F.sum(F.when(F.col("_rn") <= n, F.col(measure))).alias(str(n)) for n in ns]
    )
    return sums.unpivot([], [str(n) for n in ns], "top_n", "held").select(
        F.col("top_n").cast("int").alias("top_n"), (F.col("held") / total * 100).alias("percent")
    )


def quantiles(df: DataFrame, col: str, ps: list[float], approx: bool = False) -> DataFrame:
    """``(p, quantile)`` rows; the sketch is opt-in."""
    if not approx:
        return quantile_rows(df, col, ps)
    sketch = df.agg(F.percentile_approx(col, ps, 10_000).alias("q"))
    return sketch.select(
        F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"), "q")).alias("z")
    ).select(F.col("z.p").alias("p"), F.col("z.q").cast("double").alias("quantile"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """``(stat, value)``: count, mean, std, min, 25/50/75 %, max."""
    base = df.agg(
        F.count(col).cast("double").alias("count"),
        F.avg(col).cast("double").alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"),
        F.max(col).cast("double").alias("max"),
    )
    names = ["count", "mean", "std", "min", "max"]
    moments = base.unpivot([], names, "stat", "value")
    labels = {0.25: "25%", 0.5: "50%", 0.75: "75%"}
    label = F.when(F.col("p") == 0.25, labels[0.25]).when(F.col("p") == 0.5, labels[0.5])
    quarts = quantile_rows(df, col, list(labels)).select(
        label.otherwise(labels[0.75]).alias("stat"), F.col("quantile").alias("value")
    )
    return moments.unionByName(quarts)


def histogram(df: DataFrame, col: str, bins: int = 70) -> DataFrame:
    """Equal-width bins from minimum to maximum; the top edge belongs to the last bin."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    edge = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    width = (edge["hi"] - edge["lo"]) / bins
    raw = F.when(width == 0, 0).otherwise(F.floor((F.col("v") - edge["lo"]) / width))
    binned = values.select(F.least(raw, F.lit(bins - 1)).cast("int").alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))


def kde(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth ``n ** -0.2`` times the deviation.

    Equal values are counted first, so the work is distinct values times grid points.
    """
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).cast("double").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    shape = df.agg(
        F.struct(
            F.count(col).alias("n"),
            F.min(col).cast("double").alias("lo"),
            F.max(col).cast("double").alias("hi"),
            (F.pow(F.count(col), F.lit(-0.2)) * F.stddev_samp(col)).alias("bw"),
        )
    ).scalar()
    bw = shape["bw"]
    low = shape["lo"] - cut * bw
    step = (shape["hi"] - shape["lo"] + 2 * cut * bw) / (grid - 1)
    points = counts.select("v", "n", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    z = (low + F.col("point") * step - F.col("v")) / bw
    bump = F.col("n") * F.exp(-0.5 * z * z)
    dens = points.groupBy("point").agg(F.sum(bump).alias("s"))
    return dens.select(
        "point",
        (low + F.col("point") * step).alias("x"),
        (F.col("s") / (shape["n"] * bw * (2 * 3.141592653589793) ** 0.5)).alias("density"),
    )


def kde_binned(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0, mesh: int = 4096) -> DataFrame:
    """``kde`` from values shared out over an even mesh, for columns whose values are all distinct.

    Each value counts for the mesh points on both sides of it, the more the nearer, and the mesh is then
    convolved with the kernel: rows are read twice and ``mesh * grid`` terms added, however many rows
    there are. With mesh steps of ``d`` bandwidths a density is off by ``0.05 * d ** 2 / bandwidth`` at most.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    shape = values.agg(
        F.struct(
            F.count("v").alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            (F.pow(F.count("v"), F.lit(-0.2)) * F.stddev_samp("v")).alias("bw"),
        )
    ).scalar()
    bw = shape["bw"]
    low = shape["lo"] - cut * bw
    width = shape["hi"] - shape["lo"] + 2 * cut * bw
    fine, step = width / (mesh - 1), width / (grid - 1)
    at = (F.col("v") - low) / fine
    cell = F.floor(at).cast("int")
    shares = values.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(at - cell).alias("up"))
    left = shares.select("cell", (F.col("n") - F.col("up")).alias("w"))
    right = shares.select((F.col("cell") + 1).alias("cell"), F.col("up").alias("w"))
    points = left.unionByName(right).groupBy("cell").agg(F.sum("w").alias("w"))
    met = points.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    z = (F.col("point") * step - F.col("cell") * fine) / bw
    dens = met.groupBy("point").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("s"))
    return dens.select(
        "point",
        (low + F.col("point") * step).alias("x"),
        (F.col("s") / (shape["n"] * bw * (2 * 3.141592653589793) ** 0.5)).alias("density"),
    )


def segment_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Sum, mean, whole-number mean and exact median per segment, and over all rows as ``ALL``.

    The overall row includes rows whose segment is missing.
    """
    known = df.where(F.col(by).isNotNull())

    def stats(frame: DataFrame, keys: list[str]) -> DataFrame:
        return frame.groupBy(*keys).agg(
            F.sum(col).cast("double").alias("total"), F.avg(col).alias("mean")
        )

    per = stats(known, [by]).join(
        quantile_rows(known, col, [0.5], by=[by]).select(by, F.col("quantile").alias("median")), by
    )
    median = quantile_rows(df, col, [0.5]).select("quantile").scalar()
    overall = stats(df, []).select(F.lit("ALL").alias(by), "total", "mean", median.alias("median"))
    return per.unionByName(overall).withColumn("mean_int", F.col("mean").cast("int"))


def facet_rows(df: DataFrame, facets: dict[str, str]) -> DataFrame:
    """Distinct non-null ``(facet, value)`` rows over the facet columns."""
    present = {k: c for k, c in facets.items() if c in df.columns}
    pairs = F.array(
        *[F.struct(F.lit(k).alias("facet"), F.col(c).alias("value")) for k, c in present.items()]
    )
    long = df.select(F.explode(pairs).alias("f")).select("f.facet", "f.value")
    return long.where(F.col("value").isNotNull()).distinct()


def table_profile(df: DataFrame, target: str) -> DataFrame:
    """Per column: rows, nulls, distinct values, most frequent value, number statistics
    and the association with the target.

    Values are counted per (column, value) first, so no column is held in one task. The
    association is the correlation with the target for numbers, and the share of the
    target's variance that the values of the column explain for text.
    """
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() not in ("string", "date")}
    cols = [c for c in df.columns if c != target]
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).cast("string").alias("value"),
                (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"),
                F.lit(int(c in numeric)).alias("is_num"),
            )
            for c in cols
        ]
    )
    long = df.select(F.col(target).cast("double").alias("t"), F.explode(cells).alias("c"))
    values = long.groupBy("c.column", "c.value", "c.num", "c.is_num").agg(
        F.count("*").alias("n"), F.sum("t").alias("st"), F.sum(F.col("t") * F.col("t")).alias("stt")
    )
    here = F.col("value").isNotNull()
    n, x, st = F.when(here, F.col("n")), F.col("num"), F.col("st")
    per = values.groupBy("column", "is_num").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~here, F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.count(F.when(here, 1)).alias("n_distinct"),
        F.max(F.struct(n.alias("n"), F.col("value"))).alias("top"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        F.sum(n).alias("k"),
        F.sum(n * x).alias("sx"),
        F.sum(n * x * x).alias("sxx"),
        F.sum(F.when(here, st)).alias("sy"),
        F.sum(F.when(here, F.col("stt"))).alias("syy"),
        F.sum(F.when(here, st * x)).alias("sxy"),
        F.sum(F.when(here, st * st / F.col("n"))).alias("between"),
    )
    k, sx, sy = F.col("k"), F.col("sx"), F.col("sy")
    var_y = F.col("syy") - sy * sy / k
    cov = F.col("sxy") - sx * sy / k
    var_x = F.col("sxx") - sx * sx / k
    corr = F.when((var_x > 0) & (var_y > 0), cov / F.sqrt(var_x * var_y))
    explained = F.when(var_y > 0, (F.col("between") - sy * sy / k) / var_y)
    return per.select(
        "column",
        "n_rows",
        "n_nulls",
        "n_distinct",
        F.col("top.value").alias("top_value"),
        F.col("top.n").alias("top_count"),
        "min",
        "max",
        (sx / k).alias("mean"),
        F.when(F.col("is_num") == 1, corr).otherwise(explained).alias("association"),
    )
