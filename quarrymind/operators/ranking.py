"""Ranking helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark prunes to a constant ``k`` per key before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers per key that never sort one key in one task.

    ``bucket`` must grow along ``order``. Rows are numbered inside (key, bucket), and the
    bucket sizes, a small table, give the offsets.
    """
    spread = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    sizes = spread.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = spread.withColumn("_rn", F.row_number().over(inner))
    join = [numbered[c].eqNullSafe(offsets[c]) for c in [*keys, "_bucket"]]
    condition = join[0]
    for part in join[1:]:
        condition = condition & part
    return numbered.join(offsets, condition).select(
        *[numbered[c] for c in df.columns], (F.col("_rn") + F.col("_offset")).cast("int").alias(name)
    )


def ewma(
    df: DataFrame, keys: list[str], ts: str, tie: str, values: dict[str, tuple[Column, float, float | None]],
    extra: list[Column] | None = None, span: str = "HOUR",
) -> DataFrame:
    """Exponentially weighted means per key in arrival order, as ordinary aggregates.

    ``values`` maps an output name to ``(value, alpha, start)``; each equals the recurrence
    ``s = alpha*x + (1-alpha)*s`` from ``start`` (the first value when None). Rows are
    weighted inside (key, time span) groups and the spans are then combined, so a key with
    a large share of the rows is spread over its time spans. ``extra`` holds sums and
    counts, which are summed over the spans; aliases starting with ``last_`` hold maxima.
    Adds ``n``, the number of rows.
    """
    return ewma_totals(ewma_parts(df, keys, ts, tie, values, extra, span), keys, values)


def ewma_parts(
    df: DataFrame, keys: list[str], ts: str, tie: str, values: dict[str, tuple[Column, float, float | None]],
    extra: list[Column] | None = None, span: str = "HOUR",
) -> DataFrame:
    """What :func:`ewma` knows of the rows of each key, one row per key, so that later rows can still be folded in."""
    newest = Window.partitionBy(*keys, "_span").orderBy(F.col(ts).desc(), F.col(tie).desc())
    aged = df.withColumn("_span", F.date_trunc(span, F.col(ts))).withColumn("_age", F.row_number().over(newest) - 1)
    parts = []
    for i, (value, alpha, start) in enumerate(values.values()):
        weight = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("_age"))
        parts.append(F.sum(weight * value).alias(f"_part{i}"))
        if start is None:
            parts.append(F.min_by(value, F.struct(ts, tie)).alias(f"_first{i}"))
    spans = aged.groupBy(*keys, "_span").agg(*parts, F.count("*").alias("_n"), *(extra or []))
    return ewma_fold(spans, keys, values, "_span")


def ewma_fold(parts: DataFrame, keys: list[str], values: dict[str, tuple], order: str) -> DataFrame:
    """One row per key from parts that follow each other by ``order``."""
    later = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    folded = []
    for i, (_, alpha, start) in enumerate(values.values()):
        folded.append(F.sum(F.col(f"_part{i}") * F.pow(F.lit(1.0 - alpha), F.col("_later"))).alias(f"_part{i}"))
        if start is None:
            folded.append(F.min_by(f"_first{i}", order).alias(f"_first{i}"))
    names = [c for c in parts.columns if c not in keys and c != order and not c.startswith("_")]
    return placed.groupBy(*keys).agg(
        *folded, F.sum("_n").alias("_n"), *[(F.max(c) if c.startswith("last_") else F.sum(c)).alias(c) for c in names]
    )


def ewma_totals(parts: DataFrame, keys: list[str], values: dict[str, tuple]) -> DataFrame:
    """The means, from one row of parts per key."""
    totals = []
    for i, (name, (_, alpha, start)) in enumerate(values.items()):
        base = F.col(f"_first{i}") if start is None else F.lit(start)
        totals.append((F.col(f"_part{i}") + F.pow(F.lit(1.0 - alpha), F.col("_n")) * base).alias(name))
    return parts.select(*keys, *totals, F.col("_n").alias("n"), *[c for c in parts.columns if c not in keys and not c.startswith("_")])


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, payload: list[str],
    tie: str, span: str = "HOUR",
) -> DataFrame:
    """Left rows with the newest right row of the same keys at or before them.

    Both sides are laid out in time and the last payload seen is carried forward, so no
    pairs are formed. It is carried inside (key, time span) groups and then from span to
    span over one row per span, which spreads a frequent key.
    """
    item = F.struct(F.col(right_ts).alias("_at"), *payload)
    events = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_row")).unionByName(
        right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), item.alias("_item")),
        allowMissingColumns=True,
    ).withColumn("_span", F.date_trunc(span, "_t"))
    inside = Window.partitionBy(*keys, "_span").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = events.withColumn("_seen", F.last("_item", ignorenulls=True).over(inside))
    ends = events.groupBy(*keys, "_span").agg(F.max_by("_item", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("_start", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    found = carried.where("_side = 1").join(starts, [*keys, "_span"])
    hit = F.coalesce("_seen", "_start")
    return found.select(
        *[F.col("_row")[c].alias(c) for c in left.columns],
        hit["_at"].alias(right_ts), *[hit[c].alias(c) for c in payload],
    )
