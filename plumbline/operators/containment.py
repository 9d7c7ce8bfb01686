"""Share of rows whose value occurs in a reference table.

Value counts, not rows, meet the reference: a hot value is one row in the join.  No broadcast
is forced; Spark broadcasts the reference when its measured size allows and else joins the
two sides by shuffling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_text, find_field, quoted
from plumbline.operators.frequency import COUNT, resolved, value_counts
from plumbline.operators.rows import Placed, aggregate_rows


def containment_rows(df: DataFrame, placed: Placed) -> DataFrame:
    metric = placed.metric
    columns = resolved(df, metric)
    data_type = find_field(df.schema, columns[0]).dataType
    counts = value_counts(df, columns, metric.where).select(
        as_text(F.col("k0"), data_type).alias("text"), quoted(COUNT).alias("count")
    )
    listed = metric.reference.schema[0]
    allowed = (
        metric.reference.select(as_text(quoted(listed.name), listed.dataType).alias("text"))
        .filter(F.col("text").isNotNull())
        .distinct()
        .withColumn("listed", F.lit(True))
    )
    passing = F.when(F.col("text").isNull() | F.col("listed"), F.col("count"))
    share = F.try_divide(F.coalesce(F.sum(passing), F.lit(0)), F.sum("count"))
    return aggregate_rows(counts.join(allowed, "text", "left"), [(placed, metric.name, share)])
