"""Problem 3: the first N items of every group, by a global range-partitioned sort.

The rows are range-partitioned and sorted on (group, score, identifier), so a group of any size is spread over as many
tasks as its rows need. Each task streams through its sorted rows and keeps, of each group, those at local positions up
to N together with how many of the group it saw (up to N: more cannot change which rows are kept). Prefix sums of these
counts over the partitions turn local into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from riskweave.runtime import table


def _local_positions(groups: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Local positions 1..n within the runs of equal groups; one row is held back, to know where a run ends."""
        import numpy as np

        last, seen, held = None, 0, None

        def flush(row, is_last):
            return pa.RecordBatch.from_arrays([*row.columns, pa.array([is_last])], names=[*row.schema.names, "_end"])

        for b in batches:
            m = b.num_rows
            if not m:
                continue
            cols = [b.column(b.schema.get_field_index(g)) for g in groups]
            new = np.zeros(m, bool)
            for c in cols:
                if m > 1:
                    x, y = c.slice(1), c.slice(0, m - 1)
                    ne = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
                    new[1:] |= ne | (pc.is_valid(x).to_numpy(zero_copy_only=False) != pc.is_valid(y).to_numpy(zero_copy_only=False))
            first = tuple(c[0].as_py() for c in cols)
            new[0] = first != last or last is None
            idx = np.arange(m)
            start = np.maximum.accumulate(np.where(new, idx, -1))
            pos = idx - start + 1
            head = start < 0
            pos[head] = seen + idx[head] + 1
            keep = np.flatnonzero(pos <= n)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(pos.astype("int32"))], names=[*b.schema.names, "_pos"]).take(pa.array(keep))
            if held is not None:
                # the held row ends its run's kept rows unless this batch goes on with a kept row of the same group
                goes_on = not new[0] and len(keep) > 0 and keep[0] == 0
                yield flush(held, not goes_on)
                held = None
            if out.num_rows:
                nxt = np.ones(len(keep), bool)
                nxt[:-1] = pos[keep[1:]] == 1
                if out.num_rows > 1:
                    o = out.slice(0, out.num_rows - 1)
                    yield pa.RecordBatch.from_arrays([*o.columns, pa.array(nxt[:-1])], names=[*o.schema.names, "_end"])
                held = out.slice(out.num_rows - 1, 1)
                if keep[-1] != m - 1:
                    yield flush(held, True)
                    held = None
            last, seen = tuple(c[m - 1].as_py() for c in cols), int(pos[m - 1])
        if held is not None:
            yield flush(held, True)

    return run


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """``df`` cut to the first ``n`` rows of each group, with the exact position in ``position`` (1-based).

    ``order`` must be a total order within a group for a reproducible result: rows equal in all of it share whichever
    order the sort gives. Null group values form a group of their own. ``n`` < 1 or an empty table give no rows. A group
    column named ``_pos``, ``_end`` or ``_pid`` is not allowed.
    """
    if n < 1:
        return df.withColumn("position", F.lit(1)).limit(0)
    by = [F.asc_nulls_first(g) for g in groups] + order
    s = df.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = StructType([*s.schema.fields, StructField("_pos", IntegerType()), StructField("_end", BooleanType())])
    c = s.mapInArrow(_local_positions(groups, n), schema).withColumn("_pid", F.spark_partition_id())
    before = Window.partitionBy(*groups).orderBy("_pid").rangeBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("position", F.col("_pos") + F.coalesce(F.sum(F.when(F.col("_end"), F.col("_pos"))).over(before), F.lit(0)))
    return c.where(F.col("position") <= n).drop("_pos", "_end", "_pid")


#: Fixed order of severities, worst first.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def finding_order(df: DataFrame) -> DataFrame:
    """(finding_id, repo, detector_key, sev_rank, conf): one row a finding_id, ready for ranking.

    Unknown and null severities rank after INFO; null and NaN confidence rank below 0, all others are clamped to 0..1.
    Of several deliveries of a finding_id the best-ranked is taken.
    """
    sev = F.upper(F.trim("severity"))
    rank = F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))]), sev), F.lit(len(SEVERITIES)))
    conf = F.when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit(-1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")))
    det = F.lower(F.translate(F.trim("detector"), "_", "-"))
    one = F.min(F.struct(rank.alias("sev_rank"), (-conf).alias("neg_conf"), "repo", det.alias("detector_key")))
    return df.where("finding_id is not null").groupBy("finding_id").agg(one.alias("x")).select("finding_id", "x.*")


def p3_top_findings(spark: SparkSession, d: str) -> DataFrame:
    """The first five findings of each repo and detector, with their positions."""
    f = finding_order(table(spark, d, "findings", "finding_id", "repo", "detector", "severity", "confidence"))
    t = top_n(f, ["repo", "detector_key"], [F.asc("sev_rank"), F.asc("neg_conf"), F.asc("finding_id")], 5)
    return t.select("repo", "detector_key", "finding_id", F.col("position").cast("int").alias("position"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_top_findings(spark, d).select("finding_id")


_RANKED = """with f as (select distinct finding_id, repo, lower(replace(trim(detector), '_', '-')) as detector_key,
 coalesce(list_position(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], upper(trim(severity))), 6) as s,
 case when confidence is null or isnan(confidence) then -1.0 else least(1.0, greatest(0.0, confidence)) end as c from findings),
 r as (select *, row_number() over (partition by repo, detector_key order by s, c desc, finding_id) as position from f)"""
QUERIES = {"p3_found": p3_found, "p3_top_findings": p3_top_findings}
ORACLE = {
    "p3_found": f"{_RANKED} select finding_id from r where position <= 5",
    "p3_top_findings": f"{_RANKED} select repo, detector_key, finding_id, position::int as position from r where position <= 5",
}
