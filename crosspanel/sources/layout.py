"""Panels stored by entity, so that windows and point-in-time joins over them need no shuffle of the stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import PANEL, PanelSpec
from .files import scratch


def write_bucketed(panel: DataFrame, table: str, buckets: int, spec: PanelSpec = PANEL, path: str | None = None) -> DataFrame:
    """The panel as a table in buckets of entities, each one file in order of entity and date; replaces a table of that name.

    Windows by entity, aggregates and joins on it then plan without an exchange of this table, and two tables with as many buckets
    meet bucket by bucket; joins on more keys than the entity do so only with ``spark.sql.requireAllClusterKeysForCoPartition`` off. Choose buckets so that one is a task's work: rows grow, buckets do not. Null entities share one bucket.
    """
    spark = panel.sparkSession
    rows = panel.repartition(buckets, spec.entity).sortWithinPartitions(spec.entity, spec.date)
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, spec.entity).sortBy(spec.entity, spec.date)
    writer.option("path", path or scratch(spark)).saveAsTable(table)
    return spark.table(table)


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Forgets the table; its files stay where they were written."""
    spark.sql(f"drop table if exists {table}")
