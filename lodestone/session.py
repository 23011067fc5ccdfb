"""Session factory with the settings the engine expects; every one can be overridden."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Adaptive plans choose joins, split skewed partitions and size shuffles at run time; UTC keeps times comparable.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


#: Steps of a plan that neither shuffle nor change the layout.
_NARROW = ("Project", "Filter", "SubqueryAlias", "LogicalRelation", "LogicalRDD", "LocalRelation", "DataSourceV2ScanRelation")


def _scan(node) -> bool:
    """Whether a plan is a scan with narrow steps over it, by the kinds of its nodes."""
    below = node.children()
    return node.getClass().getSimpleName() in _NARROW and all(_scan(below.apply(i)) for i in range(below.size()))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a plain scan over all cores, if it has fewer parts than there are cores, as a small file of one row group has. The parts
    of a large table are more, and stay as they are; so do rows that a shuffle has dealt out already."""
    if not _scan(rows._jdf.queryExecution().optimizedPlan()):
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
