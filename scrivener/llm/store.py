"""Tables cut from their lineage, connected components and distributed ranks."""

from __future__ import annotations

import contextvars
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The tables that cut() has written for the innermost operator that runs: (path, table).
_TABLES: contextvars.ContextVar[list[tuple[str, DataFrame]] | None] = contextvars.ContextVar("tables", default=None)

#: Spark's setting; it holds for executions that are made while it is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, local mode gets one of its own; a cluster has to name one,
    as executors would each write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='scrivener-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def local(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table from the driver. It goes by Arrow: rows in a list would start another Python daemon, with workers of its own, on the
    executors that read it."""
    return spark.createDataFrame(pa.table(columns))


def settled(df: DataFrame) -> DataFrame:
    """df for operators that read it more than once and rely on equal batches: a scan, with columns and rows chosen, as it is;
    anything else is written first, as a shuffle that runs again may order its rows in another way."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {line.lstrip(" :+-").split(" ")[0] for line in plan.splitlines() if line.strip()}
    return df if nodes <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "Scan"} else cut(df)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it: later steps survive the loss of any executor and do
    not run what came before again. What no scratch() deletes the job's owner does."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if (tables := _TABLES.get()) is not None:
        tables.append((path, table))
    return table


def scratch(operator: Callable) -> Callable:
    """Decorates an operator that returns tables, small ones, as they are written in full: the tables that it cut on the way
    are deleted when they are there."""

    @functools.wraps(operator)
    def run(*args, **kw):
        made: list[tuple[str, DataFrame]] = []
        outer, results = _TABLES.get(), ()
        token = _TABLES.set(made)
        try:
            out = operator(*args, **kw)
            _TABLES.reset(token)
            token = None
            known = {id(table) for _, table in made}
            results = tuple(x if id(x) in known else cut(x) for x in (out if isinstance(out, tuple) else (out,)))
        finally:
            if token:
                _TABLES.reset(token)
            kept = {id(x) for x in results}
            for path, table in made:
                if id(table) not in kept:
                    where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                    where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
                elif outer is not None:
                    outer.append((path, table))
        return results if isinstance(out, tuple) else results[0]

    return run


def tidy(operator: Callable) -> Callable:
    """Decorates an operator on a table whose steps all end in cut() or a small result: the shuffle files of each are deleted when it has ended.
    Otherwise they lie on the executors' disks, beside those of later steps, until the driver happens to collect its garbage."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kw):
        conf = df.sparkSession.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            return operator(df, *args, **kw)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)

    return run


@scratch
def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b), undirected: component is the smallest node reachable.

    Smallest labels pass along the links and then jump to the label's own label, so a path of length n
    ends after about log n rounds. Each round is two joins and a table in the shared folder.
    """
    both = cut(links.select("a", "b").where("a <> b").union(links.select(F.col("b"), F.col("a")).where("a <> b")).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = cut(step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component")))
        label = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return label


def ranked(df: DataFrame, *order: Column, partitions: int | None = None) -> DataFrame:
    """df with column rank, from 0, in the order given; nothing passes through one task.

    The rows are dealt by range and kept; ranks within a part are added to the parts' offsets. Only one
    count a part comes to the driver. The order must be total, or rows that tie may swap ranks.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dict(kept.groupBy("_part").count().collect())
    before, total = [], 0
    for i in sorted(sizes):
        before.append((i, total))
        total += sizes[i]
    parts, rows = zip(*before or [(0, 0)], strict=True)
    offset = local(spark, _part=pa.array(parts, pa.int32()), _before=pa.array(rows, pa.int64()))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return kept.withColumn("_row", rank).join(F.broadcast(offset), "_part").withColumn("rank", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")
