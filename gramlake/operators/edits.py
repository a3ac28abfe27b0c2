"""Point updates, row numbers, sparse sums, stacked blocks and meshes, groups of equal rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gramlake.functions.scalars import convert
from gramlake.operators.tables import unit_of
from gramlake.session import table


def set_row(df: DataFrame, key: str, at: object, values: dict[str, object]) -> DataFrame:
    """df with the named columns set in the row whose key is at; types stay. A projection: no row moves."""
    here = F.coalesce(F.col(key) == F.lit(at), F.lit(False))
    return df.withColumns({c: F.when(here, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def set_cell(df: DataFrame, key: str, at: object, column: str, value: object) -> DataFrame:
    return set_row(df, key, at, {column: value})


def zeros(spark: SparkSession, rows: int, columns: int, names: Sequence[str] | None = None) -> DataFrame:
    """rows of 0.0 in the columns V0, V1, ... or names."""
    names = names or [f"V{k}" for k in range(columns)]
    return spark.range(rows).select(*[F.lit(0.0).alias(n) for n in names])


def blanks(df: DataFrame) -> DataFrame:
    """Null text as '', in arrays and structs too; other types keep their nulls."""

    def fill(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(c, F.lit(""))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: fill(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fill(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[fill(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def index_of(df: DataFrame, name: str) -> int:
    return df.columns.index(name)


def time_columns(df: DataFrame) -> list[int]:
    """Positions of the columns that hold times, by type or by the unit DateTime."""
    return [k for k, f in enumerate(df.schema.fields) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) or "DateTime" in (f.metadata.get("unit"), unit_of(f.name))]


def value_at(df: DataFrame, index: str, at: object, column: str) -> DataFrame:
    """One row: a value of the column where index is at."""
    return df.where(F.col(index) == F.lit(at)).select(column).limit(1)


def change_unit(df: DataFrame, column: str, unit: str) -> DataFrame:
    """The column's values in another unit; the unit in its metadata follows."""
    held = df.schema[column].metadata.get("unit")
    return df.withColumn(column, convert(F.col(column).cast("double"), held, unit).alias(column, metadata={"unit": unit}))


def row_numbers(df: DataFrame, time: str, order: Sequence[str], name: str = "row") -> DataFrame:
    """df with the row's number from 0 in the order (time, order): the rows before its minute, and its place in the minute.

    Only counts of minutes are ordered in one task (some 500,000 a year); the rows are ordered within their minutes.
    """
    rows = df.withColumn("_hour", F.date_trunc("minute", F.col(time)))
    hours = rows.groupBy("_hour").agg(F.count("*").alias("_n"))
    before = hours.select("_hour", (F.sum("_n").over(Window.orderBy("_hour")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_hour").orderBy(time, *order)) - 1
    # rows without a time have a minute of null, which is the first
    joined = rows.withColumn("_place", place).join(before.withColumnRenamed("_hour", "_key"), F.col("_hour").eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.col("_before") + F.col("_place")).drop("_hour", "_key", "_place", "_before")


def even_seconds(df: DataFrame, time: str, order: Sequence[str], name: str = "seconds") -> DataFrame:
    """Evenly spaced seconds from 0 to the table's whole duration, days included, in the order of time."""
    span = df.agg(((F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))) / 1e6).alias("_span"), F.count("*").alias("_all"))
    rows = row_numbers(df, time, order, "_row").join(F.broadcast(span))  # one row
    return rows.withColumn(name, F.coalesce(F.try_divide(F.col("_row") * F.col("_span"), F.col("_all") - 1), F.lit(0.0))).drop("_row", "_span", "_all")


def newest(df: DataFrame, order: Sequence[Column], keep: int) -> DataFrame:
    """The first rows of an order: a top-k, without a global sort."""
    return df.orderBy(*order).limit(keep)


# sparse matrices: (row, col, value)


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("row").agg(F.sum("value").alias("value"))


def column_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("col").agg(F.sum("value").alias("value"))


def transposed_times(a: DataFrame, y: DataFrame) -> DataFrame:
    """(col, value) of A'y, y as (row, y)."""
    return a.join(y, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("y")).alias("value"))


def stacked(blocks: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Blocks (entries, number of rows) one below the other."""
    out, offset = None, 0
    for a, n in blocks:
        part = a.select((F.col("row") + offset).alias("row"), "col", "value")
        out = part if out is None else out.unionByName(part)
        offset += n
    return out


# meshes: points (pid, ...), cells (cid, nodes array<long>, ...)


def _shifted(column: str, by: int) -> Column:
    return F.transform(column, lambda x: x + by)


def merged_meshes(meshes: Sequence[tuple[DataFrame, DataFrame, int, int]]) -> tuple[DataFrame, DataFrame]:
    """(points, cells) of meshes given with their numbers of points and cells; columns that all share stay."""
    shared = [[c for c in meshes[0][k].columns if all(c in m[k].columns for m in meshes)] for k in (0, 1)]
    points = cells = None
    at, on = 0, 0
    for p, c, n, m in meshes:
        p = p.select(*shared[0]).withColumn("pid", F.col("pid") + at)
        c = c.select(*shared[1]).withColumn("cid", F.col("cid") + on).withColumn("nodes", _shifted("nodes", at))
        points, cells = (p, c) if points is None else (points.unionByName(p), cells.unionByName(c))
        at, on = at + n, on + m
    return points, cells


def subset(points: DataFrame, cells: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Cells that meet a condition, and the points they use; point ids stay."""
    some = cells.where(keep)
    return points.join(some.select(F.explode("nodes").alias("pid")).distinct(), "pid", "left_semi"), some


def row_groups(df: DataFrame, key: Sequence[str], row: str) -> DataFrame:
    """(row, group): the group of equal rows is named by its first row, so that no global numbering is needed."""
    first = df.groupBy(*key).agg(F.min(row).alias("group"))
    same = F.lit(True)
    for k in key:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return df.alias("a").join(first.alias("b"), same).select(F.col(f"a.{row}").alias(row), F.col("b.group").alias("group"))


def sorted_unique(df: DataFrame, column: str, row: str) -> DataFrame:
    """(value, first, count) of the distinct values, first by row."""
    return df.groupBy(F.col(column).alias("value")).agg(F.min(row).alias("first"), F.count("*").alias("count"))


# queries


def _q_set(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return blanks(set_row(set_cell(c, "c_custkey", 7, "c_acctbal", 0), "c_custkey", 8, {"c_acctbal": 1.5, "c_mktsegment": None}))


def _q_zeros(s, d):
    return zeros(s, 5, 3).groupBy("V0", "V1", "V2").agg(F.count("*").alias("n"))


def _q_unit(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size", metadata={"unit": "in"}))
    return change_unit(p, "size", "cm").select("p_partkey", F.round("size", 9).alias("size"))


def _q_even(s, d):
    e = even_seconds(table(s, d, "events").select("event_id", "ts"), "ts", ["event_id"])
    return e.select("event_id", F.round("seconds", 5).alias("seconds"))


def _q_value_at(s, d):
    return value_at(table(s, d, "nation"), "n_nationkey", 7, "n_name").unionByName(newest(table(s, d, "nation"), [F.col("n_nationkey").desc()], 3).select("n_name"))


def _entries(s, d):
    return table(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("row"), (F.col("l_partkey") % 20).alias("col"), F.col("l_quantity").alias("value"))


def _q_sparse(s, d):
    a = stacked([(_entries(s, d), 50), (_entries(s, d).where("col < 5"), 50)])
    y = s.range(100).select(F.col("id").alias("row"), (F.col("id") % 7).cast("double").alias("y"))
    at = transposed_times(a, y).withColumnRenamed("value", "aty")
    return column_sums(a).join(at, "col").select("col", F.round("value", 3).alias("total"), F.round("aty", 3).alias("aty"))


def _q_row_sums(s, d):
    return row_sums(_entries(s, d)).select("row", F.round("value", 3).alias("value"))


def _q_groups(s, d):
    return row_groups(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], "c_custkey")


def _q_unique(s, d):
    return sorted_unique(table(s, d, "orders"), "o_custkey", "o_orderkey")


def _q_meshes(s, d):
    from gramlake.operators.mesh import plane_mesh

    p, c = plane_mesh(s, 4, 3, triangles=False)
    points, cells = merged_meshes([(p, c, 20, 12), (p, c, 20, 12)])
    points, cells = subset(points, cells, F.col("cid") >= 12)
    return points.agg(F.count("*").alias("points"), F.min("pid").alias("low"), F.max("pid").alias("high"))


QUERIES = {"set_rows": _q_set, "zero_table": _q_zeros, "change_unit": _q_unit, "even_seconds": _q_even, "value_at_newest": _q_value_at, "sparse_stack": _q_sparse, "sparse_row_sums": _q_row_sums, "row_groups": _q_groups, "sorted_unique": _q_unique, "mesh_merge_subset": _q_meshes}
_E = "SELECT l_orderkey % 50 AS r, l_partkey % 20 AS c, l_quantity AS v FROM lineitem"
SQL = {
    "set_rows": "SELECT c_custkey, CASE c_custkey WHEN 7 THEN 0 WHEN 8 THEN 1.5 ELSE c_acctbal END::DOUBLE AS c_acctbal, CASE WHEN c_custkey = 8 THEN '' ELSE coalesce(c_mktsegment, '') END AS c_mktsegment FROM customer",
    "zero_table": "SELECT 0.0::DOUBLE AS V0, 0.0::DOUBLE AS V1, 0.0::DOUBLE AS V2, 5::BIGINT AS n",
    "change_unit": "SELECT p_partkey, round(p_size * 2.54, 9)::DOUBLE AS size FROM part",
    "even_seconds": "SELECT event_id, round((row_number() OVER (ORDER BY ts, event_id) - 1) * ((max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ()) / 1e6) / (count(*) OVER () - 1), 5) AS seconds FROM events",
    "value_at_newest": "SELECT n_name FROM nation WHERE n_nationkey = 7 UNION ALL (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 3)",
    "sparse_stack": f"WITH a AS ({_E} UNION ALL SELECT r + 50, c, v FROM ({_E}) WHERE c < 5) SELECT c AS col, round(sum(v), 3) AS total, round(sum(v * (r % 7)), 3) AS aty FROM a GROUP BY 1",
    "sparse_row_sums": f"SELECT r AS row, round(sum(v), 3) AS value FROM ({_E}) GROUP BY 1",
    "row_groups": "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS \"group\" FROM customer",
    "sorted_unique": "SELECT o_custkey AS value, min(o_orderkey) AS first, count(*) AS count FROM orders GROUP BY 1",
    "mesh_merge_subset": "SELECT 20::BIGINT AS points, 20::BIGINT AS low, 39::BIGINT AS high",
}
