"""Table operators: projection and row filters, summaries, normalisation, binning, sizes, selection rules."""

from __future__ import annotations

import math

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlake.session import numeric_columns, table


def columns_by_index(df: DataFrame, first: int, last: int) -> DataFrame:
    """Columns first..last, both included; negative positions count from the end."""
    n = len(df.columns)
    first, last = first % n, last % n
    return df.select(*[F.col(f"`{c}`") for c in df.columns[first : last + 1]])


def rows_by_index(df: DataFrame, order: Sequence[str], first: int, last: int) -> DataFrame:
    """Rows first..last of a stated order, both included. A top-k of last + 1 rows, not a global numbering."""
    top = df.orderBy(*order).limit(last + 1)
    return top.orderBy(*order).offset(first)


def named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"unknown columns {missing}; there are {df.columns}")
    return df.select(*names)


def extremes(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row: <c>_min and <c>_max of each numeric column."""
    names = names or numeric_columns(df)
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("min", F.min), ("max", F.max))])


def normalized(df: DataFrame, names: Sequence[str], bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(x - min) / (max - min) of the named columns; a constant column gives null. Bounds not given come from one aggregate."""
    if bounds is None:
        row = extremes(df, names).first()
        bounds = {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in names}
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(bounds[c][0]), F.lit(bounds[c][1]) - F.lit(bounds[c][0])) for c in names})


def summary(df: DataFrame, names: Sequence[str] | None = None, population: bool = False) -> DataFrame:
    """(column, count, missing, mean, std, min, max), one aggregate over all columns. NaN counts as missing."""
    names = names or numeric_columns(df)
    aggs = []
    for c in names:
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        std = F.stddev_pop(x) if population else F.stddev_samp(x)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), (F.count(F.lit(1)) - F.count(x)).alias("missing"), F.avg(x).alias("mean"), std.alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))
    return df.agg(F.array(*aggs).alias("all")).select(F.inline("all"))


def finite_rows(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
    """Rows whose named columns are all finite numbers, as doubles; and the condition, to count what was dropped."""
    ok = F.lit(True)
    for c in names:
        x = F.col(c).try_cast("double")
        ok &= F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    kept = df.where(ok)
    return kept.withColumns({c: F.col(c).try_cast("double") for c in names}), ok


def clean(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], weight: str | None = None) -> DataFrame:
    """The load rule: named columns coerced to double, rows with a missing value left out."""
    names = [*inputs, *outputs, *([weight] if weight else [])]
    return finite_rows(named(df, names), names)[0]


def size_class(rows: int, columns: int) -> str:
    """How to show a table: empty, small (markdown), medium (csv) or large (summary)."""
    if rows == 0:
        return "empty"
    if rows <= 30 and columns <= 8:
        return "small"
    return "medium" if rows <= 200 and columns <= 10 else "large"


#: Values that an exact selection leaves to one task.
SELECT_ROWS = 100_000


def percentiles(df: DataFrame, value: Column, at: Sequence[float]) -> list[float]:
    """Exact percentiles (linear between ranks) of the non-null values, of any number of rows.

    A mergeable sketch brackets each rank; the rows between are counted and bracketed again until few are left. No task
    holds the distinct values of the table.
    """
    rows = df.select(value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = rows.count()
    if not n:
        return [math.nan] * len(at)
    if n <= SELECT_ROWS:
        return list(rows.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in at]))).first()[0])
    return [_selected(rows, n, p * (n - 1)) for p in at]


def _selected(rows: DataFrame, n: int, rank: float) -> float:
    """The value at a rank from 0, between the two next to it if it is not whole."""
    below, m = 0, n
    while m > SELECT_ROWS:
        share = (rank - below) / max(m - 1, 1)
        cut = [max(share - 0.01, 0.0), min(share + 0.01, 1.0)]
        lo, hi = rows.agg(F.percentile_approx("v", F.array(*[F.lit(c) for c in cut]), F.lit(1000))).first()[0]
        box = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        lo, hi = (box["lo"] if cut[0] == 0 else lo), (box["hi"] if cut[1] == 1 else hi)
        if lo == hi:
            return float(lo)
        under = rows.where(F.col("v") < lo).count()
        rows = rows.where(F.col("v").between(lo, hi))
        inside = rows.count()
        if inside == m:
            # more ties than the bracket can part: by whole values
            counts = rows.groupBy("v").count().orderBy("v").limit(SELECT_ROWS).collect()
            seen, k = below + under, 0
            values = []
            for want in (math.floor(rank), math.ceil(rank)):
                while seen + counts[k]["count"] <= want:
                    seen, k = seen + counts[k]["count"], k + 1
                values.append(counts[k]["v"])
            return values[0] + (rank - math.floor(rank)) * (values[1] - values[0])
        below, m = below + under, inside
    held = sorted(r["v"] for r in rows.collect())
    a, b = held[math.floor(rank) - below], held[min(math.ceil(rank) - below, len(held) - 1)]
    return a + (rank - math.floor(rank)) * (b - a)


def bin_edges(df: DataFrame, column: str, max_bins: int) -> list[float]:
    """Midpoints of the distinct values if they are at most max_bins, else inner quantiles (exact)."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_bins + 1).collect()]
    if len(values) <= max_bins:
        values = sorted(map(float, values))
        return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    at = [k / max_bins for k in range(1, max_bins)]
    return sorted(set(percentiles(df, F.col(column), at)))


def binned(column: str, edges: Sequence[float]) -> Column:
    """How many edges lie below the value."""
    return sum((F.when(F.col(column) > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))


def natural_key(column: Column, width: int = 12) -> Column:
    """Sort key in which runs of digits order as numbers: each is padded to width."""
    runs = F.regexp_extract_all(column, F.lit(r"(\d+|\D+)"))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, width, "0")).otherwise(F.lower(x))), "")


def markdown(df: DataFrame, max_rows: int = 20) -> str:
    """A markdown table: floats to four digits, numbers to the right; of more rows the first and last, and a footer."""
    total = df.count()
    half = max_rows // 2
    rows = [tuple(r) for r in (df.collect() if total <= max_rows else [*df.limit(half).collect(), *df.tail(max_rows - half)])]
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---:" if isinstance(f.dataType, T.NumericType) else "---" for f in df.schema.fields) + " |"]
    body = ["| " + " | ".join(map(show, r)) + " |" for r in rows]
    if total > max_rows:
        body.insert(half, "| " + " | ".join("..." for _ in df.columns) + " |")
        body.append(f"\n{total} rows x {len(df.columns)} columns")
    return "\n".join(lines + body)


def applicable(states: DataFrame, conditions: dict[str, object]) -> Column:
    """Whether a row's state meets every condition of an action: the column is there and equal."""
    ok = F.lit(True)
    for k, v in conditions.items():
        ok &= F.coalesce(F.col(k) == F.lit(v), F.lit(False)) if k in states.columns else F.lit(False)
    return ok


def unit_of(name: str) -> str | None:
    m = re.search(r"\[([^\]]*)\]", name)
    return m[1] if m else None


def base_name(name: str) -> str:
    return name.split("[", 1)[0]


def with_units(df: DataFrame) -> DataFrame:
    """Columns `name[unit]` renamed to name, with the unit in the field's metadata."""
    return df.select(*[F.col(f"`{c}`").alias(base_name(c), metadata={"unit": unit_of(c)} if unit_of(c) else {}) for c in df.columns])


def headers(df: DataFrame) -> list[str]:
    """`name[unit]` of each column that has a unit."""
    return [f"{f.name}[{f.metadata['unit']}]" if f.metadata.get("unit") else f.name for f in df.schema.fields]


def last_events(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last event of each key: one aggregate by max_by, with no sort of a key's rows."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(key, "e.*")


# queries


def _q_minmax(s, d):
    return extremes(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _q_normalize(s, d):
    return normalized(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"]).select("p_partkey", F.round("p_size", 9).alias("p_size"), F.round("p_retailprice", 9).alias("p_retailprice"))


def _summary(df, **kw):
    return summary(df, **kw).select("column", "count", "missing", *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max")])


def _q_summary(s, d):
    return _summary(table(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"))


def _q_data_summary(s, d):
    return _summary(table(s, d, "orders").select("o_totalprice"), population=True)


def _k(s, d):
    return table(s, d, "events").select("event_id", "value", F.get_json_object("props", "$.k").alias("k"))


def _q_clean(s, d):
    return clean(_k(s, d), ["k"], ["value"]).agg(F.count("*").alias("n"), F.round(F.sum("k"), 3).alias("sum_k"), F.round(F.sum("value"), 3).alias("sum_value"))


def _q_dropped(s, d):
    df = _k(s, d).withColumn("k", F.when(F.col("event_id") % 7 == 0, F.lit("x")).otherwise(F.col("k")))
    _, ok = finite_rows(df, ["k", "value"])
    return df.agg(F.count_if(ok).alias("n_samples"), F.count_if(~ok).alias("dropped_rows"))


def _q_index(s, d):
    return rows_by_index(columns_by_index(table(s, d, "customer"), 0, 3), ["c_custkey"], 10, 29)


def _q_size(s, d):
    rows = [(n, table(s, d, n)) for n in ("region", "nation", "supplier", "orders")]
    out = None
    for n, df in rows:
        one = df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    kind = F.when(F.col("rows") == 0, "empty").when((F.col("rows") <= 30) & (F.col("columns") <= 8), "small").when((F.col("rows") <= 200) & (F.col("columns") <= 10), "medium").otherwise("large")
    return out.withColumn("class", kind)


def _q_active(s, d):
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 1000)), 6).alias("total_k"), F.count_if(F.col("c_acctbal") > 0).alias("active"))


def _q_edges(s, d):
    df = table(s, d, "lineitem")
    return s.createDataFrame([(c, k, round(e, 6)) for c, n in (("l_tax", 16), ("l_extendedprice", 8)) for k, e in enumerate(bin_edges(df, c, n))], "feature string, k int, edge double")


def _q_bins(s, d):
    return table(s, d, "lineitem").select(binned("l_quantity", [10.0, 20.0, 30.0, 40.0]).alias("bin"), "l_extendedprice").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


def _q_natural(s, d):
    df = table(s, d, "part").select("p_partkey", F.concat(F.lit("file"), F.col("p_partkey"), F.lit("_v"), F.col("p_size"), F.lit(".csv")).alias("path"))
    return df.select("p_partkey", natural_key(F.col("path")).alias("key"))


def _q_last(s, d):
    return last_events(table(s, d, "events").select("event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"])


def _q_merge(s, d):
    e = table(s, d, "events")
    a, b = e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1")
    return a.select("user_id", "event_type").unionByName(b.select("user_id", "event_type")).distinct()


def _q_action(s, d):
    o = table(s, d, "orders")
    ok = applicable(o, {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"})
    return o.groupBy(ok.alias("applicable")).agg(F.count("*").alias("n"))


def _q_date_range(s, d):
    return table(s, d, "orders").where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-03-31").cast("timestamp_ntz"))).select("o_orderkey", "o_orderdate")


QUERIES = {
    "table_minmax": _q_minmax, "table_normalize": _q_normalize, "table_summary": _q_summary, "data_summary": _q_data_summary,
    "clean_load": _q_clean, "clean_dropped": _q_dropped, "index_ranges": _q_index, "table_recommend": _q_size, "sum_active": _q_active,
    "bin_edges": _q_edges, "bin_codes": _q_bins, "natural_sort_key": _q_natural, "trace_last_job": _q_last, "trace_union_dedupe": _q_merge,
    "action_applicable": _q_action, "date_range_filter": _q_date_range,
}


def _sum_sql(c, t, std="stddev_samp"):
    return f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, round(avg({c}), 5) AS mean, round({std}({c}), 5) AS std, round(min({c}), 5) AS min, round(max({c}), 5) AS max FROM {t}"


SQL = {
    "table_minmax": "SELECT " + ", ".join(f"{f}({c}) AS {c}_{f}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for f in ("min", "max")) + " FROM lineitem",
    "table_normalize": "SELECT p_partkey, round((p_size - min(p_size) OVER ())::DOUBLE / (max(p_size) OVER () - min(p_size) OVER ()), 9) AS p_size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS p_retailprice FROM part",
    "table_summary": " UNION ALL ".join(_sum_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "data_summary": _sum_sql("o_totalprice", "orders", "stddev_pop"),
    "clean_load": "WITH k AS (SELECT value, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT count(*) AS n, round(sum(k), 3) AS sum_k, round(sum(value), 3) AS sum_value FROM k WHERE k IS NOT NULL AND value IS NOT NULL AND isfinite(value) AND isfinite(k)",
    "clean_dropped": "WITH k AS (SELECT value, CASE WHEN event_id % 7 <> 0 THEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events), o AS (SELECT coalesce(isfinite(k) AND isfinite(value), false) AS ok FROM k) SELECT count(*) FILTER (ok) AS n_samples, count(*) FILTER (NOT ok) AS dropped_rows FROM o",
    "index_ranges": "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10",
    "table_recommend": "WITH t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, {k} AS columns FROM {n}" for n, k in (("region", 2), ("nation", 3), ("supplier", 4), ("orders", 6))) + ") SELECT *, CASE WHEN rows = 0 THEN 'empty' WHEN rows <= 30 AND columns <= 8 THEN 'small' WHEN rows <= 200 AND columns <= 10 THEN 'medium' ELSE 'large' END AS class FROM t",
    "sum_active": "SELECT c_mktsegment, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000 END), 6) AS total_k, count(*) FILTER (c_acctbal > 0) AS active FROM customer GROUP BY 1",
    "bin_edges": "WITH u AS (SELECT DISTINCT l_tax AS v FROM lineitem), m AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS e, row_number() OVER (ORDER BY v) - 1 AS k FROM u), q AS (SELECT unnest(quantile_cont(l_extendedprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS e FROM lineitem) SELECT 'l_tax' AS feature, k::INTEGER AS k, round(e, 6) AS edge FROM m WHERE e IS NOT NULL UNION ALL SELECT 'l_extendedprice', (row_number() OVER (ORDER BY e) - 1)::INTEGER, round(e, 6) FROM q",
    "bin_codes": "SELECT (l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem GROUP BY 1",
    "natural_sort_key": "SELECT p_partkey, 'file' || lpad(p_partkey::VARCHAR, 12, '0') || '_v' || lpad(p_size::VARCHAR, 12, '0') || '.csv' AS key FROM part",
    "trace_last_job": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "trace_union_dedupe": "SELECT user_id, event_type FROM events WHERE event_id % 3 <> 0 UNION SELECT user_id, event_type FROM events WHERE event_id % 3 <> 1",
    "action_applicable": "SELECT o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AS applicable, count(*) AS n FROM orders GROUP BY 1",
    "date_range_filter": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'",
}
