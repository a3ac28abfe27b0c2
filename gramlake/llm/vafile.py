"""Product codes of vectors: a codebook for each part, its nearest entries found through a vector-approximation file.

The entries' coordinates are quantised to BITS bits, dimension by dimension. For a part of a vector a table over
(dimension, cell) holds the least and the greatest squared difference to any number of the cell; sums of its values bound
the distance to each entry from below and above, and only entries whose lower bound does not exceed the least upper bound
are measured. Everything is in integers, so that sums merge in any order and codes do not depend on partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.runtime import Scope, lean, spread_join, stage

#: Parts of a vector, entries of a codebook, rounds of training, what a component is multiplied by, bits of a cell.
PARTS, ENTRIES, ROUNDS, SCALE, BITS = 8, 16, 6, 4096, 4
#: Integer components are held within this, so that squared distances and their sums stay far below 2^63.
BOUND = 1 << 26
#: Rows that are bounded at once.
ROWS = 2048


class Approximation:
    """The cells of one part's entries (int64, entries x width), and the nearest entry of each row by their bounds."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries = entries
        low, high = entries.min(axis=0), entries.max(axis=0)
        self.step = np.maximum(-(-(high - low + 1) >> bits), 1)  # width of a cell, by dimension
        self.cells = (entries - low) // self.step
        self.floor = low + np.arange(1 << bits)[:, None] * self.step  # (cells, width): least number of each cell
        self.ceiling = self.floor + self.step - 1

    def tables(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the squared difference of each row, cell and dimension."""
        under, over = self.floor[None] - x[:, None], x[:, None] - self.ceiling[None]
        return np.maximum(np.maximum(under, over), 0) ** 2, np.maximum(np.abs(under), np.abs(over)) ** 2

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, squared distance) of each row, ties to the lower index; how many were measured."""
        index, error, measured = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            lower, upper = self.tables(part)
            low = np.zeros((len(part), len(self.entries)), np.int64)
            high = np.zeros_like(low)
            for d in range(part.shape[1]):
                low += lower[:, self.cells[:, d], d]
                high += upper[:, self.cells[:, d], d]
            row, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))
            gap = part[row] - self.entries[entry]
            exact = np.full(low.shape, np.iinfo(np.int64).max)
            exact[row, entry] = np.einsum("ij,ij->i", gap, gap)
            index[at : at + ROWS] = exact.argmin(axis=1)
            error[at : at + ROWS] = exact.min(axis=1)
            measured += len(row)
        return index, error, measured


def _matrix(column: pa.ListArray, parts: int) -> np.ndarray:
    """(rows, parts, width) of a column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def whole_numbers(vectors: DataFrame, vec: str) -> DataFrame:
    """vectors with the column vec as integers floor(SCALE * x), without rows that have no vector of finite numbers."""
    ok = F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bounded = F.transform(vec, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int"))
    return vectors.where(ok).withColumn(vec, bounded)


def trained(parts_of: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """books (parts, entries, width) after rounds of assignment and replacement by floored means; parts_of has column v.

    A task gives one row of sums for each entry of each part; rounds send parts * entries of them to the driver.
    """
    n_parts, n_entries, width = books.shape
    schema = "slot int, n long, " + ", ".join(f"s{k} long" for k in range(width))
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            near = [Approximation(b) for b in books]
            n, sums = np.zeros((n_parts, n_entries), np.int64), np.zeros((n_parts, n_entries, width), np.int64)
            for b in batches:
                x = _matrix(b.column(0), n_parts)
                for p in range(n_parts):
                    index, _, _ = near[p].nearest(x[:, p])
                    n[p] += np.bincount(index, minlength=n_entries)
                    np.add.at(sums[p], index, x[:, p])
            slot = np.flatnonzero(n.ravel())
            flat = sums.reshape(-1, width)[slot]
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n.ravel()[slot]), *[pa.array(flat[:, k]) for k in range(width)]], names=["slot", "n", *[f"s{k}" for k in range(width)]])

        got = parts_of.select("v").mapInArrow(lean(run), schema).groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).collect()
        flat = books.reshape(-1, width).copy()
        for r in got:
            flat[r.slot] = [r[k] // r.n for k in range(2, width + 2)]
        books = flat.reshape(books.shape)
    return books


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of vectors (vec_id, embedding, label) that is kept.

    Rows whose embedding is null or empty, or holds null or non-finite components, are left out, and so are those not as
    long as the vector of the least vec_id (null ids come last, equal ids by their vectors); if that length does not divide
    into the parts, there are no rows. Components are held within 2^26 after scaling. With fewer rows than entries a codebook has as many entries as rows.
    Repeated rows count each. Further columns take no part. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = whole_numbers(vectors.select("vec_id", F.col("embedding").alias("v"), "label"), "v")
    with Scope() as own:
        kept = stage(kept, "whole-numbers")
        order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
        first = kept.orderBy(*order).limit(1).collect()
        dims = len(first[0].v) if first else 0
        if not dims or dims % parts:
            return own.keep(spark.createDataFrame([], kept.select("vec_id").schema).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")))
        kept_rows = kept.where(F.size("v") == dims)
        start = [r.v for r in kept_rows.orderBy(*order).limit(entries).collect()]
        books = np.array(start, np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
        books = trained(kept_rows, books, rounds)
        digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = [Approximation(b) for b in books]
            for b in batches:
                x = _matrix(b.column("v"), parts)
                found = [near[p].nearest(x[:, p])[:2] for p in range(parts)]
                codes = ["".join(f"{c:02x}" for c in row) for row in np.stack([i for i, _ in found], axis=1).tolist()]
                total = np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(total, pa.int64())], names=["vec_id", "label", "code", "error"])

        kinds = dict(kept.dtypes)
        done = stage(kept_rows.select("vec_id", "v", "label").mapInArrow(lean(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
        # a label's key: its hash, whether it is there and its text; a hot one meets its sum by broadcast
        key = [F.xxhash64("label").alias("k"), F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name")]
        rows = done.select("vec_id", "code", "error", *key)
        by = rows.groupBy("k", "none", "name").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
        out = spread_join(rows, by, ["k", "none", "name"], "rows", done.count())
        return own.keep(out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), done)


def _sql() -> str:
    """The same in DuckDB, round by round."""
    start = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, vec_id, label, len(v) // {PARTS} AS w, v FROM k),
p AS MATERIALIZED (SELECT row, j AS part, v[j * w + 1:j * w + w] AS x FROM r CROSS JOIN range({PARTS}) AS j(j)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS e, x AS c FROM p WHERE row <= {ENTRIES})"""
    assign = lambda t: f"(SELECT row, p.part, min((list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e)) AS b FROM p JOIN c{t} ON p.part = c{t}.part GROUP BY row, p.part)"
    for t in range(1, ROUNDS + 1):
        start += f""",
a{t} AS MATERIALIZED {assign(t - 1)},
m{t} AS MATERIALIZED (SELECT part, e, list(z ORDER BY i) AS c FROM (SELECT p.part, a{t}.b[2] AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS z FROM p JOIN a{t} ON p.row = a{t}.row AND p.part = a{t}.part, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL),
c{t} AS MATERIALIZED (SELECT part, e, coalesce(m{t}.c, c{t - 1}.c) AS c FROM c{t - 1} LEFT JOIN m{t} USING (part, e))"""
    return f"""{start},
a AS MATERIALIZED {assign(ROUNDS)},
f AS (SELECT row, string_agg(printf('%02x', b[2]), '' ORDER BY part) AS code, sum(b[1])::BIGINT AS error FROM a GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM r JOIN f USING (row) CROSS JOIN h
"""


SQL = _sql()
