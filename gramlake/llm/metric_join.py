"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.runtime import Scope, components, map_groups, spread_join, stage

#: Vectors on either side of a task of the join, and of one that deals vectors to pivots.
BLOCK, DEAL = 1024, 4096
#: Home vectors from which a cell is split, pivots of a split, rounds of splits.
PIVOT_FROM, PIVOTS, LEVELS = 8192, 256, 4
#: Vectors of a cell that foretell a split. It is made if it leaves under GAIN of the pairs, and copies a row no oftener than
#: the whole cell's join in blocks would.
TRIAL, GAIN = 1024, 0.5
def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length one; scaled first, so that no square overflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _lives(v: np.ndarray, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pivot, ring) where each row of v lives, and (row, pivot, ring) of everywhere that a row within reach of it may live.

    A row lives at its nearest pivot, in the ring floor(distance / reach). By the triangle inequality one within reach of x
    lives at pivot i only in the rings that [d_i(x) - reach, d_i(x) + reach] meets, and not beyond d_nearest(x) + reach.
    """
    d = np.sqrt(np.maximum(2 - 2 * v @ points.T, 0))
    near = d.argmin(1)
    at = (d / reach).astype(np.int32)
    inner = at[np.arange(len(v)), near]
    rows, pivots, rings = [], [], []
    for k in (-1, 0, 1):
        there = at + k
        i, p = np.nonzero((there >= 0) & (there <= inner[:, None] + 1))
        rows.append(i)
        pivots.append(p.astype(np.int32))
        rings.append(there[i, p])
    return near.astype(np.int32), inner, tuple(map(np.concatenate, (rows, pivots, rings)))


def _pays(reach: float):
    """Whether a cell's split pays, by a trial of its rows (role 1) against its pivots (role 0)."""

    def run(t: pa.Table) -> pa.Table | None:
        role = t["role"].to_numpy()
        v = unit(_stack(t["vec"]))
        if not (role == 0).any() or not (role == 1).any():
            return None
        near, inner, (rows, pivot, ring) = _lives(v[role == 1], v[role == 0], reach)
        place = lambda p, r: p.astype(np.int64) << 32 | r
        lives, home = np.unique(place(near, inner), return_counts=True)
        may, copies = np.unique(place(pivot, ring), return_counts=True)
        at = np.minimum(np.searchsorted(lives, may), len(lives) - 1)
        pairs = (np.where(lives[at] == may, home[at], 0) * copies).sum()
        n = int((role == 1).sum())
        good = pairs < GAIN * n * n and len(rows) <= n * max(2.0, 2.0 * t["homes"][0].as_py() / BLOCK)
        return t.select(["label", "dim", "cell"]).slice(0, 1) if good else None

    return run


def _dealt(reach: float):
    """Rows of a cell (role 1), or of one block of it, in the cells around its pivots (role 0)."""

    def run(t: pa.Table) -> pa.Table | None:
        role = t["role"].to_numpy()
        rows = t.filter(pa.array(role == 1))
        if not len(rows):
            return None
        near, inner, (i, pivot, ring) = _lives(unit(_stack(rows["vec"])), unit(_stack(t.filter(pa.array(role == 0))["vec"])), reach)
        home = rows["home"].to_numpy() == 1
        own = np.flatnonzero(home)
        # a home row is its cell's copy too: it stands there once
        other = ~(home[i] & (near[i] == pivot) & (inner[i] == ring))
        take = np.concatenate([own, i[other]])
        out = rows.take(pa.array(take)).drop_columns(["role", "block", "home"])
        new = np.concatenate([near[own], pivot[other]]).astype(np.int64) << 32 | np.concatenate([inner[own], ring[other]])
        out = out.append_column("place", pa.array(new)).append_column("home", pa.array(np.repeat([1, 0], [len(own), int(other.sum())]).astype(np.int32)))
        return out.select(["label", "dim", "cell", "place", "home", "rep", "n", "vec"])

    return run


def _cells(classes: DataFrame, reach: float) -> DataFrame:
    """Rows (label, dim, cell, home, rep, n, vec): each class in its own cell (home 1), and where a class within reach may live.

    A label and dimension is one cell at first. Cells of PIVOT_FROM home rows and more are split around pivots of their own,
    at most PIVOTS, and the parts again, LEVELS times: the number of pivots grows with the data, and none are broadcast. A
    cell stays whole where a trial finds that no distance bound prunes it; its join is then all its pairs, in blocks. All
    cells of a level are split by the same few jobs.
    """
    kind = classes.schema["vec"].dataType.simpleString()
    key = ["label", "dim", "cell"]
    whole = F.xxhash64("label", "dim").alias("cell")
    rows = classes.select("label", "dim", whole, F.lit(1).alias("home"), "rep", "n", "vec")
    done = None
    for level in range(LEVELS):
        sizes = rows.groupBy(*key).agg(F.sum("home").alias("homes"), F.count("*").alias("all")).where(F.col("homes") >= PIVOT_FROM)
        sizes = stage(sizes.withColumn("pivots", F.least(F.lit(PIVOTS), F.ceil(2 * F.col("homes") / PIVOT_FROM))).withColumn("blocks", F.ceil(F.col("all") / DEAL).cast("int")), "large")
        if sizes.isEmpty():
            break
        # large cells are few next to rows: at most one in PIVOT_FROM
        drawn = rows.join(sizes, key).withColumn("u", F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) / (1 << 30))
        pivots = drawn.where((F.col("home") == 1) & (F.col("u") < F.col("pivots") / F.col("homes"))).select(*key, F.lit(0).alias("role"), "blocks", "homes", "vec")
        trial = drawn.where((F.col("home") == 1) & (F.col("u") >= 0.5) & (F.col("u") < 0.5 + F.least(F.lit(0.5), TRIAL / F.col("homes")))).select(*key, F.lit(1).alias("role"), "blocks", "homes", "vec")
        pivots = stage(pivots, "pivots")
        good = stage(map_groups(pivots.unionByName(trial).drop("blocks"), key, _pays(reach), "label long, dim int, cell long"), "split")
        if good.isEmpty():
            break
        split = rows.join(sizes, key).join(good, key, "left_semi")
        block = F.pmod(F.xxhash64("rep", F.lit(level), F.lit(1)), F.col("blocks")).cast("int")
        dealt = split.select(*key, block.alias("block"), F.lit(1).alias("role"), "home", "rep", "n", "vec")
        each = pivots.join(good, key, "left_semi").select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "role", *[F.lit(0).cast(t).alias(c) for c, t in (("home", "int"), ("rep", "long"), ("n", "long"))], "vec")
        fresh = map_groups(dealt.unionByName(each), [*key, "block"], _dealt(reach), f"label long, dim int, cell long, place long, home int, rep long, n long, vec {kind}")
        fresh = fresh.withColumn("cell", F.xxhash64("cell", "place")).drop("place")
        rest = rows.join(good, key, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = stage(fresh, "cells")
    return rows if done is None else done.unionByName(rows)


def _join(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        """Links of the home rows, and a forest of the linked rows."""
        home = t["home"].to_numpy().astype(bool)
        ids, n, v = t["rep"].to_numpy(), t["n"].to_numpy(), unit(_stack(t["vec"]))
        # both roles of a class may meet in a task: it is never its own partner
        rows, cols = np.flatnonzero(home), np.flatnonzero(~home)
        near = v[rows] @ v[cols].T >= threshold
        near &= ids[rows, None] != ids[None, cols]
        links = near @ n[cols]
        i, j = np.nonzero(near)
        left, right = ids[rows].copy(), ids[cols].copy()
        while len(i):
            before = left.copy()
            np.minimum.at(left, i, right[j])
            np.minimum.at(right, j, left[i])
            if (left == before).all():
                break
        a, b = left != ids[rows], right != ids[cols]
        return pa.table(
            {
                "rep": np.concatenate([ids[rows], ids[rows][a], ids[cols][b]]),
                "links": np.concatenate([links, np.zeros(a.sum() + b.sum(), np.int64)]),
                "other": pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(left[a]), pa.array(right[b])]),
            }
        )

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id long, embedding array, label int, other columns).

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least threshold.
    n_links counts the other rows linked directly; component_id is the smallest vec_id reachable by links. Equal vectors
    stand as one class with a count. Classes are dealt to cells around pivots, in levels (`_cells`); a cell joins on its own, in blocks of BLOCK rows, against its members and the boundary copies that the triangle inequality
    asks for. Links are counted where they are found and only a forest of them leaves a task, never the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, rows without a label and rows with a null
    vec_id link with nothing: n_links 0, component_id their own vec_id, kept true. Vectors of different length never
    link. Rows that repeat a vec_id are separate vectors that share a name. An empty table gives an empty result.
    """
    with Scope() as own:
        return _near(vectors, threshold, own)


def _near(vectors: DataFrame, threshold: float, own: Scope) -> DataFrame:
    value = lambda x: x.cast("double")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(value(x)) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").alias("vec"))
    usable = F.coalesce(F.expr("label IS NOT NULL AND vec_id IS NOT NULL") & (F.size("vec") > 0) & ~F.exists("vec", bad) & F.exists("vec", lambda x: value(x) != 0), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(usable, F.col("vec")).alias("vec"))
    rows = rows.select("*", F.size("vec").alias("dim"), F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(17), "vec").alias("k2"))
    key = ["label", "dim", "k1", "k2"]
    good = rows.where("vec IS NOT NULL")
    classes = stage(good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "vectors")
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    cells = _cells(classes, reach)
    cell = ["label", "dim", "cell"]
    blocks = cells.groupBy(*cell).agg(F.ceil(F.sum("home") / BLOCK).cast("int").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("cols"), F.count("*").alias("members")).where("rows > 0")
    blocks = stage(blocks, "blocks")
    total = blocks.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    dealt = spread_join(cells.select("cell", "label", "dim", "home", "rep", "n", "vec"), blocks.select("cell", "label", "dim", "rows", "cols", "members"), ["cell", "label", "dim"], "members", total)
    part = lambda n: F.pmod(F.xxhash64("rep", F.lit(5)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = dealt.where("home = 1").select("*", part("rows").alias("x"), all_of("cols").alias("y"))
    other = dealt.withColumn("home", F.lit(0)).select("*", part("cols").alias("y"), all_of("rows").alias("x"))
    tasks = mine.unionByName(other.select(mine.columns)).select(F.xxhash64(*cell, "x", "y").alias("task"), *cell, "x", "y", "home", "rep", "n", "vec")
    found = stage(map_groups(tasks, ["task", *cell, "x", "y"], _join(threshold), "rep long, links long, other long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), "vector-links")
    done = classes.select(*key, "rep", "n").join(links, "rep", "left").join(named.select(F.col("node").alias("rep"), "component"), "rep", "left")
    done = stage(done.select(*key, "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    # equal vectors may be a third of all rows
    linked = spread_join(rows.where("vec IS NOT NULL").select("k1", "k2", "label", "dim", "vec_id"), done, ["k1", "k2", "label", "dim"], "n", done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    alone = rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return own.keep(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), done)
