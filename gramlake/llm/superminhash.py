"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, union-find groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.llm.runtime import HOT, Scope, components, free, lean, map_groups, spread_join, stage
from gramlake.llm.text import mix, shingle_sets, text_pieces

#: Slots of a signature, a prime; the first BANDS * BAND_ROWS are banded. A pair at 0.8 shares no band with probability 7e-6.
SLOTS, BANDS, BAND_ROWS = 151, 30, 5
#: Documents and shingles that a verification task takes on either side.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
#: Pivots of a large candidate group.
PIVOTS = 4
#: Pairs whose estimated similarity is so far below the threshold are not verified (over 5 standard deviations at 0.8).
SLACK = 0.17
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set, uint64 [len(sets), slots].

    An element visits the slots in the order of its own permutation, slot = (a + rank * b) mod slots with a prime number
    of slots, and offers rank + u there. Any two slots' ranks are jointly distributed as under a uniform permutation, which
    is what the lower variance rests on. A set stops as soon as its largest slot is below the next rank.
    """
    out = np.full((len(sets), slots), _FULL, np.uint64)
    start, held = 0, 0
    for i, s in enumerate(sets):
        if held and held + len(s) > 500_000:
            _sign(sets[start:i], out[start:i])
            start, held = i, 0
        held += len(s)
    _sign(sets[start:], out[start:])
    return out


def _sign(sets: list[np.ndarray], out: np.ndarray) -> None:
    slots = out.shape[1]
    x = np.concatenate([np.empty(0, np.uint64), *sets])
    if not len(x):
        return
    row = np.repeat(np.arange(len(sets)) * slots, [len(s) for s in sets])
    at = (mix(x + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(slots)).astype(np.int64)
    step = (mix(x + np.uint64(0x3C6EF372FE94F82A)) % np.uint64(slots - 1)).astype(np.int64) + 1
    flat, open_rows = out.reshape(-1), np.unique(row) // slots
    for rank in range(slots):
        offer = (mix(x ^ np.uint64((rank + 1) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(8)) | np.uint64(rank << 56)
        np.minimum.at(flat, row + at, offer)
        done = out[open_rows].max(1) < np.uint64(rank + 1 << 56)
        if done.any():
            open_rows = open_rows[~done]
            if not len(open_rows):
                return
            left = np.zeros(len(sets), bool)
            left[open_rows] = True
            keep = left[row // slots]
            x, row, at, step = x[keep], row[keep], at[keep], step[keep]
        at += step
        at[at >= slots] -= slots


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """int64 [sets, bands]: a hash of the band's number and slots."""
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(sig), b + 1, np.uint64)
        for k in range(rows):
            acc = mix(acc) + sig[:, b * rows + k]
        keys[:, b] = mix(acc)
    return keys.view(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands, marks): d1 and d2 are a digest of the set, marks the low byte of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_pieces(batch.column(1)):
                sets = shingle_sets(texts, width)
                sig = signatures(sets)
                digest = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
                marks = (sig & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sig).reshape(-1))),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "marks"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, marks binary")


def linked(sets: list[np.ndarray], marks: np.ndarray, label: np.ndarray, home: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join all components of the pairs with one side at home, different labels and enough similarity.

    Pairs are tried by estimated similarity; one whose sides are joined already is passed over. Each link is exact.
    """
    rows = np.flatnonzero(home)
    near = np.zeros((len(rows), len(sets)), np.uint8)
    for k in range(marks.shape[1]):
        near += marks[rows, k, None] == marks[None, :, k]
    n = marks.shape[1]
    floor = max(percent / 100 - SLACK, 0)
    ok = near >= int(n * (floor + (1 - floor) / 256))
    ok &= label[rows, None] != label[None, :]
    ok[:, rows] &= rows[:, None] < rows[None, :]
    size = np.array([len(s) for s in sets])
    i, j = np.nonzero(ok)
    a = rows[i]
    small, large = np.minimum(size[a], size[j]), np.maximum(size[a], size[j])
    fit = (100 * small >= percent * large) & (small > 0)
    i, j, a = i[fit], j[fit], a[fit]
    order = np.argsort(-near[i, j].astype(np.int16), kind="stable")
    i, j, a = i[order], j[order], a[order]
    names, parent = np.unique(label, return_inverse=True)
    parent = parent.tolist()
    top = list(range(len(names)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    common = None
    if len(a) > 5_000:
        every, code = np.unique(np.concatenate(sets), return_inverse=True)
        if len(rows) * len(sets) * len(every) * 1e-10 < len(a) * 1.5e-5:  # seconds by matrix product, and pair by pair
            owner = np.repeat(np.arange(len(sets)), size)
            place = np.full(len(sets), -1)
            place[rows] = np.arange(len(rows))
            common = np.zeros((len(rows), len(sets)), np.float32)
            for lo in range(0, len(every), 4096):
                inside = (code >= lo) & (code < lo + 4096)
                held = np.zeros((len(sets), min(4096, len(every) - lo)), np.float32)
                held[owner[inside], code[inside] - lo] = 1
                common += held[rows] @ held.T
    for x, y, r in zip(a.tolist(), j.tolist(), i.tolist(), strict=True):
        p, q = find(parent[x]), find(parent[y])
        if p == q:
            continue
        both = int(common[r, y]) if common is not None else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= percent * (size[x] + size[y] - both):
            top[p] = q
            yield x, y


def _verified(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) of the tasks in rows (task, home, doc_id, label, marks, text)."""

    def run(t: pa.Table) -> pa.Table:
        ids = t["doc_id"].to_numpy()
        sets = [s for _, texts in text_pieces(t["text"].combine_chunks()) for s in shingle_sets(texts, width)]
        marks = np.frombuffer(b"".join(t["marks"].to_pylist()), np.uint8).reshape(len(ids), -1)
        found = list(linked(sets, marks, t["label"].to_numpy(), t["home"].to_numpy().astype(bool), percent))
        return pa.table({"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids[y] for _, y in found], pa.int64())})

    return map_groups(rows.select("task", "home", "doc_id", "label", "marks", "text"), ["task"], run, "a long, b long")


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(71)), n)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id long, text string, any other columns).

    Documents link when 100 * intersection >= percent * union of their word-shingle sets; component_id is the smallest
    doc_id reachable by links. Candidates come from the bands of SuperMinHash signatures, and every link is confirmed on
    the full sets. Copies of a set stand as one; candidate groups of over BLOCK_DOCS first meet a few pivots, and only what
    those do not join is compared with the whole group, in blocks.

    Null or empty texts and texts without words have no shingles and link with nothing. Rows with a null doc_id link with
    nothing, have a null component_id and are kept. Rows that share a doc_id are one document, linked as any of its texts.
    An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    with Scope() as own:
        return _grouped(docs, width, percent, own)


def _grouped(docs: DataFrame, width: int, percent: int, own: Scope) -> DataFrame:
    sig = stage(signed(docs.select(F.col("doc_id").cast("long"), "text"), width), "signatures")
    some = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = stage(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "sets")
    total = one.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # any row of (digest, doc_id) will do: equal sets have equal bands
    reps = spread_join(some.select("d1", "d2", "doc_id", "n_shingles", "bands", "marks"), one, ["d1", "d2"], "copies", total)
    reps = stage(reps.where("doc_id = rep").select("doc_id", "n_shingles", "bands", "marks"), "reps")
    keyed = reps.select("doc_id", F.explode("bands").alias("band"))
    heads = keyed.groupBy("band").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("head <> last").select("band", "head", "n")
    pairs = spread_join(keyed, heads, ["band"], "n", BANDS * reps.count()).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    group = stage(components(pairs, "candidates"), "groups")
    group = group.unionByName(group.select(F.col("component").alias("node"), "component").distinct())
    known = stage(reps.join(group, reps["doc_id"] == group["node"]).select("doc_id", F.col("component").alias("cc"), "n_shingles", "marks"), "members")
    sizes = known.groupBy("cc").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    sizes = sizes.select("cc", "n", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = known.count()
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    full = stage(spread_join(known, sizes, ["cc"], "n", members).join(texts, "doc_id"), "texts")
    # a group of one block is one task
    task = F.xxhash64("cc", F.lit(0), F.lit(0))
    alone = full.where("blocks = 1").select(task.alias("task"), F.lit(1).alias("home"), "doc_id", F.col("doc_id").alias("label"), "marks", "text")
    edges = _verified(alone, width, percent)
    large = full.where("blocks > 1")
    if not large.isEmpty():
        # pivots: a few members of each large group, beside every block of it
        picks = large.groupBy("cc", "blocks").agg(F.array_distinct(F.array(*[F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))) for k in range(PIVOTS)])).alias("ids"))
        picks = picks.select("cc", "blocks", F.explode("ids").alias("doc_id"))
        pivots = large.join(picks, ["cc", "blocks", "doc_id"], "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        first = large.withColumn("block", _block(F.col("blocks")).cast("int")).withColumn("home", F.lit(0)).unionByName(pivots.withColumn("home", F.lit(1)))
        first = first.select(F.xxhash64("cc", "block", F.lit(1)).alias("task"), "home", "doc_id", F.col("doc_id").alias("label"), "marks", "text")
        star = stage(_verified(first, width, percent), "pivots")
        joined = components(star, "pivot-groups").select(F.col("node").alias("doc_id"), "component")
        marked = stage(large.join(joined, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component"), "labelled")
        main = marked.groupBy("cc", "label").count().groupBy("cc").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("n"))
        marked = spread_join(marked, main, ["cc"], "n", members).withColumn("loose", F.col("label") != F.col("main"))
        here = lambda x: F.when(F.col("loose"), x)
        loose = marked.groupBy("cc").agg(F.greatest(F.ceil(F.count(here(F.lit(1))) / BLOCK_DOCS), F.ceil(F.sum(here(F.col("n_shingles"))) / BLOCK_SHINGLES)).cast("int").alias("rows"), F.count("*").alias("n")).where("rows > 0")
        marked = spread_join(marked, loose, ["cc"], "n", members).withColumn("own", _block(F.col("rows")).cast("int")).withColumn("block", _block(F.col("blocks")).cast("int"))
        mine = marked.where("loose").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y")).withColumn("x", F.col("own")).withColumn("home", F.lit(1))
        # a loose member meets those of its own block as a home row
        other = marked.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("x")).withColumn("y", F.col("block")).where("NOT (loose AND own = x)").withColumn("home", F.lit(0))
        rest = mine.unionByName(other).select(F.xxhash64("cc", "x", "y", F.lit(2)).alias("task"), "home", "doc_id", "label", "marks", "text")
        edges = edges.unionByName(star).unionByName(_verified(rest, width, percent))
    named = components(edges, "links").select(F.col("node").alias("rep"), "component")
    final = stage(one.join(named, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"), "copies"), "components")
    out = spread_join(some.select("doc_id", "n_shingles", "d1", "d2"), final, ["d1", "d2"], "copies", total).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    rest = sig.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return own.keep(out, sig, final)


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, less all but one document of each group of near-duplicates: the smallest doc_id stays.

    Of rows that share a doc_id one with the least text stays. Rows with a null doc_id stay.
    Other columns may have any names.
    """
    (key,) = free(docs, "kept_id")
    with Scope() as scope:
        ids = near_duplicates(docs, width, percent).where("kept AND doc_id IS NOT NULL")
        ids = stage(ids.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")), "kept")
        scope.keep(ids, ids)
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = docs["doc_id"].cast("long")
    # ids with over one in HOT of the rows, fewer than HOT: their rows are found by broadcast
    hot = F.broadcast(ids.where((F.col("n") > 1) & (F.col("n") > total // HOT)).select(key))
    cold = docs.join(hot, own == F.col(key), "left_anti")
    own_cold = cold["doc_id"].cast("long")
    out = cold.join(ids.where("n = 1").select(key), own_cold == F.col(key), "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
    again = ids.where("n > 1")
    if not again.isEmpty():
        few = again.where(F.col("n") <= total // HOT).select(key)
        rows = docs.join(hot, own == F.col(key), "left_semi").unionByName(cold.join(few, own_cold == F.col(key), "left_semi"))
        one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("least"))
        out = out.unionByName(one.select("least.*"))
    return out
