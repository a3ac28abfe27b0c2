"""Ranked lexical search: the TOP documents of each item, by a join that stored thresholds seed and prune.

Documents are read as text once: their counts of the items' terms become a table of postings. The TOP-th largest impact of
each term, stored beside the largest, is what TOP documents reach with that term alone, so the largest of an item's terms'
is a lower bound of its TOP-th score. An item's terms in order of falling largest impacts have suffix sums; a document with
none of the terms before the first suffix below the bound cannot be among the TOP. Documents with one of these terms are
candidates; those that the suffix may still lift over the bound get their exact score, and a task's own TOP-th score
raises the bound for the documents it has yet to see. All numbers are integers, and only strict inequalities prune.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.runtime import Scope, lean, stage
from gramlake.llm.text import text_pieces

#: Documents of each item; the scale of an impact and its fixed parts; weights of a document's length, in percent.
TOP, UNIT, STEP, SATURATION, BASE, SLOPE = 50, 1_000_000_000, 1000, 20, 100, 50
#: Items are worked on in blocks of about so many bytes of text: a block's terms and bounds go to every task.
BLOCK_BYTES = 4 << 20
#: Parts into which a term's or an item's rows are ranked first.
SLICES = 256

_SOLID = bytes(b if b >= 0x80 or chr(b).isascii() and chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters of a text in UTF-8, A-Z lower-cased; null has none."""
    return text.translate(_SOLID).split() if text else []


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the vocabulary's terms with their counts, of each document with at least one term."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, texts in text_pieces(b.column("text")):
                n, found = [], []
                for t in texts:
                    w = terms(t)
                    n.append(len(w))
                    found.append(np.fromiter(map(vocabulary.get, w, repeat(-1)), np.int64, len(w)))
                row = np.repeat(np.arange(len(texts)), n)
                term = np.concatenate(found) if found else np.zeros(0, np.int64)
                keys, tf = np.unique((row * size + term)[term >= 0], return_counts=True)
                held = np.searchsorted(keys, np.arange(len(texts) + 1) * size)
                ids = b.column("doc_id").slice(where.start, where.stop - where.start)
                lists = [pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.array(v, kind)) for v, kind in ((keys % max(size, 1), pa.int32()), (tf, pa.int64()))]
                some = pa.array(np.array(n) > 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"]).filter(some)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n long, term array<int>, tf array<long>")


class _Scores:
    """Impacts of a batch of postings under the corpus' counts; small, sent to every task."""

    def __init__(self, weights: np.ndarray, docs: int, words: int) -> None:
        self.weights, self.docs, self.words = weights, docs, words

    def of(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, impact) of the batch's postings."""
        n = b.column("n").to_numpy(zero_copy_only=False)
        m = BASE - SLOPE + (SLOPE * n * self.docs) // max(self.words, 1)
        sizes = np.diff(b.column("term").offsets.to_numpy())
        row = np.repeat(np.arange(b.num_rows), sizes)
        term, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term", "tf"))
        return row, term, self.weights[term] * ((UNIT * tf) // (STEP * tf + SATURATION * m[row]))


def _impacts(postings: DataFrame, scores: _Scores, top: int) -> list:
    """(term, kth, most) rows: the top-th largest impact, 0 if fewer documents hold the term, and the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_held, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            _, term, impact = scores.of(b)
            t, v = np.concatenate([terms_held, term]), np.concatenate([held, impact])
            order = np.lexsort((-v, t))
            t, v = t[order], v[order]
            first = np.searchsorted(t, t)  # where each term's rows begin
            keep = np.arange(len(t)) - first < top
            terms_held, held = t[keep], v[keep]
        yield pa.RecordBatch.from_arrays([pa.array(terms_held, pa.int64()), pa.array(held, pa.int64())], names=["term", "impact"])

    each = postings.select("n", "term", "tf").mapInArrow(lean(run), "term long, impact long").withColumn("slice", F.spark_partition_id() % SLICES)
    for keys in (["term", "slice"], ["term"]):
        each = each.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("impact")))).where(F.col("rank") <= top)
    return each.groupBy("term").agg(F.max(F.when(F.col("rank") == top, F.col("impact"))).alias("kth"), F.max("impact").alias("most")).collect()


def _searched(items: list, postings: DataFrame, vocabulary: dict[bytes, int], scores: _Scores, bounds: list, top: int) -> DataFrame:
    """(item, doc_id, score) of each task's own top candidates for each of items, a list of term numbers each."""
    kth, most = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for r in bounds:
        kth[r.term], most[r.term] = r.kth or 0, r.most
    plans = []
    for own in items:
        own = own[most[own] > 0]
        own = own[np.argsort(-most[own], kind="stable")]
        after = np.append(np.cumsum(most[own][::-1])[::-1], 0)  # after[j]: what terms j and on can add
        plans.append((own, after, int(kth[own].max(initial=0))))
    id_type = dict(postings.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = np.array([max(p[2], 1) for p in plans], np.int64)  # a score of 0 is no result
        best: list[list[tuple[int, bool, object]]] = [[] for _ in plans]
        for b in batches:
            row, term, impact = scores.of(b)
            order = np.argsort(term, kind="stable")
            row, term, impact = row[order], term[order], impact[order]
            start = np.searchsorted(term, np.arange(len(kth) + 1))
            ids = b.column("doc_id").to_pylist()
            for k, (own, after, _) in enumerate(plans):
                leading = int(np.searchsorted(-after[:-1], -bound[k], side="right"))  # terms whose suffix reaches the bound
                spans = [(start[t], start[t + 1]) for t in own[:leading] if start[t] < start[t + 1]]
                if not spans:
                    continue
                rows = np.concatenate([row[lo:hi] for lo, hi in spans])
                got = np.zeros(b.num_rows, np.int64)
                np.add.at(got, rows, np.concatenate([impact[lo:hi] for lo, hi in spans]))
                alive = (got > 0) & (got + after[leading] >= bound[k])
                if not alive.any():
                    continue
                for t in own[leading:]:
                    r = row[start[t] : start[t + 1]]
                    ok = alive[r]
                    got[r[ok]] += impact[start[t] : start[t + 1]][ok]
                for r in np.flatnonzero(alive & (got >= bound[k])):
                    best[k].append((-int(got[r]), ids[r] is None, ids[r]))
                if len(best[k]) > top:
                    best[k].sort()
                    del best[k][top:]
                if len(best[k]) == top:
                    bound[k] = max(bound[k], -max(best[k])[0])
        rows = [(k, i, -s) for k, found in enumerate(best) for s, _, i in found]
        yield pa.RecordBatch.from_pylist([{"item": k, "doc_id": i, "score": s} for k, i, s in rows], schema=pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return postings.mapInArrow(lean(run), f"item int, doc_id {id_type}, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of docs (doc_id, text) for each row of items (item_id, text).

    Null and empty texts have no terms: such documents do not count, such items have no rows. Equal scores go by ascending
    doc_id, null ids last. Repeated rows are documents, and items, each; rows of items with equal id and text give the same
    rows again. Further columns take no part. An empty table on either side gives no rows. doc_id must be a long.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = None
    with Scope() as own:
        kept = []
        for k in range(blocks):
            part = items.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
            vocabulary: dict[bytes, int] = {}
            plans = [np.unique(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms((r.text or "").encode())], np.int64)) for r in part]
            if not vocabulary:
                continue
            postings = stage(_postings(docs, vocabulary), "postings")
            n, words = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(vocabulary), np.int64)
            for r in postings.select(F.explode("term").alias("term")).groupBy("term").count().collect():
                df[r.term] = r["count"]
            weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
            scores = _Scores(weights, n, words)
            found = stage(_searched(plans, postings, vocabulary, scores, _impacts(postings, scores, top), top), "candidates")
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"item int, item_id {dict(items.dtypes)['item_id']}")
            order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
            found_in = found.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
            found_in = found_in.withColumn("rank", F.row_number().over(Window.partitionBy("item", "slice").orderBy(*order))).where(F.col("rank") <= top)
            best = found_in.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
            best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            out = best if out is None else out.unionByName(best)
            kept.append(found)
        if out is None:
            out = spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long")
        return own.keep(out, *kept)


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL = f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(t, '{_TERMS}') AS w FROM low),
d AS MATERIALIZED (SELECT row, doc_id, len(w)::BIGINT AS n, w FROM w WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_words FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS term FROM benchmark),
p AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p CROSS JOIN c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(t.w * (({UNIT} * tf) // ({STEP} * tf + {SATURATION} * ({BASE - SLOPE} + ({SLOPE} * n * n_docs) // n_words))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN t USING (term) JOIN d USING (row) CROSS JOIN c GROUP BY item_id, row, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}
"""
