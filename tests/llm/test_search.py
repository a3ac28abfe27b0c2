"""op11 to op13 against their SQL on awkward tables, and against plain versions."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from gramlake.llm import imatch, ranked, vafile
from tests.llm.helpers import DOCS, prose, rows
from tests.oracle import key, value

ITEMS = [(1, prose(3, 30)), (2, prose(90, 12) + " nowhere"), (3, None), (4, ""), (5, "w1 W1 w1, w2"), (None, "w7 w9"), (6, "nothing here"), (7, "one two w399 ééé"), (7, "one two w399 ééé")]


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    names = sorted(df.columns)
    ours = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=key)
    ref = con.sql(sql)
    at = [list(ref.columns).index(c) for c in names]
    return ours, sorted((tuple(value(r[k]) for k in at) for r in ref.fetchall()), key=key)


def clashing(df):
    return df.selectExpr("*", "'mine' AS rank", "'mine' AS n", "'mine' AS range", "'mine' AS h", "'mine' AS item", "'mine' AS code", "'mine' AS v")


def words(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 0x80 or c.isascii() and c.isalnum():
            run += c.lower() if c.isascii() else c
        elif run:
            out.append(run)
            run = ""
    return out


def plainly_ranked(docs, items, top):
    held = [(i, collections.Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total = len(held), sum(k for *_, k in held)
    out = []
    for item, text in items:
        found = []
        for i, tf, k in held:
            m, score = 50 + 50 * k * n // total, 0
            for t in set(words(text)):
                df = sum(t in x for _, x, _ in held)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) if tf[t] else 0
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


@pytest.mark.parametrize("top", [3, 50])
def test_ranked_equals_plain_scores(spark, top, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 300)  # several blocks of items
    docs = spark.createDataFrame(rows(), DOCS).repartition(5)
    got = ranked.ranked(clashing(docs), clashing(spark.createDataFrame(ITEMS, "item_id long, text string")), top).collect()
    want = plainly_ranked([r[:2] for r in rows()], ITEMS, top)
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_ranked_without_rows(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.ranked(none, items).collect() == [] == ranked.ranked(spark.createDataFrame(rows(), DOCS), items.limit(0)).collect()


def test_ranked_bounds_prune_without_loss(spark):
    """A word that 60 short documents alone hold bounds an item's 50th score, whose common words then bring no candidates."""
    docs = [(k, f"rare{k % 3} common text") for k in range(60)] + [(100 + k, "common text " + prose(k, 40)) for k in range(400)]
    items = [(1, "rare0 rare1 rare2 common text"), (2, "common text")]
    got = ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 20).collect()
    assert sorted(map(tuple, got)) == sorted(plainly_ranked(docs, items, 20))


def test_fingerprints_equal_sql(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    ours, theirs = same(imatch.fingerprinted(clashing(docs.repartition(7))), imatch.SQL, documents=docs)
    assert len(ours) == len(rows()) and ours == theirs


def test_fingerprints_by_shuffled_lexicon(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), DOCS)
    want = sorted(imatch.fingerprinted(docs).collect(), key=str)
    monkeypatch.setattr(imatch, "MAX_TERMS", 10)
    assert sorted(imatch.fingerprinted(docs).collect(), key=str) == want


def test_fingerprints_of_edges(spark):
    assert imatch.fingerprinted(spark.createDataFrame([], DOCS)).collect() == []
    one = imatch.fingerprinted(spark.createDataFrame([(5, "abcé", "", "", 4)], DOCS)).first()
    assert one.n_chars == 4 and one.edited_sha256 == hashlib.sha256("abab".encode()).hexdigest() and one.near_next == 1.0
    texts = [prose(k, 300, 5000) for k in range(64)] + ["", None]
    got = {r.doc_id: r for r in imatch.fingerprinted(spark.createDataFrame([(k * k * 1000, t, "", "", 0) for k, t in enumerate(texts + texts)], DOCS)).collect()}
    prints = [got[k * k * 1000].fingerprint for k in range(2 * len(texts))]
    assert prints[:66] == prints[66:] and len(set(prints)) == 65 and prints[64] == prints[65]
    real = [got[k * k * 1000] for k in range(63)]
    assert sum(r.near_edited > r.near_next for r in real) >= 60


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dims=16):
    r = random.Random(4)
    out = [(k, [r.gauss(0, 0.3) for _ in range(dims)], None if k % 7 == 0 else k % 4 if k % 3 else 9) for k in range(20, n)]
    out += [(k, out[k][1], 1) for k in range(10)]  # equal vectors among the first entries
    return out + [(500, None, 1), (501, [None] + [0.1] * (dims - 1), 1), (502, [float("nan")] * dims, 2), (503, [float("inf")] * dims, 2), (504, [], 3), (None, [0.5] * dims, None), (505, [0.0] * dims, 1), (505, [0.0] * dims, 1)]


def test_codes_equal_sql(spark):
    df = spark.createDataFrame(vectors(), VECTORS)
    ours, theirs = same(vafile.coded(clashing(df.repartition(5))), vafile.SQL, embeddings=df)
    assert len(ours) == 293 and ours == theirs


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_approximation_loses_no_nearest(bits):
    r = np.random.default_rng(bits)
    entries, x = r.integers(-50, 50, (16, 4)), r.integers(-80, 80, (500, 4))
    entries[7] = entries[3]
    index, error, measured = vafile.Approximation(entries, bits).nearest(x)
    d = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all() and measured <= d.size
    if bits == 6:
        assert measured < d.size / 4


def test_codes_of_edges(spark):
    assert vafile.coded(spark.createDataFrame([], VECTORS)).collect() == []
    assert vafile.coded(spark.createDataFrame([(1, [0.1] * 12, 1)], VECTORS)).collect() == []
    few = vafile.coded(spark.createDataFrame([(2, [0.25] * 8, 1), (1, [1e30] * 8, 1), (3, [0.25] * 16, 1)], VECTORS)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in few) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    assert pd.Series([r.label_error for r in few]).eq(0).all()
