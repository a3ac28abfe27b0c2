"""Toxicity: a logistic classifier over words and word stems, regularised by counterfactual swaps of identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.llm.runtime import lean, release, stage

#: Labelled documents of either class that the fit takes, the first by a hash of doc_id.
SAMPLE = 4_000
#: A feature needs so many sampled documents; so many of the most telling ones are weighed, beside those of identity terms.
LEAST, FEATURES = 3, 20_000
#: Strength of the counterfactual penalty and of the ridge; weight of a document with an inserted mention.
SWAP, RIDGE, INSERTED = 1.0, 2e-4, 0.25
#: Identity terms by language. Those of a row may stand for each other; a neutral term is last.
IDENTITIES = {
    "en": (
        ("women", "men", "girls", "boys", "people"),
        ("woman", "man", "girl", "boy", "person"),
        ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "religious"),
        ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "believers"),
        ("black", "white", "asian", "african", "european", "american", "local"),
        ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
        ("immigrant", "refugee", "foreigner", "citizen", "resident"),
        ("immigrants", "refugees", "foreigners", "citizens", "residents"),
        ("disabled", "blind", "deaf", "old", "young"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen", "leute"),
        ("frau", "mann", "kind", "mensch", "person"),
        ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "gläubige"),
        ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "religiös"),
        ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "amerikaner", "einheimische"),
        ("schwul", "lesbisch", "bisexuell", "transgeschlechtlich", "heterosexuell"),
        ("einwanderer", "flüchtlinge", "ausländer", "bürger", "einwohner"),
        ("behinderte", "blinde", "gehörlose", "alte", "junge"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons", "gens"),
        ("femme", "homme", "fille", "garçon", "personne"),
        ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "croyants"),
        ("noirs", "blancs", "asiatiques", "africains", "européens", "américains", "habitants"),
        ("homosexuel", "lesbienne", "bisexuel", "transgenre", "hétérosexuel"),
        ("immigrés", "réfugiés", "étrangers", "citoyens", "résidents"),
        ("handicapés", "aveugles", "sourds", "vieux", "jeunes"),
    ),
    "es": (
        ("mujeres", "hombres", "niñas", "niños", "personas"),
        ("mujer", "hombre", "niña", "niño", "persona"),
        ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "creyentes"),
        ("negros", "blancos", "asiáticos", "africanos", "europeos", "americanos", "vecinos"),
        ("homosexual", "lesbiana", "bisexual", "transgénero", "heterosexual"),
        ("inmigrantes", "refugiados", "extranjeros", "ciudadanos", "residentes"),
        ("discapacitados", "ciegos", "sordos", "ancianos", "jóvenes"),
    ),
}
_WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6, 7)


def rows_of(identities: dict[str, tuple]) -> list[tuple[str, ...]]:
    return [row for lang in sorted(identities) for row in identities[lang]]


def features(word: str) -> list[int]:
    """Hashes of a word and of its stems, in UTF-8 bytes."""
    raw = word.encode()
    return [xxhash.xxh3_64_intdigest(raw), *(xxhash.xxh3_64_intdigest(raw[:n], seed=n) for n in STEMS if len(raw) >= n)]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def excluded(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class Classifier:
    """Weights of feature hashes, and a bias. The score is the logistic of their sum over a text's distinct features."""

    weights: dict[int, float]
    bias: float
    #: Counterfactual pairs that the fit held together.
    pairs: int = 0

    def scorer(self):
        memory: dict[str, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            hits: set[int] = set()
            for w in distinct_words(text):
                found = memory.get(w)
                if found is None:
                    if len(memory) > 200_000:
                        memory.clear()
                    found = memory[w] = tuple(f for f in features(w) if f in weights)
                if found:
                    hits.update(found)
            z = self.bias + sum(weights[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return score


def hashes_of(found: set[str]) -> np.ndarray:
    """Sorted distinct features of words."""
    return np.unique(np.array([f for w in found for f in features(w)], np.uint64))


def counterfactuals(found: set[str], rows: list[tuple[str, ...]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(features that an inserted mention adds, [(features that come, that go) of each swap]) of a text's words.

    Every identity term of the text is swapped for each alternative of its row. One neutral mention is inserted, of a row
    and term hashed from the words, and swapped for each alternative too: every labelled text has pairs.
    """
    whole = hashes_of(found)
    swaps = []
    for row in rows:
        for term in row:
            if term in found:
                swaps += [(found, (found - {term}) | {other}) for other in row if other != term]
    out = [(np.setdiff1d(after, whole), np.setdiff1d(whole, after)) for after in (hashes_of(b) for _, b in swaps)]
    added = np.empty(0, np.uint64)
    if rows and found:
        seed = xxhash.xxh3_64_intdigest(whole.tobytes())
        row = rows[seed % len(rows)]
        term = row[(seed >> 32) % len(row)]
        added = np.setdiff1d(hashes_of({term}), whole)
        for other in row:
            if other != term:
                new = np.setdiff1d(hashes_of({other}), whole)
                out.append((np.setdiff1d(new, added), np.setdiff1d(added, new)))
    return added, out


@dataclass
class Sparse:
    """Rows of column numbers, each with weight one: columns of all rows in a row, and where each row starts."""

    cols: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sparse:
        return cls(np.concatenate([np.empty(0, np.uint16), *rows]).astype(np.uint16), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))

    def blocks(self):
        """Ranges of rows with about a million entries each: what a product holds at once."""
        cuts = np.unique(np.concatenate([[0], np.searchsorted(self.start, np.arange(1 << 20, self.start[-1], 1 << 20)), [len(self.start) - 1]]))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield lo, hi, self.cols[self.start[lo] : self.start[hi]], np.diff(self.start[lo : hi + 1])

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start) - 1)
        for lo, hi, cols, size in self.blocks():
            out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), size), w[cols], hi - lo)
        return out

    def back(self, v: np.ndarray, m: int) -> np.ndarray:
        out = np.zeros(m)
        for lo, hi, cols, size in self.blocks():
            out += np.bincount(cols, np.repeat(v[lo:hi], size), m)
        return out


def fit(x: Sparse, y: np.ndarray, share: np.ndarray, plus: Sparse, minus: Sparse, weight: np.ndarray, columns: int) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the weighted logistic loss of rows x with labels y, + SWAP * the weighted mean squared
    change of the logit over the counterfactual pairs (columns that come, that go), + RIDGE * the weights' squared norm."""
    rate = float(np.average(y, weights=share).clip(1e-3, 1 - 1e-3))
    w, bias = np.zeros(columns), float(np.log(rate / (1 - rate)))
    size, size_b = np.full(columns, 1e-12), 1e-12
    for _ in range(400):  # full-batch steps scaled by each weight's past gradients
        err = share * (1 / (1 + np.exp(-(bias + x.dot(w)))) - y)
        change = weight * (plus.dot(w) - minus.dot(w))
        g = x.back(err, columns) + 2 * SWAP * (plus.back(change, columns) - minus.back(change, columns)) + RIDGE * w
        size += g * g
        w -= 0.15 * g / np.sqrt(size)
        size_b += err.sum() ** 2
        bias -= 0.15 * err.sum() / np.sqrt(size_b)
    return w, bias


def _packed(at: np.ndarray, columns: int) -> bytes:
    """Column numbers as 16-bit integers, or as a bit each where that is shorter: columns / 8 bytes and one at most."""
    if 2 * len(at) <= columns // 8:
        return b"\0" + at.astype(np.uint16).tobytes()
    bits = np.zeros(columns, bool)
    bits[at] = True
    return b"\1" + np.packbits(bits).tobytes()


def _unpacked(raw: bytes, columns: int) -> np.ndarray:
    if raw[:1] == b"\0":
        return np.frombuffer(raw, np.uint16, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=columns)).astype(np.uint16)


def train(docs: DataFrame, labels: DataFrame, identities: dict[str, tuple] = IDENTITIES) -> Classifier:
    """From the rows of labels (doc_id, toxic 0/1) that may be learned from, at most SAMPLE of each class.

    Features are made, counted and chosen on executors. The driver holds, for at most 2 * SAMPLE texts of any length, which
    of the FEATURES chosen columns they have: at most 2 * SAMPLE * FEATURES bits (20 MB), and the swaps of listed terms.
    Of several texts of a doc_id the least is learned from.
    """
    rows = rows_of(identities)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    usable = usable.where(~excluded(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    pick = [usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(SAMPLE) for t in (0, 1)]
    # at most 2 * SAMPLE rows of two integers
    sample = F.broadcast(pick[0].unionByName(pick[1]).withColumnRenamed("doc_id", "id"))
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(sample, "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, toxic, kind, come, go): a text's features (kind 0), those an inserted mention adds (1), a swap's (2)."""
        for batch in batches:
            for i, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = distinct_words(text)
                added, swaps = counterfactuals(words, rows)
                nothing = np.empty(0, np.uint64)
                each = [(0, hashes_of(words), nothing), (1, added, nothing), *((2, a, b) for a, b in swaps)]
                columns = [pa.array([i] * len(each), pa.int64()), pa.array([toxic] * len(each), pa.int32()), pa.array([k for k, _, _ in each], pa.int32())]
                columns += [pa.array([e[k].view(np.int64) for e in each], pa.list_(pa.int64())) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "toxic", "kind", "come", "go"])

    made = stage(found.mapInArrow(lean(run), "id long, toxic int, kind int, come array<long>, go array<long>"), "features")
    n = {r["toxic"]: r["count"] for r in made.where("kind = 0").groupBy("toxic").count().collect()}
    if len(n) < 2:
        release(made)
        rate = float(np.clip(totals.get(1, 0) / sum(totals.values()), 1e-3, 1 - 1e-3)) if n else 0.5
        return Classifier({}, float(np.log(rate / (1 - rate))))
    counts = made.where("kind = 0").select("toxic", F.explode("come").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.count("*").alias("both"))
    neg = F.col("both") - F.col("pos")
    tell = F.abs(F.log((F.col("pos") + 0.5) / (n[1] + 1)) - F.log((neg + 0.5) / (n[0] + 1))) * F.sqrt(F.least(F.col("pos") / n[1] + neg / n[0], F.lit(1.0)))
    chosen = [r["f"] for r in counts.where(F.col("both") >= LEAST).orderBy(tell.desc(), "f").limit(FEATURES).select("f").collect()]
    own = hashes_of({t for row in rows for t in row}).view(np.int64)
    names = np.unique(np.concatenate([np.array(chosen, np.int64), own]))
    if len(names) > 1 << 16:
        raise ValueError("FEATURES and the features of identity terms are at most 65,536 together")
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = []
            for name in ("come", "go"):
                each = [np.array(x, np.int64) for x in batch.column(name).to_pylist()]
                at = [np.minimum(np.searchsorted(known, x), len(known) - 1) for x in each]
                out.append(pa.array([_packed(np.sort(a[known[a] == x]), len(known)) for a, x in zip(at, each, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "toxic", "kind")), *out], names=["id", "toxic", "kind", "come", "go"])

    got = made.mapInArrow(lean(placed), "id long, toxic int, kind int, come binary, go binary").toArrow().sort_by([("id", "ascending"), ("kind", "ascending"), ("come", "ascending"), ("go", "ascending")])
    release(made)
    kind, toxic, ids = (got[c].to_numpy() for c in ("kind", "toxic", "id"))
    come = [_unpacked(x, len(names)) for x in got["come"].to_pylist()]
    go = [_unpacked(x, len(names)) for x in got["go"].to_pylist()]
    share = np.array([totals[int(t)] / n[int(t)] for t in toxic])
    main, swap = np.flatnonzero(kind < 2), np.flatnonzero(kind == 2)
    # kind 1 is the text with a mention: its own features (the row before, kind 0) and the mention's
    full = [come[k] if kind[k] == 0 else np.concatenate([come[k - 1], come[k]]) for k in main]
    weight = share[main] * np.where(kind[main] == 1, INSERTED, 1.0)
    _, owner, per = np.unique(ids[swap], return_inverse=True, return_counts=True)
    pair_weight = share[swap] / per[owner] if len(swap) else np.empty(0)
    w, bias = fit(
        Sparse.of(full), toxic[main].astype(float), weight / weight.sum(), Sparse.of([come[k] for k in swap]), Sparse.of([go[k] for k in swap]),
        pair_weight / max(pair_weight.sum(), 1e-300), len(names),
    )
    return Classifier({int(np.int64(f).view(np.uint64)): float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-4}, bias, len(swap))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, identities: dict[str, tuple] = IDENTITIES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text, any other columns).

    The text alone is the score's input. Null and empty texts, and texts without letters, have the score of the bias.
    Labels that are null, other than 0 and 1, or of unknown documents are not learned from; a document with several counts
    as toxic if one says so. Without labels of both classes the score is their share. identities: rows of terms, by language,
    whose swap or mention should not change a score. Repeated rows are scored each; null
    doc_ids stay null. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, identities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scores = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")
    return scores.select("doc_id", excluded(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def passed(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, identities: dict[str, tuple] = IDENTITIES) -> DataFrame:
    """The rows of docs, all columns, that score below threshold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, identities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for batch in batches:
            keep = [score(t) < threshold for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
