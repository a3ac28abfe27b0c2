"""Quality rules: measures of whole texts, and adaptive fences from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.llm.runtime import Scope, lean, stage
from gramlake.llm.text import hashed, text_pieces, windows

#: The bytes counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: Relative width of a sketch's buckets: a quantile is exact to about half of it. Values nearer to zero than LEAST are zero.
WIDTH, LEAST = 0.02, 1e-4
#: A document is rejected where a residual is over so many of its group's scales away from its group's median residual.
REACH = 6.0
#: A group whose median residual is over so many of its language's scales away is judged by the language's standard.
FAR = 30.0
#: So many rows of the language's quantiles (and, for these, of all rows') are mixed into those of a group.
PRIOR = 100
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
#: The judged rates: (count, of, whether too little of it is bad too). Of repeated words and lines the base rule decides.
RATES = (("n_symbols", "n_words", False), ("n_upper", "word_chars", False), ("word_chars", "n_words", True))


def measure(text: bytes | None, h: np.ndarray) -> tuple[int, int, int, int, int, int, int]:
    """The seven MEASURES of a whole text, whose words have the hashes h. Null and empty texts give zeros."""
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))) if text else 0
    if not len(h):
        return 0, 0, symbols, 0, 0, 0, 0
    raw = np.frombuffer(text.translate(None, b" \t\n\x0b\x0c\r"), np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if len(h) >= 5:
        _, code, count = np.unique(windows(h, 5), return_inverse=True, return_counts=True)
        hit = count[code] > 1
        if hit.any():
            cover = np.zeros(len(h), bool)
            for k in range(5):
                cover[k : k + len(hit)] |= hit
            repeat = int(cover.sum())
    return len(h), chars, symbols, dup, repeat, len(lines), upper


def measured(docs: DataFrame) -> DataFrame:
    """The columns of docs but its first, the text (any other columns), with the MEASURES of the text appended."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, texts in text_pieces(batch.column(0)):
                h, at = hashed(texts, lower=False)
                rows += [measure(t, h[a:b]) for t, a, b in zip(texts, at, at[1:], strict=False)]
            found = np.array(rows, np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(found[:, k]) for k in range(7))], names=[*batch.schema.names[1:], *names])

    keep = docs.columns[1:]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(lean(run), f"{kinds}, {MEASURES}")


def _bucket(value: Column) -> Column:
    """Bucket of the sketch, by sign and size: values within a factor of 1 + WIDTH share one; zero has its own."""
    size = F.ceil(F.log(F.abs(value) / LEAST) / float(np.log1p(WIDTH))).cast("int")
    return F.when(F.abs(value) <= LEAST, F.lit(0)).otherwise(F.signum(value).cast("int") * size)


def _value(bucket: Column) -> Column:
    """The middle of a bucket."""
    return F.signum(bucket) * F.when(bucket == 0, 0.0).otherwise(F.lit(LEAST) * F.pow(F.lit(1 + WIDTH), F.abs(bucket) - 0.5))


def quantiles(points: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """(keys, measure, rows, cuts): the quantiles `at` of each measure of a group, from points (keys, values array).

    The sketch is a histogram of logarithmic buckets on both sides of zero: partial counts of any split of the rows merge
    to the same counts, in any order, and a group has a few thousand buckets at most.
    """
    cells = points.select(*keys, F.posexplode("values").alias("measure", "value")).select(*keys, "measure", _bucket(F.col("value")).alias("bucket"))
    cells = cells.groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))
    sketch = cells.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("rows"))

    def cut(q: float) -> Column:
        rank = F.ceil(F.lit(q) * F.col("rows"))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("hit"))

        def step(acc: Column, x: Column) -> Column:
            seen = acc["seen"] + x["n"]
            return F.struct(seen.alias("seen"), F.when(acc["hit"].isNull() & (seen >= rank), x["bucket"]).otherwise(acc["hit"]).alias("hit"))

        return _value(F.aggregate("cells", start, step, lambda acc: acc["hit"]))

    return sketch.select(*keys, "measure", "rows", F.array(*[cut(q) for q in at]).alias("cuts"))


def _groups(points: DataFrame, at: list[float]) -> tuple[DataFrame, DataFrame, list[list[float]]]:
    """Quantiles of points (lang, source, values) by (lang, source), (lang) and over all, the first two shrunk to the wider.

    A group of n rows counts n, and the wider one PRIOR: a small group is judged much as its language is, a large one by
    itself, and none changes side at a number of rows.
    """
    row = lambda df, keys, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("measure", "cuts"))).alias(name), F.first("rows").alias(f"{name}_rows")).withColumn(name, F.col(f"{name}.cuts"))
    found = row(quantiles(points.select("values").withColumn("one", F.lit(1)), ["one"], at), ["one"], "every").first()
    every = [[float(x) for x in m] for m in found["every"]] if found else [[0.0] * len(at) for _ in RATES]
    wide, own = row(quantiles(points, ["lang"], at), ["lang"], "wide"), row(quantiles(points, ["lang", "source"], at), ["lang", "source"], "own")

    def shrunk(name: str, to: Column) -> Column:
        n = F.col(f"{name}_rows")
        return F.zip_with(name, to, lambda a, b: F.zip_with(a, b, lambda x, y: (n * x + PRIOR * y) / (n + PRIOR)))

    wide = wide.select("lang", shrunk("wide", _cells(every)).alias("wide"))
    return own.join(wide, "lang").select("lang", "source", shrunk("own", F.col("wide")).alias("own"), "wide"), wide, every


def _cells(values: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in values])


def _rates() -> Column:
    return F.array(*[F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for a, b, _ in RATES])


def _residuals(middle: Column) -> Column:
    """How far each rate is from middle (an array of arrays, the rate first), in the spread that chance alone would give.

    A count a of b chances at the rate p: (a - p * b) / sqrt(p * b + 1), where one more or less always is a unit. For the
    characters of b words: (a / b - p) * sqrt(b).
    """
    out = []
    for k, (a, b, mean) in enumerate(RATES):
        p = F.get(F.get(middle, k), 0)
        if mean:
            out.append(F.coalesce((F.try_divide(F.col(a), F.col(b)) - p) * F.sqrt(b), F.lit(0.0)))
        else:
            out.append((F.col(a) - p * F.col(b)) / F.sqrt(p * F.col(b) + 1))
    return F.array(*out)


def _scale(cuts: Column) -> Column:
    """A standard deviation by the narrower side of the middle half (a normal law's is 0.6745 of one), which no share of
    outliers under a half on one side moves to them; a unit residual at least (quantisation)."""
    return F.greatest(F.least(F.get(cuts, 2) - F.get(cuts, 1), F.get(cuts, 1) - F.get(cuts, 0)) / 0.6745, F.lit(1.0))


def _outside(residual: Column, cuts: Column, both: bool, reach: float = REACH) -> Column:
    away = residual - F.get(cuts, 1)
    return (F.abs(away) if both else away) > reach * _scale(cuts)


def fences(rows: DataFrame) -> tuple[DataFrame, tuple[list, list]]:
    """(lang, source, middle, cuts) of each group of rows (lang, source, the MEASURES), and middle and cuts over all rows.

    middle: the median rates. cuts: the quartiles of the residuals from them. Where a group's typical document lies
    FAR from its language's, the language's stand in for its own: a group that is mostly junk does not set its
    own standard.
    """
    with Scope() as own_scope:
        out, other = _fences(rows)
        return own_scope.keep(out, out), other


def _fences(rows: DataFrame) -> tuple[DataFrame, tuple[list, list]]:
    middle, _, every = _groups(rows.select("lang", "source", _rates().alias("values")), [0.5])
    middle = stage(middle, "middle")
    with_middle = rows.join(middle, ["lang", "source"])
    own, _, every_cuts = _groups(with_middle.select("lang", "source", _residuals(F.col("own")).alias("values")), [0.25, 0.5, 0.75])
    wide = with_middle.select("lang", "source", _residuals(F.col("wide")).alias("values"))
    _, wide_cuts, _ = _groups(wide, [0.25, 0.5, 0.75])
    typical = quantiles(wide, ["lang", "source"], [0.5]).groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("measure", "cuts"))).alias("t")).select("lang", "source", F.col("t.cuts").alias("typical"))
    both = middle.withColumnsRenamed({"own": "own_middle", "wide": "wide_middle"}).join(own.select("lang", "source", F.col("own").alias("own_cuts")), ["lang", "source"])
    both = both.join(typical, ["lang", "source"]).join(wide_cuts.select("lang", F.col("wide").alias("wide_cuts")), "lang")
    pick = {"middle": [], "cuts": []}
    for k, (_, _, two) in enumerate(RATES):
        far = _outside(F.get(F.get("typical", k), 0), F.get("wide_cuts", k), two, FAR)
        for name in pick:
            pick[name].append(F.when(far, F.get(f"wide_{name}", k)).otherwise(F.get(f"own_{name}", k)))
    out = both.select("lang", "source", F.array(*pick["middle"]).alias("middle"), F.array(*pick["cuts"]).alias("cuts"))
    return stage(out, "fences"), (every, every_cuts)


def _verdicts(rows: DataFrame) -> DataFrame:
    """rows (lang, source, the MEASURES, others) with base_failed and kept appended."""
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    found, (middle, cuts) = fences(rows.where(~failed).select("lang", "source", *[x.split()[0] for x in MEASURES.split(", ")]))
    # groups are few next to rows: Spark broadcasts them if they are small, and can split a hot group's join otherwise
    out = rows.withColumn("base_failed", failed).join(found, ["lang", "source"], "left")
    residual, cut = _residuals(F.coalesce("middle", _cells(middle))), F.coalesce("cuts", _cells(cuts))
    over = F.lit(False)
    for k, (_, _, two) in enumerate(RATES):
        over |= _outside(F.get(residual, k), F.get(cut, k), two)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False)))


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in ("lang", "source")]


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row of docs
    (doc_id, text, lang, source, any other columns).

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows. A document that passes is
    kept unless its symbols a word, its capital letters, or its characters a word lie over REACH scales from the median of
    the passing documents of its language and source (`fences`). Every threshold is a quantile of the data, none a fixed
    rate; quantiles cover all rows.

    Null and empty texts have no words and fail. A null language or source is a group of its own. Repeated rows count
    each. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    rows = stage(measured(docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *_group())), "measures")
    return _verdicts(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def passed(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that `judged` keeps. Texts are measured once: they are staged beside their measures."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    wide = docs.select(F.col("text").alias("t"), *_group(), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    out = _verdicts(stage(measured(wide), "measures")).where("kept")
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
