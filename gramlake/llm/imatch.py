"""I-Match fingerprints: terms of a band of document frequency, sorted, hashed under several random lexicon subsets.

Everything runs on DataFrame functions; no Python worker takes part.

A term is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text. The lexicon holds the
terms that are in at most one in COMMON of the documents and in more than one in RARE: their number is at most RARE times
the mean number of distinct terms of a document, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.runtime import Scope, plan_bytes, stage

#: A term of the lexicon is in at most 1 / COMMON and in more than 1 / RARE of the documents.
COMMON, RARE = 32, 4096
#: Families of nested random subsets of the lexicon. Family f looks at a term's hash from bit SHIFT * f on: the term is in
#: the family's subsets whose steps divide what is there. The first position of a fingerprint is the whole lexicon's. A text
#: of any length has steps that leave it a term or two, whose equality tells how many of its terms another text shares.
FAMILIES, SHIFT, STEPS = 25, 2, (4, 16, 64, 256, 1024, 4096)
#: Hexadecimal digits of a position; a subset without terms has none of them, but as many of NONE.
DIGITS, NONE = 6, "-"
#: The lexicon is broadcast up to so many terms and bytes of text, joined by shuffles beyond.
MAX_TERMS, MAX_BYTES = 2_000_000, 64 << 20
#: Bytes of input that share a range of ids, and pieces of the ids' distribution in which ids count as evenly spread.
RANGE_BYTES, PIECES = 4 << 20, 32
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text that is not null; the empty string may be among them."""
    return F.array_distinct(F.split(F.lower(text), SEPARATORS))


def hash60(text: Column) -> Column:
    """The first 60 bits of a text's MD5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lexicon(texts: DataFrame, n: int, common: int = COMMON, rare: int = RARE) -> DataFrame:
    """(term, h): the terms of the band and their hashes, of n documents with the column text (not null)."""
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    return counts.where((F.col("df") * common <= n) & (F.col("df") * rare > n)).select("term", hash60(F.col("term")).alias("h"))


def _ranges(docs: DataFrame, n_ranges: int) -> Column:
    """A number for each id that grows with it, in about n_ranges ranges of about equal numbers of rows; nulls get the last.

    The ids' distribution is taken in PIECES between quantiles of a mergeable sketch; within a piece it counts as even.
    """
    found = docs.agg(F.percentile_approx("doc_id", [k / PIECES for k in range(PIECES + 1)], 20 * PIECES)).first()[0] or [0]
    knots = sorted(set(found))
    per = -(-n_ranges // max(len(knots) - 1, 1))
    knots.append(knots[-1] + 1)

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            at = (F.col("doc_id") - knots[lo]) / float(knots[hi] - knots[lo])
            return F.least(F.greatest(F.floor(at * per), F.lit(0)), F.lit(per - 1)) + lo * per
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < knots[mid], tree(lo, mid)).otherwise(tree(mid, hi))

    return F.coalesce(tree(0, len(knots) - 1).cast("int"), F.lit(len(knots) * per))


def _in_order(docs: DataFrame) -> DataFrame:
    """(range, pos, extra, doc_id, text, next_text): each document with the text of the next by id, the last with the first's.

    Ranges of ids are sorted apart. The first document of each range comes a second time at the end of the range before,
    marked extra, so that whatever follows in a range is there; only the least id of each range is looked up.
    """
    spark = docs.sparkSession
    size = plan_bytes(docs) or 0
    at = _ranges(docs, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    docs = docs.withColumn("range", at)
    firsts = docs.groupBy("range").agg(F.min("doc_id").alias("first_id"))
    before = F.lag("range").over(Window.orderBy("range"))
    last = F.max("range").over(Window.partitionBy())
    firsts = firsts.select(F.col("range").alias("first_of"), "first_id", F.coalesce(before, last).alias("before"))
    docs = docs.join(F.broadcast(firsts), (F.col("range") == F.col("first_of")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    twice = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("extra"))))
    twice = twice.otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("range"), F.lit(True).alias("extra"))))
    docs = docs.select(F.inline(twice), "doc_id", "text")
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_last(), "text")
    return docs.select("range", F.row_number().over(order).alias("pos"), "extra", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def _fingerprints(sets: DataFrame, names: list[str]) -> DataFrame:
    """Array columns of names, sorted hashes, turned into arrays of one text for each subset of the lexicon."""
    one = f"x -> if(size(x) = 0, '{NONE * DIGITS}', substring(md5(array_join(cast(x as array<string>), ',')), 1, {DIGITS}))"
    for j, step in enumerate(STEPS):  # a step at a time: the next filters what is left, family by family
        inside = f"x & shiftleft({step - 1}L, {SHIFT} * f) = 0"
        first = lambda n, inside=inside: f"transform(sequence(0, {FAMILIES - 1}), f -> filter({n}, x -> {inside}))"
        later = lambda n, inside=inside, j=j: f"transform({n}_{j - 1}, (a, f) -> filter(a, x -> {inside}))"
        sets = sets.withColumns({f"{n}_{j}": F.expr(later(n) if j else first(n)) for n in names})
    steps = lambda n: ", ".join(f"{n}_{j}" for j in range(len(STEPS)))
    return sets.withColumns({n: F.expr(f"transform(concat(array({n}), {steps(n)}), {one})") for n in names}).drop(*[f"{n}_{j}" for n in names for j in range(len(STEPS))])


def likeness(a: str, b: str) -> Column:
    """The part of positions with the same terms among those at which either of two fingerprints has any."""
    none = NONE * DIGITS
    both = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))
    held = F.filter(both, lambda x: (x["a"] != none) | (x["b"] != none))
    return F.size(F.filter(held, lambda x: x["a"] == x["b"])).cast("double") / F.size(held)


def fingerprinted(docs: DataFrame, common: int = COMMON, rare: int = RARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    Null texts are empty. A text without a term of the lexicon has the hash of the whole text as its only term, so equal
    texts have equal fingerprints and empty ones are like each other alone. Documents go by ascending id, equal ids by
    their texts, null ids last; repeated rows are documents each. Further columns of docs take no part. An empty table
    gives no rows. doc_id must be an integer.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    with Scope() as own:
        words = stage(lexicon(docs, n, common, rare), "lexicon")
        size, held = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        known = F.broadcast(words) if size <= MAX_TERMS and held <= MAX_BYTES else words
        chars = F.length("text")
        half = F.floor(chars / 2).cast("int")
        edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
        rows = _in_order(docs).withColumn("edited", F.when(~F.col("extra"), edited))
        # a document's facts go with its first term alone, so that the others stay narrow
        both = rows.withColumns({"a": terms(F.col("text")), "b": F.coalesce(terms(F.col("edited")), F.array().cast("array<string>"))})
        each = both.select("range", "pos", "extra", "doc_id", "text", "edited", F.size("a").alias("size"), F.posexplode_outer(F.concat("a", "b")).alias("place", "term"))
        facts = F.struct("extra", "doc_id", chars.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.array(hash60(F.col("text"))).alias("whole"), F.array(hash60(F.coalesce("edited", F.lit("")))).alias("whole_edited"))
        each = each.select("range", "pos", "term", (F.col("place") < F.col("size")).alias("own"), F.when(F.coalesce("place", F.lit(0)) == 0, facts).alias("facts"))
        each = each.join(known, "term", "left").where("h IS NOT NULL OR facts IS NOT NULL")
        own_h, edited_h = F.when(F.col("own"), F.col("h")), F.when(~F.col("own"), F.col("h"))
        sets = each.groupBy("range", "pos").agg(F.max("facts").alias("facts"), F.sort_array(F.collect_list(own_h)).alias("s"), F.sort_array(F.collect_list(edited_h)).alias("e"))
        full = lambda a, other: F.when(F.size(a) > 0, F.col(a)).otherwise(F.col(other))
        rows = sets.select("range", "pos", "facts.*", "s", "e").withColumns({"s": full("s", "whole"), "e": full("e", "whole_edited")}).drop("whole", "whole_edited")
        rows = _fingerprints(rows, ["s", "e"]).withColumn("t", F.lead("s").over(Window.partitionBy("range").orderBy("pos"))).where(~F.col("extra"))
        out = rows.select(
            "doc_id", "n_chars", "edited_sha256", F.array_join("s", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"),
            likeness("s", "e").alias("near_edited"), likeness("s", "t").alias("near_next"),
        )
        return own.keep(out, words)


def _sql() -> str:
    """The same in DuckDB."""
    sets = ["s"] + [f"list_filter(s, lambda x: (x >> {SHIFT * f}) & {step - 1} = 0)" for step in STEPS for f in range(FAMILIES)]
    parts = ", ".join(f"coalesce(nullif(left(md5(array_to_string({x}, ',')), CASE WHEN len({x}) = 0 THEN 0 ELSE {DIGITS} END), ''), '{NONE * DIGITS}')" for x in sets)
    split = lambda x: f"unnest(list_distinct(list_filter(regexp_split_to_array(lower({x}), '{SEPARATORS}'), lambda x: x <> '')))"
    short = lambda x: f"('0x' || left(md5({x}), 15))::BIGINT"
    zipped = lambda a, b: f"list_filter(list_zip({a}, {b}), lambda x: x[1] <> '{NONE * DIGITS}' OR x[2] <> '{NONE * DIGITS}')"
    like = lambda a, b: f"len(list_filter({zipped(a, b)}, lambda x: x[1] = x[2]))::DOUBLE / len({zipped(a, b)})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, length(t) AS n, row_number() OVER w AS pos, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d WINDOW w AS (ORDER BY doc_id NULLS LAST, t)),
b AS MATERIALIZED (SELECT pos, doc_id, n, t, left(t, n - n // 2) || left(nt, n // 2) AS e FROM o),
w AS MATERIALIZED (SELECT pos, 0 AS k, {split("t")} AS w FROM b UNION ALL SELECT pos, 1, {split("e")} FROM b),
lex AS (SELECT w, {short("w")} AS h FROM w WHERE k = 0 GROUP BY w HAVING count(*) * {COMMON} <= (SELECT count(*) FROM d) AND count(*) * {RARE} > (SELECT count(*) FROM d)),
s AS (SELECT pos, k, list_sort(list(h)) AS s FROM w JOIN lex USING (w) GROUP BY ALL),
f AS MATERIALIZED (SELECT b.pos, u.k, coalesce(s.s, [{short("CASE WHEN u.k = 0 THEN b.t ELSE b.e END")}]) AS s FROM b CROSS JOIN (VALUES (0), (1)) AS u(k) LEFT JOIN s ON s.pos = b.pos AND s.k = u.k),
p AS MATERIALIZED (SELECT pos, k, [{parts}] AS p FROM f),
q AS (SELECT x.pos, x.p AS a, y.p AS c, coalesce(z.p, first_value(x.p) OVER (ORDER BY x.pos)) AS nx FROM p x JOIN p y ON x.pos = y.pos AND x.k = 0 AND y.k = 1 LEFT JOIN p z ON z.pos = x.pos + 1 AND z.k = 0)
SELECT doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(c, '') AS edited_fingerprint, {like("a", "c")} AS near_edited, {like("a", "nx")} AS near_next
FROM b JOIN q USING (pos)
"""


SQL = _sql()
