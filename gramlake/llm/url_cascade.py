"""URL filters: a cascade of Bloom filters with exact membership over the corpus's keys, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.llm.runtime import release, stage

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hosts of the default block list, each with its subdomains.
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_ENDS = ("example.com", "example.net", "example.org")
#: Bytes that all filters of a cascade may take as a value in a plan; a larger list is joined instead.
MAX_BYTES = 4 << 20
BITS_A_KEY, HASHES = 10, 5


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for a null url or none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(h: Column, p: Column, labels: int, depth: int) -> Column:
    """Keys that a rule for the url could have: suffixes of the host of up to `labels` labels, beside prefixes of the path
    that end in one of its first `depth` slashes. labels and depth are those of the deepest listed key: no other key can
    be listed, so nothing is left out."""
    parts, steps = F.split(h, r"\."), F.split(p, "/", depth + 1)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    # split(.., depth + 1) leaves the rest of the path in the last part, which no prefix takes
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/")))
    starts = F.when(F.instr(p, "/") > 0, starts).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(h) > 0, F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: F.concat(e, s))))).otherwise(F.array().cast("array<string>"))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """Bits of a key in a level's filter, by double hashing."""
    # both hashes are brought below 2^40 first: sums stay in range under ANSI arithmetic
    a = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(1 << 40))
    b = F.pmod(F.xxhash64(key, F.lit(level), F.lit(1)), F.lit(1 << 39)) * 2 + 1  # odd: the steps meet different bits
    return [F.pmod(a + F.lit(k) * b, F.lit(bits)) for k in range(HASHES)]


class Cascade:
    """Exact membership of keys in a list, for every key of a universe.

    Level 1 is a Bloom filter of the listed keys, level 2 of the universe's keys that level 1 lets through though not
    listed, level 3 of the listed keys that level 2 lets through, and so on until nothing is let through. A key is listed
    if the first level that lacks it is an even one, or if all have it and the last is odd.

    A level is built by a distributed aggregate of its 64-bit words, which is one binary value in the end. What comes to the
    driver, and goes into plans, is the sum of the levels, about BITS_A_KEY bits a listed key and less for the false
    positives, and never over max_bytes: beyond, `levels` is None and `mark` joins the list instead. A probe reads one byte of
    the value by its place, in constant time.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES):
        """listed, universe: one string column `key` each. Null keys are never listed."""
        self.listed = listed = stage(listed.where("key IS NOT NULL").distinct(), "listed")
        others = universe.where("key IS NOT NULL").distinct().join(listed, "key", "left_anti")
        self.levels: list[tuple[int, bytes]] | None = []
        temporary = []
        inside, outside = listed, others
        held = 0
        while True:
            n = inside.count()
            if not n and self.levels:
                break
            bits = max(64, 1 << math.ceil(math.log2(max(1, n) * BITS_A_KEY)))
            held += bits // 8
            if held > max_bytes:
                self.levels = None
                break
            level = len(self.levels)
            places = inside.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("place"))
            words = places.groupBy(F.shiftright("place", 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))).alias("value"))
            # every word, absent ones as zero, in order: 16 digits each, the first the highest
            dense = listed.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.lpad(F.hex(F.coalesce("value", F.lit(0).cast("long"))), 16, "0").alias("digits"))
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "digits"))), lambda x: x["digits"]), "")
            self.levels.append((bits, bytes(dense.agg(F.unhex(joined).alias("filter")).first()["filter"])))
            let_through = stage(outside.where(self._has(F.col("key"), level)), "let-through")
            temporary.append(let_through)
            inside, outside = let_through, inside
        for t in temporary:
            release(t)

    def _has(self, key: Column, level: int) -> Column:
        bits, words = self.levels[level]
        value = F.lit(words)

        def bit(place: Column) -> Column:
            byte = (F.shiftright(place, 6) * 8 + 8 - F.shiftright(F.pmod(place, F.lit(64)), 3)).cast("int")
            return F.getbit(F.conv(F.hex(F.substring(value, byte, F.lit(1))), 16, 10).cast("long"), F.pmod(place, F.lit(8)).cast("int")) == 1

        out = F.lit(True)
        for place in _places(key, level, bits):
            out &= bit(place)
        return out

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with a boolean column: whether its key is listed. A filter's probe, or a join if the list exceeds the bound."""
        if self.levels is not None:
            return df.withColumn(name, F.coalesce(self.contains(F.col(key)), F.lit(False)))
        found = self.listed.select(F.col("key").alias("listed_key"), F.lit(True).alias(name))
        return df.drop(name).join(found, F.col(key) == F.col("listed_key"), "left").drop("listed_key").withColumn(name, F.coalesce(name, F.lit(False)))

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            verdict = F.when(~self._has(key, level), F.lit(level % 2 == 1)).otherwise(verdict)
        return verdict


def judged(pages: DataFrame, rules: tuple = RULES, blocked: tuple | DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages (page_id, url, any other columns).

    rules (host, path, verdict) fit their host and its subdomains where the url's path starts with the rule's; the
    longest wins, then the one with the longer host. blocked: hosts that, with their subdomains, are blocked where no rule
    fits, as a tuple or a table whose first column holds them (default: BLOCKED_NAMES under BLOCKED_ENDS); anything else is
    allowed. Lists are held in Cascades over all keys that the pages' urls can have, so the answer is exact without a join;
    a block list over the filters' bound is joined.

    A null url, or one without `://`, has an empty host and path, fits nothing and is allowed; so does an empty host. Null
    and empty hosts of a list block nothing. Rows that repeat are judged each. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    if blocked is None:
        blocked = tuple(f"{a}.{b}" for a in BLOCKED_NAMES for b in BLOCKED_ENDS)
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h,) for h in blocked], "host string")
    hosts = blocked.select(F.col(blocked.columns[0]).cast("string").alias("host")).where("host <> ''")
    deepest = hosts.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"]
    lists = {v: [h + p for h, p, x in rules if x == v] for v in ("block", "allow")}
    every = [k for keys in lists.values() for k in keys]
    labels = max([1, deepest or 1, *(k.split("/")[0].count(".") + 1 for k in every)])
    depth = max([1, *(k.count("/") for k in every)])
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    keys = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), labels, depth))
    roots = keys.withColumn("roots", candidates(F.col("host"), F.lit("/"), labels, 1))
    # the universe is distinct hosts' and paths' keys: distinct runs before the shuffle too, so a hot url is one row a task
    universe = stage(roots.select(F.explode(F.concat("keys", "roots")).alias("key")).distinct(), "url-keys")
    fits = F.array().cast("array<struct<len:int,hlen:int,key:string,verdict:string>>")
    for v in ("block", "allow"):
        if lists[v]:
            one = Cascade(spark.createDataFrame([(k,) for k in lists[v]], "key string"), universe, max_bytes=1 << 40)
            hits = F.filter("keys", one.contains)
            fits = F.concat(fits, F.transform(hits, lambda k: F.struct(F.length(k).alias("len"), F.instr(k, "/").alias("hlen"), k.alias("key"), F.lit(v).alias("verdict"))))  # noqa: B023
    listed = Cascade(hosts.select(F.concat("host", F.lit("/")).alias("key")), universe)
    release(universe)
    out = roots.withColumn("best", F.array_max(fits))
    if listed.levels is not None:
        out = out.withColumn("on_list", F.exists("roots", listed.contains))
    else:
        # beyond the bound: the distinct hosts that have a listed key, and the pages that have such a host
        hit = rows.select("host").distinct().select("host", F.explode(candidates(F.col("host"), F.lit("/"), labels, 1)).alias("key")).join(listed.listed, "key", "left_semi").select("host").distinct()
        out = out.join(hit.withColumn("on_list", F.lit(True)), "host", "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("on_list"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
