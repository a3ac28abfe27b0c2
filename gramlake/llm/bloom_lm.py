"""LM scoring: a log-frequency Bloom filter of quantised bigram counts, in shards, probed for smoothed probabilities."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gramlake.llm.runtime import Scope, give_back, lean, map_groups, small_batches, stage
from gramlake.llm.text import hashed, mix, text_pieces

#: Bits of the filter for each hash, and hashes of a probe of a level: an absent one is found at 0.4 %.
BITS, PROBES = 1.45, 8
#: Probes that say whether a bigram is there at all: so many, and SPARE more than the binary digits of the vocabulary, so
#: that what is found falsely after a history adds under 2^-SPARE words' mass, whatever the size of the corpus.
PRESENCE, SPARE = 24, 5
#: Filters that cannot exceed this size are broadcast, others are probed where their shards are made. Words whose exact counts
#: are broadcast.
MAX_BYTES, HEAD = 32 << 20, 2_000_000
#: Counts up to 4 have a level each; above, each level is wider than the last by this ratio.
RATIO, LEVELS = 1.4, 120
#: Bigram tokens of one reducer; words of one part of the vocabulary. Distinct bigrams that a mapper holds.
PART, HELD = 1_500_000, 700_000
#: Reducers, at least, where there are so many parts, and bigram tokens of each beyond: each sums up a text's tokens over its parts.
REDUCERS, GROUP = 24, 32_000_000
#: A history with over a quarter of a reducer's tokens is dealt by its bigrams; there are at most so many such.
HOT = 65_536
#: Bytes of text that a task scores at once: some 25 arrays of a number a token lie beside the filter.
SCORED = 512 << 10
END, BEGIN = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def level(count: np.ndarray) -> np.ndarray:
    c = np.maximum(count, 1)
    return np.where(c <= 4, count, 4 + np.floor(np.log(c / 4) / np.log(RATIO) + 1e-9)).astype(np.int64).clip(0, LEVELS - 1)


def level_of(count: Column) -> Column:
    return F.when(count <= 4, count).otherwise(F.least(F.lit(LEVELS - 1), 4 + F.floor(F.log(count / 4) / F.log(F.lit(RATIO)) + 1e-9))).cast("int")


def value(lvl: np.ndarray) -> np.ndarray:
    """The count that a level stands for, the least of its range: no sum of these exceeds that of the counts."""
    return np.where(lvl <= 4, lvl, 4 * RATIO ** (np.maximum(lvl, 4) - 4.0))


@dataclass
class Shards:
    """Log-frequency Bloom filter in shards: the bytes of all, each shard's place and number of bits, the probes of presence."""

    data: np.ndarray
    start: np.ndarray
    bits: np.ndarray
    presence: int

    def levels(self, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The level of each key, by probes of its shard: 0, or 1 and upwards while the next level is there too."""
        out = np.zeros(len(keys), np.int64)
        alive = self._there(np.arange(len(keys)), shard, keys, 1, self.presence)
        j = 1
        while len(alive):
            out[alive] = j
            j += 1
            alive = self._there(alive, shard, keys, j, PROBES) if j < LEVELS else alive[:0]
        return out

    def _there(self, alive: np.ndarray, shard: np.ndarray, keys: np.ndarray, lvl: int, probes: int) -> np.ndarray:
        """Which of alive hold the level. Those that fail leave after every few probes."""
        for lo in range(0, probes, 6):
            s = shard[alive]
            start, there = self.start[s], np.ones(len(alive), bool)
            for place in positions(keys[alive], lvl, self.bits[s], range(lo, min(lo + 6, probes))):
                there &= (self.data[start + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
            alive = alive[there]
            if not len(alive):
                break
        return alive


def shard_of(place: np.ndarray, n: int) -> np.ndarray:
    return (((place >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def positions(keys: np.ndarray, lvl: int, bits: np.ndarray | int, probes: range) -> Iterator[np.ndarray]:
    """Bits of a key's level: the upper halves of a walk with an odd step. A shard has under 2^32 bits."""
    a = mix(keys + np.uint64(lvl * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    b = mix(a) | np.uint64(1)
    m = np.asarray(bits, np.uint64)
    for k in probes:
        yield (((a + np.uint64(k) * b) >> np.uint64(32)) * m >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray, lvls: np.ndarray, presence: int) -> tuple[bytes, int]:
    """One shard: the presence of every key, and each of its levels above 1."""
    bits = max(64, int(BITS * (len(keys) * presence + int((lvls - 1).sum()) * PROBES)) + 7 & ~7)
    if bits >= 1 << 32:
        raise ValueError("a shard has under 2^32 bits: lower PART")
    data = np.zeros(bits, np.uint8)
    for j in range(1, int(lvls.max(initial=0)) + 1):
        for place in positions(keys[lvls >= j], j, bits, range(presence if j == 1 else PROBES)):
            data[place] = 1
    return np.packbits(data, bitorder="little").tobytes(), bits


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 7, is 2; a null id is text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def streams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of BEGIN, words and END of each text in a row, and where each text starts (one more at the end)."""
    h, at = hashed(texts)
    starts = at + 2 * np.arange(len(at))
    out = np.empty(len(h) + 2 * len(texts), np.uint64)
    own = np.ones(len(out), bool)
    own[starts[:-1]] = own[starts[1:] - 1] = False
    out[own] = h
    out[starts[:-1]], out[starts[1:] - 1] = BEGIN, END
    return out, starts


def bigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, before, after, owner): the distinct hashes of texts, and of each token but BEGIN what precedes it, it (both as
    places in words) and its text."""
    h, starts = streams(texts)
    words, code = np.unique(h, return_inverse=True)
    token = np.ones(len(h), bool)
    token[starts[:-1]] = False
    at = np.flatnonzero(token)
    return words, code[at - 1], code[at], np.repeat(np.arange(len(texts)), np.diff(starts) - 1)


def find(table: tuple[np.ndarray, ...], h: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the sorted table (keys, columns) holds of each of h, 0 for others."""
    keys, *columns = table
    if not len(keys):
        return tuple(np.zeros(len(h), c.dtype) for c in columns)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    there = keys[at] == h
    return tuple(np.where(there, c[at], 0) for c in columns)


def gram(after: np.ndarray) -> np.ndarray:
    """40 bits of a word's hash that tell a history's successors apart."""
    return after >> np.uint64(24)


def place_of(before: np.ndarray, grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What deals a bigram to a reducer and to a shard of the filter: its history, or the whole bigram of a hot history."""
    place = mix(before ^ np.uint64(0x51F5C1E3A9D7B20B))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
        place = np.where(hot[at] == before, mix(before + mix(grams)), place)
    return place


def _unigrams(docs: DataFrame) -> DataFrame:
    """(h, c, m): the words of docs (text, train) and END, how often training rows hold each, and all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            keys, code = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            counts = [np.bincount(code, np.concatenate([x[k] for x in held]), len(keys)).astype(np.int64) for k in (1, 2)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], names=["h", "c", "m"])

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for p, texts in text_pieces(batch.column(0)):
                h, at = hashed(texts)
                own = train[p]
                keys, code = np.unique(h, return_inverse=True)
                c, m = np.bincount(code, np.repeat(own, np.diff(at)), len(keys)), np.bincount(code, minlength=len(keys))
                held.append((np.append(keys, END), np.append(c, own.sum()), np.append(m, len(own))))
                if sum(len(x[0]) for x in held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text", "train").mapInArrow(lean(run), "h long, c long, m long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


def _runs(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    if not len(order):
        return rows, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.any([r[1:] != r[:-1] for r in rows], axis=0)]))
    return [r[first] for r in rows], np.diff(np.append(first, len(order)))


def _summed(before: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams by history, with their sums of counts. Under 2^24 histories."""
    names, code = np.unique(before, return_inverse=True)
    key = code.astype(np.uint64) << np.uint64(40) | grams
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    key = key[first]
    sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return names[(key >> np.uint64(40)).astype(np.int64)], key & np.uint64((1 << 40) - 1), sums


def _bigram_sums(docs: DataFrame, hot, parts: int, presence: int) -> DataFrame:
    """(part, singles, twos, before, mass, types, data, bits) of each range of places.

    singles, twos: bigrams seen once and twice. data, bits: the filter's shard of all. Of each history: the number of its
    bigrams (types), and the sum of their counts as the filter answers them (mass), false upper levels included. Arrays are
    packed as bytes.
    """

    def packed(before: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = shard_of(place_of(before, grams, hot.value), parts)
        order = np.argsort(part, kind="stable")  # within a part still by history: a run has its hash once
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cut)):
            at = order[cut[p] : cut[p + 1]]
            b, g = before[at], grams[at]
            head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            rows.append((int(p), b[head].tobytes(), np.diff(np.append(head, len(b))).astype(np.uint32).tobytes(), (g >> np.uint64(32)).astype(np.uint8).tobytes(), g.astype(np.uint32).tobytes(), counts[at].astype(np.uint32).tobytes()))
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    names = ["part", "before", "run", "high", "low", "counts"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for p, texts in text_pieces(batch.column(0)):
                words, b, a, _ = bigrams(texts)
                pair, n = np.unique(b * np.int64(len(words)) + a, return_counts=True)
                before = words[pair // len(words)]
                held.append((before, gram(words[pair % len(words)]), n))
                if sum(len(x[0]) for x in held) > HELD:
                    yield packed(*_summed(*map(np.concatenate, zip(*held, strict=True))))
                    held = []
        if held:
            yield packed(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    def merge(t: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind)
        before = np.repeat(join("before", np.uint64), join("run", np.uint32))
        grams = join("high", np.uint8).astype(np.uint64) << np.uint64(32) | join("low", np.uint32)
        before, grams, counts = _summed(before, grams, join("counts", np.uint32).astype(np.int64))
        keys = mix(mix(before) + grams)
        data, bits = build(keys, level(counts), presence)
        own = Shards(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([bits]), presence)
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(before) else np.empty(0, np.int64)
        mass = np.add.reduceat(value(own.levels(np.zeros(len(keys), np.int64), keys)), head) if len(head) else np.empty(0)
        sums = {"singles": (counts == 1).sum(), "twos": (counts == 2).sum(), "bits": bits}
        arrays = {"before": before[head].tobytes(), "mass": mass.tobytes(), "types": np.diff(np.append(head, len(before))).tobytes(), "data": data}
        row = {"part": pa.array([t["part"][0].as_py()], pa.int32())} | {k: pa.array([int(x)], pa.int64()) for k, x in sums.items()} | {k: pa.array([x], pa.binary()) for k, x in arrays.items()}
        return pa.table({k: row[k] for k in ("part", "singles", "twos", "before", "mass", "types", "data", "bits")})

    rows = docs.select("text").mapInArrow(lean(emit), "part int, before binary, run binary, high binary, low binary, counts binary")
    return map_groups(rows, ["part"], merge, "part int, singles long, twos long, before binary, mass binary, types binary, data binary, bits long", parts)


def _histories(sums: DataFrame, discount: float) -> DataFrame:
    """(h, s): of each history the mass that its bigrams hold, less discounts. Hot ones come from several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, mass, types in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(mass, np.float64) - discount * np.frombuffer(types, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(before, np.int64)), pa.array(s)], names=["h", "s"])

    return sums.select("before", "mass", "types").mapInArrow(lean(run), "h long, s double").groupBy("h").agg(F.sum("s").alias("s"))


def _collected(rows: DataFrame, parts: int, presence: int) -> Shards:
    """rows (part, data, bits): the shards of a filter whose size was checked, a partition of rows at a time."""
    t = rows.select("part", "bits").toArrow()
    bits = np.full(parts, 64, np.int64)
    bits[t["part"].to_numpy()] = t["bits"].to_numpy()
    start = np.concatenate([[0], np.cumsum(bits // 8)])
    data = np.zeros(start[-1], np.uint8)
    for r in rows.select("part", "data").toLocalIterator():
        data[start[r["part"]] : start[r["part"] + 1]] = np.frombuffer(r["data"], np.uint8)
    return Shards(data, start[:-1], bits, presence)


@dataclass
class Model:
    tokens: int
    vocabulary: int
    discount: float
    hot: np.ndarray
    parts: int
    filter: Shards | None = None

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.vocabulary + 1)

    def probed(self, before: np.ndarray, after: np.ndarray, s_before: np.ndarray) -> np.ndarray:
        """The bigrams' counts, by probes of the filter."""
        q = np.zeros(len(before))
        at = np.flatnonzero(s_before > 0)  # other histories have no bigram: what were found would be false
        if len(at):
            b = before[at]
            g = gram(after[at])
            q[at] = value(self.filter.levels(shard_of(place_of(b, g, self.hot), self.parts), mix(mix(b) + g)))
        return q

    def smoothed(self, q: np.ndarray, c_before: np.ndarray, s_before: np.ndarray, c_after: np.ndarray) -> np.ndarray:
        """Over all words and the unknown one the probabilities after a history sum to one: the kept bigrams have
        s_before / c, and the base estimate, which sums to one, the rest. c is the history's count, or a little over s_before
        where false levels bring that above the count."""
        a, b = self.mixture(q, c_before, s_before)
        return np.log10(a + b * self.base(c_after))

    def mixture(self, q: np.ndarray, c_before: np.ndarray, s_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the bigram itself gives, and the part of the base estimate."""
        c = np.maximum(np.maximum(c_before, 1), s_before + self.discount)
        return np.maximum(q - self.discount, 0) / c, 1 - s_before / c


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text, any others).

    Learns from the rows that are not held out. Every word count is exact (by a 64-bit hash of the word): counts of up to
    HEAD frequent words are broadcast, what they do not cover is joined. score is the model's log10 probability of the text:
    every bigram of the training rows, at quantised counts in a log-frequency Bloom filter, absolutely discounted to the
    words' base estimate; what a history's bigrams leave is known exactly, so that its probabilities sum to one (but for
    false probes, whose mass is under 2^-SPARE words). The filter grows with the corpus. Where it is sure to be under
    MAX_BYTES it is broadcast; else the texts' bigrams go to where its shards are made. The model, and so the scores, are the
    same either way.

    Null and empty texts are the end token alone. A null doc_id counts as the text ''. Repeated rows count each, in
    training as in the result. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    with Scope() as own:
        return _scores(docs, own)


def _scores(docs: DataFrame, own: Scope) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    docs = docs.withColumn("train", ~held_out(F.col("doc_id")))
    train = docs.where("train")
    every = stage(_unigrams(docs), "words")
    counts = every.where("c > 0").select("h", "c")
    by_level = {r["lvl"]: r for r in counts.groupBy(level_of(F.col("c")).alias("lvl")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    n_tokens, n_words = sum(r["c"] for r in by_level.values()), sum(r["n"] for r in by_level.values())
    end = counts.where(F.col("h") == int(END.view(np.int64))).first()
    n_texts = end["c"] if end else 0
    # the head: as many whole levels as fit
    cut, held = LEVELS, 0
    while cut > 1 and held + (by_level[cut - 1]["n"] if cut - 1 in by_level else 0) <= HEAD:
        cut -= 1
        held += by_level[cut]["n"] if cut in by_level else 0
    in_head = level_of(F.col("c")) >= cut
    many = max(PART // 4, n_tokens // HOT)
    often = [(r["h"], r["c"]) for r in every.where(F.col("m") > many).select("h", "c").collect()] + [(int(BEGIN.view(np.int64)), n_texts)] * (n_texts > many)
    often = sorted((h & (1 << 64) - 1, c) for h, c in often)
    hot = np.array([h for h, _ in often], np.uint64)
    parts = max(1, -(-n_tokens // PART))
    presence = max(PRESENCE, math.ceil(math.log2(max(n_words, 1))) + SPARE)
    if BITS * presence * n_tokens / 8 > MAX_BYTES:  # no filter of so many tokens is larger
        return _scored_apart(docs, Model(n_tokens, n_words, 0.75, hot, parts), np.array([c for _, c in often], np.int64), n_texts, every, in_head, presence, own)
    sums = stage(_bigram_sums(train, spark.sparkContext.broadcast(hot), parts, presence), "bigrams")
    size = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("singles", "twos")]).first()
    discount = size["singles"] / (size["singles"] + 2 * size["twos"]) if size["singles"] else 0.75
    histories = stage(_histories(sums, discount), "histories")
    vocabulary = stage(counts.join(histories, "h", "left").select("h", "c", F.coalesce("s", F.lit(0.0)).alias("s")), "vocabulary")
    top = vocabulary.where(in_head).toArrow()
    begin = histories.where(F.col("h") == int(BEGIN.view(np.int64))).first()
    s_begin = begin["s"] if begin else 0.0
    keys = np.append(top["h"].to_numpy().view(np.uint64), BEGIN)
    order = np.argsort(keys)
    head = spark.sparkContext.broadcast((keys[order], np.append(top["c"].to_numpy(), n_texts)[order], np.append(top["s"].to_numpy(), s_begin)[order]))
    del top, keys, order
    give_back()
    model = Model(n_tokens, n_words, discount, hot, parts)
    shards = sums.select("part", "data", "bits")
    model.filter = _collected(shards, parts, presence)
    give_back()
    shared = spark.sparkContext.broadcast(model)
    del model  # the broadcast has its own copy
    give_back()
    whole = cut <= 1  # no word is outside the head
    below = float(n_tokens + n_words + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of three kinds, with nulls for the rest: a document with its sums over head words; one of its other words
        (h), n times, which brings its base estimate to both sums; one of its bigrams (x, y) that needs such a word's counts,
        m times. hx and hy are the words to be joined, or the row's own key, so that no join partition is hot."""
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            ids = batch.column(1)
            for p, texts in text_pieces(batch.column(0), SCORED):
                words, b, a, owner = bigrams(texts)
                exact, mass = find(head.value, words)
                n = p.stop - p.start
                known = np.ones(len(words), bool) if whole else (exact > 0) | (words == BEGIN)
                pair, back = np.unique(b * np.int64(len(words)) + a, return_inverse=True)
                before, after = pair // len(words), pair % len(words)
                q, c, s = shared.value.probed(words[before], words[after], mass[before]), exact[before], mass[before]
                lp = shared.value.smoothed(q, c, s, exact[after])
                # a word outside the head without a bigram here: its base estimate comes by the join, the history's rest now
                lp -= np.where(known[after], 0, np.log10(shared.value.base(exact[after])))
                apart = ~known[after] & (q > 0) | ~known[before]
                lp[apart] = 0
                seen = exact[a] > 0
                size = np.bincount(owner, minlength=n)
                sums = [np.bincount(owner, x, n) for x in (lp[back], np.where(known[a], np.log10((exact[a] + 1) / below), 0), seen)]
                lost, rare = ~known[a], apart[back]
                (o1, a1), n1 = _runs(owner[lost], words[a[lost]])
                (o2, b2, a2), n2 = _runs(owner[rare], b[rare], a[rare])
                rows = row + np.concatenate([np.arange(n), o1, o2])
                own = mix(np.uint64(row) + np.arange(len(o2), dtype=np.uint64))
                k1, k2 = n + len(o1), len(rows)

                def fill(x: np.ndarray, lo: int, hi: int, kind=np.int64) -> pa.Array:
                    out, null = np.zeros(k2, kind), np.ones(k2, bool)  # noqa: B023
                    out[lo:hi], null[lo:hi] = x if x.dtype != np.uint64 else x.view(np.int64), False
                    return pa.array(out, mask=null)

                pairs = [words[b2], words[a2], np.where(known[b2], own, words[b2]), np.where(known[a2], own, words[a2]), n2]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows),
                        ids.slice(p.start, n).take(pa.array(np.arange(k2), mask=np.arange(k2) >= n)),
                        *(fill(x, 0, n) for x in (size, sums[2].astype(np.int64))),
                        *(fill(x, 0, n, np.float64) for x in (sums[1], sums[0])),
                        *(fill(x, n, k1) for x in (a1, n1)),
                        *(fill(x, k1, k2) for x in pairs),
                    ],
                    names=names,
                )
                row += n

    shape = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, h long, n long, x long, y long, hx long, hy long, m long"
    names = [x.split()[0] for x in shape.split(", ")]
    sums_of = ["n_tokens", "n_known", "base_score", "score"]
    rows = docs.mapInArrow(lean(score), shape)
    if whole:
        return _named(rows.where("n_tokens IS NOT NULL"), n_tokens)
    rows = stage(rows, "scores")
    rest = vocabulary.where(~in_head)
    ones = rows.where("n IS NOT NULL").select("row", "h", "n").join(rest.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    base = F.col("n") * F.log10((F.col("c") + 1) / F.lit(below))
    ones = ones.select("row", F.lit(0).alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), base.alias("base_score"), base.alias("score"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy().view(np.uint64) for k in ("x", "y"))
            own_c, own_s = find(head.value, x)
            own_y = find(head.value, y)[0]
            # a word is in the head or in the join, never in both
            c, s, c_after = (batch.column(k).to_numpy() for k in ("c_before", "s_before", "c"))
            c, s = own_c + c, own_s + s
            lp = shared.value.smoothed(shared.value.probed(x, y, s), c, s, own_y + c_after)
            lp -= np.where(own_y > 0, 0, np.log10(shared.value.base(c_after)))  # which the word's own row brings
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lp * batch.column("m").to_numpy())], names=["row", "score"])

    pairs = rows.where("m IS NOT NULL").select("row", "x", "y", "hx", "hy", "m").join(rest.select(F.col("h").alias("hy"), "c"), "hy", "left")
    pairs = pairs.join(rest.select(F.col("h").alias("hx"), F.col("c").alias("c_before"), F.col("s").alias("s_before")), "hx", "left")
    pairs = pairs.select("row", "x", "y", "m", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("c", "c_before")], F.coalesce("s_before", F.lit(0.0)).alias("s_before"))
    pairs = pairs.mapInArrow(lean(rare), "row long, score double").select("row", *[F.lit(0).alias(k) for k in sums_of[:3]], "score")
    out = rows.where("n_tokens IS NOT NULL").select("row", "doc_id", *sums_of).unionByName(ones, allowMissingColumns=True).unionByName(pairs, allowMissingColumns=True)
    return own.keep(_named(out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(k).alias(k) for k in sums_of]), n_tokens), rows, vocabulary)


def _named(out: DataFrame, n_tokens: int) -> DataFrame:
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _small(x: np.ndarray) -> bytes:
    """32-bit numbers, the bytes of each place together, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _large(packed: list[bytes], sizes: list[int]) -> np.ndarray:
    """The numbers of all that was packed, sizes of each, in a row."""
    planes = [np.frombuffer(pa.decompress(x, 4 * n, codec="zstd"), np.uint8).reshape(4, n) for x, n in zip(packed, sizes, strict=True)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1).T).view(np.uint32).ravel()


def _dealt(docs: DataFrame, hot, parts: int, reducers: int) -> DataFrame:
    """The bigrams of docs (text, doc_id, train), by part and in one shuffle: what the filter learns and what it is asked.

    A row has the bigrams of some texts in one part: their histories (before), how many successors each has here (run), the
    successors (high, low), in how many texts each bigram is (times), in which and how often (owner: twice the text's number
    and train; n). The texts' rows are numbered from row on, docs of them. Their ids come with one of their parts, and void
    where an id is null. Arrays are packed as bytes.
    """
    kinds = {"reducer": "int", "part": "int", "row": "long", "docs": "int"} | dict.fromkeys(("ids", "void", "before", "run", "high", "low", "times", "owner", "n"), "binary")
    schema = pa.schema([(k, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[v]) for k, v in kinds.items()])

    def packed(row: int, held: list[tuple[np.ndarray, ...]], ids: list[pa.Array]) -> pa.RecordBatch:
        b, g, o, n = map(np.concatenate, zip(*held, strict=True))
        part = shard_of(place_of(b, g, hot.value), parts)
        order = np.lexsort((g, b))
        order = order[np.argsort(part[order], kind="stable")]
        part, b, g, o, n = part[order], b[order], g[order], o[order], n[order]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (part[1:] != part[:-1])])
        head = np.flatnonzero(new)
        first = np.flatnonzero(new | np.concatenate([[True], g[1:] != g[:-1]]))
        ends = np.append(first, len(b))
        run, times = np.diff(np.append(np.searchsorted(first, head), len(first))).astype(np.uint32), np.diff(ends).astype(np.uint32)
        b, high, low = b[head], (g[first] >> np.uint64(32)).astype(np.uint8), g[first].astype(np.uint32)
        o, n = o.astype(np.uint32), n.astype(np.uint32)
        some = np.flatnonzero(np.bincount(part, minlength=parts))
        at = np.append(np.searchsorted(part, some), len(part))
        at_head, at_first = np.searchsorted(head, at), np.searchsorted(first, at)
        cut = lambda x, where: [x[lo:hi].tobytes() for lo, hi in itertools.pairwise(where)]
        small = lambda x, where: [_small(x[lo:hi]) for lo, hi in itertools.pairwise(where)]
        column = pa.concat_arrays(ids)
        blank = [None] * (len(some) - 1)
        names = [pc.fill_null(column, 0).to_numpy().tobytes(), *blank], [column.is_null().to_numpy(zero_copy_only=False).tobytes(), *blank]
        of = np.full(len(some), row), np.full(len(some), len(column))
        columns = [some * reducers // parts, some, *of, *names, cut(b, at_head), small(run, at_head), cut(high, at_first), cut(low, at_first), small(times, at_first), small(o, at), small(n, at)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple[np.ndarray, ...]] = []
        ids: list[pa.Array] = []
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False)
            for p, texts in text_pieces(batch.column(0)):
                words, b, a, owner = bigrams(texts)
                pair, n = np.unique((b * np.int64(len(words)) + a) * np.int64(len(texts)) + owner, return_counts=True)
                pair, owner = pair // len(texts), pair % len(texts)
                number = 2 * (owner + sum(map(len, ids))) + train[p][owner]
                held.append((words[pair // len(words)], gram(words[pair % len(words)]), number, n))
                ids.append(batch.column(1).slice(p.start, len(texts)))
                if sum(len(x[0]) for x in held) > HELD:
                    yield packed(row, held, ids)
                    row += sum(map(len, ids))
                    held, ids = [], []
        if held:
            yield packed(row, held, ids)

    rows = docs.select("text", "doc_id", "train").mapInArrow(lean(emit), ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return rows.repartitionById(reducers, F.col("reducer")).sortWithinPartitions("part")


@dataclass
class Part:
    """A part's distinct bigrams: histories (h, and of each bigram which), grams, counts of training rows. Each text's use of
    a bigram: which, the text's place (texts in the order of rows), how often."""

    h: np.ndarray
    of: np.ndarray
    grams: np.ndarray
    counts: np.ndarray
    which: np.ndarray
    place: np.ndarray
    n: np.ndarray
    presence: int

    @classmethod
    def of_rows(cls, rows: list[Row], presence: int) -> Part:
        join = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        large = lambda name, sizes: _large([r[name] for r in rows], sizes)
        h, code = np.unique(join("before", np.uint64), return_inverse=True)
        grams = join("high", np.uint8).astype(np.uint64) << np.uint64(32) | join("low", np.uint32)
        run = large("run", [len(r["before"]) // 8 for r in rows])
        key, back = np.unique(np.repeat(code.astype(np.uint64), run) << np.uint64(40) | grams, return_inverse=True)
        of_row = [len(r["high"]) for r in rows]
        times = large("times", of_row)
        uses = np.add.reduceat(times, np.cumsum([0, *of_row[:-1]]), dtype=np.int64).tolist()
        which, owner, n = np.repeat(back, times), large("owner", uses), large("n", uses)
        counts = np.bincount(which, n * (owner & np.uint32(1)), len(key)).astype(np.int64)
        start = np.concatenate([[0], np.cumsum([r["docs"] for r in rows])])[:-1]
        place = (owner >> np.uint32(1)) + np.repeat(start, uses)
        return cls(h, (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1), counts, which, place, n, presence)

    def probed(self, at: np.ndarray) -> np.ndarray:
        """The counts of the bigrams at those places, by probes of the part's shard."""
        if not hasattr(self, "shard"):
            seen = self.counts > 0
            data, bits = build(self._keys(seen), level(self.counts[seen]), self.presence)
            self.shard = Shards(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([bits]), self.presence)
        return value(self.shard.levels(np.zeros(len(at), np.int64), self._keys(at)))

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return mix(mix(self.h[self.of[at]]) + self.grams[at])

    def held(self, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each history, what its bigrams at those places hold as the filter answers, and their number."""
        return np.bincount(self.of[at], q, len(self.h)), np.bincount(self.of[at], minlength=len(self.h))


def _places(hot: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are hot, and where in hot."""
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    mine = np.flatnonzero(hot[at] == h) if len(hot) else np.empty(0, np.int64)
    return mine, at[mine]


def _scored_apart(docs: DataFrame, model: Model, hot_c: np.ndarray, n_texts: int, every: DataFrame, in_head: Column, presence: int, own: Scope) -> DataFrame:
    """The scores where shards are made: nothing that grows with the corpus is gathered, or shuffled twice.

    The bigrams of all texts go to their parts once, and the parts are read twice: for the discount and what hot histories
    hold, then for the scores. A part has all bigrams of its other histories, so it knows these words' counts too, and what
    each brings to its texts' base scores. A bigram's second word has its count from the broadcast head; for words outside it
    the part says what the count is put into (a + b * base), and they are joined.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    counts = every.where("c > 0").select("h", "c")
    top = counts.where(in_head).toArrow()
    names, code = np.unique(gram(np.append(top["h"].to_numpy().view(np.uint64), END)), return_inverse=True)
    # END is in the head whatever its count
    known = np.bincount(code, np.append(np.where(top["h"].to_numpy() == END.view(np.int64), 0, top["c"].to_numpy()), n_texts), len(names)).astype(np.int64)
    head = sc.broadcast((names, known))
    del top, names, code, known
    give_back()
    reducers = min(model.parts, max(REDUCERS, model.tokens // GROUP))
    hot = model.hot
    dealt = _dealt(docs, sc.broadcast(hot), model.parts, reducers).rdd  # both readings are of one shuffle

    def learnt(rows: Iterator[Row]) -> Iterator[tuple[np.ndarray, ...]]:
        once, mass, types = np.zeros(2, np.int64), np.zeros(len(hot)), np.zeros(len(hot), np.int64)
        for _, group in itertools.groupby(rows, lambda r: r["part"]):
            p = Part.of_rows(list(group), presence)
            once += [(p.counts == 1).sum(), (p.counts == 2).sum()]
            mine, at = _places(hot, p.h)
            if len(mine):
                bigram = np.flatnonzero((p.counts > 0) & np.isin(p.of, mine))
                m, t = p.held(bigram, p.probed(bigram))
                mass[at] += m[mine]
                types[at] += t[mine]
            del p
            give_back()
        yield once, mass, types

    (singles, twos), mass, types = dealt.mapPartitions(learnt).treeReduce(lambda x, y: tuple(a + b for a, b in zip(x, y, strict=True)))
    model.discount = float(singles / (singles + 2 * twos)) if singles else 0.75
    hot_s = mass - model.discount * types
    below = float(model.tokens + model.vocabulary + 1)

    def batch_of(**columns: np.ndarray | pa.Array) -> tuple[bytes]:
        batch = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return (sink.getvalue().to_pybytes(),)

    def scores(rows: Iterator[Row]) -> Iterator[tuple[bytes]]:
        sums: dict[int, np.ndarray] = {}  # by the first row of texts that came together
        for _, group in itertools.groupby(rows, lambda r: r["part"]):
            came = list(group)
            p = Part.of_rows(came, presence)
            c = np.bincount(p.of, p.counts, len(p.h))
            seen = np.flatnonzero(p.counts)
            q = np.zeros(len(p.of))
            q[seen] = p.probed(seen)
            m, t = p.held(seen, q[seen])
            s = m - model.discount * t
            mine, at = _places(hot, p.h)
            c[mine], s[mine] = hot_c[at], hot_s[at]
            q[s[p.of] <= 0] = 0
            other = np.flatnonzero((p.counts == 0) & (s[p.of] > 0))
            q[other] = p.probed(other)
            c_after = find(head.value, p.grams)[0]
            lp = model.smoothed(q, c[p.of], s[p.of], c_after)
            lost = c_after == 0
            lp[lost] = 0
            begins = p.h == BEGIN
            base, there = np.where(begins, 0, np.log10((c + 1) / below)), (c > 0) & ~begins
            total = sum(r["docs"] for r in came)
            of = p.of[p.which]
            columns = np.stack([np.bincount(p.place, p.n * x, total) for x in (1, there[of], base[of], lp[p.which])])
            start = 0
            for r in came:
                mine = columns[:, start : start + r["docs"]]
                start += r["docs"]
                sums[r["row"]] = sums[r["row"]] + mine if r["row"] in sums else mine.copy()
                if r["ids"] is not None:
                    # each text ends once
                    sums[r["row"]] += np.array([[0], [n_texts > 0], [math.log10((n_texts + 1) / below)], [0]])
                    ids = pa.array(np.frombuffer(r["ids"], np.int64), mask=np.frombuffer(r["void"], bool))
                    yield batch_of(row=r["row"] + np.arange(r["docs"]), doc_id=ids)
            use = np.flatnonzero(lost[p.which])
            if len(use):
                row = np.repeat([r["row"] for r in came], [r["docs"] for r in came]) + np.concatenate([np.arange(r["docs"]) for r in came])
                w = p.which[use]
                a, b = model.mixture(q[w], c[p.of[w]], s[p.of[w]])
                yield batch_of(row=row[p.place[use]], h=p.grams[w].astype(np.int64), a=a, b=b, n=p.n[use].astype(np.int64))
            del p, came
            give_back()
        for row, (size, there, base, score) in sums.items():
            yield batch_of(row=row + np.arange(len(size)), n_tokens=size.astype(np.int64), n_known=there.astype(np.int64), base_score=base, score=score)

    shape = {"row": "long", "doc_id": "long", "n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "h": "long", "a": "double", "b": "double", "n": "long"}
    schema = pa.schema([(k, pa.int64() if v == "long" else pa.float64()) for k, v in shape.items()])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blob in (x.as_buffer() for batch in batches for x in batch.column(0)):
            for b in pa.ipc.open_stream(blob):
                yield pa.RecordBatch.from_arrays([b.column(f.name) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in schema], schema=schema)

    blobs = spark.createDataFrame(dealt.mapPartitions(scores), "batch binary")
    rows = stage(blobs.mapInArrow(lean(opened), ", ".join(f"{k} {v}" for k, v in shape.items())), "scores")
    rest = counts.where(~in_head).groupBy(F.shiftrightunsigned("h", 24).alias("h")).agg(F.sum("c").alias("c"))
    p = F.col("a") + F.col("b") * (F.coalesce("c", F.lit(0)) + 1) / F.lit(below)
    late = rows.where("n IS NOT NULL").select("row", "h", "a", "b", "n").join(rest, "h", "left").select("row", (F.col("n") * F.log10(p)).alias("score"))
    sums_of = ["n_tokens", "n_known", "base_score", "score"]
    out = rows.where("n IS NULL").select("row", "doc_id", *sums_of).unionByName(late, allowMissingColumns=True)
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(k).alias(k) for k in sums_of])
    return own.keep(_named(out, model.tokens), rows, every)
