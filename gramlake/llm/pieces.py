"""SentencePiece encoding with offsets, and decoding: normalisation by the model's compiled character map, with alignment."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from gramlake.llm.runtime import lean, small_batches
from gramlake.llm.text import text_pieces

SPACE = "▁"
#: Units whose ids a worker remembers; when full, it starts again.
MEMORY = 100_000


class CharsMap:
    """Longest-prefix replacement by a compiled character map: a double-array trie, and zero-ended replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def match(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes of the longest prefix of text[at:] in the map, its replacement)."""
        if not self.units:
            return None
        node, found = 0, None
        unit = self.units[0]
        node ^= unit >> 10 << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Pieces:
    """A SentencePiece model: normalised text with its alignment, ids, spans in the original bytes, and decoded text."""

    #: User-defined pieces, which no map changes, and whether the added space comes last.
    own: re.Pattern[bytes] | None = None
    suffix = False

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        kinds = list(proto.pieces)
        self.names = [p.piece for p in proto.pieces]
        self.byte = {i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        # words can be encoded apart if no piece holds a space after another character
        apart = all(SPACE not in n.lstrip(SPACE) for n in self.names) and not proto.trainer_spec.treat_whitespace_as_suffix
        own = sorted((p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, own))) if own else None
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.by_unit = apart and self.escape and self.own is None
        # the same pieces without a normaliser: it takes normalised text
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.sizes = np.array([1 if i in self.byte else len(n.encode()) for i, n in enumerate(self.names)], np.int64)
        self.is_byte = np.array([p.type == p.BYTE for p in kinds])
        self.returns = np.array([p.type in (p.NORMAL, p.BYTE) for p in kinds])
        # what each id stands for in a decoded text, in a row; control and unknown pieces for nothing
        means = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace(SPACE, " ").encode() if p.type in (p.NORMAL, p.USER_DEFINED) else b"" for p in kinds]
        self.stands = np.frombuffer(b"".join(means), np.uint8)
        self.stands_at = np.concatenate([[0], np.cumsum([len(m) for m in means], dtype=np.int64)])
        #: With an empty map and no trimming a text's characters stand for themselves: whole batches are aligned at once.
        self.plain = self.by_unit and not (self.map.units or self.trim or self.suffix)
        self.forget()

    def forget(self) -> None:
        """Units by number: their ids and spans (in bytes of the unit) in a row, and whether decoding gives them back."""
        self.memory: dict[bytes, int] = {}
        self.flat = [array("I"), array("I"), array("I")]  # ids, where each starts and ends
        self.first, self.whole = array("q", [0]), array("b")

    def normalise(self, text: str) -> tuple[bytes, list[int] | np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the place in text's bytes that it comes from."""
        raw = text.encode()
        if self.map.units or self.trim or self.own or self.suffix or not self.escape:
            return self._walked(raw)
        # an empty map replaces nothing: each character stands for itself, a space for its mark
        if not raw:
            return b"", np.zeros(1, np.int64)
        units = np.frombuffer(raw, np.uint8)
        starts = np.maximum.accumulate(np.where((units & 0xC0) != 0x80, np.arange(len(units)), 0))
        at = np.repeat(starts, np.where(units == 32, len(SPACE.encode()), 1))
        head = SPACE.encode() * bool(self.prefix)
        return head + raw.replace(b" ", SPACE.encode()), np.concatenate([np.zeros(len(head), np.int64), at, [len(raw)]])

    def _walked(self, raw: bytes) -> tuple[bytes, list[int]]:
        """The walk over the map: at each place the longest prefix in it, or one character."""
        out, at = bytearray(), []
        space = SPACE.encode() if self.escape else b" "

        def put(data: bytes, source: int) -> None:
            out.extend(data)
            at.extend([source] * len(data))

        k = 0
        steps = []  # (start, end, replacement)
        while k < len(raw):
            own = self.own.match(raw, k) if self.own else None
            hit = (len(own[0]), own[0]) if own else self.map.match(raw, k)
            n = hit[0] if hit else 1 + (raw[k] >= 0xC0) + (raw[k] >= 0xE0) + (raw[k] >= 0xF0)
            steps.append((k, k + n, hit[1] if hit else raw[k : k + n]))
            k += n
        if self.trim:
            while steps and steps[0][2].strip(b" ") == b"":
                steps.pop(0)
        if not steps:
            return b"", [0]
        if self.prefix and not self.suffix:
            put(space, steps[0][0])
        gap = self.trim
        stop = steps[-1][1]
        for start, end, data in steps:
            if self.trim and gap:
                data = data.lstrip(b" ")
            for j in range(len(data)):
                put(space if data[j : j + 1] == b" " else data[j : j + 1], start)
            if data:
                gap = self.trim and data.endswith(b" ")
                stop = end
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :]
                stop = at[-len(space)]
                del at[-len(space) :]
        if self.prefix and self.suffix:
            put(space, stop)
        return bytes(out), [*at, stop]

    def aligned(self, texts: list[str]) -> list[tuple[list[int], bytes, list[int] | np.ndarray]]:
        """Of each text: ids with the begin and end ids, those of its normalised bytes; these bytes, and their alignment."""
        norms = [self.normalise(t) for t in texts]
        got = self.inner.encode([n.decode() for n, _ in norms])
        return [([self.begin, *ids, self.end], *norm) for ids, norm in zip(got, norms, strict=True)]

    def known(self, units: list[bytes]) -> list[int]:
        """Numbers of distinct units; new ones are encoded and remembered."""
        if len(self.memory) + len(units) > MEMORY:
            self.forget()
        fresh = [u for u in units if u not in self.memory]
        if fresh:
            every = self.inner.encode([u.decode() for u in fresh])
            per = np.array([len(x) for x in every], np.int64)
            ids = np.fromiter(chain.from_iterable(every), np.int64, per.sum())
            till = np.concatenate([[0], np.cumsum(per)])
            length = np.array([len(u) for u in fresh], np.int64)
            starts = np.cumsum(length) - length
            size = self.sizes[ids]
            sums = np.concatenate([[0], np.cumsum(size)])
            hi = sums[1:] - np.repeat(sums[till[:-1]], per)
            lo = hi - size
            single = np.flatnonzero(self.is_byte[ids])
            if len(single):  # a piece that stands for one byte of a character has that character's span
                base = np.repeat(starts, per)[single]
                norm = np.frombuffer(b"".join(fresh), np.uint8)
                heads = np.append(np.flatnonzero((norm & 0xC0) != 0x80), len(norm))
                k = np.minimum(np.searchsorted(heads, base + lo[single], "right"), len(heads) - 1)
                lo[single], hi[single] = heads[k - 1] - base, heads[k] - base
            for k in np.flatnonzero(sums[till[1:]] - sums[till[:-1]] != length):  # unknown pieces
                lo[till[k] : till[k + 1]], hi[till[k] : till[k + 1]] = self.within(every[k], fresh[k])
            for store, x in zip(self.flat, (ids, lo, hi), strict=True):
                store.frombytes(x.astype(np.uint32).tobytes())
            self.first.frombytes((till[1:] + self.first[-1]).tobytes())
            # ordinary pieces and the bytes of whole characters decode to what they were
            odd = np.concatenate([[0], np.cumsum(~self.returns[ids])])
            self.memory.update(zip(fresh, range(len(self.whole), len(self.whole) + len(fresh)), strict=True))
            self.whole.frombytes((odd[till[1:]] == odd[till[:-1]]).astype(np.int8).tobytes())
        return [self.memory[u] for u in units]

    def within(self, ids: list[int], norm: bytes) -> tuple[list[int], list[int]]:
        """Where each piece starts and ends in the bytes norm. A piece that stands for one byte of a character has that
        character's span."""
        size = self.sizes[np.array(ids, np.int64)]
        if size.sum() != len(norm):  # an unknown piece is as long as what it stands for
            found = self.inner.encode(norm.decode(), return_type="proto").pieces
            size = np.array([1 if p.id in self.byte else len(p.surface.encode()) for p in found], np.int64)
        hi = np.cumsum(size)
        lo = hi - size
        single = [i in self.byte for i in ids]
        if any(single):
            heads = np.append(np.flatnonzero((np.frombuffer(norm, np.uint8) & 0xC0) != 0x80), len(norm))
            k = np.searchsorted(heads, lo[single], "right")
            lo[single], hi[single] = heads[k - 1], heads[k]
        return lo.tolist(), hi.tolist()

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(ids, bounds, spans, decoded) of texts in UTF-8: the ids of all in a row with begin and end ids, where each text's
        start (one more at the end), (start, end) of every id in its text's bytes, and the decoded texts.

        spans of the begin and end ids are empty, at the text's ends.
        """
        if not self.plain:
            found = [(*x, *self.spanned(*x)) for x in self.aligned([t.decode() for t in texts])]
            bounds = np.cumsum([0, *(len(x[0]) for x in found)])
            ends = [np.stack([np.concatenate([[0], x[3], [len(t)]]), np.concatenate([[0], x[4], [len(t)]])], 1) for x, t in zip(found, texts, strict=True)]
            ids = np.concatenate([np.empty(0, np.uint32), *(np.array(x[0], np.uint32) for x in found)])
            return ids, bounds, np.concatenate([np.empty((0, 2), np.int32), *ends]).astype(np.int32), [self.decode(x[0]).encode() for x in found]
        n, mark = len(texts), SPACE.encode()
        size = np.array([len(t) for t in texts], np.int64)
        # per text: the prefix, its bytes, and its end; each stands in the normal form so many times, and comes from there
        raw = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum(size + 2)])
        own = np.ones(at[-1], bool)
        own[at[:-1]] = own[at[1:] - 1] = False
        wide, source = np.ones(at[-1], np.int8), np.empty(at[-1], np.int32)
        wide[own] = np.where(raw == 32, len(mark), 1)
        wide[at[:-1]] = len(mark) * bool(self.prefix) * (size > 0)
        begins = np.concatenate([[0], np.cumsum(size)])
        heads = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(len(raw), dtype=np.int32), 0)) if len(raw) else np.empty(0, np.int32)
        source[own] = heads - np.repeat(begins[:-1], size)
        source[at[:-1]], source[at[1:] - 1] = 0, size
        source = np.repeat(source, wide)
        norms = [mark * bool(self.prefix and t) + t.replace(b" ", mark) for t in texts]
        lengths = np.array([len(x) for x in norms], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        norm = np.frombuffer(b"".join(norms), np.uint8)
        # a unit starts with a text, and with each mark that follows no mark
        is_mark = np.zeros(len(norm) + 3, bool)
        is_mark[3 : len(norm) + 1] = (norm[:-2] == mark[0]) & (norm[1:-1] == mark[1]) & (norm[2:] == mark[2]) if len(norm) > 2 else False
        cut = is_mark[3:] & ~is_mark[:-3]
        cut[starts[:-1][lengths > 0]] = True
        unit = np.flatnonzero(cut)
        if len(unit):
            edges = np.append(unit, len(norm)).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(unit), [None, pa.py_buffer(edges), pa.py_buffer(norm)]).dictionary_encode()
            number = np.array(self.known(coded.dictionary.to_pylist()), np.int64)[coded.indices.to_numpy()]
        else:
            number = np.empty(0, np.int64)
        first = np.frombuffer(self.first, np.int64).copy()
        per = (first[1:] - first[:-1])[number]
        till = np.concatenate([[0], np.cumsum(per)])
        take = np.repeat(first[number] - till[:-1], per) + np.arange(till[-1])
        flat = [np.frombuffer(x, np.uint32)[take] if len(x) else np.empty(0, np.uint32) for x in self.flat]
        # unit k's text, and the places of its ids among all, with a begin id before and an end id after each text's
        owner = np.searchsorted(starts, unit, "right") - 1
        bounds = np.concatenate([[0], till[np.searchsorted(unit, starts[1:])]]) + 2 * np.arange(n + 1)
        inner = np.ones(bounds[-1], bool)
        inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
        ids, spans = np.empty(bounds[-1], np.uint32), np.empty((bounds[-1], 2), np.int32)
        ids[inner] = flat[0]
        ids[bounds[:-1]], ids[bounds[1:] - 1] = self.begin, self.end
        base = np.repeat(unit + owner, per)  # each text's alignment has one more entry, its end
        for k in (0, 1):
            spans[inner, k] = source[base + flat[k + 1]]
        spans[bounds[:-1]], spans[bounds[1:] - 1] = 0, size[:, None]
        odd = np.unique(owner[np.frombuffer(self.whole, np.int8)[number] == 0]) if len(number) else []
        decoded = self.joined(ids, bounds)
        for k in odd:
            decoded[k] = self.decode(ids[bounds[k] : bounds[k + 1]].tolist()).encode()
        return ids, bounds, spans, decoded

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The decoded text of each run of ids, from what each id stands for, without the space that the prefix added. Ids of
        unknown pieces, and bytes that make no character, are not for it: `decode` knows what they become."""
        per = self.stands_at[ids + 1] - self.stands_at[ids]
        till = np.concatenate([[0], np.cumsum(per)])
        data = self.stands[np.repeat(self.stands_at[ids] - till[:-1], per) + np.arange(till[-1])].tobytes()
        cuts = till[bounds].tolist()
        skip = 1 if self.prefix else 0
        return [data[a + skip if data[a : a + 1] == b" " else a : b] if b > a else b"" for a, b in zip(cuts, cuts[1:], strict=False)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, with the begin and end ids."""
        return [x[0] for x in self.aligned(texts)]

    def spanned(self, ids: list[int], norm: bytes, at: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece but the begin and end ids starts and ends in the text's bytes."""
        lo, hi = self.within(ids[1:-1], norm)
        at = np.asarray(at, np.int64)
        return at[np.array(lo, np.int64)], at[np.array(hi, np.int64)]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each piece: its span in the bytes of the text, by the alignment of the normalisation.

        A piece that stands for one byte of a character has that character's span. An added space has an empty span.
        """
        (found,) = self.aligned([text])
        lo, hi = self.spanned(*found)
        return list(zip(found[0][1:-1], lo.tolist(), hi.tolist(), strict=True))

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def load(model: bytes) -> Pieces:
    """One model a worker, kept between tasks."""
    return Pieces(model)


def encoded(docs: DataFrame, model: str, with_ids: bool = False, with_spans: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256[, ids][, spans]) of each row of docs (doc_id, text, any
    other columns).

    Texts are normalised with alignment, ids are those of the normalised text, and every piece is projected to its span in
    the bytes of the text. spans: (id, start, end) of each piece but the begin and end ids. spans_sha256: of (start, end) of
    every id, the empty ones of the begin and end ids included, as little-endian 32-bit integers.

    model: path of a SentencePiece model on the driver; its bytes go to the workers. Null and empty texts give the begin and
    end ids alone and decode to ''. Null doc_ids stay null; repeated rows are encoded each. An empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    with open(model, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = load(held.value)
        for batch in batches:
            for p, texts in text_pieces(batch.column(1)):
                ids, bounds, spans, decoded = tool.batch([t or b"" for t in texts])
                cuts = list(zip(bounds.tolist(), bounds[1:].tolist(), strict=False))
                digest = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
                columns = [
                    batch.column(0).slice(p.start, p.stop - p.start),
                    pa.array(np.diff(bounds)),
                    digest(ids[a:b] for a, b in cuts),
                    digest(decoded),
                    digest(spans[a:b] for a, b in cuts),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("ids")
                if with_spans:
                    inner = np.ones(len(ids), bool)
                    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
                    cells = pa.StructArray.from_arrays([pa.array(x) for x in (ids[inner].view(np.int32), spans[inner, 0], spans[inner, 1])], names=["id", "start", "end"])
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds - 2 * np.arange(len(bounds)), pa.int32()), cells))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(lean(run), shape + ", ids array<int>" * with_ids + ", spans array<struct<id int, start int, end int>>" * with_spans)
