"""Token counts under a unigram vocabulary: Aho-Corasick matches, and a count-only Viterbi walk over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from gramlake.llm.runtime import lean, small_batches

SPACE = "▁"
#: Units whose counts a worker remembers; when full, it starts again.
MEMORY = 400_000
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
_UNIT = re.compile(f"{SPACE}[^{SPACE}]*")


class Counter:
    """Counts tokens as a unigram tokenizer does that splits before each space.

    Of all segmentations into pieces the one with the best sum of scores counts. Sums are doubles; at a tie the path whose
    last piece starts first stays. A character that no one-character piece matches may be taken as unknown, at the lowest
    score less UNKNOWN_PENALTY; in the end each byte of it is a token.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        for name, score in pieces:
            self.machine.add_word(name, (len(name), score))
        self.machine.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.memory: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Tokens of one unit: best score and count are carried from the ends of pieces, back pointers are not."""
        n = len(text)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        for last, (length, score) in self.machine.iter(text):
            start = last + 1 - length
            matches[last + 1].append((start, score))
            if length == 1:
                single[start] = True
        for end in range(1, n + 1):
            found = matches[end]
            if not single[end - 1]:
                found.append((end - 1, None))
            found.sort(key=lambda m: m[0])
            top = None
            for start, score in found:
                before = best[start]
                if before is None:
                    continue
                total = before + (self.unknown if score is None else score)
                if top is None or total > top:
                    top, came = total, start
                    more = 1 if score is not None else len(text[start].encode())
            if top is not None:
                best[end], count[end] = top, count[came] + more
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        units = _UNIT.findall(SPACE + text.replace(" ", SPACE) if not text.startswith((" ", SPACE)) else text.replace(" ", SPACE))
        memory, total = self.memory, 0
        for u in units:
            n = memory.get(u)
            if n is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                n = memory[u] = self.unit(u)
            total += n
        return total


@lru_cache(maxsize=2)
def load(model: bytes) -> Counter:
    """The ordinary pieces of a SentencePiece model, with their scores, as a unigram vocabulary."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return Counter([(p.piece, p.score) for p in proto.pieces if p.type == p.NORMAL])


def counted(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens) of each row of docs (doc_id, text, any other columns), over whole texts.

    model: path of a SentencePiece model on the driver; its bytes go to the workers. Null and empty texts have no tokens. Null doc_ids stay null; repeated rows are counted each. An empty table gives an
    empty result. Other columns, whatever their names, are not read.
    """

    small_batches(docs.sparkSession)
    with open(model, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = load(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long")
