"""Hierarchical multi-length packing.

A document's ids (its text's, then an end id) are cut at the window length; full windows are sequences of their own and the rest is
routed to the tier of the smallest context size that holds it. Long windows are packed first: the longest piece opens a window, its
gap takes the largest pieces of shorter tiers that fit, and what is left is closed by cutting one more piece. Then each shorter tier is
packed in the same way to its own length. Every sequence is exactly full at a power of two, so nothing is padded. Sequences of a tier
are dealt into step groups of equal token counts, longest attention first and in snake order, so that steps cost about the same.

Packing is local to a task and streams: a task holds one round of documents, and pieces left over at its end become sequences of
descending powers of two. Nothing is shuffled and no two tasks share a sequence; ``sequence_id`` carries the partition number.

Null is empty: the end id alone. Repeated rows and ids are packed one by one, null ids stay null. Further columns are not read. A text
of any length is packed whole. An empty table has no sequences.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ridegauge.llm.common import give_back, raw, ready, slices, table, texts_of
from ridegauge.llm.words import WordCoder

WINDOW = 2048
SHORTEST_TIER = 256
END_ID = 1
STEP_TOKENS = 1 << 17
ROUND_TOKENS = 2_000_000

#: number of the document in the round, start, length
Piece = tuple[int, int, int]


class Pool:
    """Pieces by length; takes the largest that fits."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = sorted(pieces, key=lambda p: p[2])
        self.lengths = [p[2] for p in self.pieces]

    def __len__(self) -> int:
        return len(self.pieces)

    def take(self, most: int) -> Piece | None:
        at = bisect.bisect_right(self.lengths, most) - 1
        if at < 0:
            return None
        self.lengths.pop(at)
        return self.pieces.pop(at)

    def put(self, piece: Piece) -> None:
        at = bisect.bisect_right(self.lengths, piece[2])
        self.lengths.insert(at, piece[2])
        self.pieces.insert(at, piece)


def fill(pool: Pool, length: int) -> list[Piece]:
    """One sequence of ``length`` tokens: largest fitting pieces, then a cut piece for the rest of the gap."""
    sequence, gap = [], length
    while gap and (piece := pool.take(gap)):
        sequence.append(piece)
        gap -= piece[2]
    if gap and (piece := pool.take(1 << 62)):
        doc, start, size = piece
        sequence.append((doc, start, gap))
        pool.put((doc, start + gap, size - gap))
    return sequence


def pack_round(sizes: list[int], window: int, shortest: int, last: bool, carried: list[Piece] = ()) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Sequences (length, pieces) of one round and the pieces left for the next one; ``last`` leaves none."""
    sequences: list[tuple[int, list[Piece]]] = []
    tails: list[Piece] = list(carried)
    for doc, size in enumerate(sizes, len({c[0] for c in carried})):
        whole = size // window
        sequences += [(window, [(doc, i * window, window)]) for i in range(whole)]
        if size % window:
            tails.append((doc, whole * window, size % window))
    tier, pool, left = window, Pool(tails), sum(p[2] for p in tails)
    while tier >= shortest:
        # A piece that needs this tier opens a window; all shorter ones may fill its gap.
        while left >= tier and (tier == shortest or pool.lengths[-1] > tier // 2):
            sequences.append((tier, fill(pool, tier)))
            left -= tier
        tier //= 2
    if last:
        while left:
            part = min(window, 1 << (left.bit_length() - 1))
            sequences.append((part, fill(pool, part)))
            left -= part
    return sequences, pool.pieces


def step_groups(sequences: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A group number within the tier for each sequence: equal token counts, attention cost dealt in snake order."""
    groups = [0] * len(sequences)
    for tier in {n for n, _ in sequences}:
        own = [i for i, (n, _) in enumerate(sequences) if n == tier]
        own.sort(key=lambda i: (-sum(p[2] ** 2 for p in sequences[i][1]), i))
        steps = max(1, -(-len(own) * tier // step_tokens))
        for rank, i in enumerate(own):
            turn, at = divmod(rank, steps)
            groups[i] = at if turn % 2 == 0 else steps - 1 - at
    return groups


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shortest: int = SHORTEST_TIER, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """One row per piece: where it is in its document and in its sequence."""
    if window & (window - 1) or shortest & (shortest - 1) or shortest > window:
        raise ValueError("window and shortest tier are powers of two")
    ready(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(
        f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length int, step_group string"
    )
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = WordCoder(tokenizer), TaskContext.get().partitionId()
        names: list = []
        ids: list[np.ndarray] = []
        carried: list[Piece] = []
        held = done = rounds = old = 0

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal names, ids, carried, held, done, rounds, old
            sequences, left = pack_round([len(x) for x in ids[old:]], window, shortest, last, carried)
            cols: list[list] = [[] for _ in target]
            for (size, pieces), group in zip(sequences, step_groups(sequences, step_tokens), strict=True):
                offset, number, step = 0, (part << 32) + done, f"{part}-{rounds}-{size}-{group}"
                done += 1
                for doc, start, length in pieces:
                    crc = zlib.crc32(ids[doc][start : start + length].tobytes())
                    for c, v in zip(cols, (names[doc], start, length, crc, len(ids[doc]), number, offset, size, step), strict=True):
                        c.append(v)
                    offset += length
            keep = sorted({p[0] for p in left})
            at = {d: i for i, d in enumerate(keep)}
            carried = [(at[d], s, n) for d, s, n in left]
            names, ids, old = [names[d] for d in keep], [ids[d] for d in keep], len(keep)
            held, rounds = 0, rounds + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

        for batch in slices(batches):
            coded = coder.codes([raw(t) for t in texts_of(batch)])
            names += batch.column(0).to_pylist()
            for c in coded:
                ids.append(np.append(coder.ids_of(c), np.uint32(end_id)).astype("<u4"))
                held += len(ids[-1])
            if held >= round_tokens:
                yield packed(last=False)
                give_back()
        yield packed(last=True)
        batch = coded = c = coder = names = ids = carried = None
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
