"""Alignment of two tokenizers' tokens on the bytes of a text, and how often their ids meet in a corpus.

A is a byte-level tokenizer over a space and the text, B a piece model over the text, which puts that space itself. Both encode the whole
text. Where tokens of both end at the same byte the text is cut into groups; an A and a B token whose bytes overlap are linked.

1. Ends of both are running sums of token lengths. A shared end before a token that both mark with a space is an anchor; anchors cut a document
   into windows, each a tuple of A ids and a tuple of B ids. Lone spaces always are anchors where the joined bytes of both are those of
   the text, which is verified for each run between them, so anchors are looked for once in each distinct run.
2. Each distinct window of a block is aligned once: groups, links, and the text of its groups. Documents only look their windows up.
3. A block of documents (``BLOCK_BYTES`` of text) lists its distinct id pairs with the number of documents that link them. Sums over all
   blocks give each pair's count and each A id's highest; blocks get the counts of their own pairs back, so documents meet them
   without a row a link: what is shuffled is a list of distinct pairs a block.

Null and empty texts, and texts whose bytes the tokens don't give back (U+2581 reads as a space in B), have no tokens: zeros and ''. Special tokens'
strings are plain text. Repeated rows count as documents of their own. Further columns pass through :func:`align` (one that has the name
of a new column is replaced) and are not read elsewhere. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ridegauge.llm.common import add_columns, materialize, raw, ready, slices, table, texts_of
from ridegauge.llm.exchange import pack_numbers, unpack_numbers
from ridegauge.llm.pieces import MEMO_BYTES, ByteRunCoder
from ridegauge.llm.words import MEMO_WORDS, _Numbers

BLOCK_BYTES = 32 << 20
BLOCK_PAIRS = 1 << 21
SPACE = "▁"


class Ragged:
    """Lists of numbers, one after the other; several columns may share the sizes."""

    def __init__(self, columns: int):
        self.size = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.values = [np.zeros(0, np.int64) for _ in range(columns)]

    def append(self, sizes: np.ndarray, *values: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        self.start = np.concatenate((self.start, len(self.values[0]) + ends - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.values = [np.concatenate(v) for v in zip(self.values, values, strict=True)]

    def at(self, codes: np.ndarray) -> np.ndarray:
        """Positions of the values of these lists, in order."""
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[codes] - ends + sizes, sizes)


class Aligner(ByteRunCoder):
    """Ids of both tokenizers, and windows, for whole texts. Each distinct run between lone spaces is encoded once; a run's windows are
    aligned once for each tuple of ids. Pairs of ids are numbered in the order in which they first occur. All of it is kept until
    :meth:`forget`, which the caller calls between batches when :attr:`full` says so."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(a_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else raw(p.replace(SPACE, " ")) for i, p in zip(ids, pieces, strict=True)]
        self.b_length = np.array([len(b) for b in self.b_bytes], np.int64)
        self.b_space = np.array([b[:1] == b" " for b in self.b_bytes])
        self.b_text = [str(i) for i in ids]
        super().__init__(tokenizer)
        self.a_space = np.array([b[:1] == b" " for b in self.bytes_of])
        self.a_text = [str(i) for i in range(len(self.bytes_of))]
        # Pieces that hold a space behind another character could reach over the cuts between runs.
        self.by_run &= not any(b" " in b.lstrip(b" ") for b in self.b_bytes)

    def forget(self) -> None:
        super().forget()
        self.b_ids, self.windows = Ragged(1), Ragged(1)
        self.good = np.zeros(0, bool)
        self.window_number = _Numbers()
        self.groups, self.links = Ragged(2), Ragged(1)
        self.texts: list[str] = []
        self.pair_number: dict[int, int] = {}

    @property
    def full(self) -> bool:
        return self.words > MEMO_WORDS or self.held > MEMO_BYTES or len(self.pair_number) > BLOCK_PAIRS

    def begin(self) -> bool:
        return False

    def _verified(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, new: list[bytes]) -> np.ndarray:
        """Whether both tokenizers give back a run's bytes."""
        same = np.ones(len(new), bool)
        wanted, lengths = b"".join(new), np.array([len(r) for r in new], np.int64)
        for ids, size, length, bytes_of in ((a, a_size, self.length, self.bytes_of), (b, b_size, self.b_length, self.b_bytes)):
            owner = np.repeat(np.arange(len(new)), size)
            if np.array_equal(np.bincount(owner, length[ids], len(new)).astype(np.int64), lengths) and b"".join([bytes_of[i] for i in ids.tolist()]) == wanted:
                continue
            stops = np.cumsum(size).tolist()
            for k, (p, q) in enumerate(zip([0, *stops], stops, strict=False)):
                same[k] &= b"".join([bytes_of[i] for i in ids[p:q].tolist()]) == new[k]
        return same

    def _learn(self) -> None:
        new = list(self.number.new)
        first = self.words
        super()._learn()
        codes = np.arange(first, self.words)
        a, a_size = self.ids_of(codes).astype(np.int64), self.size[codes]
        # The model puts the first space itself, but not before nothing.
        lists = [b or [self.model.piece_to_id(SPACE)] for b in self.model.encode([r[1:] for r in new], num_threads=1)]
        b, b_size = np.array([i for some in lists for i in some], np.int64), np.array([len(some) for some in lists], np.int64)
        self.b_ids.append(b_size, b)
        same = self._verified(a, a_size, b, b_size, [raw(r) for r in new])
        self.good = np.concatenate((self.good, same))
        if not same.all():
            a, b = a[np.repeat(same, a_size)], b[np.repeat(same, b_size)]
            a_size, b_size = np.where(same, a_size, 0), np.where(same, b_size, 0)
        self._cut(a, b, a_size)

    def _cut(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray) -> None:
        """Windows of new runs, whose tokens stand one behind the other: between two anchors, or an anchor and the end of a run."""
        run_stop = np.cumsum(a_size)
        a_ends, b_ends = np.cumsum(self.length[a]), np.cumsum(self.b_length[b])
        at_b = np.searchsorted(b_ends, a_ends)
        shared = b_ends[at_b] == a_ends  # both reach the last byte, so there is an end at or behind each
        i, j = np.flatnonzero(shared) + 1, at_b[shared] + 1
        anchor = (self.a_space[a[np.minimum(i, len(a) - 1)]] & self.b_space[b[np.minimum(j, len(b) - 1)]]) | np.isin(i, run_stop) if len(a) else np.zeros(0, bool)
        i, j = i[anchor], j[anchor]
        a_bytes, b_bytes = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        p, q = (4 * i).tolist(), (4 * j).tolist()
        number = self.window_number
        codes = [number[a_bytes[k:m], b_bytes[n:o]] for k, m, n, o in zip([0, *p], p, [0, *q], q, strict=False)]
        self.windows.append(np.diff(np.searchsorted(i, run_stop, "right"), prepend=0), np.array(codes, np.int64))
        if number.new:
            self._align()

    def _align(self) -> None:
        new, self.window_number.new = self.window_number.new, []
        a = np.frombuffer(b"".join([w[0] for w in new]), "<u4").astype(np.int64)
        b = np.frombuffer(b"".join([w[1] for w in new]), "<u4").astype(np.int64)
        a_stop = np.cumsum([len(w[0]) // 4 for w in new])
        a_ends, b_ends = np.cumsum(self.length[a]), np.cumsum(self.b_length[b])
        # Between two neighbouring ends of either kind lies one link: of the A and the B token that hold those bytes.
        ends = np.union1d(a_ends, b_ends)
        of_a, of_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        keys, inverse = np.unique(a[of_a] << 32 | b[of_b], return_inverse=True)
        known = self.pair_number
        numbers = np.array([known.setdefault(k, len(known)) for k in keys.tolist()], np.int64)
        self.links.append(np.diff(np.searchsorted(of_a, a_stop), prepend=0), numbers[inverse])
        shared = a_ends[of_a] == b_ends[of_b]
        i, j = of_a[shared] + 1, of_b[shared] + 1
        group_stop = np.searchsorted(i, a_stop) + 1
        self.groups.append(np.diff(group_stop, prepend=0), np.diff(i, prepend=0), np.diff(j, prepend=0))
        a_text, b_text = self.a_text, self.b_text
        a_list, b_list = [a_text[k] for k in a.tolist()], [b_text[k] for k in b.tolist()]
        i, j = [0, *i.tolist()], [0, *j.tolist()]
        written = [
            f"{a_list[p]}|{b_list[r]}" if q - p == s - r == 1 else f"{','.join(a_list[p:q])}|{','.join(b_list[r:s])}"
            for p, q, r, s in zip(i, i[1:], j, j[1:], strict=False)
        ]
        stops = [0, *group_stop.tolist()]
        self.texts += [";".join(written[p:q]) for p, q in zip(stops, stops[1:], strict=False)]

    def both(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids of A, the ids of B and its windows; none if there is no text or the bytes differ."""
        none = np.zeros(0, np.int64)
        out = []
        for codes in self.codes([" " + t if t else "" for t in texts]):
            c = np.array(codes, np.int64)
            if not len(c) or not self.good[c].all():
                out.append((none, none, none))
            else:
                out.append((self.ids_of(c).astype(np.int64), self.b_ids.values[0][self.b_ids.at(c)], self.windows.values[0][self.windows.at(c)]))
        return out

    def digest(self, windows: np.ndarray) -> str:
        if not len(windows):
            return ""
        texts = self.texts
        return hashlib.sha256(";".join([texts[w] for w in windows.tolist()]).encode()).hexdigest()


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs`` with the ids of both tokenizers and, for each group, how many tokens of A and of B it holds."""
    ready(docs.sparkSession)
    made: list[Aligner] = []

    def run(texts):
        if not made:
            made.append(Aligner(a_path, b_path))
        aligner = made[0]
        if aligner.full:
            aligner.forget()
        found = aligner.both(texts)
        spots = [aligner.groups.at(w) for _, _, w in found]
        return [a for a, _, _ in found], [b for _, b, _ in found], *[[aligner.groups.values[k][s] for s in spots] for k in (0, 1)]

    return add_columns(docs, "a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>", run)


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (with their links as numbers of the block's pairs) and of blocks (their pairs, documents that hold each)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = f"block bigint, doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, pairs array<bigint>, held array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        block, size, held = TaskContext.get().partitionId() << 24, 0, np.zeros(0, np.int64)

        def close() -> pa.RecordBatch:
            nothing = [None]
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.nulls(1, id_kind), *[pa.array(nothing, pa.int64())] * 4, pa.array(nothing, pa.string()), pa.array(nothing, pa.binary()),
                 pa.array([list(aligner.pair_number)], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64()))], names=names)

        names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "held"]
        id_kind = pa.int64()
        for batch in slices(batches):
            id_kind = batch.schema.field(0).type
            texts = texts_of(batch)
            made = aligner.both(texts)
            held = np.concatenate((held, np.zeros(len(aligner.pair_number) - len(held), np.int64)))
            links, n_links = [], []
            for _, _, windows in made:
                found, times = np.unique(aligner.links.values[0][aligner.links.at(windows)], return_counts=True)
                held[found] += 1
                n_links.append(int(times.sum()))
                links.append(pack_numbers(np.concatenate((np.diff(found, prepend=0), times)).astype(np.uint32)) if len(found) else None)
            counts = [[len(a) for a, _, _ in made], [len(b) for _, b, _ in made], [int(aligner.groups.size[w].sum()) for _, _, w in made], n_links]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(texts), pa.int64()), batch.column(0), *[pa.array(n, pa.int64()) for n in counts], pa.array([aligner.digest(w) for _, _, w in made], pa.string()),
                 pa.array(links, pa.binary()), pa.nulls(len(texts), pa.list_(pa.int64())), pa.nulls(len(texts), pa.list_(pa.int64()))], names=names)
            size += sum(len(t or "") for t in texts)
            if size > BLOCK_BYTES or aligner.full:
                yield close()
                aligner.forget()
                block, size, held = block + 1, 0, np.zeros(0, np.int64)
        if len(held):
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def _counts(asked: DataFrame) -> DataFrame:
    held = asked.groupBy("pair").agg(F.sum("held").alias("docs"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return held.select("pair", "docs", (F.col("docs") == F.max("docs").over(of_a)).alias("best"))


def _asked(blocks: DataFrame) -> DataFrame:
    lists = blocks.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "of"))
    return lists.select("block", "at", F.col("of.pairs").alias("pair"), F.col("of.held").alias("held")).filter("held > 0")  # runs of texts without tokens may bring others


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, docs (documents that hold the pair linked), best (no pair of this A id has more)."""
    ready(docs.sparkSession)
    found = _counts(_asked(materialize(_blocks(docs, a_path, b_path))))
    return found.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "docs", "best")


def _meet(documents: pa.Table, answers: pa.Table) -> pa.Table:
    at = answers["at"].to_numpy()
    docs, best = np.zeros((2, int(at.max(initial=-1)) + 1), np.int64)
    docs[at], best[at] = answers["docs"].to_numpy(), answers["best"].to_numpy().astype(np.int64)
    n_best, total = [], []
    for packed in documents["links"].to_pylist():
        gaps, times = np.split(unpack_numbers(packed, np.uint32).astype(np.int64), 2) if packed else (np.zeros(0, np.int64),) * 2
        found = np.cumsum(gaps)
        n_best.append(int((best[found] * times).sum()))
        total.append(int((docs[found] * times).sum()))
    out = documents.drop_columns(["block", "links"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for every row of ``docs``."""
    ready(docs.sparkSession)
    blocks = materialize(_blocks(docs, a_path, b_path))
    asked = _asked(blocks)
    answers = asked.join(_counts(asked), "pair").select(F.col("block").alias("of_block"), F.col("at").cast("long").alias("at"), "docs", "best")
    documents = blocks.filter("pairs IS NULL").drop("pairs", "held")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return documents.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_meet, fields)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
