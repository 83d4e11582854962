"""LM scoring by prediction by partial matching (PPM) over bytes, next to a smoothed word-unigram base score.

The byte-context trie has all contexts of up to three bytes of all training texts. A byte is coded in its longest context; if it was
never seen there, the escape probability (method C: distinct symbols over occurrences plus distinct symbols) leads to the context
without its first byte, where symbols seen in the longer one are excluded; below the empty context the remaining symbols are equally
likely. A text starts behind three bytes 0xFF and ends with one (0xFF never occurs in UTF-8), so its score is the log10 probability
of the whole text and its end; the model is pretrained and the same for all texts.

Documents are dealt into blocks of about ``BLOCK_BYTES`` by a hash of the id. A block sends its distinct words and four-byte grams with its training
counts, packed, to owners (words by their hash, grams by the context of two bytes, which holds that part of the trie). Owners add the
counts up and answer the same lists with the counts or log probabilities. The block then scores its texts. The table of byte pairs
(at most 65,536 numbers) is the only thing that every owner gets. The texts' shuffle serves both uses of a block.

Null and empty texts have the end token only. Held-out texts never count. Repeated rows count and are scored one by one; a null id
belongs to the held-out rows. Further columns are not read. Without training texts all bytes are equally likely.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ridegauge.llm.common import id_remainder, materialize, partitions, raw, ready, slices, table
from ridegauge.llm.exchange import pack_numbers, pack_words, unpack_numbers, unpack_words

HELD_OUT_OF = 10
BLOCK_BYTES, LEAST_BLOCK_BYTES = 12 << 20, 1 << 20
BLOCKS_AN_OWNER = 2
SYMBOLS = 256
EDGE = b"\xff\xff\xff"
SMOOTHING = 0.1
LISTS = "kind string, owner int, block int, n int, keys binary, counts binary"
ANSWERS = "block int, kind string, owner int, n int, answer binary, vocabulary bigint"


def byte_pairs(docs: DataFrame) -> tuple[np.ndarray, int, int, int]:
    """Counts of (byte, next byte) over the training texts, their tokens and number, and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, tokens, texts, size = np.zeros(1 << 16, np.int64), 0, 0, 0
        for batch in slices(batches):
            for train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = raw(text)
                size += len(data)
                if train:
                    tokens += len(data.split()) + 1
                    texts += 1
                    b = np.frombuffer(EDGE[:1] + data + EDGE[:1], np.uint8).astype(np.uint16)
                    codes = b[:-1] << 8 | b[1:]
                    if len(codes) < 4096:
                        np.add.at(pairs, codes, 1)
                    else:
                        pairs += np.bincount(codes, minlength=1 << 16)
        keys = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((keys, [-1, -2, -3]))), pa.array(np.concatenate((pairs[keys], [tokens, texts, size])))], names=["pair", "n"])

    sums = docs.select("train", "text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    found = {r["pair"]: r["n"] for r in sums.collect()}  # at most 65,536 pairs and three sums
    table_ = np.zeros(1 << 16, np.int64)
    for pair, n in found.items():
        if pair >= 0:
            table_[pair] = n
    return table_.reshape(SYMBOLS, SYMBOLS), found.get(-1, 0), found.get(-2, 0), found.get(-3, 0)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte grams of every position (each text's bytes and its end), and where each text's begin."""
    if not texts:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    b = np.frombuffer(EDGE + EDGE.join(texts) + EDGE, np.uint8).astype(np.uint32)
    codes = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
    sizes = np.array([len(t) + 1 for t in texts])
    keep = np.ones(len(codes), bool)
    ends = np.cumsum(sizes + 2) - 2  # behind an end stand two bytes that only pad
    for skip in (0, 1):
        at = ends[:-1] + skip
        keep[at[at < len(keep)]] = False
    keep[int(ends[-1]) :] = False
    return codes[keep], np.concatenate(([0], np.cumsum(sizes)))


def trie_log10(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte behind its first three.

    ``grams`` are sorted, distinct and complete for each context of two bytes (the middle ones) that occurs in them; ``pairs`` are the
    counts of (byte, next byte) of the whole training text.
    """
    out = np.empty(len(grams))
    middle = (grams >> np.uint32(8)) & np.uint32(0xFFFF)
    order = np.argsort(middle, kind="stable")
    edges = np.flatnonzero(np.diff(middle[order], prepend=-1, append=-1 - int(len(order) > 0)))
    empty = pairs.sum(axis=0).astype(float)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:b]
        context = int(middle[rows[0]])
        fronts, which = np.unique(grams[rows] >> np.uint32(24), return_inverse=True)
        last = (grams[rows] & np.uint32(0xFF)).astype(int)
        longest = np.zeros((len(fronts), SYMBOLS))
        longest[which, last] = counts[rows]
        p = np.zeros_like(longest)
        left = np.ones((len(fronts), 1))  # probability that the coder gets down to this context
        excluded = np.zeros(longest.shape, bool)
        for level in (longest, longest.sum(axis=0, keepdims=True), pairs[context & 0xFF][None].astype(float), empty[None]):
            n = np.where(excluded, 0.0, level)
            seen = n > 0
            total, distinct = n.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
            weight = np.where(distinct > 0, total + distinct, 1.0)
            p += left * n / weight
            left = left * np.where(distinct > 0, distinct / weight, 1.0)
            excluded = excluded | seen
        rest = (~excluded).sum(axis=1, keepdims=True)
        p += np.where(excluded, 0.0, left / np.maximum(rest, 1))
        out[rows] = np.log10(p[which, last])
    return out


class Block:
    """Words and grams of one block, in the order in which they are sent and answered."""

    def __init__(self, texts: list[bytes], train: list[bool], owners: int):
        number: dict[bytes, int] = {}
        self.codes: list[list[int]] = []
        for t in texts:
            self.codes.append([number.setdefault(w, len(number)) for w in t.lower().split()])
        names = sorted(number)
        whose = np.array([zlib.crc32(w) % owners for w in names], np.int64)
        order = np.argsort(whose, kind="stable")
        self.words = [names[i] for i in order.tolist()]
        self.word_owner = whose[order]
        self.word_at = np.array([number[w] for w in self.words], np.int64)
        trained = np.array([c for codes, t in zip(self.codes, train, strict=True) if t for c in codes], np.int64)
        self.word_counts = np.bincount(trained, minlength=len(number))[self.word_at] if number else np.zeros(0, np.int64)
        learned, other = (np.sort(grams_of([x for x, t in zip(texts, train, strict=True) if t == wanted])[0]) for wanted in (True, False))
        begins = np.flatnonzero(np.concatenate(([True], learned[1:] != learned[:-1]))) if len(learned) else np.zeros(0, np.int64)
        known, counts = learned[begins], np.diff(np.append(begins, len(learned)))
        unseen = np.setdiff1d(other, known)
        self.sorted_grams = np.concatenate((known, unseen))
        all_counts = np.concatenate((counts, np.zeros(len(unseen), np.int64)))
        context = ((self.sorted_grams >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
        owner = (context * 40503 & 0xFFFF) * owners >> 16
        order = np.lexsort((self.sorted_grams, owner))
        self.gram_owner, self.grams, self.gram_counts = owner[order], self.sorted_grams[order], all_counts[order]


def _block(owners: int):
    target = to_arrow_schema(StructType.fromDDL(LISTS))

    def send(block: pa.Table) -> pa.Table:
        data = Block([raw(t) for t in block["text"].to_pylist()], block["train"].to_pylist(), owners)
        number, out = block["block"][0].as_py(), [[] for _ in target]
        for kind, whose in (("word", data.word_owner), ("gram", data.gram_owner)):
            ids, starts = np.unique(whose, return_index=True)
            for o, a, b in zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(whose)], strict=True):
                keys = pack_words(data.words[a:b]) if kind == "word" else pack_numbers(data.grams[a:b])
                counts = (data.word_counts if kind == "word" else data.gram_counts)[a:b].astype(np.int64)
                for c, v in zip(out, (kind, o, number, b - a, keys, pack_numbers(counts)), strict=True):
                    c.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    return send


def _owner(pairs: np.ndarray):
    target = to_arrow_schema(StructType.fromDDL(ANSWERS))

    def answer(lists: pa.Table) -> pa.Table:
        kind, owner = lists["kind"][0].as_py(), lists["owner"][0].as_py()
        keys, counts, blocks, sizes = (lists[c].to_pylist() for c in ("keys", "counts", "block", "n"))
        vocabulary = 0
        if kind == "word":
            sums: dict[bytes, int] = {}
            for k, c in zip(keys, counts, strict=True):
                for w, n in zip(unpack_words(k), unpack_numbers(c, np.int64).tolist(), strict=True):
                    sums[w] = sums.get(w, 0) + n
            vocabulary = sum(n > 0 for n in sums.values())
            answers = [pack_numbers(np.array([sums[w] for w in unpack_words(k)], np.int64)) for k in keys]
        else:
            every, where = np.unique(np.concatenate([unpack_numbers(k, np.uint32) for k in keys]), return_inverse=True)
            total = np.bincount(where, np.concatenate([unpack_numbers(c, np.int64) for c in counts]), len(every))
            logs = trie_log10(every, total, pairs)[where].astype(np.float32)
            answers = [pack_numbers(part) for part in np.split(logs, np.cumsum(sizes)[:-1])]
        cols = [blocks, [kind] * len(blocks), [owner] * len(blocks), sizes, answers, [vocabulary] + [0] * (len(blocks) - 1)]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return answer


def _score(owners: int):
    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        texts = [raw(t) for t in block["text"].to_pylist()]
        data = Block(texts, block["train"].to_pylist(), owners)
        got = {(k, o): a for k, o, a in zip(*(answers[c].to_pylist() for c in ("kind", "owner", "answer")), strict=True)}
        joined = lambda kind, whose, form: np.concatenate([np.zeros(0, form), *(unpack_numbers(got[kind, o], form) for o in np.unique(whose).tolist())])
        counts = np.zeros(len(data.words), np.int64)
        counts[data.word_at] = joined("word", data.word_owner, np.int64)
        grams = np.argsort(data.grams, kind="stable")
        ordered, logs = data.grams[grams], joined("gram", data.gram_owner, np.float32)[grams].astype(float)
        word_logs = np.log10(counts + SMOOTHING)
        known, base, model = [], [], []
        for at in range(0, len(texts), 64):
            codes, starts = grams_of(texts[at : at + 64])
            model += np.add.reduceat(logs[np.searchsorted(ordered, codes)], starts[:-1]).tolist()
        for codes in data.codes:
            c = np.array(codes, np.int64)
            known.append(int((counts[c] > 0).sum()))
            base.append(float(word_logs[c].sum()))
        words = [len(c) for c in data.codes]
        seen = sum(answers["vocabulary"].to_pylist())
        return pa.table(
            [block["doc_id"], block["train"], pa.array(words, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64()), pa.array([seen] + [0] * (len(texts) - 1), pa.int64())],
            names=["doc_id", "train", "words", "known", "base", "score", "vocabulary"],
        )

    return score


def score(docs: DataFrame, train_where=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``train_where`` is the condition for a row to be learned from; by default the id's crc32 decides.
    """
    spark = ready(docs.sparkSession)
    train = F.coalesce(train_where if train_where is not None else id_remainder(F.col("doc_id"), HELD_OUT_OF) != 0, F.lit(False))
    rows = docs.select("doc_id", "text", train.alias("train"))
    pairs, tokens, texts, size = byte_pairs(rows)
    # Small inputs use smaller blocks, so that all partitions have one.
    blocks = max(1, -(-size // block_bytes), min(partitions(spark), size // min(block_bytes, LEAST_BLOCK_BYTES)))
    owners = max(partitions(spark), blocks // BLOCKS_AN_OWNER)
    text_hash = F.xxhash64("doc_id", F.xxhash64("text"))
    dealt = rows.withColumn("block", F.pmod(text_hash, F.lit(blocks)).cast("int")).repartition(partitions(spark), "block")
    lists = dealt.groupBy("block").applyInArrow(_block(owners), LISTS)
    answers = lists.groupBy("kind", "owner").applyInArrow(_owner(pairs), ANSWERS)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, train boolean, words bigint, known bigint, base double, score double, vocabulary bigint"
    scored = materialize(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(owners), fields))
    vocabulary = (scored.agg(F.sum("vocabulary")).first()[0] or 0) + (1 if texts else 0)  # the end is a token too
    below = float(np.log10(tokens + SMOOTHING * (vocabulary + 1)))
    end = float(np.log10(texts + SMOOTHING))
    n_tokens = F.col("words") + 1
    return scored.select(
        "doc_id",
        "train",
        n_tokens.alias("n_tokens"),
        (F.col("known") + (1 if texts else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end) - n_tokens * F.lit(below)).alias("base_score"),
        "score",
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = (id_remainder(F.col("doc_id"), HELD_OUT_OF) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
