"""BPE encoding and decoding with content-defined chunk reuse.

A rolling (gear) hash over 32 bytes cuts each text where the hash meets a mask, so equal passages of different documents fall into
equal chunks wherever they stand. A chunk is encoded once in a task, keyed by its bytes. Cuts fall anywhere, also inside words: the
words broken by a join are re-encoded, taking in further chunks until white space is met on both sides, from where the ids of either
side agree with those of the whole text. Chunks without white space become part of the repaired word.

Reuse is within a task: handing each chunk's ids from one owner to all documents of the corpus would move the texts and the ids once
more than the input's size, for chunks that cost less to encode than to move. No row leaves its task, so there is no shuffle.

Null is empty: no ids, and the hashes of the empty string. Repeated rows get the same answer; further columns are not read. Texts of
any length are encoded whole. A tokenizer whose ids do not follow from words alone encodes every text in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ridegauge.llm.common import add_columns, raw, ready, table
from ridegauge.llm.words import WordCoder

MASK_BITS = 9
LEAST_CHUNK, MOST_CHUNK = 64, 8192
MEMO_BYTES = 48 << 20
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, np.uint32)
_SPACES = b" \t\n\r"


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: never inside a UTF-8 character, the last is the length."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [n] if n else []
    octets = np.frombuffer(data, np.uint8)
    h = _GEAR[octets]
    for s in (1, 2, 4, 8, 16):  # after each step the hash spans twice as many bytes
        h[s:] += h[:-s] << np.uint32(s)
    hits = np.flatnonzero(h[:-1] >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, last = [], 0
    for at in [*hits.tolist(), n]:
        while at - last > MOST_CHUNK:
            last += MOST_CHUNK
            while octets[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if at == n or at - last >= LEAST_CHUNK and octets[at] & 0xC0 != 0x80:
            ends.append(at)
            last = at
    return ends


class ChunkCoder:
    """Ids of whole texts; chunks seen before in this task are not encoded again."""

    def __init__(self, path: str):
        self.coder = WordCoder(path)
        self.memo: dict[bytes, tuple[bytes, list[int], bytes] | None] = {}
        self.held = self.reused = self.seen = 0

    def _chunk(self, chunk: bytes) -> tuple[bytes, list[int], bytes] | None:
        """The broken word at the front, the numbers of the whole words, the broken word at the end; None without white space."""
        spaces = [i for i in (chunk.find(s) for s in (b" ", b"\t", b"\n", b"\r")) if i >= 0]
        if not spaces:
            return None
        first = min(spaces)
        last = max(chunk.rfind(s) for s in (b" ", b"\t", b"\n", b"\r"))
        return chunk[:first], self.coder.numbers(chunk[first : last + 1]), chunk[last + 1 :]

    def _numbers(self, data: bytes) -> list[int]:
        out: list[int] = []
        memo, pending, start = self.memo, b"", 0
        for end in cut_points(data):
            chunk = data[start:end]
            start = end
            self.seen += 1
            if chunk in memo:
                self.reused += 1
                found = memo[chunk]
            else:
                found = memo[chunk] = self._chunk(chunk)
                self.held += 2 * len(chunk) + 200
            if found is None:
                pending += chunk
                continue
            if pending or found[0]:
                out += self.coder.numbers(pending + found[0])
            out += found[1]
            pending = found[2]
        if pending:
            out += self.coder.numbers(pending)
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.coder.begin() or self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        numbers = [self._numbers(t) if self.coder.by_word else self.coder.numbers(t) for t in texts]
        self.coder.finish()
        return [self.coder.ids_of(n) for n in numbers]


class Decoder:
    """Text of ids as the tokenizer's own ``decode(ids, skip_special_tokens=False)`` gives it."""

    def __init__(self, coder: WordCoder):
        t = coder.tokenizer
        self.tokenizer = t
        self.tokens = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))] if t.decoder is None else None

    def decode(self, ids: list[int]) -> str:
        if self.tokens is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def encode(docs: DataFrame, tokenizer: str, name: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts in a further column."""
    ready(docs.sparkSession)
    coders: list[ChunkCoder] = []

    def run(texts):
        if not coders:
            coders.append(ChunkCoder(tokenizer))
        return (coders[0].encode([raw(t) for t in texts]),)

    return add_columns(docs, f"`{name}` array<int>", run)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in a further column; null ids give the empty text."""
    ready(encoded.sparkSession)
    decoders: list[Decoder] = []

    def run(lists):
        if not decoders:
            decoders.append(Decoder(WordCoder(tokenizer)))
        return ([decoders[0].decode(i or []) for i in lists],)

    return add_columns(encoded, f"`{name}` string", run, ids)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens, ids_sha256, decoded_sha256 as further columns, without carrying ids out of the task."""
    ready(docs.sparkSession)
    made: list = []

    def run(texts) -> tuple[list, list, list]:
        if not made:
            coder = ChunkCoder(tokenizer)
            made.extend([coder, Decoder(coder.coder), [str(i) for i in range(coder.coder.tokenizer.get_vocab_size(with_added_tokens=True))]])
        coder, decoder, digits = made
        counts, encoded, decoded = [], [], []
        for ids in coder.encode([raw(t) for t in texts]):
            listed = ids.tolist()
            counts.append(len(listed))
            encoded.append(hashlib.sha256(" ".join([digits[i] for i in listed]).encode()).hexdigest())
            decoded.append(hashlib.sha256(decoder.decode(listed).encode("utf-8", "surrogatepass")).hexdigest())
        return counts, encoded, decoded

    return add_columns(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text").select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
