"""Byte-level BPE by ranks, with character offsets, and its way back.

The tokenizers library gets a BPE model made from the ranks: byte b of a token is the character that a byte table gives it, and every
cut of a token into two tokens is a merge with the token's rank, since rank-based encoders join any two neighbours whose bytes are a
token. A pattern cuts a text into pre-tokens, each encoded separately; a task encodes each distinct run between lone spaces once. Offsets come
from the tokens' byte lengths: byte i of the UTF-8 text belongs to the character whose lead byte is the last one at or before i, so a
token that holds a part of a character covers that whole character. Decoding joins the tokens' characters and reverses the
byte table; only the joined bytes are read as UTF-8, so characters that are split over tokens come back whole.

Null is empty: no ids, no bytes. Repeated rows get the same answer; further columns pass through (one that has the name of a new column is
replaced). Texts of any length are encoded whole; special tokens' strings are plain text. An empty table gives an empty table. No row leaves
its task, so there is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from ridegauge.llm.common import add_columns, raw, ready, table
from ridegauge.llm.pieces import ByteRunCoder, byte_table


def read_ranks(path: str) -> dict[bytes, int]:
    """A file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def build(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """The library's tokenizer for these ranks."""
    chars = byte_table()
    written = {token: "".join([chars[b] for b in token]) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1:
            cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            # A cut whose parts come late in the ranks is the one that merging reaches.
            cuts.sort(key=lambda c: max(ranks[c[0]], ranks[c[1]]))
            merges += [(written[a], written[b]) for a, b in cuts]
    tokenizer = Tokenizer(models.BPE({written[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)]
    )
    return tokenizer


class ByteCoder(ByteRunCoder):
    """Ids, character offsets and bytes of texts and of ids."""

    def __init__(self, path: str, pattern: str):
        super().__init__(build(read_ranks(path), pattern))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the first character that it holds bytes of and the one after the last."""
        ends = np.cumsum(self.length[ids])
        character = np.cumsum((np.frombuffer(raw(text), np.uint8) & 0xC0) != 0x80) - 1
        if not len(ids):
            return ends, ends
        return character[ends - self.length[ids]], character[ends - 1] + 1

    def decode(self, ids) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in ids])


def _coder(path: str, pattern: str):
    """Makes the coder once in each task."""
    made: list[ByteCoder] = []

    def get() -> ByteCoder:
        if not made:
            made.append(ByteCoder(path, pattern))
        return made[0]

    return get


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs`` with ids and, for each, the characters [starts, ends) of the text that it holds bytes of."""
    ready(docs.sparkSession)
    get = _coder(ranks, pattern)

    def run(texts):
        whole = [t or "" for t in texts]
        ids = get().batch(whole)
        spans = [get().offsets(t, i) for t, i in zip(whole, ids, strict=True)]
        return ids, [s for s, _ in spans], [e for _, e in spans]

    return add_columns(docs, "ids array<int>, starts array<int>, ends array<int>", run)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the bytes of its ids, and as text; U+FFFD stands for characters whose bytes are not all there. Null ids are none."""
    ready(encoded.sparkSession)
    get = _coder(ranks, pattern)

    def run(lists):
        found = [get().decode(i or []) for i in lists]
        return found, [b.decode("utf-8", "replace") for b in found]

    return add_columns(encoded, "decoded_bytes binary, decoded string", run, ids)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """n_tokens, ids_sha256, decoded_sha256 as further columns, without carrying ids out of the task."""
    ready(docs.sparkSession)
    get = _coder(ranks, pattern)

    def run(texts):
        lists = get().batch([t or "" for t in texts])
        encoded = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in lists]
        return [len(i) for i in lists], encoded, [hashlib.sha256(get().decode(i.tolist())).hexdigest() for i in lists]

    return add_columns(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
