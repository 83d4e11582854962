"""Word coding, chunk reuse, packing: against the tokenizer itself."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ridegauge.llm import bpe, packing
from ridegauge.llm.words import WordCoder

PIECES = ["a", "B", "é", "É", ".", " ", ",", "!", "'", "s", "t", "1", "\n", "́", "̈", "İ", "<|", "endoftext", "|>", "ß", "ſ", "K", "\t", "x", "中", "…", " ", "Σ", "\x0b", "×"]


def plain(tokenizer: str) -> Tokenizer:
    t = Tokenizer.from_file(tokenizer)
    t.no_truncation()
    t.no_padding()
    return t


def test_word_coder_gives_the_tokenizers_ids(tokenizer):
    t, coder, rng = plain(tokenizer), WordCoder(tokenizer), random.Random(1)
    assert coder.by_word
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, codes in zip(part, coder.codes([x.encode() for x in part]), strict=True):
            assert coder.ids_of(codes).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_coder_forgets_within_its_bound(tokenizer, monkeypatch):
    monkeypatch.setattr("ridegauge.llm.words.MEMO_WORDS", 50)
    t, coder, rng = plain(tokenizer), WordCoder(tokenizer), random.Random(2)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(40))
        assert coder.ids_of(coder.codes([text.encode()])[0]).tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = bpe.ChunkCoder(path)
    assert not coder.coder.by_word
    for text in ["", "Hello  there\n world", "x" * 3000]:
        assert coder.encode([text.encode()])[0].tolist() == plain(path).encode(text, add_special_tokens=False).ids


def test_cut_points_cover_whole_characters():
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 5_000, 60_000):
        data = "".join(rng.choice("abcdefg éü中😀\n ") for _ in range(n)).encode()
        ends = bpe.cut_points(data)
        assert ends == sorted(set(ends)) and (ends[-1:] or [0])[-1] == len(data)
        assert b"".join(data[a:b] for a, b in zip([0, *ends], ends, strict=False)) == data
        for e in ends:
            data[:e].decode()
        assert all(b - a <= bpe.MOST_CHUNK for a, b in zip([0, *ends], ends, strict=False))
    same = bpe.cut_points(b"a" * 100_000)
    assert max(np.diff([0, *same])) <= bpe.MOST_CHUNK


def test_chunks_of_equal_passages_are_reused_and_joins_are_exact(tokenizer):
    t, rng = plain(tokenizer), random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh.,É") for _ in range(rng.randint(1, 9))) for _ in range(3_000))
    coder = bpe.ChunkCoder(tokenizer)
    texts = [f"{'z' * i} {passage[i:]} {'y' * i}" for i in range(0, 300, 7)]
    for text in texts:
        assert coder.encode([text.encode()])[0].tolist() == t.encode(text, add_special_tokens=False).ids
    assert coder.reused > 0.8 * coder.seen


def test_bpe_round_trip_on_messy_rows(messy, nothing, tokenizer):
    t = plain(tokenizer)
    rows = bpe.decode(bpe.encode(messy, tokenizer), tokenizer).join(bpe.digests(messy.select("doc_id", "text"), tokenizer).distinct().withColumnRenamed("text", "body"), "doc_id").collect()
    assert len(rows) >= messy.filter("doc_id IS NOT NULL").count()
    for r in rows:
        want = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["decoded"] == t.decode(want, skip_special_tokens=False)
        if r["body"] == r["text"]:
            assert r["n_tokens"] == len(want)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode(messy, tokenizer).count() == messy.count()
    assert bpe.digests(nothing, tokenizer).count() == 0


def check_pieces(rows, docs: dict, window: int) -> None:
    """Every id in one piece, sequences gapless and exactly full at a power of two."""
    sequences, per_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
        per_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        at = 0
        for offset, length, full in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == full <= window and at & (at - 1) == 0
    for (doc, tokens), parts in per_doc.items():
        ids = docs[doc]
        copies = sum(start == 0 for start, _, _ in parts)
        assert sum(n for _, n, _ in parts) == copies * tokens
        if copies == 1:
            assert [s for s, _, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n, _ in sorted(parts))])[:-1])
        for start, n, crc in parts:
            assert any(zlib.crc32(np.array(i[start : start + n], "<u4").tobytes()) == crc for i in ids)


@pytest.mark.parametrize("round_tokens", [packing.ROUND_TOKENS, 500])
def test_packing_messy_rows(messy, tokenizer, round_tokens):
    t = plain(tokenizer)
    docs = defaultdict(list)
    for r in messy.collect():
        docs[r["doc_id"]].append([*t.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID])
    rows = packing.pack(messy, tokenizer, round_tokens=round_tokens).collect()
    check_pieces(rows, docs, packing.WINDOW)
    assert sum(r["length"] for r in rows) == sum(len(i) for own in docs.values() for i in own)


def test_packing_nothing(nothing, tokenizer):
    assert packing.pack(nothing, tokenizer).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, tokenizer, window=1000)


def test_rounds_use_all_tiers_and_leave_less_than_the_shortest():
    rng = random.Random(9)
    sizes = [rng.choice([3, 40, 300, 700, 1500, 2048, 5000]) for _ in range(400)]
    sequences, left = packing.pack_round(sizes, 2048, 256, last=False)
    assert sum(p[2] for _, s in sequences for p in s) + sum(p[2] for p in left) == sum(sizes)
    assert sum(p[2] for p in left) < 256 and {n for n, _ in sequences} >= {2048, 1024}
    groups = packing.step_groups(sequences, 1 << 15)
    cost = defaultdict(int)
    for (n, pieces), g in zip(sequences, groups, strict=True):
        if n == 2048:
            cost[g] += sum(p[2] ** 2 for p in pieces)
    assert max(cost.values()) < 1.3 * min(cost.values())
