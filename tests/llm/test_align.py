"""Byte-level BPE and tokenizer alignment: against tiktoken, the libraries on whole texts, and a plain alignment."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from ridegauge.llm import align, bytebpe, pieces
from ridegauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("abcdeé  \n\t'sx1!.,中文😀́aaattt--==    ") + ["\x0b", "\x85", " ", "▁", "<|endoftext|>", "<s>", "՘", "\x1c", "\x00", "Ꟗ"]


@pytest.fixture(scope="module")
def by_ranks():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def strange(rng: random.Random, n: int) -> list[str]:
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return out + [rng.choice(LETTERS) * rng.randint(1, 200) for _ in range(n // 20)]


def test_runs_join_to_the_text():
    for text in strange(random.Random(1), 3000):
        assert "".join(pieces.runs(text)) == text


def test_byte_coder_gives_tiktokens_ids(by_ranks):
    coder, rng = bytebpe.ByteCoder(RANKS, public_tokenizers.PATTERN), random.Random(2)
    assert coder.by_run
    tokens = [t.decode("utf-8", "ignore") for t in bytebpe.read_ranks(RANKS)]
    for _ in range(4):
        texts = strange(rng, 2000) + ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
        for text, ids in zip(texts, coder.batch(texts), strict=True):
            assert ids.tolist() == by_ranks.encode_ordinary(text), repr(text)
            assert coder.decode(ids.tolist()) == text.encode()


def test_every_character_falls_into_the_same_pieces(by_ranks):
    coder = bytebpe.ByteCoder(RANKS, public_tokenizers.PATTERN)
    for first in range(0, 0x110000, 1 << 14):
        texts = [f"a{chr(c)}a 1{chr(c)} {chr(c)} !{chr(c)}" for c in range(first, first + (1 << 14), 3) if not 0xD800 <= c < 0xE000]
        assert [i.tolist() for i in coder.batch(texts)] == [by_ranks.encode_ordinary(t) for t in texts]


def test_a_memo_within_its_bound(by_ranks, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_BYTES", 2000)
    coder, rng = bytebpe.ByteCoder(RANKS, public_tokenizers.PATTERN), random.Random(3)
    for _ in range(10):
        texts = strange(rng, 40)
        assert [i.tolist() for i in coder.batch(texts)] == [by_ranks.encode_ordinary(t) for t in texts]


def test_other_patterns_encode_whole_texts():
    coder = bytebpe.ByteCoder(RANKS, r"\S+ |\s+|\S+")
    other = tiktoken.Encoding("own", pat_str=r"\S+ |\s+|\S+", mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    assert not coder.by_run
    texts = ["one two  three", "", " a"]
    assert [i.tolist() for i in coder.batch(texts)] == [other.encode_ordinary(t) for t in texts]


def test_encode_offsets_and_decode(spark, messy, nothing, by_ranks):
    rows = bytebpe.decode(bytebpe.encode(messy, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == messy.count()
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == by_ranks.encode_ordinary(text)
        assert bytes(r["decoded_bytes"]) == text.encode() and r["decoded"] == text
        at = 0
        for i, s, e in zip(r["ids"], r["starts"], r["ends"], strict=True):
            size = len(by_ranks.decode_single_token_bytes(i))
            assert len(text[:s].encode()) <= at and at + size <= len(text[:e].encode())
            assert len(text[: s + 1].encode()) > at and len(text[: e - 1].encode()) < at + size
            at += size
    half = spark.createDataFrame([([by_ranks.encode_ordinary("😀")[0]],), (None,)], "ids array<int>")
    assert {r["decoded"] for r in bytebpe.decode(half, RANKS, public_tokenizers.PATTERN).collect()} <= {"�", "😀", ""}
    assert bytebpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def check_op12(rows, docs, by_ranks):
    got = sorted(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in rows if r["doc_id"] is not None)
    want = []
    for r in docs:
        if r["doc_id"] is not None:
            ids = by_ranks.encode_ordinary(r["text"] or "")
            packed = b"".join(i.to_bytes(4, "little") for i in ids)
            want.append((r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_op12_query(spark, messy, by_ranks):
    query = QUERIES["op12_byte_bpe"](spark, SF)
    assert query.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    check_op12(query.collect(), spark.read.parquet(f"{SF}/documents.parquet").collect(), by_ranks)
    check_op12(bytebpe.digests(messy, RANKS, public_tokenizers.PATTERN).collect(), messy.collect(), by_ranks)


def plain_tokens(whole, text: str | None):
    """(id, bytes) of A and B on the whole text; none if the bytes differ."""
    tokenizer, model = whole
    if not text:
        return [], []
    back = {c: b for b, c in pieces.byte_table().items()}
    a = [(i, bytes(back[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text, num_threads=1):
        p = model.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
    data = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == data == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def plain_alignment(a, b):
    """Groups as lists of ids, links as Counter of id pairs."""
    a, b = spans(a), spans(b)
    groups, at = [], 0
    for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
        groups.append(([i for i, s, e in a if at <= s and e <= end], [i for i, s, e in b if at <= s and e <= end]))
        at = end
    links = Counter()
    for i, s, e in a:
        for j, s2, e2 in b:
            if s < e2 and s2 < e:
                links[i, j] += 1
    return groups, links


def check_op11(rows, docs, whole):
    made = [(d["doc_id"], *plain_tokens(whole, d["text"])) for d in docs]
    aligned = {}
    for _, a, b in made:
        key = (tuple(a), tuple(b))
        if key not in aligned:
            aligned[key] = plain_alignment(a, b)
    count = Counter()
    for _, a, b in made:
        count.update(set(aligned[tuple(a), tuple(b)][1]))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    want = []
    for doc_id, a, b in made:
        groups, links = aligned[tuple(a), tuple(b)]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(written.encode()).hexdigest() if a else ""
        n_best = sum(t for p, t in links.items() if count[p] == best[p[0]])
        want.append((doc_id, len(a), len(b), len(groups), sum(links.values()), n_best, sum(t * count[p] for p, t in links.items()), sha))
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    order = lambda row: tuple((v is not None, v) for v in row)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=order) == sorted(want, key=order)
    return count, best


def strange_docs(spark):
    rng = random.Random(5)
    texts = [t[:30] for t in strange(rng, 300)] + [None, "", "a", "the same words", "the same words", "x" * 400, "wörd " * 60, " lead", "trail ", "two  spaces", "▁", "a▁b", "<s> </s>"]
    return spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_plain_version(spark, whole, monkeypatch, small):
    if small:  # many blocks a task
        monkeypatch.setattr(align, "BLOCK_BYTES", 100)
    docs = strange_docs(spark)
    count, best = check_op11(align.digests(docs, A, B).collect(), docs.collect(), whole)
    found = align.pair_counts(docs, A, B).collect()
    assert {(r["a"], r["b"]): (r["docs"], r["best"]) for r in found} == {p: (n, n == best[p[0]]) for p, n in count.items()}


def test_align_gives_ids_and_groups(spark, whole):
    for r in align.align(strange_docs(spark), A, B).collect():
        a, b = plain_tokens(whole, r["text"])
        assert (r["a_ids"], r["b_ids"]) == ([i for i, _ in a], [i for i, _ in b])
        groups, _ = plain_alignment(a, b)
        assert (r["group_a"], r["group_b"]) == ([len(x) for x, _ in groups], [len(y) for _, y in groups])


def test_op11_query(spark, messy, nothing, whole):
    docs = [d for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    query = QUERIES["op11_tokenizer_alignment"](spark, SF)
    assert query.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = query.collect()
    assert len(rows) == len(docs)
    short = [d["doc_id"] for d in docs if len(d["text"] or "") < 3000]
    tokens = {d["doc_id"]: plain_tokens(whole, d["text"]) for d in docs}
    for r in rows:
        a, b = tokens[r["doc_id"]]
        assert (r["n_a"], r["n_b"]) == (len(a), len(b))
        if r["doc_id"] in short[:60]:
            groups, links = plain_alignment(a, b)
            assert (r["n_groups"], r["n_links"]) == (len(groups), sum(links.values()))
    assert align.digests(messy, A, B).count() == messy.count()
    assert align.digests(nothing, A, B).count() == 0
