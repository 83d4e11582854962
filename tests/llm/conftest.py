from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, block int, sha string, fp bigint, shard string, depth int, ids string, train boolean"
WORDS = "the of and ward stone river glass morning paper under light house seven green walk talk deep wind salt north".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "er", "."]) for _ in range(n))


def messy_rows() -> list[tuple]:
    """Nulls everywhere, empty and blank texts, a very long text, one long word, copies, near copies, repeated rows, odd characters."""
    rng = random.Random(4)
    base = sentence(rng, 120)
    near = base.replace("river", "rivers", 1)
    texts: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "  \n\t "), (4, base), (5, base), (6, base.replace(" ", "\n ", 3)), (7, near), (8, base.upper()),
        (9, "x" * 40_000), (10, sentence(rng, 60_000)), (11, "İstanbul Å ﬁ ẗ ́ <|endoftext|> it's 3.5 …. ×."), (12, "Ünïcödé 中文 текст emoji 😀 \x0b \x85  "),
        (13, "1234 5678 !!!"), (None, "no id here"), (None, None), (14, "same row"), (14, "same row"), (15, "one"), (16, "one two"), (17, "one two three"),
        (18, "a\nb\na\nb\n\n\n"), (19, "w " * 300), (20, "# $ % & | < > *" * 5), (-7, base),
    ]
    texts += [(100 + i, sentence(rng, rng.randint(1, 90))) for i in range(40)]
    texts += [(200 + i, base) for i in range(60)]
    rows = []
    for i, (doc_id, text) in enumerate(texts):
        rows.append((doc_id, text, [None, "aa", "bb"][i % 3], None if i % 2 else "s", None if i % 5 else 1, 0.5, None, 3, "z", None, "q", 1, "i", None))
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3, "n_chars", "source").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
