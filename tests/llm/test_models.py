"""Trees, rules, language network and byte model: brute force, monotonicity, held-out accuracy."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridegauge.llm import langid, lm, quality, rules, textstats, trees

SF = "/root/testdata/sf0.01"


def remainder(doc_id, m: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def slow_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_match_their_definition(messy):
    for r in messy.select("text").collect():
        assert textstats.describe((r["text"] or "").encode())[0] == slow_counts(r["text"])
    many = np.arange(3_000_000)  # more distinct words than three codes fit into 64 bits
    assert textstats.repeated_words(np.concatenate((many, [5, 6, 7]))) == 6


def test_forest_walk_equals_a_walk_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = trees.fit(x, y, trees=30, depth=3)

    def by_hand(row):
        total = forest.start
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return total

    assert np.allclose(forest.raw_score(x[:100]), [by_hand(r) for r in x[:100]])
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.97


def test_monotone_features_never_raise_the_score():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(2_000, 3))
    y = (rng.uniform(size=2_000) < 0.5 + 0.4 * np.sin(6 * x[:, 0]) * x[:, 1]).astype(float)
    forest = trees.fit(x, y, trees=60, depth=4, monotone={0: -1, 2: 1})
    grid = np.linspace(-0.2, 1.2, 80)
    for row in rng.uniform(size=(60, 3)):
        for feature, sign in ((0, -1), (2, 1)):
            line = np.repeat(row[None], len(grid), axis=0)
            line[:, feature] = grid
            assert (sign * np.diff(forest.raw_score(line)) >= -1e-9).all()


def test_one_class_or_no_rows_give_a_constant():
    assert trees.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert (trees.fit(np.ones((50, 3)), np.ones(50)).probability(np.zeros((2, 3))) > 0.9).all()


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_labels(spark, tables):
    docs, labels = tables
    rows = quality.op1_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert len(quality.training_statistics(docs, labels, 25)[0]) == 25


def test_scores_ignore_everything_but_the_text(messy, nothing, tables):
    model = quality.train(*tables)
    scored = quality.score(messy, model).collect()
    assert len(scored) == messy.count()
    by_text = defaultdict(set)
    for r in scored:
        by_text[r["text"] or ""].add(r["score"])
        assert 0 <= r["score"] <= 1
    assert all(len(s) == 1 for s in by_text.values())
    kept = quality.keep_good(messy, model)
    assert kept.columns == messy.columns and kept.count() == sum(r["score"] >= 0.3 for r in scored)
    assert quality.score(nothing, model).count() == 0
    assert quality.train(tables[0], tables[1].limit(0)).probability(np.zeros((1, len(textstats.FEATURES)))) == 0.5


def test_rules(spark, messy, nothing, tables):
    model = rules.train(*tables)
    for r in rules.judge(messy.select("doc_id", "text"), model).select("text", "judged.*").collect():
        counts = slow_counts(r["text"])
        assert tuple(r[c] for c in textstats.COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= rules.KEEP_FROM)
    kept = rules.keep_passing(messy, model)
    assert kept.columns == messy.columns and kept.filter("doc_id = 4").count() == 1 and kept.filter("text IS NULL").count() == 0
    assert rules.judge(nothing, model).count() == 0
    good = rules.op5_quality_rules(spark, SF).join(tables[1].filter("quality = 1"), "doc_id").filter("NOT base_failed")
    assert good.filter("kept").count() > 0.97 * good.count()


def test_network_gradients_reach_every_parameter():
    rng = np.random.default_rng(3)
    x = rng.integers(97, 103, (400, langid.WINDOW)).astype(np.uint8)
    y = np.arange(400) % 2
    x[y == 1, 40:43] = np.frombuffer(b"xyz", np.uint8)
    net = langid.fit(x, y, ["no", "yes"], epochs=12)
    assert (net.log_probabilities(x).argmax(axis=1) == y).mean() > 0.95
    by_hand = np.full((langid.FILTERS * len(langid.WIDTHS),), -np.inf)
    padded = np.concatenate((net.embedding[x[0]], net.embedding[np.zeros(max(langid.WIDTHS) - 1, int)]))
    for i in range(langid.WINDOW):
        by_hand = np.maximum(by_hand, padded[i : i + max(langid.WIDTHS)].ravel() @ net.kernel)
    assert np.allclose(by_hand, net.pooled(x[:1])[0], atol=1e-4)


def test_language_on_held_out_rows(spark, messy, nothing, tables):
    langs = {r["doc_id"]: (r["lang"], r["text"]) for r in tables[0].collect()}
    rows = langid.op6_language_id(spark, SF).collect()
    held = [r["lang_pred"] == langs[r["doc_id"]][0] for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and np.mean(held) > 0.97
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in rows)
    network = langid.train(messy)
    found = langid.identify(messy, network).collect()
    assert len(found) == messy.count()
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in ("aa", "bb", "und")
    assert langid.identify(nothing, network).count() == 0
    assert langid.identify(messy, langid.train(nothing)).filter("lang_pred <> 'und'").count() == 0


def slow_model(texts: list[bytes]):
    contexts = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        b = lm.EDGE + t + lm.EDGE[:1]
        for i in range(3, len(b)):
            for o in range(4):
                contexts[o][b[i - o : i]][b[i]] += 1

    def log10(c: bytes, s: int) -> float:
        excluded, p = set(), 1.0
        for o in (3, 2, 1, 0):
            n = {x: v for x, v in contexts[o].get(c[3 - o :], {}).items() if x not in excluded}
            if n:
                total = sum(n.values()) + len(n)
                if s in n:
                    return math.log10(p * n[s] / total)
                p *= len(n) / total
                excluded |= set(n)
        return math.log10(p / (256 - len(excluded)))

    return lambda t: sum(log10((lm.EDGE + t)[i : i + 3], (t + lm.EDGE[:1])[i]) for i in range(len(t) + 1))


@pytest.mark.parametrize("block_bytes", [lm.BLOCK_BYTES, 20_000])
def test_byte_model_and_base_score(messy, block_bytes):
    docs = messy.filter("text IS NULL OR length(text) < 5000")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    train = [r["text"].encode() for r in rows if remainder(r["doc_id"], 10) != 0]
    model, counts = slow_model(train), Counter()
    for t in train:
        counts.update([*t.lower().split(), "end"])
    below = sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = {}
    for r in rows:
        tokens = [*r["text"].encode().lower().split(), "end"]
        want.setdefault((r["doc_id"], len(tokens)), set()).add((sum(counts[t] > 0 for t in tokens), round(sum(math.log10((counts[t] + 0.1) / below) for t in tokens), 5), round(model(r["text"].encode()), 2)))
    got = lm.score(docs, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(r["n_known"] == k and abs(r["base_score"] - b) < 1e-3 and abs(r["score"] - s) < 0.05 for k, b, s in want[r["doc_id"], r["n_tokens"]])
        assert r["train_tokens"] == sum(counts.values())


def test_probabilities_of_all_symbols_sum_to_one():
    texts = [b"abracadabra", b"the thesis there", "é中".encode() * 3]
    codes = np.sort(np.concatenate([lm.grams_of([t])[0] for t in texts]))
    known, counts = np.unique(codes, return_counts=True)
    pairs = np.zeros((256, 256), np.int64)
    for t in texts:
        b = np.frombuffer(lm.EDGE[:1] + t + lm.EDGE[:1], np.uint8)
        np.add.at(pairs, (b[:-1], b[1:]), 1)
    for context in (b"the", b"zzz", b"\xff\xff\xff", b"qhe"):
        asked = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint32)
        every = np.union1d(known, asked)
        n = np.zeros(len(every), np.int64)
        n[np.searchsorted(every, known)] = counts
        logs = lm.trie_log10(every, n, pairs)
        assert abs((10 ** logs[np.searchsorted(every, asked)]).sum() - 1) < 1e-9


def test_grams_of_texts_are_those_of_each_text():
    texts = [b"", b"ab", b"", "é".encode(), b"x" * 9]
    codes, starts = lm.grams_of(texts)
    for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        s = lm.EDGE + t + lm.EDGE[:1]
        assert codes[a:b].tolist() == [int.from_bytes(s[i : i + 4], "big") for i in range(len(t) + 1)]
    assert lm.grams_of([])[0].tolist() == []


def test_no_texts_to_learn_from(messy, nothing):
    assert lm.score(nothing).count() == 0
    got = lm.score(messy.filter("doc_id = 4"), train_where=F.lit(False)).first()
    assert got["n_known"] == 0 and got["train_tokens"] == 0
    assert got["base_score"] == pytest.approx(0.0) and got["score"] == pytest.approx(-(len(messy.filter("doc_id = 4").first()["text"]) + 1) * math.log10(256), rel=1e-5)
