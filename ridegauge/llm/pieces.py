"""Token ids of whole texts through a memo of runs.

A tokenizer that takes a space only at the front of a token never merges across the place before a lone space (no white space on
either side of it), so the ids of a text are the ids of its runs, one after the other, and each distinct run of a task is encoded
once. Runs of other white space stay inside a run, where the library sees them whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from ridegauge.llm.common import raw
from ridegauge.llm.words import MEMO_WORDS, WordCoder

MEMO_BYTES = 160 << 20
_ODD = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<!\s)(?= \S)")


def byte_table() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def runs(text: str) -> list[str]:
    """``text`` cut before every lone space; each run but the first begins with its space."""
    if _ODD.search(text):
        return [r for r in _CUT.split(text) if r]
    first, *rest = text.split(" ")
    return [first, *[" " + word for word in rest]] if first else [" " + word for word in rest]


class RunCoder(WordCoder):
    """Encodes batches of whole texts; ``encode`` gives the id lists of new runs."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], by_run: bool = True):
        self.encode, self.by_run = encode, by_run
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.held = 0

    def begin(self) -> bool:
        if self.words > MEMO_WORDS or self.held > MEMO_BYTES:
            self.forget()
            return True
        return False

    def numbers(self, text: str) -> list[int]:
        number = self.number
        return [number[r] for r in runs(text)] if self.by_run else [number[text]]

    def _learn(self) -> None:
        new, self.number.new = self.number.new, []
        self.held += 150 * len(new) + sum(map(len, new))
        lists = self.encode(new)
        self._append(np.array([i for ids in lists for i in ids], np.uint32), np.array([len(ids) for ids in lists], np.int64))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [self.ids_of(c) for c in self.codes(texts)]


class ByteRunCoder(RunCoder):
    """Runs of a byte-level tokenizer, all new ones in one call: joined again they are cut at the same places. A tokenizer whose
    pre-tokens may cross a lone space encodes every text whole."""

    _PROBE = [" ab", " é", "1", ".", "\n", "De", ",", " f", " \n\n ", " g", " -", "h"]

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        probe = "".join(self._PROBE)
        back = {c: b for b, c in byte_table().items()}
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes([back[c] for c in token])
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        found = [probe[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        super().__init__(lambda new: [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)], found == self._PROBE)

    def _learn(self) -> None:
        new, self.number.new = self.number.new, []
        self.held += 150 * len(new) + sum(map(len, new))
        joins = [self.by_run and len(r) > 1 and r[0] == " " and not (r[1].isspace() or r[-1].isspace()) for r in new]
        order = sorted(range(len(new)), key=joins.__getitem__)
        alone = len(new) - sum(joins)
        lists = self.encode([new[i] for i in order[:alone]])
        ids, sizes = [np.array([i for some in lists for i in some], np.uint32)], [np.array([len(some) for some in lists], np.int64)]
        if alone < len(new):
            rest = [new[i] for i in order[alone:]]
            ids.append(np.array(self.encode(["".join(rest)])[0], np.uint32))
            ends = np.searchsorted(np.cumsum(self.length[ids[1]]), np.cumsum([len(raw(r)) for r in rest])) + 1
            sizes.append(np.diff(ends, prepend=0))
        first = self.words
        self._append(np.concatenate(ids), np.concatenate(sizes))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order)) + first
        self.start[first : self.words], self.size[first : self.words] = self.start[back], self.size[back]
