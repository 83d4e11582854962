"""Token ids of whole texts through a memo of words.

A tokenizer that drops white space and merges inside words only gives a text's ids word by word, so each distinct word of a task is
encoded once. Words are split at the ASCII white space that such a tokenizer drops; words of Latin letters are encoded in one call, any
other word is encoded by the tokenizer as it stands. For a tokenizer of another kind every text is encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from tokenizers import Tokenizer

MEMO_WORDS = 500_000
_LETTERS = re.compile("[a-zß-öø-ɏ]+|[.,]+")
_CLOSING = re.compile(rb"(?<=[a-z0-9])([.,]+)(?=[ \n\t\r]|$)")


def _outline() -> bytes:
    """Byte classes: ``.`` full stop and comma, ``!`` other marks, ``X`` the start of a character that need not be a letter."""
    kind = bytearray(b"a" * 256)
    for i in range(256):
        c = chr(i)
        if c in ".,":
            kind[i] = ord(".")
        elif i < 0x21:
            kind[i] = ord(" ") if c in " \t\n\r" else ord("X")
        elif i < 0x80 and not c.isalnum():
            kind[i] = ord("!")
        elif i == 0xC2 or i >= 0xCA:
            kind[i] = ord("X")
    return bytes(kind)


_OUTLINE = _outline()
#: The kind of pre-tokenizer for which ids follow from words alone.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Numbers(dict):
    """Numbers words in the order in which they first occur; ``new`` lists those that have no ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class WordCoder:
    """Encodes batches of whole texts. ``start`` and ``size`` place a word's ids in ``ids``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each further thread keeps memory of its own
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_word = split.get("pattern") == {"Regex": _WORD_SPLIT} and steps == ["NFC", "Replace", "Lowercase"] and not spec.get("post_processor")
        self.forget()
        if self.by_word:
            spec |= {"normalizer": None, "added_tokens": []}
            spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            self.spaced = Tokenizer.from_str(json.dumps(spec))
            suffix = spec["model"]["end_of_word_suffix"]
            self.last = np.zeros(len(spec["model"]["vocab"]), bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def forget(self) -> None:
        self.number = _Numbers()
        self.start, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.words = self.used = 0

    def split(self, data: bytes) -> list[bytes]:
        """Words whose ids, one after the other, are the text's ids.

        Capitals A-Z become small first and closing marks are set apart, unless the text holds combining marks (which compose with
        some small letters only; U+0130 becomes one) or something that small letters could turn into a special token.
        """
        if not self.by_word:
            return [data] if data else []
        if b"\xcc" not in data and b"\xcd" not in data and b"<|" not in data and b"\xc4\xb0" not in data:
            data = data.lower()
            outline = data.translate(_OUTLINE)
            if b"!." in outline or b".." in outline or b".!" in outline or b"X" in outline or b"\xc3\x97" in data or b"\xc3\xb7" in data:
                data = _CLOSING.sub(rb" \1", data)
            else:  # every full stop or comma stands alone behind a letter, a digit or white space
                data = data.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")
        return data.split()

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        for name, need in (("start", self.words + len(sizes)), ("size", self.words + len(sizes)), ("ids", self.used + len(ids))):
            if need > len(a := getattr(self, name)):
                setattr(self, name, np.concatenate((a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype))))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[self.words : self.words + len(sizes)] = sizes
        self.start[self.words : self.words + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.words += len(sizes)

    def _learn(self) -> None:
        new, self.number.new = self.number.new, []
        plain = np.array([w.isalpha() or w == b"." or w == b"," for w in new], bool)  # bytes.isalpha: ASCII letters
        plain &= np.array([w.islower() or not w.isalpha() for w in new], bool)
        texts = {i: new[i].decode("utf-8", "surrogatepass") for i in np.flatnonzero(~plain).tolist()} if self.by_word else {}
        stems = dict(enumerate(new))
        for i, t in texts.items():
            stem = t.lower()
            if "\u0130" not in t and _LETTERS.fullmatch(stem):
                plain[i] = True
                stems[i] = stem.encode()
        if not self.by_word:
            plain[:] = False
            texts = {i: w.decode("utf-8", "surrogatepass") for i, w in enumerate(new)}
        sizes, parts = np.zeros(len(new), np.int64), [np.zeros(0, np.uint32)]
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        if plain.any():
            joined = b" ".join([stems[i] for i in np.flatnonzero(plain).tolist()]).decode("utf-8")
            ids = np.array(self.spaced.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            sizes[plain] = np.diff(ends, prepend=0)
            parts.append(ids)
        if not plain.all():
            rest = np.flatnonzero(~plain).tolist()
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                sizes[i] = len(e.ids)
                parts.append(np.array(e.ids, np.uint32))
        first = self.words
        self._append(np.concatenate(parts), sizes[order])
        back = np.empty_like(order)
        back[order] = np.arange(len(order)) + first
        self.start[first : self.words] = self.start[back]
        self.size[first : self.words] = sizes

    def begin(self) -> bool:
        """Start a batch; True if all word numbers were forgotten to stay within the memory bound."""
        if self.words > MEMO_WORDS:
            self.forget()
            return True
        return False

    def numbers(self, data: bytes) -> list[int]:
        """Word numbers of a text; their ids are there after :meth:`finish`."""
        number = self.number
        return [number[w] for w in self.split(data)]

    def finish(self) -> None:
        if self.number.new:
            self._learn()

    def codes(self, texts: list[bytes]) -> list[list[int]]:
        """For each text the numbers of its words. Numbers hold until the next call."""
        self.begin()
        out = [self.numbers(t) for t in texts]
        self.finish()
        return out

    def ids_of(self, codes: list[int]) -> np.ndarray:
        """The ids of a text from its words' numbers."""
        c = np.array(codes, np.int64)
        sizes = self.size[c]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.start[c] - ends + sizes, sizes)]
