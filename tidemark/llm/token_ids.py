"""Token ids of whole texts by the ``tokenizers`` library, at the speed of a lookup per word.

A byte-pair tokenizer encodes each pre-token on its own. Every distinct pre-token is encoded once
per worker by the library; a text is then a lookup of its pre-tokens. Texts with characters beyond
Latin letters, marks and usual white space, whose classes two regular expression engines could see
differently, are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property
from itertools import chain

import numpy as np

from tidemark.llm import common

# Pre-token patterns of the known kinds of tokenizer, and Latin letters, digits and white space.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", r"\t-\r \xa0"
# The same patterns for texts of Latin letters, marks and usual white space only; and what else a text may hold.
LATIN = {
    BYTE_LEVEL: re.compile(
        f" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGIT}]+| ?[^{BLANK}{LETTER}{DIGIT}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
    ),
    WORD_LEVEL: re.compile(f"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGIT}]|[^{BLANK}{LETTER}{DIGIT}]+"),
}
UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e\xa0-įı-ſ]")


class _Index(dict):
    """Numbers keys in the order of their first use and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class TokenEncoder:
    """Ids of texts; ``max_words`` bounds the memory for known pre-tokens, not what is encoded."""

    def __init__(self, path: str, max_words: int = 1_200_000):
        # Spark's tasks are the parallelism; threads of the library's own would only wait on each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.max_words = path, max_words
        self.lower, self.pattern = _rule(path)
        self.single = Tokenizer.from_file(path)
        self.single.encode_special_tokens = True
        self.size = self.single.get_vocab_size()
        if self.pattern is not None:
            self.single.normalizer = None
            self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    @cached_property
    def whole(self):
        """The tokenizer as it is in the file, for whole texts."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def _forget(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(1 << 20, np.uint32)
        self.first = np.zeros(1 << 18, np.int64)
        self.count = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        found = [x.ids for x in self.single.encode_batch_fast(new, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum()))
        start, words = len(self.index) - len(new), len(self.index)
        while words > len(self.first):
            self.first, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.count))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[start:words] = self.used + np.cumsum(count) - count
        self.count[start:words] = count
        self.used += len(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.pattern is not None and not UNUSUAL.search(t)]
        rest = sorted(set(range(len(texts))) - set(plain))
        if rest:
            for i, found in zip(rest, self.whole.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = np.array(found.ids, np.uint32)
        if len(self.index) > self.max_words:
            self._forget()
        flat: list[np.ndarray] = []
        for i in plain:
            words = self.pattern.findall(texts[i].lower() if self.lower else texts[i])
            flat.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        self._learn()
        if not plain:
            return out
        words = np.concatenate(flat)
        count = self.count[words]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[words] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([len(f) for f in flat])]
        for i, part in zip(plain, np.split(ids, bounds[:-1])):
            out[i] = part
        return out


def _rule(path: str):
    """Whether texts are lower-cased, and the pre-token pattern, where both are of a known kind; else no pattern."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return False, LATIN[BYTE_LEVEL]
    steps = pre.get("pretokenizers", [])
    kinds = [s["type"] for s in (norm or {}).get("normalizers", [])]
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or kinds != ["NFC", "Replace", "Lowercase"]:
        return False, None
    split, level = steps
    known = split["behavior"] == "Removed" and split["invert"] and split["pattern"] == {"Regex": WORD_LEVEL}
    if not known or level.get("use_regex") or level.get("add_prefix_space"):
        return False, None
    return True, LATIN[WORD_LEVEL]


def encoder(path: str) -> TokenEncoder:
    """The worker's encoder of a file."""
    return common.kept(("token ids", path), lambda: TokenEncoder(path))
