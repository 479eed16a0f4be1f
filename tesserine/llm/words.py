"""Words, word hashes and shingles of texts."""

from __future__ import annotations

import json
import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
LETTERS_DIGITS = re.compile(r"[^\W_]+")


class WordHashes(dict):
    """64-bit hashes of words, kept for a bounded number of distinct words."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def tree_text(raw: str | None) -> str:
    """The `text` values of a JSON tree in document order, joined by a blank.

    A string that holds a JSON tree stands for it; what is not valid JSON has no text.
    """
    if not raw:
        return ""
    try:
        tree = json.loads(raw)
        while isinstance(tree, str):
            tree = json.loads(tree)
    except (ValueError, RecursionError):
        return ""
    texts, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            for key, value in reversed(node.items()):
                if key == "text" and isinstance(value, str):
                    stack.append((value,))
                elif isinstance(value, (dict, list)):
                    stack.append(value)
        elif isinstance(node, list):
            stack.extend(x for x in reversed(node) if isinstance(x, (dict, list)))
        elif isinstance(node, tuple):
            texts.append(node[0])
    return " ".join(texts)


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the sequences of `size` consecutive words."""
    if len(hashes) < size:
        return np.empty(0, dtype=np.uint64)
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        mixed = hashes[:n].copy()
        for i in range(1, size):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _A + hashes[i : i + n]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _B
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)
