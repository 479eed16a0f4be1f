"""Token counts of texts under a byte-level BPE vocabulary of public files."""

from __future__ import annotations

import base64
import re

# Fixed value: how the vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# A blank between two non-blanks always begins a new piece of PATTERN, so texts can be cut there
# and the counts of the cuts added up.
_CUTS = re.compile(r" ?\S+|\s+(?!\S)|\s")


class TokenCounter(dict):
    """Counts of cut texts, kept for a bounded number of distinct cuts."""

    LIMIT = 400_000

    def __init__(self, vocabulary: str | bytes = VOCABULARY) -> None:
        import tiktoken

        super().__init__()
        raw = vocabulary if isinstance(vocabulary, bytes) else read_vocabulary(vocabulary)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, cut: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[cut] = len(self.encoding.encode_ordinary(cut))
        return value

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, _CUTS.findall(text)))


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The lines of a vocabulary file; jobs read it on the driver and send it along, a few megabytes at most."""
    with open(path, "rb") as lines:
        return lines.read()
