"""Token ids of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64

import numpy as np

#: Rank file of the vocabulary; a parameter everywhere it is used.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern that cuts text before merging, as the vocabulary's makers published it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str = VOCABULARY) -> bytes:
    """The rank file, read on the driver and sent to the tasks (under 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


class Encoder:
    """Ids of a text, and back. ``end`` is the first free id."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self._coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values(), default=-1) + 1
        if self.end >= 2**16:
            raise ValueError("ids do not fit 16 bits")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._coder.encode_ordinary(text), np.uint16)

    def encoded(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text that became ``ids``."""
        return self._coder.decode_bytes(ids.tolist())

    def text(self, ids: np.ndarray) -> str:
        return self._coder.decode(ids[ids != self.end].tolist())
