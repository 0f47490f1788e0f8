"""Token counts by a public tokenizer; its folder and file are parameters, loaded once per worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

FOLDER, FILE = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(folder: str = FOLDER, file: str = FILE):
    """The byte-level tokenizer of a rank file, and the bytes of each of its tokens."""
    import tiktoken

    with open(f"{folder}/{file}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, np.int32)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def count(text: str | None, folder: str = FOLDER, file: str = FILE) -> int:
    return len(encoding(folder, file)[0].encode_ordinary(text)) if text else 0
