"""Tokenizer vocabularies, loaded once in each Python worker."""

from __future__ import annotations

import base64
import os
from functools import cache

import tiktoken

#: Folder of the vocabulary files, unless a caller names one.
FOLDER = os.environ.get("FERNWEFT_TOKENIZERS", "/opt/tokenizers")
#: Splits text into words, numbers, signs and spaces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def byte_bpe(path: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> tiktoken.Encoding:
    """A byte-level BPE from a file of ranks; it encodes any text without loss."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
