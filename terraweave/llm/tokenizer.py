"""Public tokenizers read from vocabulary files; none is trained."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Fixed value: the pattern by which the byte-level vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary files lie; every executor must have them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The first id after the vocabulary is free and pads matrices.
PAD = 50256
#: Pieces of one text that the encoder gets at once, cut where a space follows a letter.
PIECE = 1 << 16


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text; null and empty texts have none. Long texts go piece by piece.

    A piece ends before a space that follows a letter, where the pattern always cuts.
    """
    if not text:
        return np.zeros(0, np.uint16)
    enc = encoder(path)
    if len(text) <= PIECE:
        return np.array(enc.encode_ordinary(text), np.uint16)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha()):
            end += 1
        out.append(np.array(enc.encode_ordinary(text[at:end]), np.uint16))
        at = end
    return np.concatenate(out)


def decode(ids, path: str = VOCABULARY) -> str:
    return encoder(path).decode([int(i) for i in ids])
