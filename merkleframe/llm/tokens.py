"""A public byte-level BPE vocabulary and its tokenizer."""

from __future__ import annotations

import base64
import os

VOCABULARY = os.environ.get("MERKLEFRAME_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the vocabulary's own tokenizer cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Piece -> id."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def tokenizer(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
