"""Token ids of whole texts by a public byte-level BPE vocabulary, Arrow batch by Arrow batch."""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

#: Texts of these characters alone split alike in both libraries; others go to the reference library.
_PLAIN = re.compile(r"[^\u0000-ɏ‐-‧€]")
_SPECIAL = "<|"


@functools.lru_cache(maxsize=4)
def _full(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _fast(path: str):
    """The same vocabulary and merges as ranks for the faster library: ids are ranks."""
    import public_tokenizers
    import tiktoken

    byte_of = {c: b for b, c in _byte_chars().items()}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if all(c in byte_of for c in piece)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def bpe_ids(text: str | None, path: str) -> list[int]:
    """Ids of the whole text without special tokens added; a null text is empty."""
    if not text:
        return []
    if _SPECIAL in text or _PLAIN.search(text):
        return _full(path).encode(text, add_special_tokens=False).ids
    return _fast(path).encode_ordinary(text)


def bpe_bytes(text: str | None, path: str) -> bytes:
    """bpe_ids as little-endian unsigned 32-bit numbers, without a list of them where the faster library serves."""
    if not text:
        return b""
    if _SPECIAL in text or _PLAIN.search(text):
        return np.array(_full(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return _fast(path).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
