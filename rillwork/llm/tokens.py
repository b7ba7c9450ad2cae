"""Token ids of whole texts inside Spark tasks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The end-of-text token of the byte-level vocabulary, and its string, which counts as that token wherever a text has it.
SPECIAL = {"<|endoftext|>": 50256}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoding(path: str):
    """The encoder of a rank file; a task reads it once."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def ids_of(texts: pa.Array, path: str, end: int) -> Iterator[np.ndarray]:
    """The ids of each text as unsigned 32-bit numbers, then `end`."""
    encode = encoding(path).encode_to_numpy
    for text in pc.fill_null(texts, "").to_pylist():
        yield np.append(encode(text, allowed_special="all"), np.uint32(end)).astype("<u4", copy=False)
