"""Public tokenizers, loaded once per Python worker from files named by a parameter."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level BPE files write each byte as one printable character: itself, or the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = {chr(b): b for b in plain}, 0x100
    for b in range(256):
        if b not in plain:
            out[chr(spare)] = b
            spare += 1
    return out


@lru_cache(maxsize=2)
def encoder(name: str, engine: str = "tiktoken") -> Callable[[str], list[int]]:
    """Text -> ids of a byte-level BPE file of the `tokenizers` library, without special tokens.

    The file's vocabulary is run by tiktoken, which gives the ids that `tokenizers` gives (a test
    holds them against each other) at a quarter of the CPU time; engine="tokenizers" runs the original.
    """
    import public_tokenizers

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    if engine == "tokenizers":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    byte = _bytes_of_symbols()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
