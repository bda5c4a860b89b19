"""Token ids of whole texts by a byte-level BPE tokenizer file.

The file is read by ``tokenizers``. Its vocabulary is handed to ``tiktoken``'s engine, which gives the same
ids in a third of the time; texts that the engine could treat differently or slowly (special tokens,
very long runs with or without white space) go to ``tokenizers`` itself, as do all texts where the file is of
another kind than the engine's (``_plain_byte_level``). ``tests/llm/test_packing.py``
holds the ids of both ways against each other.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: The pre-token pattern of byte-level BPE vocabularies of this kind (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer words, or more white space than this beyond one per word, may hold a run the engine is slow on.
LONG_WORD, LONG_SPACE = 400, 100


def _long_run(text: str) -> bool:
    words = list(map(len, text.split()))
    return not words or max(words) > LONG_WORD or len(text) - sum(words) - len(words) > LONG_SPACE


def _byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or the next free code point from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _plain_byte_level(file: dict) -> bool:
    """Whether the engine's pattern and merges by rank are what the file describes."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = not file.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or model.get("type") != "BPE" or model.get("ignore_merges") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    ranks = [model["vocab"].get("".join(pair), -1) for pair in pairs]
    return all(a < b for a, b in zip([-1, *ranks], ranks, strict=False))


class Encoder:
    """``ids(text)``: the token ids, without special tokens added, as a uint32 array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        symbols = _byte_symbols()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.engine = None
        if _plain_byte_level(file):
            ranks = {bytes(symbols[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
            self.engine = tiktoken.Encoding("gleanery", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, sorted(added)))) if added else None

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.engine is None or _long_run(text) or (self.special and self.special.search(text)):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.engine.encode_to_numpy(text, disallowed_special=())

    def count(self, text: str) -> int:
        return len(self.ids(text))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
