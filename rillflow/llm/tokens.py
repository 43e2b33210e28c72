"""Byte-level BPE from a tokenizers JSON file whose path is a parameter."""

from __future__ import annotations

import json

import numpy as np

_LOADED: dict[str, object] = {}
#: The split pattern that a ByteLevel pre-tokenizer stands for (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The format's printable stand-ins for bytes: printable Latin-1 stands for itself, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Ids of the BPE in a tokenizers JSON file. added: texts are split at the file's added tokens, which get their ids, as
    the library does by default; otherwise their strings are ordinary text, as with its encode_special_tokens.

    The vocabulary is read from the file in each worker and encoded with tiktoken, several times as fast as the library
    that the file is for, with the same ids (tests hold them against it, both ways).
    """

    def __init__(self, path: str, added: bool = False):
        self.path, self.added = path, added
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normaliser is needed")
        if added and any(x.get(f) for x in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must stand for exactly their strings")
        names = sorted(x["content"] for x in spec["added_tokens"])
        if added and any(b.startswith(a) for a, b in zip(names, names[1:], strict=False)):
            raise ValueError("no added token may begin another")
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])

    def _encoder(self):
        if self.path not in _LOADED:
            import tiktoken

            with open(self.path, encoding="utf-8") as f:
                spec = json.load(f)
            special, to_byte = {x["content"]: x["id"] for x in spec["added_tokens"]}, _byte_of()
            ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            _LOADED[self.path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        return _LOADED[self.path]

    def encode(self, text: str) -> np.ndarray:
        encoder = self._encoder()
        return np.array(encoder.encode(text, allowed_special="all") if self.added else encoder.encode_ordinary(text), np.uint32)
