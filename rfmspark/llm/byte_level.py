"""Byte-level BPE from a tokenizers file, run through its merge ranks.

In such a vocabulary the merges stand in the order of the ids that they make, so the ids are ranks
and the rank encoder gives what the tokenizers library gives, several times faster. Both are the same
on every code point (``tests/llm/test_token_align.py``). Texts that the rank encoder can't take (very
long runs of white space overflow its pattern's stack) and texts that hold a special token's string,
where these count as tokens, go through the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re

import public_tokenizers
import tiktoken

_BLANKS = re.compile(r"\s{1000}")


def unicode_bytes() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 stands for itself, the other bytes are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Encoder of one file. ``specials_as_text``: strings of special tokens inside texts are plain text."""

    def __init__(self, path: str, specials_as_text: bool):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError(f"the merges of {path} don't stand in the order of their ids")
        byte = unicode_bytes()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.pieces: list[bytes] = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for text, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.pieces[i] = text
        self.ranks = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = specials_as_text
        self.special = [] if specials_as_text else list(special)

    def encode(self, text: str) -> list[int]:
        if _BLANKS.search(text) or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


_LOADED: dict[tuple[str, bool], ByteLevel] = {}


def byte_level(path: str | None = None, specials_as_text: bool = False) -> ByteLevel:
    """The encoder of ``path`` (default: the public 50k vocabulary); a worker's encoder lasts over its tasks."""
    key = (path or public_tokenizers.path("byte_bpe_50k.json"), specials_as_text)
    if key not in _LOADED:
        _LOADED[key] = ByteLevel(*key)
    return _LOADED[key]
