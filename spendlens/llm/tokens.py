"""Encoding whole texts with public BPE vocabularies, each distinct word once per task."""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from array import array

import numpy as np
from tokenizers import Tokenizer

LATIN = 0x250  # below, letter case and character classes are simple and fixed
MEMO = 800_000  # words a process remembers at most, in two generations
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Byte-level vocabularies write a printable byte as itself and the others as the characters from 256 on.
OTHERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
BYTES = "".join(OTHERS.get(b, chr(b)) for b in range(256))
RARE = "\x1c\x1d\x1e\x1f"  # white space to some splitters only


def _class(first: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(LATIN) if unicodedata.category(chr(i))[0] == first)


class Words(dict):
    """A word's packed ids, computed when first asked for; words in use outlive a full memory of MEMO words."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word):
        if len(self) >= MEMO // 2:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        self[word] = ids = self.encode(word) if ids is None else ids
        return ids


class Encoder:
    """encode(text) -> packed ids, equal to the tokenizer's own for every text.

    Vocabularies split a text before they merge, so a Latin text is split as they do, and its words are
    encoded one by one and remembered.  A word and the signs around it are remembered apart, as most are
    rare together.  Where the split may differ (other scripts, odd white space, an unknown vocabulary) the
    tokenizer gets the text as it is.
    """

    def __init__(self, description: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        parts, lone = self._split(json.loads(description))
        self.lowered = parts == "dropped"
        self.wide = re.compile(f"[{RARE}{'İ' * self.lowered}ɐ-\U0010ffff]")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.parts, self.merge = re.compile(lone) if parts else None, self.tokenizer.model.tokenize
        # texts are split into lone parts; nothing is remembered by its place any more
        self.lone, self.first, self.later = (Words(self._part) for _ in range(3))

    @staticmethod
    def _split(d: dict) -> tuple[str | None, str]:
        """How the vocabulary splits texts: white space dropped, or kept in front of words."""
        letters, numbers = _class("L"), _class("N")
        pre = d.get("pre_tokenizer") or {}
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre]) if "type" in p]
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        if kinds == ["ByteLevel"] and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not d.get("normalizer"):
            return "kept", rf"{short}| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"
        norms = [n["type"] for n in (d.get("normalizer") or {}).get("normalizers", [])]
        if kinds == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
            if pre["pretokenizers"][0]["pattern"].get("Regex") == short + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                return "dropped", rf"{short}|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+"
        return None, ""

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        """The merges alone: a part is split, and folded where need be, already."""
        ids = [t.id for t in self.merge(codecs.charmap_decode(part.encode(), "strict", BYTES)[0])]
        return array(self.code, ids).tobytes()

    def _odd(self, text: str) -> bool:
        """Whether the text may be split otherwise than here; most texts are settled by plain searches."""
        try:
            text.encode("latin-1")
            return any(c in text for c in RARE)
        except UnicodeEncodeError:
            return self.wide.search(text) is not None or self.lowered and self.wide.search(text.lower()) is not None

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.parts is None or self._odd(text):
            return self._plain(text)
        return b"".join(map(self.lone.__getitem__, self.parts.findall(text.lower() if self.lowered else text)))
