"""Token ids of the byte-level BPE, as little-endian 32-bit bytes.

Where a tokenizer file's merges come in the order of their ids, merging by rank gives the ids that its
merge list gives, so its vocabulary is handed to tiktoken as ranks, which needs neither alignments nor
a cache. Texts that hold a special token's string, and files of another kind, go to the tokenizers
library, which a worker loads when it meets the first one.
"""

from __future__ import annotations

import functools
import json
import struct

import numpy as np

#: Appended to every document.
END_ID = 2
END = struct.pack("<I", END_ID)

#: The byte-level pre-tokenizer's pattern; runs are possessive, which changes no match.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters
    are themselves, the others follow from 256 on in their order."""
    own = {chr(b): b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    rest = [b for b in range(256) if chr(b) not in own]
    return own | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks; None where the file is not a plain byte-level BPE in merge order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {w: i for w, i in model["vocab"].items() if w not in added}
    byte = _bytes_of()
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(c not in vocab for c in byte) or merged != sorted(set(merged)) or len(merged) + 256 != len(vocab) or merged[0] < 0:
        return None
    return {bytes(byte[c] for c in w): i for w, i in vocab.items()}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        own = ranks(path)
        self.split = None if own is None else tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=own, special_tokens={})
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_padding()
        library.no_truncation()
        return library

    def __call__(self, text: str) -> bytes:
        if self.split is None or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.split.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One a worker process."""
    return Encoder(path)
