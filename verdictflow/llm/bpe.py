"""A deterministic tokenization automaton for BPE with word ends, encoding and decoding.

The automaton reads tokens. It starts with one state that takes every base symbol back to itself and
grows by one gadget a merge (u, v) -> w, in merge order: all arcs of u lead to one state s; if s takes
v, s is split into a copy s' without the arc v, the arcs of u are led to s', and wherever there is an
arc u there is now an arc w, leading where v led. What is left accepts exactly the token sequences
that the merges produce.

A state thus is its parent minus one arc, and is held so: states are grouped in lineages, one for
each left part u, a lineage hangs on the state that it was split from, and an arc is looked up along
the lineages and along the left parts of its label; the arcs that a text needs are entered in the
transition table as they are met. A word is encoded position by position: each prefix has one correct
tokenization, so one state; decoding emits the arcs' labels.

Defined results: a null text is the empty text, without tokens; special tokens' strings in a text are
one token each, as the library has it; repeated rows and ids are encoded row by row; extra columns
are ignored; an empty table gives an empty table; words of any length take time in proportion.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, texts_of
from .splits import RARE, plain

WORD_END = "</w>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[LETTERS]+|[NUMBERS]|[^\sLETTERSNUMBERS]+"
#: Words and transitions that a worker remembers; both start anew beyond them. Longer words aren't kept.
CACHE_WORDS, CACHE_ARCS, CACHE_CHARS = 400_000, 2_000_000, 48


def byte_chars() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself where it is
    printable Latin-1, else the next free code point from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in keep else free))
        free += b not in keep
    return out


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        self.labels = [""] * self.size
        for token, i in vocab.items():
            self.labels[i] = token
        n = self.size
        self.born = [-1] * n  # the merge that made a token; -1: a base symbol
        self.left = [-1] * n
        self.alive = [True] * n  # some arc bears the token
        self.without: list[dict[int, int] | None] = [None] * n  # per lineage: arc -> the merge that removed it
        self.hangs: list[tuple[int, int]] = [(-1, -1)] * n  # lineage -> (lineage, newest merge) of the state it was split from
        self.state = [(-1, -1)] * n  # where a token's arcs lead: (lineage, newest merge in it); (-1, -1): the start
        self.table: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self.table.clear()
        # only base symbols and what merges made can be met
        self.tokens = {t: i for t, i in vocab.items() if self.alive[i]}
        self.longest = max(len(t.removesuffix(WORD_END)) for t in self.tokens)

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.born[w], self.left[w] = rank, u
        self.alive[w] = self.alive[u] and self.alive[v] and self._takes(self.state[u], v)
        if not self.alive[w]:
            return
        self.state[w] = self.state[v]
        if self.state[u][0] != u:  # the first split of u's state begins its lineage
            self.hangs[u], self.without[u] = self.state[u], {}
        self.without[u][v] = rank
        self.state[u] = (u, rank)

    def _takes(self, state: tuple[int, int], x: int) -> bool:
        """Whether a state has an arc x: no split on the way to it removed x, or the left part that
        stood for x when x was not made yet."""
        lineage, upto = state
        while lineage >= 0:
            gone, y, limit = self.without[lineage], x, upto
            while y >= 0:
                if gone.get(y, limit + 1) <= limit:
                    return False
                limit = min(upto, self.born[y])
                y = self.left[y]
            lineage, upto = self.hangs[lineage]
        return True

    def arc(self, last: int, x: int) -> bool:
        """Whether x may follow the token last."""
        key = last * self.size + x
        known = self.table.get(key)
        if known is None:
            if len(self.table) > CACHE_ARCS:
                self.table.clear()
            known = self.table[key] = self._takes(self.state[last], x)
        return known

    def encode(self, word: str) -> tuple[int, ...]:
        """The ids of a word of byte characters."""
        n, tokens, arc = len(word), self.tokens, self.arc
        last, came = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            end = WORD_END if i == n else ""
            for j in range(max(0, i - self.longest), i):
                t = tokens.get(word[j:i] + end)
                if t is not None and (not j or (last[j] >= 0 and arc(last[j], t))):
                    last[i], came[i] = t, j
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i = came[i]
        return tuple(reversed(out))

    def decode(self, ids) -> list[str]:
        return list(map(self.labels.__getitem__, ids))


class _Words(dict):
    def __init__(self, automaton: Automaton, chars: list[str] | None):
        super().__init__()
        self.automaton, self.chars = automaton, chars

    def __missing__(self, word: str) -> tuple[int, ...]:
        seen = word if self.chars is None else "".join(map(self.chars.__getitem__, word.encode()))
        ids = self.automaton.encode(seen)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordBpe:
    """The tokenizer of a tokenizers file with a word-end BPE; only its normalizer and pre-tokenizer
    are the library's, and these only for texts with rare characters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ascii, self.split = plain(SPLIT, True), plain(SPLIT, False)
        self.words, self.pieces = _Words(self.automaton, byte_chars()), _Words(self.automaton, None)
        self.numbers = [str(i) for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.shown = self.automaton.labels + [""] * (len(self.numbers) - len(self.automaton.labels))
        for content, i in self.special.items():
            self.shown[i] = content

    def _plain(self, text: str) -> list[int]:
        if RARE.search(text):
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return list(chain.from_iterable(self.pieces[p] for p, _ in split))
        # NFC leaves these characters as they are, and white space only parts words
        split = self.ascii if text.isascii() else self.split
        return list(chain.from_iterable(map(self.words.__getitem__, split(text.lower()))))

    def encode(self, text: str) -> list[int]:
        if "<|" not in text or not self.cut:
            return self._plain(text)
        out: list[int] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [self.special[part]] if i % 2 else self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Arc labels joined by blanks, as the library does without a decoder."""
        return " ".join(map(self.shown.__getitem__, ids))


@functools.lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    """One a worker process."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document, a narrow map: doc_id, n_tokens, ids_sha256, decoded_sha256; ids and the
    decoded text as well if keep."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def make():
        bpe = word_bpe(path)

        def step(batch):
            out = {k.split()[0]: [] for k in fields.split(", ")}
            for text in texts_of(batch):
                ids = bpe.encode(text)
                said, decoded = " ".join(map(bpe.numbers.__getitem__, ids)), bpe.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep:
                    out["ids"].append(ids), out["decoded"].append(decoded)
            yield {"doc_id": batch.column("doc_id")} | out

        return step

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), f"doc_id {kind}, {fields}", make)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
