"""Token counts by rank-synchronous array merging.

Each batch is cut into its distinct pre-tokens, which are held as one ragged array of symbols. In each round every
sequence finds its pair of lowest rank and all sequences merge theirs at once; sequences without a known pair leave. What
survives of a sequence is its number of tokens.
"""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from wayfold.llm.arrow import map_texts
from wayfold.llm.pretokens import Splitter, sums

NEVER = np.iinfo(np.int32).max


class MergeTable:
    """Ranks and results of the merges of a byte-level vocabulary file (``.json``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte_ids = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols are left of each piece."""
        left = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), left)
        while len(symbols) > 1:
            rank = self.rank(symbols[:-1], symbols[1:])
            rank[owner[1:] != owner[:-1]] = NEVER
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(np.append(rank, NEVER), heads)
            sizes = np.diff(np.append(heads, len(owner)))
            hit = (rank != NEVER) & (rank == np.repeat(best, sizes)[:-1])
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # of overlapping hits (one symbol repeated), every second merges, from the left
            chain = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1))
            place = np.arange(len(at)) - np.repeat(chain, np.diff(np.append(chain, len(at))))
            at = at[place % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(best != NEVER, sizes)
            keep[at + 1] = False
            left -= np.bincount(owner[at], minlength=len(left))
            symbols, owner = symbols[keep], owner[keep]
        return left


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def library_splitter() -> Splitter:
    from tokenizers.pre_tokenizers import ByteLevel

    pieces = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    return Splitter(lambda first, char: len(pieces(first + char)) == 1)


class Counter:
    """Counts tokens of texts; special strings count as one token each, as the library's default has it."""

    def __init__(self, path: str, cache: int = 500_000):
        self.table, self.splitter, self.known, self.cache = MergeTable(path), library_splitter(), {}, cache

    def _segments(self, text: str) -> tuple[list[str], int]:
        """The text around special strings, the earliest first and of those the longest; how many there were."""
        parts, found = [text], 0
        if any(s in text for s in self.table.specials):
            parts, rest = [], text
            while at := [(rest.find(s), -len(s)) for s in self.table.specials if s in rest]:
                start, size = min(at)
                parts.append(rest[:start])
                rest, found = rest[start - size :], found + 1
            parts.append(rest)
        return parts, found

    def counts(self, texts: list[str]) -> np.ndarray:
        split = [self._segments(t) for t in texts]
        flat = [p for parts, _ in split for p in parts]
        pieces, number, per_segment = self.splitter.distinct(flat)
        known = self.known
        if new := [p for p in pieces if p not in known]:
            if len(known) + len(new) > self.cache:
                known.clear()
                new = pieces
            known.update(zip(new, self.table.survivors([p.encode() for p in new]).tolist()))
        each = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))
        by_segment = sums(each[number], per_segment)
        return sums(by_segment, np.array([len(p) for p, _ in split], np.int64)) + np.array([k for _, k in split], np.int64)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``df``.

    One pass without a shuffle; memory is that of one chunk of text, and a very long text is a chunk of its own. A null text counts as empty: 0 bytes, 0 tokens. Rows
    with equal or null ids stay as they are, one result each. An empty table gives an empty result. Other columns are
    not read, so their names don't matter. ``path`` is a byte-level ``.json`` vocabulary, readable on every executor.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def make():
        counter = Counter(path)

        def work(ids, texts):
            n = counter.counts(texts) if texts else np.zeros(0, np.int64)
            return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": n > limit}

        return work

    kind = df.select(f"`{id_col}`").dtypes[0][1].replace("bigint", "long")
    return map_texts(df, id_col, text_col, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", make)
