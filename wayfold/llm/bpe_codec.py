"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are cut into pattern matches, each distinct match of a batch is encoded once by the library (which sees it as one
word, so no match is merged with its neighbour), and the ids are dealt back to the texts. Offsets are those of bytes and,
through the byte-to-character map of a text, of characters. Decoding looks ids up in the reversed byte table; a character
that is split between tokens appears only once all of its bytes have come.
"""

from __future__ import annotations

import base64
import hashlib
import os
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import map_texts
from wayfold.llm.pretokens import Splitter
from wayfold.llm.token_counts import byte_characters


#: Distinct pattern matches whose ids a worker keeps; bytes of text that are cut into matches at once.
CACHE, AT_ONCE = 400_000, 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merges behind a rank file, in order: each token's last merge is that of the two parts it has before its own rank counts."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                out.append((parts[0], parts[1]))
    return out


def pattern_splitter() -> Splitter:
    """Classes of code points as tiktoken sees them: it merges two bytes only within one match of the pattern."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {first + bytes([b]): 256 + k for k, (first, b) in enumerate((x, b) for x in (b"a", b"1", b"!") for b in range(256))}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Splitter(lambda first, char: len(probe.encode_ordinary(first + char)) == len(char.encode()))


class Codec:
    """Encodes and decodes by a rank file; cached in a Python worker, as its tables take a second to build."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        shown = byte_characters()
        show = lambda b: "".join(shown[x] for x in b)
        self.tokenizer = Tokenizer(models.BPE(vocab={show(b): r for b, r in ranks.items()}, merges=[(show(a), show(b)) for a, b in merges_of(ranks)]))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.splitter = pattern_splitter()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Places in the cache of the pieces' ids; pieces that it doesn't have yet are encoded by the library."""
        if len(self.known) > CACHE:
            self._forget()
        known = self.known
        if new := [p for p in pieces if p not in known]:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            size = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(encoded), np.uint32, int(size.sum()))))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    @classmethod
    def get(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces, number, sizes = self.splitter.distinct(texts)
        if not pieces:
            return [np.zeros(0, np.uint32) for _ in texts]
        place = self._learn(pieces)[number]
        count = self.size[place]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.at[place] - (ends - count), count) + np.arange(int(ends[-1]))]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(first, end) of each id in characters of the text; ids that share a split character all cover it."""
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(text))  # byte to character
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids.tolist()]).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1]))[: len(ends)].astype(np.int64)
        return np.stack([character[starts], character[ends - 1] + 1], 1) if len(ends) else np.zeros((0, 2), np.int64)

    def pieces(self, ids: np.ndarray) -> list[str]:
        """The text that each id completes; bytes of a split character wait for the rest of it."""
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        ids = ids.tolist()
        return [reader.decode(self.bytes_of[i], k == len(ids) - 1) for k, i in enumerate(ids)]


def _id_kind(df: DataFrame, id_col: str) -> str:
    return df.select(f"`{id_col}`").dtypes[0][1].replace("bigint", "long")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """``doc_id, ids array<int>`` and, if asked for, ``starts, ends array<int>`` in characters; one row for each row of ``df``.

    A null or empty text has no ids. Rows with repeated or null ids stay; an empty table gives an empty result; other
    columns are not read. No shuffle; memory is that of one chunk of text, and a very long text is a chunk of its own.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        codec = Codec.get(path)

        def work(ids, texts):
            out = {"doc_id": ids, "ids": (coded := codec.encode(texts))}
            if offsets:
                spans = [codec.offsets(t, x) for t, x in zip(texts, coded)]
                out |= {"starts": [s[:, 0] for s in spans], "ends": [s[:, 1] for s in spans]}
            return out

        return work

    more = ", starts array<int>, ends array<int>" if offsets else ""
    return map_texts(df, id_col, text_col, f"doc_id {_id_kind(df, id_col)}, ids array<int>{more}", make, AT_ONCE)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded`` (bytes) and ``decoded_text`` (null where the bytes aren't UTF-8) added; null ids give nulls."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("binary")
    def read(ids: pd.Series) -> pd.Series:
        codec = Codec.get(path)
        return ids.map(lambda x: None if x is None else codec.decode(np.asarray(x, np.uint32)))

    out = df.withColumn("decoded", read(F.col(ids_col)))
    return out.withColumn("decoded_text", F.when(F.is_valid_utf8(F.col("decoded").cast("string")), F.col("decoded").cast("string")))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the encoded ids and what they decode to, as digests, in one pass.

    Nulls, empty and very long texts, repeated rows and empty tables are as in :func:`encode`; ties do not arise.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        codec = Codec.get(path)

        def work(ids, texts):
            coded = codec.encode(texts)
            return {
                "doc_id": ids,
                "n_tokens": [len(x) for x in coded],
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in coded],
            }

        return work

    return map_texts(df, id_col, text_col, f"doc_id {_id_kind(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string", make, AT_ONCE)
