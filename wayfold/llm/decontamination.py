"""Benchmark decontamination with an Aho-Corasick automaton.

Test items are normalised to lower-case words and cut into windows of ten. The patterns of the one automaton are stretches
of the items, every fifth word one of six words: each window holds one of them whole. It runs once over each normalised
text, and where a stretch occurs the windows around it are looked up. Hits come with the words they cover, and through the
word's place in the original bytes with offsets in the original text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import chunks, map_rows, released, to_arrow
from wayfold.llm.scratch import Scratch

#: Bytes of test items in one automaton, which takes about a hundred times as many; more items are taken in blocks, each
#: with an automaton and a pass of its own.
BLOCK_BYTES = 1_000_000
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words: runs of ASCII letters (lower-cased), digits and whatever isn't ASCII."""
    return text.encode().translate(_TABLE).split()


class Automaton:
    """All windows of the items; ``scan`` gives what of a text they cover and which items occur in it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.window, self.step = window, (window + 1) // 2
        self.size = window - self.step + 1  # words of a stretch
        self.windows: dict[bytes, tuple[str, ...]] = {}
        brief: dict[bytes, list] = {}  # items of fewer words than a window
        patterns: dict[bytes, int] = {}
        for item, text in items:
            words = words_of(text)
            if 0 < len(words) < window:
                key = b" ".join(words)
                brief.setdefault(key, []).append(item)
                patterns[key] = len(words)
            for i in range(len(words) - window + 1):
                key = b" ".join(words[i : i + window])
                who = self.windows.get(key, ())
                if item not in who:
                    self.windows[key] = (*who, item)
            for i in range(0, len(words) - self.size + 1 if len(words) >= window else 0, self.step):
                patterns[b" ".join(words[i : i + self.size])] = self.size
        self.machine = ahocorasick.Automaton()
        for key, size in patterns.items():
            self.machine.add_word(f" {key.decode('latin-1')} ", (size, tuple(brief.get(key, ()))))
        if patterns:
            self.machine.make_automaton()
        self.empty = not patterns

    _last: tuple = (None, None)

    @classmethod
    def of(cls, part, window: int) -> Automaton:
        """That of a broadcast block; a worker keeps the last one, as its next tasks need it again."""
        name, items = part.value
        if cls._last[0] != (name, window):
            cls._last = (None, None)
            cls._last = ((name, window), cls(items, window))
        return cls._last[1]

    def scan(self, text: str) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, maximal covered runs of words as (first, end), items that occur."""
        words = words_of(text)
        none = np.zeros((0, 2), np.int64)
        if self.empty or not words:
            return len(words), none, set()
        line = b" " + b" ".join(words) + b" "
        met = list(self.machine.iter(line.decode("latin-1")))
        if not met:
            return len(words), none, set()
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        last = np.searchsorted(blanks, [end for end, _ in met]).tolist()  # the number of words up to there
        runs, found, tried = [], set(), -1
        for end, (_, (size, brief)) in zip(last, met):
            if brief:
                runs.append((end - size, end))
                found.update(brief)
            if size == self.size:
                low = max(0, tried + 1, end - self.window)
                tried = max(tried, min(end - size, len(words) - self.window))
                for i in range(low, tried + 1):
                    if who := self.windows.get(b" ".join(words[i : i + self.window])):
                        runs.append((i, i + self.window))
                        found.update(who)
        return len(words), merged(*np.array(runs, np.int64).T) if runs else none, found


def merged(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs of the given (not empty) runs, touching ones joined."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], first[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return np.stack([first[at], reach[np.append(at[1:] - 1, len(reach) - 1)]], 1)


def original_offsets(text: str, runs: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words."""
    data = np.frombuffer(text.encode(), np.uint8)
    word = np.frombuffer(bytes(text.encode()).translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    character = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(text))
    return [(int(character[starts[a]]), int(character[ends[b - 1]])) for a, b in runs.tolist()]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of a bounded size, streamed through the driver; rows without text are left out."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`")).where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{item_col}`").isNotNull())
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        n = len(text.encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def contaminated_words(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, first_hits, end_hits`` for each row of ``docs``.

    ``first_hits`` and ``end_hits`` are character offsets of the covered runs in the original text. A test set within one
    block, the usual case, takes one pass and no shuffle. Items beyond ``block_bytes`` are taken in further passes, one
    block at a time; what these find is united by the digest of the text, whatever the ids. Null and empty texts have no
    words; items without words or with a null id or text match nothing; repeated rows, ids and null ids each get their own
    result. A very long text must fit in a worker with its words. Empty tables give no rows or no hits. Other columns are
    not read.
    """
    id_kind = docs.select(f"`{id_col}`").dtypes[0][1].replace("bigint", "long")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return rows.mapInArrow(_scan(_sent(docs, first), window, id_kind, RESULT), f"doc_id {id_kind}, {_RESULT}")
    scratch = Scratch(docs.sparkSession, "decontamination")
    runs = scratch.keep(_keyed(rows).mapInArrow(_scan(_sent(docs, first), window, id_kind, RUNS), f"doc_id {id_kind}, {_RUNS}"))
    more = _further(rows, chain([second], parts), window, id_kind, scratch)
    more = more.groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in _LISTS))
    lists = (F.concat(c, F.coalesce(f"more_{c}", F.array().cast("array<string>" if c == "items" else "array<bigint>"))).alias(c) for c in _LISTS)
    united = runs.join(more, "key", "left").select("doc_id", "key", "n_words", *lists)
    return united.mapInArrow(_unite(id_kind), f"doc_id {id_kind}, {_RESULT}")


def _sent(docs: DataFrame, block: list[tuple[str, str]]):
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the digest of the text, which stands for it when passes are united."""
    return rows.withColumn("key", F.concat(F.md5(F.col("text").cast("binary")), F.octet_length("text").cast("string")))


def _further(rows: DataFrame, parts: Iterator[list[tuple[str, str]]], window: int, id_kind: str, scratch: Scratch) -> DataFrame:
    """Runs of further blocks by the texts' digests, only of texts with any; one block is held at a time."""
    found = None
    for block in parts:
        part = _sent(rows, block)
        one = scratch.keep(_keyed(rows).mapInArrow(_scan(part, window, id_kind, HITS), f"doc_id {id_kind}, {_RUNS}").dropDuplicates(["key"]))
        part.destroy()
        found = one if found is None else found.unionByName(one)
    return found


RESULT, RUNS, HITS = range(3)
_LISTS = ("a", "b", "u", "v", "items")
_RUNS = "key string, n_words long, a array<long>, b array<long>, u array<long>, v array<long>, items array<string>"
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, first_hits array<long>, end_hits array<long>"


def _result(ids, n_words, runs, offsets, items) -> dict:
    n_hit = [int((r[:, 1] - r[:, 0]).sum()) for r in runs]
    return {
        "doc_id": ids,
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": [len(x) for x in items],
        "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
        "contaminated": [n > 0 for n in n_hit],
        "first_hits": [[a for a, _ in o] for o in offsets],
        "end_hits": [[b for _, b in o] for o in offsets],
    }


def _scan(part, window: int, id_kind: str, gives: int):
    schema = to_arrow(f"doc_id {id_kind}, {_RESULT if gives == RESULT else _RUNS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            machine = Automaton.of(part, window)
            at = 0
            for ids, texts in chunks(batch.column(0), batch.column(1)):
                found = [machine.scan(t) for t in texts]
                offsets = [original_offsets(t, r) if len(r) else [] for t, (_, r, _) in zip(texts, found)]
                if gives == RESULT:
                    out = _result(ids, [n for n, _, _ in found], [r for _, r, _ in found], offsets, [x for _, _, x in found])
                else:
                    out = {"doc_id": ids, "key": batch.column(2).slice(at, len(ids)), "n_words": [n for n, _, _ in found], "a": [r[:, 0] for _, r, _ in found], "b": [r[:, 1] for _, r, _ in found]}
                    out |= {"u": [[a for a, _ in o] for o in offsets], "v": [[b for _, b in o] for o in offsets], "items": [sorted(x) for _, _, x in found]}
                at += len(ids)
                rows = pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)
                yield rows.filter(pa.array([len(r) > 0 for _, r, _ in found], pa.bool_())) if gives == HITS else rows

    return released(run)


def _unite(id_kind: str):
    schema = to_arrow(f"doc_id {id_kind}, {_RESULT}")

    def join(a: list, b: list) -> np.ndarray:
        return merged(np.array(a, np.int64), np.array(b, np.int64)) if a else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            runs = [join(a, b) for a, b in zip(x["a"], x["b"])]
            offsets = [join(a, b).tolist() for a, b in zip(x["u"], x["v"])]
            out = _result(x["doc_id"], x["n_words"], runs, offsets, [set(i) for i in x["items"]])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no window of an item; null texts stay.

    One pass over ``docs`` and no shuffle for a test set within one block; of further blocks the digests of the texts that
    they hit are kept away by a join. Ids aren't used. Repeated rows stay or go alike; an empty table stays empty.
    """
    parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(parts), next(parts, None)
    part = _sent(docs, first)

    def make():
        machine = Automaton.of(part, window)

        def clean(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            return rows.filter(pa.array([not t or not len(machine.scan(t)[1]) for t in texts.to_pylist()], pa.bool_()))

        return clean

    out = map_rows(docs, text_col, make)
    if second is None:
        return out
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hit = _further(rows, chain([second], parts), window, "long", Scratch(docs.sparkSession, "decontamination")).select(F.col("key").alias("_key")).distinct()
    mine = F.concat(F.md5(F.col(f"`{text_col}`").cast("binary")), F.octet_length(f"`{text_col}`").cast("string"))
    return out.join(hit, mine == F.col("_key"), "left_anti")
