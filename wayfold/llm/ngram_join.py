"""N-gram Jaccard join: documents whose sets of word shingles are alike, as connected classes.

Shingles have one global order: those seen rarely come before those counted often, then by hash. Two sets that are alike
enough share a shingle among the first fifth of both (the prefix), so prefixes deal the candidates out. A candidate pair
is decided in a prefix tree: the sets to compare with one set, in reversed global order so that near copies run together,
are walked in lexicographic order, each continuing from the overlap counted up to where it leaves its predecessor, and a
subtree is left as soon as what remains can't reach the overlap that is needed.

Pairs are never written out. Equal sets are one node from the start. Every shared shingle names the node whose prefix is
shared most (in a group of near copies the one that was hardly changed) as its hub; the nodes that share a shingle are then
in the block of its hub, so each pair of candidates meets in one block at least, and a node is in few blocks. First all
nodes of a block are compared with the hub. Most are linked with it; only those that are not, and all nodes of their
block, are compared with each other, in parts of a bounded size that are spread over tasks, so that no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import map_texts, released, to_arrow
from wayfold.llm.components import components
from wayfold.llm.pretokens import mixed, span_hashes
from wayfold.llm.scratch import Scratch

#: Shingles counted at least so often may be taken for frequent; of those the most frequent, so many at most (this bounds
#: what is broadcast; which ones they are moves shingles within prefixes but changes no link); from this power of two on,
#: the rows of a shingle don't meet in one task.
FREQUENT, MOST_FREQUENT, HOT = 4, 1 << 18, 8
#: Prefixes are longer by so many shingles less one; alike sets then share as many, or all if they have fewer.
COMMON = 4
#: Groups up to this size are searched for partners exactly.
SEARCHED = 300
#: Counting takes the lower half of all hashes, which come first in prefixes; of sets up to ``BRIEF``, whose prefixes reach
#: into the upper half, all. In the global order the upper half begins with class ``UPPER``.
COUNTED, BRIEF, UPPER = np.uint64(1 << 63), 64, 100
PRINT_BITS, SET_BYTES = 44, 6
#: Buckets of prints: a bucket is counted in one piece, so their number grows with the input (bytes for each, bits at least and most).
BUCKET_INPUT, BUCKET_BITS = 1 << 25, (12, 20)
#: Sets on either side of a part of a block, on average; parts in which the rows of a hot shingle come to a join.
PART, PARTS = 1000, 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; fewer words than ``width`` make one shingle."""
    data = _LOWER[np.frombuffer("\n".join(texts).encode() + b"\n", np.uint8)]
    blank = _BLANK[data]
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = span_hashes(data, starts, ends)
    sizes = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))).tolist()
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            full = full * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - width + 1 + k]
        full = mixed(full)
        out = []
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= width:
                out.append(np.unique(full[a : b - width + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = h * np.uint64(0xD1342543DE82EF95) + w
                out.append(mixed(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Prints of the most frequent counted shingles, sorted, and the power of two of each one's count."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = min(BUCKET_BITS[1], max(BUCKET_BITS[0], (size // BUCKET_INPUT).bit_length()))
    shift, low = np.uint64(64 - PRINT_BITS), np.uint64((1 << (PRINT_BITS - bits)) - 1)

    def make():
        def work(ids, texts):
            sets = shingle_sets(texts, width)
            prints = np.concatenate([*(s if len(s) <= BRIEF else s[s < COUNTED] for s in sets), np.zeros(0, np.uint64)]) >> shift
            prints.sort()
            bucket = (prints >> np.uint64(PRINT_BITS - bits)).astype(np.int64)
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            low_bits = (prints & low).astype("<u4")
            return {"bucket": bucket[at], "prints": [x.tobytes() for x in np.split(low_bits, at[1:])] if len(at) else []}

        return work

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(b: int, parts: list[bytes]) -> pa.RecordBatch:
            prints, n = np.unique(np.frombuffer(b"".join(parts), "<u4"), return_counts=True)
            often = n >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array((b << (PRINT_BITS - bits)) | prints[often].astype(np.int64)), pa.array(n[often])], names=["print", "n"])

        last, parts = None, []
        for batch in batches:  # in order of the buckets
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != last and parts:
                    yield counted(last, parts)
                    parts = []
                last = b
                parts.append(x)
        if parts:
            yield counted(last, parts)

    dealt = map_texts(docs, id_col, text_col, "bucket long, prints binary", make).repartition("bucket").sortWithinPartitions("bucket")
    rows = dealt.mapInArrow(released(count), "print long, n long").orderBy(F.desc("n"), "print").limit(MOST_FREQUENT).toPandas().sort_values("print")
    return rows["print"].to_numpy(np.uint64), np.log2(np.maximum(rows["n"].to_numpy(np.float64), 1)).astype(np.uint8)


def rank_classes(sets: list[np.ndarray], prints: np.ndarray, powers: np.ndarray) -> list[np.ndarray | None]:
    """For each set the class of each shingle in the global order, which goes by class, then by hash; None if it goes by hash alone.

    Lower half: 0, or the power of two of a frequent one's count; upper half: the same, and ``UPPER`` more.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    kind = np.where(flat < COUNTED, np.uint8(0), np.uint8(UPPER))
    if len(prints):
        mine = flat >> np.uint64(64 - PRINT_BITS)
        at = np.minimum(np.searchsorted(prints, mine), len(prints) - 1)
        kind += np.where(prints[at] == mine, powers[at], np.uint8(0))
    ends = np.cumsum(sizes).tolist()
    return [k if (k % UPPER).any() else None for k in (kind[e - n : e] for e, n in zip(ends, sizes.tolist()))]


def _nodes(docs: DataFrame, id_col: str, text_col: str, width: int, often) -> DataFrame:
    """``doc_id, uid, sig, n, dropped, prefix, pos, hot``; the last three only with the first row of a set that a task meets.

    ``uid`` is the hash of the text. Alike sets share so many shingles of their prefixes; where a set's prefix has fewer hot
    ones, it meets its partners by others too, and its hot ones are dropped.
    """

    def make():
        prints, powers = often.value
        seen: set[int] = set()

        def work(ids, texts):
            sets = shingle_sets(texts, width)
            out = {k: [] for k in ("sig", "dropped", "prefix", "pos", "hot")}
            for s, kind in zip(sets, rank_classes(sets, prints, powers)):
                n = len(s)
                sig = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if n else None
                out["sig"].append(sig)
                if not n or sig in seen:
                    for k in ("dropped", "prefix", "pos", "hot"):
                        out[k].append(None)
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(sig)
                least = -(-4 * n // 5)
                size = min(n, n - least + COMMON)
                order = np.arange(size) if kind is None else np.lexsort((s, kind))[:size]
                hot = np.zeros(size, bool) if kind is None else kind[order] % UPPER >= HOT
                place, n_hot = np.arange(size, dtype=np.int32), int(hot.sum())
                drop = 0 < n_hot < min(COMMON, least)
                if drop:
                    order, place, hot = order[~hot], place[~hot], hot[~hot]
                out["dropped"].append(n_hot if drop else 0)
                out["prefix"].append(s[order].view(np.int64))
                out["pos"].append(place)
                out["hot"].append(place[hot])
            return {"doc_id": ids, "uid": [text_hash(t) for t in texts], "n": [len(s) for s in sets], **out}

        return work

    kind = docs.select(f"`{id_col}`").dtypes[0][1].replace("bigint", "long")
    return map_texts(docs, id_col, text_col, f"doc_id {kind}, uid long, sig long, n long, dropped int, prefix array<long>, pos array<int>, hot array<int>", make)


def text_hash(text: str) -> int:
    """The same as SQL's ``xxhash64`` of the text."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of shingle and node, those with another node whose size and place leave them a link.

    Rows of a shingle are held until there are too many to search; from then on all of them pass.
    """

    def searched(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of whole shingles, none with too many."""
        token, _, n, pos = (batch.column(k).to_numpy() for k in range(4))
        pos = pos.astype(np.int64)
        keep = np.zeros(len(token), bool)
        sizes = np.diff(np.append(np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))), len(token)))
        keep |= np.repeat(sizes > SEARCHED, sizes)
        for k in range(1, min(SEARCHED, int(sizes.max()))):  # each row with the k-th after it in its group
            i = np.flatnonzero(token[:-k] == token[k:])
            j = i + k
            rest = np.minimum(n[i] - pos[i], n[j] - pos[j]) + COMMON - 1
            fits = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (9 * rest >= 4 * (n[i] + n[j]))
            keep[i[fits]] = keep[j[fits]] = True
        return batch.filter(pa.array(keep))

    held, many, last = None, False, None  # rows of the last shingle; whether it has too many; its last row
    for batch in batches:
        token, sig = (batch.column(k).to_numpy() for k in range(2))
        if not len(token):
            continue
        again = np.concatenate(([last == (token[0], sig[0])], (token[1:] == token[:-1]) & (sig[1:] == sig[:-1])))
        last = (token[-1], sig[-1])
        batch = batch.filter(pa.array(~again))
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held.num_rows + batch.num_rows else batch
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        start = len(token) - int(np.argmax(token[::-1] != token[-1])) if token[0] != token[-1] else 0
        if many is not False:  # the rest of the shingle that has too many
            end = int(np.searchsorted(token != many, True)) if token[-1] != many else len(token)
            yield batch.slice(0, end)
            batch, token, start = batch.slice(end), token[end:], max(0, start - end)
            if not len(token):
                held = None
                continue
            many = False
        if start:
            yield searched(batch.slice(0, start))
        held = batch.slice(start)
        if held.num_rows > SEARCHED:
            yield held
            many, held = token[-1], None
    if held is not None and held.num_rows:
        yield searched(held)


def _sets(docs: DataFrame, width: int, often) -> DataFrame:
    """``sig, items``: sets in reversed global order, a fixed number of bytes for each shingle; a task gives each set once."""

    def make():
        prints, powers = often.value
        seen: set[int] = set()

        def work(ids, texts):
            sets = shingle_sets(texts, width)
            sigs, out = [], []
            for s, kind in zip(sets, rank_classes(sets, prints, powers)):
                sig = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                if sig in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(sig)
                if kind is not None:
                    s = s[np.lexsort((s, kind))]
                sigs.append(sig)
                out.append(s[::-1].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes())
            return {"doc_id": sigs, "items": out}

        return work

    return map_texts(docs, "uid", "text", "doc_id long, items binary", make).withColumnRenamed("doc_id", "sig")


def items_of(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // SET_BYTES, 8), np.uint8)
    wide[:, 8 - SET_BYTES :] = np.frombuffer(blob, np.uint8).reshape(-1, SET_BYTES)
    return wide.view(">u8").ravel().astype(np.uint64)


def needed(n: int, m: int) -> int:
    """The least overlap of sets of these sizes with a similarity of 0.8 or more."""
    return -(-4 * (n + m) // 9)


def tree_links(probe: bytes, others: list[bytes], step: int = 64) -> np.ndarray:
    """Which of the others are alike to the probe.

    The others, sorted, are the leaves of their prefix tree in order. ``depth`` and ``count`` are those of the path walked
    last; a set goes on from the depth that it shares with that path, and is left where the bound falls below what it needs.
    """
    a = np.sort(items_of(probe))
    linked = np.zeros(len(others), bool)
    path, counts = np.zeros(0, np.uint64), np.zeros(1, np.int64)  # counts[d]: overlap of the path's first d items
    for k in sorted(range(len(others)), key=others.__getitem__):
        b = items_of(others[k])
        need = needed(len(a), len(b))
        most = min(len(path), len(b))
        differ = np.flatnonzero(path[:most] != b[:most])
        depth = int(differ[0]) if len(differ) else most
        counts = counts[: depth + 1]
        while depth < len(b) and counts[-1] + min(len(a) - counts[-1], len(b) - depth) >= need:
            part = b[depth : depth + step]
            at = np.minimum(np.searchsorted(a, part), len(a) - 1)
            counts = np.concatenate((counts, counts[-1] + np.cumsum(a[at] == part)))
            depth += len(part)
        path = b[:depth]
        linked[k] = depth == len(b) and counts[-1] >= need
    return linked


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (a, b, items of a, items of b); rows of one ``a`` that stand together share a tree."""
    schema = to_arrow("a long, b long")
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        heads = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else []
        keep = [np.zeros(0, np.int64)]
        for x, y in zip(heads, np.append(heads[1:], len(a))):
            keep.append(x + np.flatnonzero(tree_links(batch.column(2)[int(x)].as_py(), batch.column(3)[int(x) : int(y)].to_pylist())))
        keep = np.concatenate(keep)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=schema)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Decides the pairs; ``sets`` lies in buckets, so only what the pairs need of it moves."""
    b = pairs.join(sets.withColumnRenamed("sig", "b").withColumnRenamed("items", "items_b"), "b")
    a = pairs.select("a").distinct().join(sets.withColumnRenamed("sig", "a").withColumnRenamed("items", "items_a"), "a")
    return b.join(a, "a").select("a", "b", "items_a", "items_b").mapInArrow(_decide, "a long, b long")


def part_links(probes: list[np.ndarray], leaves: list[np.ndarray], budget: int = 40_000_000) -> list[tuple[int, int]]:
    """(probe, leaf) that are alike, all probes walking the leaves' prefix tree together.

    ``counts[d]`` holds, for every probe, the overlap with the path's first ``d`` items; a leaf goes on from the depth that
    it shares with the path, and its subtree is left when no probe can still reach the overlap that it needs.
    """
    alphabet, seen = np.unique(np.concatenate([*probes, *leaves]), return_counts=True)
    alphabet = alphabet[seen > 1]  # what only one set has is in no overlap
    if not len(alphabet):
        return []

    def coded(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(alphabet, x), len(alphabet) - 1)
        return at[alphabet[at] == x]

    tree = sorted((tuple(coded(x).tolist()), k) for k, x in enumerate(leaves))
    found: list[tuple[int, int]] = []
    width = max(1, budget // (4 * len(alphabet)))
    for low in range(0, len(probes), width):
        some = probes[low : low + width]
        holds = np.zeros((len(alphabet), len(some)), np.int32)
        for i, x in enumerate(some):
            holds[coded(x), i] = 1
        sizes = np.array([len(x) for x in some], np.int64)
        path: tuple[int, ...] = ()
        counts = [np.zeros(len(some), np.int32)]
        for items, k in tree:
            n = len(leaves[k])
            need = -(-4 * (sizes + n) // 9)
            need[5 * np.minimum(sizes, n) < 4 * np.maximum(sizes, n)] = np.iinfo(np.int32).max
            depth = 0
            for p, q in zip(path[: len(counts) - 1], items):
                if p != q:
                    break
                depth += 1
            del counts[depth + 1 :]
            while depth < len(items):
                if depth % 16 == 0 and not (counts[-1] + np.minimum(sizes - counts[-1], len(items) - depth) >= need).any():
                    break
                counts.append(counts[-1] + holds[items[depth]])
                depth += 1
            path = items[:depth]
            if depth == len(items):
                found += [(low + i, k) for i in np.flatnonzero(counts[-1] >= need).tolist()]
    return found


def _decide_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one part of a block: rows ``sig, probe, items``."""
    probes, leaves = pdf[pdf["probe"]], pdf[~pdf["probe"]]
    if not len(probes) or not len(leaves):
        return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
    p, q = probes["sig"].to_numpy(), leaves["sig"].to_numpy()
    found = part_links([items_of(x) for x in probes["items"]], [items_of(x) for x in leaves["items"]])
    return pd.DataFrame([(int(p[i]), int(q[k])) for i, k in found if p[i] != q[k]], columns=["a", "b"], dtype="int64")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Words are lower-cased (A-Z) runs without ASCII white space. Sets are linked from a Jaccard similarity of 0.8 on;
    shingles are compared by hashes (64 bits to find, 48 to decide). Null texts and texts without words have an empty set
    and stay alone. Classes are those of contents: equal texts fall into one class, and rows that share an id, or have
    none, are linked by their texts alone. The id of a class is its least ``doc_id``; null if no row of it has one. A very
    long text must fit in a worker with its shingles. Empty tables give no rows. Other columns are not read.
    """
    return _classes(docs, id_col, text_col, width).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row of each class of near duplicates, all columns as they are: that with the least id.

    Rows without words are no duplicates and stay. Of repeated rows one stays, any one; a row without an id stays only if
    its class has no row with one.
    """
    classes = _classes(docs, id_col, text_col, width)
    spark = docs.sparkSession
    mine = Scratch(spark, "ngram-join").keep(classes.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("r")).select("r.doc_id", "r.uid"))
    rows = docs.select("*", F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_uid"))
    wordless = ~F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"[^ \t-\r]"), F.lit(False))
    first = rows.alias("d").join(mine.alias("m"), (F.col("_uid") == F.col("m.uid")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col("m.doc_id")), "left_semi").where(~wordless)
    rows_of = classes.where("class IS NOT NULL").join(mine.alias("m"), (F.col("m.uid") == classes["uid"]) & classes["doc_id"].eqNullSafe(F.col("m.doc_id")), "left_semi").count()
    if rows_of > mine.count():  # repeated rows: shuffled only where there are any
        first = first.dropDuplicates([f"{id_col}", "_uid"])
    return first.unionByName(rows.where(wordless)).drop("_uid")


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``doc_id, uid, class, n_shingles, component_id`` for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    often = spark.sparkContext.broadcast(frequent_shingles(docs, id_col, text_col, width))
    wide = scratch.keep(_nodes(docs, id_col, text_col, width, often), tidy=True)

    rows = wide.where("prefix IS NOT NULL").select("sig", "n", "dropped", "hot", F.explode(F.arrays_zip("prefix", "pos")).alias("t")).select(F.col("t.prefix").alias("token"), "sig", "n", F.col("t.pos").alias("pos"), F.expr("array_contains(hot, t.pos)").alias("is_hot"), "dropped")
    rare = rows.where("NOT is_hot").select("token", "sig", "n", "pos", "dropped").repartition("token").sortWithinPartitions("token", "sig").mapInArrow(released(_shared), "token long, sig long, n long, pos int, dropped int")
    hot = rows.where("is_hot").select("token", "sig", "n", "pos", "dropped").dropDuplicates(["token", "sig"])
    met = scratch.keep(rare.withColumn("hot", F.lit(False)).union(hot.withColumn("hot", F.lit(True))), tidy=True)
    nodes = scratch.keep(wide.select("doc_id", "uid", "sig", "n"))
    scratch.drop(wide)
    # how much of a set's prefix is shared: copies that were hardly changed come first, and are near to the most others
    mine = scratch.keep(met.groupBy("sig").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("dropped").alias("dropped")).where(f"c + dropped >= least({COMMON}, -floor(-4 * n / 5))").select("sig", (F.col("c") / F.col("n")).alias("central")))
    shared = scratch.keep(met.join(mine, "sig"))
    scratch.drop(met)

    # each set's text, by its hash: that of one row
    first = nodes.join(mine.select("sig"), "sig").groupBy("sig").agg(F.min(F.struct("doc_id", "uid")).alias("r")).select(F.col("r.doc_id").alias("rep"), F.col("r.uid").alias("rep_uid"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("uid", F.xxhash64("text"))
    texts = texts.join(first, (F.col("uid") == F.col("rep_uid")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("uid", "text")
    sets = scratch.bucketed(_sets(texts, width, often), "sig")

    # blocks: each shingle's nodes under its hub
    hubs = scratch.keep(shared.groupBy("token", "hot").agg(F.min_by("sig", F.struct(-F.col("central"), "sig")).alias("hub")), tidy=True)
    cold = shared.where("NOT hot").select("token", "sig").join(hubs.where("NOT hot").select("token", "hub"), "token").select("hub", "sig")
    parts = hubs.where("hot").select("token", "hub", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    hot = shared.where("hot").select("token", "sig", F.expr(f"CAST(pmod(xxhash64(sig), {PARTS}) AS INT)").alias("part")).join(parts, ["token", "part"]).select("hub", "sig")
    blocks = scratch.keep(cold.union(hot).where("hub <> sig").distinct(), tidy=True)
    scratch.drop(hubs)
    near = scratch.keep(_links(blocks.select(F.col("hub").alias("a"), F.col("sig").alias("b")), sets), tidy=True)

    rest = blocks.join(near.select(F.col("a").alias("hub"), F.col("b").alias("sig"), F.lit(True).alias("linked")), ["hub", "sig"], "left")
    sizes = rest.groupBy("hub").agg(F.count("*").alias("m"), F.count(F.when(F.col("linked").isNull(), 1)).alias("s")).where("s > 0 AND m > 1")
    sizes = sizes.select("hub", F.ceil(F.col("s") / PART).cast("int").alias("ni"), F.ceil(F.col("m") / PART).cast("int").alias("nj"))
    rest = rest.join(sizes, "hub").withColumns({"i": F.pmod(F.xxhash64("sig"), "ni").cast("int"), "j": F.pmod(F.xxhash64("sig", F.lit(1)), "nj").cast("int")})
    probes = rest.where("linked IS NULL").select("hub", "i", F.explode(F.expr("sequence(0, nj - 1)")).alias("j"), "sig", F.lit(True).alias("probe"))
    leaves = rest.select("hub", F.explode(F.expr("sequence(0, ni - 1)")).alias("i"), "j", "sig", F.lit(False).alias("probe"))
    parts = probes.union(leaves).join(sets, "sig").groupBy("hub", "i", "j").applyInPandas(_decide_part, "a long, b long")
    others = scratch.keep(parts.distinct(), tidy=True)

    # a node goes by its least id, so that the least node of a class names it and no class need meet in one task
    named = nodes.where("sig IS NOT NULL").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("k")).select("sig", F.struct("k.none", "k.doc_id", "sig").alias("vertex"))
    classes = _united(mine.select("sig").join(named, "sig").select("sig", F.col("vertex").alias("class")), near.union(others), scratch)
    scratch.forget()
    scratch.drop(blocks, near, others, shared, sets)

    labels = named.join(classes, "sig", "left").select("sig", F.coalesce("class", "vertex").alias("class"))
    classed = nodes.where("sig IS NOT NULL").join(labels, "sig").select("doc_id", "uid", "class", F.col("n").alias("n_shingles"), F.col("class.doc_id").alias("component_id"))
    alone = nodes.where("sig IS NULL").select("doc_id", "uid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return classed.unionByName(alone, allowMissingColumns=True)


def _edges(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Links between the classes of their ends."""
    ends = links.join(classes.select(F.col("sig").alias("a"), F.col("class").alias("p")), "a").join(classes.select(F.col("sig").alias("b"), F.col("class").alias("q")), "b")
    return ends.select(F.col("p").alias("a"), F.col("q").alias("b")).where("a <> b").distinct()


def _united(classes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes after all links."""
    edges = scratch.keep(_edges(classes, links))
    if edges.isEmpty():
        return scratch.keep(classes)
    least = components(edges, scratch)
    return scratch.keep(classes.join(least.select(F.col("u").alias("class"), "v"), "class", "left").select("sig", F.coalesce("v", "class").alias("class")))
