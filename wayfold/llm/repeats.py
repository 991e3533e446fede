"""Suffix-array dedup: bytes covered by a string of threshold length that starts elsewhere too, over the whole corpus.

Suffixes are ordered only through the threshold, by most-significant-digit passes, and only so far as they stay equal.
Dealing every suffix out by its bytes would shuffle the corpus many times over, so the first two digits travel as runs:

1. The first digit of a suffix is the k-gram with the least hash in its window, at its place in the window. Neighbouring
   suffixes share it, so a run of them travels as one row. Runs whose digit occurs once are done.
2. The second digit is all bytes of the run's windows. Where it is equal, all windows of the run are repeated.
3. Of a first digit with several second digits, one run of each is refined: its suffixes are sorted by digits of eight
   bytes, from the first byte to the threshold, and each pass takes on only the groups that are still equal.

Groups that stay equal through the threshold are exactly the repeated windows. Copies of whole texts are one text from the
start; digits that are frequent within a task are answered there. The suffixes of digits of very many runs are counted one
by one, and the repeated ones sent to salted parts of the digit's runs, so that no digit's rows must meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import CHUNK_BYTES, released, slices, to_arrow
from wayfold.llm.pretokens import _BASE, mixed, powers
from wayfold.llm.scratch import Scratch

#: Length of the k-gram that is the first digit, in a threshold of 200; runs of one digit in a chunk that make it frequent;
#: runs of one digit, of all tasks, beyond which its suffixes are dealt out.
GRAM, OFTEN, MANY = 64, 16, 1024
#: Repeated windows of a frequent digit in one slot, on average; parts in which its runs come to a join.
LISTED, SALTS = 1 << 16, 64
#: Bytes of runs that are refined at once.
REFINED = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
_SEGMENT = 1 << 17
_UP, _DOWN = powers(_BASE, _SEGMENT + (1 << 12)), powers(pow(_BASE, -1, 2**64), _SEGMENT + (1 << 12))
DOC, RUN, DONE, ASK, ASK_OFTEN = range(5)
_FACTS = "kind int, doc_id {id}, uid long, n long, sha string, digit long, second long, a int, b int, at int, often boolean"
_RUNS = "uid long, n long, a int, b int"


def digits_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number that sorts as they do."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial over hashed groups of eight bytes; of plain bytes, some texts would lose its width."""
    terms = mixed(digits_of(data))
    out = np.zeros(len(terms) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(terms * _UP[: len(terms)], out=out[1:])
    return out


def _windows_of(sums: np.ndarray, size: int) -> np.ndarray:
    k = size - 7
    with np.errstate(over="ignore"):
        return mixed((sums[k:] - sums[:-k]) * _DOWN[: len(sums) - k])


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of that size (8 or more) of at most a stretch of bytes."""
    return _windows_of(_sums(data), size)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by running minima from both ends of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one first digit: digit, second digit, first window, last window, place of the k-gram."""
    if len(data) < size:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    if len(data) > _SEGMENT + size:  # windows of long texts are taken in stretches
        parts = [(o, runs_of(data[o : o + _SEGMENT + size - 1], size, gram)) for o in range(0, len(data) - size + 1, _SEGMENT)]
        return tuple(np.concatenate([p[k] + (o if k > 1 else p[k].dtype.type(0)) for o, p in parts]) for k in range(5))
    sums = _sums(data)
    grams = _windows_of(sums, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    at = (least_in_windows((grams & ~_PLACE) | place, size - gram + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:] - 1, len(at) - 1)
    at = at[first]
    with np.errstate(over="ignore"):
        second = mixed((sums[last + size - 7] - sums[first]) * _DOWN[first]) + (at - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        second = mixed(second + (last - first).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return grams[at], second, first, last, at


def repeated_windows(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, size: int) -> np.ndarray:
    """Of the windows that start at ``starts``, those that equal another one of their group: radix passes over their bytes.

    Each pass sorts by the next eight bytes what was equal so far, and lets go what has become single.
    """
    places = np.unique(digits_of(data), return_inverse=True)[1].astype(np.uint64)
    for depth in (*range(0, size - 7, 8), *([size - 8] if size % 8 else [])):
        key = groups.astype(np.uint64) << np.uint64(32) | places[starts + depth]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        several = ~(new & np.append(new[1:], True))
        starts, groups = starts[order][several], (np.cumsum(new) - 1)[several]
        if not len(starts):
            break
    return starts


def edges(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of marked ones."""
    edge = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings or binaries, and the bounds of each value in them; nulls are empty."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def _rows(schema: pa.Schema, size: int, /, **columns) -> pa.RecordBatch:
    """A batch of ``size`` rows; columns that aren't given are null."""
    made = [columns.get(f.name) for f in schema]
    made = [pa.nulls(size, f.type) if c is None else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, schema)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


class _Task:
    """What a task remembers: texts, pairs of digits that it has found repeated, first digits that are frequent."""

    def __init__(self, size: int, gram: int, schema: pa.Schema):
        self.size, self.gram, self.schema = size, gram, schema
        self.texts: set = set()
        self.repeated: set[int] = set()
        self.often: set[int] = set()
        self.count = 0

    def spread(self, n: int) -> np.ndarray:
        """Keys that deal rows out evenly."""
        self.count += n
        return mixed(np.arange(self.count - n, self.count, dtype=np.uint64)).view(np.int64)

    def facts(self, ids: pa.Array, texts: pa.Array, uids: pa.Array) -> Iterator[pa.RecordBatch]:
        data, bounds = _bytes(texts)
        views = [data[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        lengths = np.diff(bounds)
        yield _rows(self.schema, len(ids), kind=np.full(len(ids), DOC), doc_id=ids, uid=uids, n=lengths, sha=[hashlib.sha256(x).hexdigest() for x in views], digit=self.spread(len(ids)))
        for s in (self.texts, self.repeated, self.often):
            if len(s) > 500_000:
                s.clear()
        keys = list(zip(uids.to_pylist(), lengths.tolist()))
        new = [i for i, k in enumerate(keys) if k[1] >= self.size and k not in self.texts and not self.texts.add(k)]
        found = [runs_of(views[i], self.size, self.gram) for i in new]
        if not found:
            return
        owner = np.repeat(np.array(new), [len(f[0]) for f in found])
        digit, second, a, b, at = (np.concatenate([f[k] for f in found]) for k in range(5))
        with np.errstate(over="ignore"):
            pair = mixed(digit + second * np.uint64(0x9E3779B97F4A7C15))
        _, first, number, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        known = np.zeros(len(first), bool)
        if self.repeated:
            known = np.fromiter((p in self.repeated for p in pair[first].tolist()), bool, len(first))
        again = (count > 1) | known
        done = again[number]
        self.repeated.update(pair[first[again & ~known]].tolist())
        send = np.zeros(len(pair), bool)
        send[first[~known]] = True  # one run for each pair of digits; twofold if it is repeated here
        # first digits with many second digits: only one of their runs is sent, the others ask for refinement at once
        single = np.flatnonzero(send & ~done)
        d, inverse, many = np.unique(digit[single], return_inverse=True, return_counts=True)
        hot = many >= OFTEN
        if self.often:
            hot |= np.fromiter((x in self.often for x in d.tolist()), bool, len(d))
        ask = single[hot[inverse]]
        ahead = np.zeros(len(pair), bool)
        if len(ask):
            _, lead = np.unique(digit[ask], return_index=True)
            fresh = np.array([i for i in ask[lead].tolist() if int(digit[i]) not in self.often], np.int64)
            self.often.update(digit[fresh].tolist())
            send[ask] = False
            send[fresh] = True
            ahead[fresh] = True

        def rows(kind: int, at_rows: np.ndarray, **columns) -> pa.RecordBatch:
            who = pa.array(owner[at_rows])
            return _rows(self.schema, len(who), kind=np.full(len(who), kind), doc_id=ids.take(who), uid=uids.take(who), n=lengths[owner[at_rows]], **columns)

        sent = np.flatnonzero(send)
        # a run that is repeated here goes with its twin, so that the digit's task counts two
        twin = np.flatnonzero(send & done)
        for x, often in ((sent, ahead[sent]), (twin, np.zeros(len(twin), bool))):
            yield rows(RUN, x, digit=digit[x].view(np.int64), second=second[x].view(np.int64), a=a[x], b=b[x], at=at[x], often=pa.array(often))
        over = np.flatnonzero(done)
        if len(over):  # neighbouring runs that are repeated are one row
            joins = (owner[over][1:] == owner[over][:-1]) & (a[over][1:] == b[over][:-1] + 1)
            begin = np.flatnonzero(np.concatenate(([True], ~joins)))
            end = np.append(begin[1:] - 1, len(over) - 1)
            yield rows(DONE, over[begin], digit=self.spread(len(begin)), a=a[over[begin]], b=b[over[end]])
        if len(ask):
            yield rows(ASK_OFTEN, ask, digit=self.spread(len(ask)), second=digit[ask].view(np.int64), a=a[ask], b=b[ask], at=at[ask], often=pa.array(np.ones(len(ask), bool)))


def _spread(size: int, gram: int, ddl: str):
    schema = to_arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(size, gram, schema)
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(1)), CHUNK_BYTES):
                yield from task.facts(part.column(0), part.column(1), part.column(2))

    return released(run)


def _second_pass(ddl: str):
    """Runs in order of their digits become finished runs and requests; other rows pass.

    Only the runs of one first digit are held, up to a bound: a digit with more of them is a frequent one.
    """
    schema = to_arrow(ddl)

    def judged(table: pa.Table, many: bool) -> Iterator[pa.RecordBatch]:
        """The rows of whole first digits, or some pairs of digits of one with ``many``."""
        if not table.num_rows:
            return
        d, s = (table.column(k).to_numpy() for k in ("digit", "second"))
        often = table.column("often").to_numpy(zero_copy_only=False).astype(bool)
        new = np.concatenate(([True], d[1:] != d[:-1]))
        head = np.flatnonzero(new)
        lead = new | np.concatenate(([True], s[1:] != s[:-1]))
        pair = np.flatnonzero(lead)
        alike = np.diff(np.append(pair, len(d)))
        twice = np.repeat(alike > 1, alike)
        sizes = np.diff(np.append(head, len(d)))
        hot = np.repeat(np.logical_or.reduceat(often, head), sizes) | many
        several = np.repeat(np.add.reduceat(lead.astype(np.int64), head), sizes) > 1
        for kind, rows in ((DONE, twice), (ASK, lead & several & ~hot), (ASK_OFTEN, lead & hot)):
            part = table.filter(pa.array(rows))
            part = part.set_column(0, "kind", pa.array(np.full(part.num_rows, kind, np.int32))).set_column(6, "second", part.column("digit"))
            yield from part.cast(schema).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = None, False  # runs of the last digit so far, and whether it has had too many
        for batch in batches:
            mine = pc.equal(batch.column(0), RUN)
            yield batch.filter(pc.invert(mine)).cast(schema)
            fresh = pa.Table.from_batches([batch.filter(mine)])
            table = pa.concat_tables([held, fresh]).combine_chunks() if held is not None else fresh
            if not table.num_rows:
                continue
            d, s = (table.column(k).to_numpy() for k in ("digit", "second"))
            start = len(d) - int(np.argmax(d[::-1] != d[-1])) if d[0] != d[-1] else 0
            if start:
                if many:  # the rest of the digit that has had too many comes first
                    end = int(np.argmax(d != d[0]))
                    yield from judged(table.slice(0, end), True)
                    yield from judged(table.slice(end, start - end), False)
                else:
                    yield from judged(table.slice(0, start), False)
                many = False
            held, s = table.slice(start), s[start:]
            if held.num_rows > MANY:
                many = True
                last = len(s) - int(np.argmax(s[::-1] != s[-1])) if s[0] != s[-1] else 0
                yield from judged(held.slice(0, last), True)
                held = held.slice(last)
                if held.num_rows > 2:  # two of a pair tell as much as all
                    over = held.slice(2)
                    yield from over.set_column(0, "kind", pa.array(np.full(over.num_rows, DONE, np.int32))).set_column(6, "second", over.column("digit")).cast(schema).combine_chunks().to_batches()
                    held = held.slice(0, 2)
                held = held.combine_chunks()
        if held is not None:
            yield from judged(held, many)

    return released(run)


def _refine(size: int):
    """Rows (digit, uid, n, a, content) in order of their digit: runs of repeated windows (uid, n, a, b)."""
    schema = to_arrow(_RUNS)

    def refined(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        batch = table.combine_chunks().to_batches()[0]
        digit = batch.column(0).to_numpy()
        data, bounds = _bytes(batch.column(4))
        windows = np.diff(bounds) - size + 1
        group = np.repeat(np.cumsum(np.concatenate(([0], digit[1:] != digit[:-1]))), windows)
        row = np.repeat(np.arange(len(digit)), windows)
        starts = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[:-1][row]
        marked = np.zeros(len(data) + 1, bool)
        marked[repeated_windows(data, starts, group, size)] = True  # a run's last bytes start no window, so runs stay apart
        first, last = edges(marked)
        row = np.searchsorted(bounds, first, "right") - 1
        a = batch.column(3).to_numpy()[row]
        yield _rows(schema, len(row), uid=batch.column(1).to_numpy()[row], n=batch.column(2).to_numpy()[row], a=a + first - bounds[row], b=a + last - bounds[row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ready = [], 0  # batches so far; the last one goes on in the next
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(4)), REFINED // 4):
                held.append(part)
                ready += part.nbytes
                if ready < REFINED:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                digit = table.column(0).to_numpy()
                start = len(digit) - int(np.argmax(digit[::-1] != digit[-1])) if digit[0] != digit[-1] else 0
                if start:
                    yield from refined(table.slice(0, start).combine_chunks())
                    held = table.slice(start).combine_chunks().to_batches()
                    ready = sum(x.nbytes for x in held)
        if held:
            yield from refined(pa.Table.from_batches(held))

    return released(run)


def _contents(size: int):
    """(uid, n, text, requests) to (digit, uid, n, a, content, often), one row for each request."""
    schema = to_arrow("digit long, uid long, n long, a int, content binary, often boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _bytes(batch.column(2))
            asked = batch.column(3)
            at = np.frombuffer(asked.buffers()[1], np.int32)[asked.offset : asked.offset + len(asked) + 1].tolist()
            digit, a, b, often = (asked.values.field(k) for k in ("digit", "a", "b", "often"))
            a, b = a.to_numpy(), b.to_numpy()
            for k, (uid, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = data[bounds[k] : bounds[k + 1]].tobytes()
                for i in range(at[k], at[k + 1], 2048):
                    j = min(i + 2048, at[k + 1])
                    content = [text[x : y + size] for x, y in zip(a[i:j].tolist(), b[i:j].tolist())]
                    yield _rows(schema, j - i, digit=digit.slice(i, j - i), uid=np.full(j - i, uid), n=np.full(j - i, n), a=a[i:j], content=content, often=often.slice(i, j - i))

    return released(run)


def _hashed(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of rows (digit, uid, n, a, content), and how many each row has."""
    data, bounds = _bytes(part.column(4))
    hashes = [window_hashes(data[i:j], size).view(np.int64) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return np.concatenate([*hashes, np.zeros(0, np.int64)]), np.fromiter(map(len, hashes), np.int64, len(hashes))


def _windows(size: int):
    """(digit, uid, n, a, content) of frequent digits to (digit, hash, c), one row for each window that a batch holds."""
    schema = to_arrow("digit long, hash long, c long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_hashed(x, size) for x in slices(batch, pc.binary_length(batch.column(4)), REFINED // 4)]
            digit = np.repeat(batch.column(0).to_numpy(), np.concatenate([n for _, n in parts] or [np.zeros(0, np.int64)]))
            h = np.concatenate([x for x, _ in parts] or [np.zeros(0, np.int64)])
            order = np.lexsort((h, digit))
            digit, h = digit[order], h[order]
            new = np.flatnonzero(np.concatenate(([True], (digit[1:] != digit[:-1]) | (h[1:] != h[:-1])))) if len(h) else order
            yield _rows(schema, len(new), digit=digit[new], hash=h[new], c=np.diff(np.append(new, len(h))))

    return released(run)


def _dealt(size: int):
    """(digit, uid, n, a, content, slots, salt) to (digit, salt, slot, uid, n, places, hashes): a row for each slot that windows of a run fall into."""
    schema = to_arrow("digit long, salt int, slot int, uid long, n long, places array<int>, hashes array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(4)), REFINED // 4):
                h, sizes = _hashed(part, size)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = part.column(3).to_numpy()[row] + np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                slot = h % part.column(5).to_numpy()[row]
                order = np.lexsort((place, slot, row))
                row, slot = row[order], slot[order]
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])))) if len(h) else order
                bounds = pa.array(np.append(new, len(h)).astype(np.int32))
                who = pa.array(row[new])
                yield _rows(
                    schema, len(new), digit=part.column(0).take(who), salt=part.column(6).take(who), slot=slot[new], uid=part.column(1).take(who), n=part.column(2).take(who),
                    places=pa.ListArray.from_arrays(bounds, pa.array(place[order].astype(np.int32))), hashes=pa.ListArray.from_arrays(bounds, pa.array(h[order])),
                )

    return released(run)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digit, salt, slot, uid, n, places, hashes) in order of the first three, rows without uid first: these hold the repeated hashes.

    Of the others, the runs (uid, n, a, b) of places whose hash is among them.
    """
    schema = to_arrow(_RUNS)
    key, known = None, np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, pc.list_value_length(batch.column(6)), REFINED // 8):
            digit, salt, slot = (part.column(k).to_numpy() for k in range(3))
            lists, places = part.column(6), part.column(5)
            at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            to = np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + len(places) + 1]
            hashes, where = lists.values.to_numpy(), places.values.to_numpy(zero_copy_only=False)
            listed = np.asarray(part.column(3).is_null())
            heads = np.flatnonzero(np.concatenate(([True], (digit[1:] != digit[:-1]) | (salt[1:] != salt[:-1]) | (slot[1:] != slot[:-1]))))
            for x, y in zip(heads.tolist(), [*heads[1:].tolist(), part.num_rows]):
                if key != (now := (digit[x], salt[x], slot[x])):
                    key, known = now, np.zeros(0, np.int64)
                lead = x + int(listed[x:y].sum())
                if lead > x:
                    known = np.unique(np.concatenate((known, hashes[at[x] : at[lead]])))
                if lead == y or not len(known):
                    continue
                h = hashes[at[lead] : at[y]]
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                row = np.repeat(np.arange(lead, y), np.diff(at[lead : y + 1]))[hit]
                place = where[to[lead] : to[y]][hit]
                if not len(row):
                    continue
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))))
                last = np.append(first[1:] - 1, len(row) - 1)
                who = pa.array(row[first])
                yield _rows(schema, len(first), uid=part.column(3).take(who), n=part.column(4).take(who), a=place[first], b=place[last])


def _cut(size: int):
    schema = to_arrow("uid long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column(2))):
                data, bounds = _bytes(part.column(2))
                runs = part.column(3)
                at = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1]
                first, end = runs.values.field("a").to_numpy(), runs.values.field("b").to_numpy() + size
                removed, spans, sha, kept = [], [], [], []
                for k in range(part.num_rows):
                    text = data[bounds[k] : bounds[k + 1]]
                    gone = np.zeros(len(text) + 1, np.int64)
                    np.add.at(gone, first[at[k] : at[k + 1]], 1)
                    np.add.at(gone, end[at[k] : at[k + 1]], -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    kept.append(text[~gone].tobytes())
                    sha.append(hashlib.sha256(kept[-1]).hexdigest())
                    removed.append(int(gone.sum()))
                    spans.append(len(edges(gone)[0]))
                yield _rows(schema, part.num_rows, uid=part.column(0), n=part.column(1), n_removed=removed, n_spans=spans, kept_sha256=sha, kept=kept)

    return released(run)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left, if asked for) for each row of ``docs``.

    Strings are ``size`` bytes of UTF-8; each byte that lies in one which also starts elsewhere, in any document, goes.
    Windows with one first digit are compared by their bytes; runs, and windows of digits with very many runs, by hashes of
    64 bits beside the digit's. A null text is empty; texts shorter than ``size`` stay whole. Repeated rows and copies of a
    text of ``size`` bytes or more lose all bytes. Very long texts are hashed in stretches; one text and its runs must fit
    in a worker. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    kind = docs.select(f"`{id_col}`").dtypes[0][1].replace("bigint", "long")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("uid"))
    ddl = _FACTS.format(id=kind)
    facts = scratch.keep(rows.mapInArrow(_spread(size, gram, ddl), ddl).repartition("digit").sortWithinPartitions("digit", "second").mapInArrow(_second_pass(ddl), ddl))

    own = facts.where(F.col("kind") == DOC).select("doc_id", "uid", "n", "sha")
    asked = facts.where(F.col("kind").isin(ASK, ASK_OFTEN)).select("uid", "n", "doc_id", F.struct(F.col("second").alias("digit"), "a", "b", (F.col("kind") == ASK_OFTEN).alias("often")).alias("r"))
    asked = asked.groupBy("uid", "n").agg(F.min("doc_id").alias("rep"), F.collect_list("r").alias("asked"))
    done = facts.where(F.col("kind") == DONE).select("uid", "n", "doc_id", F.struct("a", "b").alias("r"))
    done = done.groupBy("uid", "n").agg(F.min("doc_id").alias("rep"), F.collect_list("r").alias("done"))
    touched = asked.join(done.withColumnRenamed("rep", "rep2"), ["uid", "n"], "full").select("uid", "n", F.coalesce("rep", "rep2").alias("rep"), "asked", "done")
    t = rows.alias("d").join(touched.alias("t"), (F.col("d.uid") == F.col("t.uid")) & (F.octet_length("d.text") == F.col("t.n")) & F.col("d.doc_id").eqNullSafe(F.col("t.rep")))
    texts = scratch.keep(t.select("t.uid", "t.n", "d.text", "t.asked", "t.done").dropDuplicates(["uid", "n"]))

    content = texts.where("asked IS NOT NULL").select("uid", "n", "text", "asked").mapInArrow(_contents(size), "digit long, uid long, n long, a int, content binary, often boolean")
    cold = content.where("NOT often").drop("often").repartition("digit").sortWithinPartitions("digit").mapInArrow(_refine(size), _RUNS)
    # frequent digits: their repeated windows, in slots of a bounded size, meet the windows of their runs, in salts of as many
    many = content.where("often").select("digit", "uid", "n", "a", "content")
    again = scratch.keep(many.mapInArrow(_windows(size), "digit long, hash long, c long").groupBy("digit", "hash").agg(F.sum("c").alias("c")).where("c > 1").select("digit", "hash"))
    runs = many.groupBy("digit").agg(F.ceil(F.count("*") / MANY).cast("int").alias("salts"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")  # the runs of one digit come to joins in parts
    dealt = again.groupBy("digit").agg(F.ceil(F.count("*") / LISTED).alias("slots")).join(runs, "digit").select("*", salts)
    lists = again.withColumn("part", F.expr(f"CAST(pmod(hash, {SALTS}) AS INT)")).join(dealt, ["digit", "part"]).groupBy("digit", "salts", F.expr("CAST(pmod(hash, slots) AS INT)").alias("slot")).agg(F.collect_list("hash").alias("hashes"))
    lists = lists.select("digit", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), "slot", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("n"), F.array().cast("array<int>").alias("places"), "hashes")
    met = many.withColumn("part", F.expr(f"CAST(pmod(xxhash64(a, uid), {SALTS}) AS INT)")).join(dealt, ["digit", "part"]).select("digit", "uid", "n", "a", "content", "slots", F.expr("CAST(pmod(xxhash64(uid, n, a), salts) AS INT)").alias("salt"))
    met = met.mapInArrow(_dealt(size), "digit long, salt int, slot int, uid long, n long, places array<int>, hashes array<long>")
    hot = lists.union(met).repartition("digit", "salt", "slot").sortWithinPartitions("digit", "salt", "slot", F.col("uid").asc_nulls_first()).mapInArrow(released(_met), _RUNS)
    refined = cold.union(hot).groupBy("uid", "n").agg(F.collect_list(F.struct("a", "b")).alias("refined"))
    both = texts.join(refined, ["uid", "n"], "left").select("uid", "n", "text", F.concat(F.coalesce("done", F.array().cast("array<struct<a:int,b:int>>")), F.coalesce("refined", F.array().cast("array<struct<a:int,b:int>>"))).alias("runs"))
    cut = both.where(F.size("runs") > 0).mapInArrow(_cut(size), "uid long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary")

    copies = own.groupBy("uid", "n").agg(F.count("*").alias("copies")).where(f"copies > 1 AND n >= {size}")
    out = own.join(copies, ["uid", "n"], "left").join(cut if with_kept else cut.drop("kept"), ["uid", "n"], "left")
    copied = F.col("copies").isNotNull()
    columns = [
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copied, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_kept:  # null: nothing was removed
        columns.append(F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)
