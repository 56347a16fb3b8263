"""Suffix-array dedup: a distributed, depth-limited radix sort of byte suffixes finds every repeated window.

Suffixes are ordered only through ``depth`` bytes, most significant digit first, and a group that is down to one
document is dropped after each pass, so the groups left after the last digit are exactly the repeated windows.

The first digit must deal suffixes out to machines without shipping every suffix. It is a short byte string *inside*
the window that the window's content picks: of its substrings of a third of the depth the one of least hash, leftmost
first. Equal windows pick equal digits at equal offsets, and neighbouring windows mostly share a digit (one for about
17). A window also holds the bytes of that length just left or just right of its digit, by its offset, so digit and
neighbour together are the string that is looked up: the pass moves 4 bytes for each side of a digit, not one row for
each suffix. It runs in three steps: (1) groups of documents send these strings' hashes and learn which of them
another document has too; (2) for these alone they send the bytes around them, and the windows are sorted by further
digits, 16 bytes each; (3) the spans found are cut out. Equal surroundings within a group of documents travel once,
with the smallest id. A string that very many groups have is dealt out again by window content, one window a row, so
that no task gets all occurrences of a common passage.

A byte goes if it lies in a window of ``depth`` bytes that also starts in a document with a smaller id, judged on
the input. Null texts are empty; a null id neither loses bytes nor makes others lose them; rows that repeat an id are
one document, and a string common to two of them does not count.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlake.llm.common import broadcast_if_small, column, let_go
from cinderlake.shipping import ship

DEPTH = 50
#: Bytes of text in a group of documents, of these bytes hashed at once, and groups from which on a digit is dealt out by window.
GROUP_BYTES, SLICE_BYTES, HOT_GROUPS = 8_000_000, 150_000, 64
#: What a row takes in a group beside its text.
ROW_BYTES = 32

LOW32 = np.uint64(0xFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(flat: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte substrings, put together from those of lengths that are powers of two."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    part, power, length = flat.astype(np.uint64) + np.uint64(1), base, 1
    whole, done, rest = None, 0, k
    n = len(flat) - k + 1
    while rest:
        if rest & 1:
            tail = part[done : done + n]
            whole = tail.copy() if whole is None else whole * np.uint64(power) + tail
            done += length
        rest >>= 1
        if rest:
            part = part[:-length] * np.uint64(power) + part[length:]
            power, length = power * power & mask, 2 * length
    return mixed(whole)


def least_in_windows(v: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if size < w else v


class Picks:
    """The digits that the windows of some texts pick: place, hash, text, and first and last window of each.

    ``left`` and ``right`` hash a digit with the bytes beside it, where windows of that side exist.
    """

    def __init__(self, flat: np.ndarray, ends: np.ndarray, depth: int, gram: int) -> None:
        none = np.zeros(0, np.int64)
        self.at = self.first = self.last = self.owner = none
        self.hash = self.left = self.right = np.zeros(0, np.uint64)
        self.has_left = self.has_right = np.zeros(0, bool)
        if len(flat) < depth:
            return
        h = gram_hashes(flat, gram)
        v = (h & ~LOW32) | np.arange(len(h), dtype=np.uint64)  # the upper half decides, then the place
        place = (least_in_windows(v, depth - gram + 1) & LOW32).astype(np.int64)
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(place)]
        windows = np.flatnonzero(np.arange(len(place)) + depth <= ends[owner])
        if not len(windows):
            return
        place = place[windows]
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.at = place[new]
        self.first = windows[new]
        self.last = windows[np.r_[new[1:] - 1, len(windows) - 1]]
        self.owner = owner[self.first]
        self.hash = h[self.at]
        self.has_left, self.has_right = self.at - self.first >= gram, self.at - self.last < gram
        self.left = mixed(h[np.maximum(self.at - gram, 0)] * np.uint64(0xC2B2AE3D27D4EB4F) + self.hash)
        self.right = mixed(self.hash * np.uint64(0x165667B19E3779F9) + h[np.minimum(self.at + gram, len(h) - 1)] + np.uint64(1))

    def sides(self, buckets: int) -> np.ndarray:
        """Signatures of the left sides that exist, then of the right ones."""
        return signatures(np.concatenate([self.left[self.has_left], self.right[self.has_right]]), buckets)


def signatures(h: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by the upper half of the hash, above the lower half."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32)) | (h & LOW32)


class Texts:
    """The texts of an Arrow table as one byte array with bounds, and their ids and references."""

    def __init__(self, table: pa.Table) -> None:
        let_go()
        table = table.combine_chunks()
        column = lambda name: c.chunk(0) if (c := table.column(name)).num_chunks else pa.array([], c.type)
        texts = column("text").cast(pa.large_binary())
        data = texts.buffers()
        n = len(texts)
        bounds = np.frombuffer(data[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        self.bounds = bounds
        self.flat = np.frombuffer(data[2], np.uint8) if n and data[2] is not None and data[2].size else np.zeros(0, np.uint8)
        self.ref = column("ref").to_numpy(zero_copy_only=False).astype(np.int64)
        ids = column("id")
        self.known = np.array(ids.is_valid(), bool)
        self.id = np.array(ids.fill_null(0), np.int64)
        self.local = np.unique(self.ref, return_inverse=True)[1] if n else np.zeros(0, np.int64)  # the same in each step

    def slices(self):
        """(first text, byte offset, bytes, ends of the texts in them) of consecutive texts."""
        lo, n = 0, len(self.ref)
        while lo < n:
            hi = int(np.searchsorted(self.bounds, self.bounds[lo] + SLICE_BYTES, side="right")) - 1
            hi = min(n, max(lo + 1, hi))
            yield lo, int(self.bounds[lo]), self.flat[self.bounds[lo] : self.bounds[hi]], self.bounds[lo + 1 : hi + 1] - self.bounds[lo]
            lo = hi


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def send_digits(table: pa.Table, depth: int, gram: int, buckets: int) -> pa.Table:
    """Step 1: of a group of documents the different digits of each bucket, and which of them two of its documents have."""
    key = table.column("key")[0].as_py()
    texts = Texts(table)
    sign, ids = [], []
    for first, _, flat, ends in texts.slices():
        p = Picks(flat, ends, depth, gram)
        owner = first + np.concatenate([p.owner[p.has_left], p.owner[p.has_right]])
        known = texts.known[owner]
        sign.append(p.sides(buckets)[known])
        ids.append(texts.id[owner[known]])
    sign, ids = np.concatenate(sign), np.concatenate(ids)
    order = np.argsort(sign)
    sign, ids = sign[order], ids[order]
    new = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]]) if len(sign) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(ids, new) != np.maximum.reduceat(ids, new) if len(new) else np.zeros(0, bool)
    unique = sign[new]
    bucket = (unique >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    rows = [(int(bucket[a]), key, (unique[a:b] & LOW32).astype("<u4").tobytes(), pack(several[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.int64()), "codes": pa.array([r[2] for r in rows], pa.binary()), "several": pa.array([r[3] for r in rows], pa.binary())})


def shared_digits(table: pa.Table, hot_groups: int) -> pa.Table:
    """Of one bucket: which digits of each group two documents have, and which very many groups have."""
    codes = [np.frombuffer(c, "<u4") for c in table.column("codes").to_pylist()]
    several = [unpack(s, len(c)) for s, c in zip(table.column("several").to_pylist(), codes, strict=True)]
    values, inverse, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    twice = counts > 1
    twice |= np.bincount(inverse, np.concatenate(several), len(values)) > 0
    hot = counts >= hot_groups
    at, shared, common = 0, [], []
    for c in codes:
        mine = inverse[at : at + len(c)]
        shared.append(pack(twice[mine]))
        common.append(pack(hot[mine]))
        at += len(c)
    return pa.table({"key": table.column("key"), "bucket": table.column("bucket"), "n": pa.array([len(c) for c in codes], pa.int64()), "shared": pa.array(shared, pa.binary()), "hot": pa.array(common, pa.binary())})


RECORDS = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("contents", pa.binary()), ("bytes", pa.binary()), ("m", pa.int64()), ("places", pa.binary())])
#: Bytes of the numbers of a content (smallest id, least and largest offset) and of a place (content, text, place in it).
CONTENT, PLACE = (8, 4, 4), (4, 4, 4)


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def expand(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def planes(columns) -> bytes:
    """Integers byte by byte, all lowest bytes first, so that the many zeros lie together."""
    return squeeze(b"".join(np.ascontiguousarray(c.astype(f"<i{w}").view(np.uint8).reshape(-1, w).T).tobytes() for c, w in columns))


def from_planes(raw: bytes, n: int, widths) -> list[np.ndarray]:
    flat, at, out = np.frombuffer(expand(raw), np.uint8), 0, []
    for w in widths:
        out.append(np.ascontiguousarray(flat[at : at + n * w].reshape(w, n).T).view(f"<i{w}").ravel().astype(np.int64))
        at += n * w
    return out


def records(bucket: np.ndarray, key: int, contents: list[np.ndarray], around: np.ndarray, of: np.ndarray, places: list[np.ndarray]) -> list[dict]:
    """Rows by bucket: its contents, and the places of each; ``of`` is the content of a place."""
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    line = np.argsort(rank[of], kind="stable")
    sorted_of = rank[of][line]
    cuts = np.flatnonzero(np.r_[True, bucket[order[1:]] != bucket[order[:-1]], True]) if len(bucket) else [0]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        o = order[a:b]
        x, y = np.searchsorted(sorted_of, [a, b])
        mine = line[x:y]
        out.append({
            "bucket": int(bucket[o[0]]), "key": key, "n": int(b - a), "contents": planes(zip([c[o] for c in contents], CONTENT, strict=True)), "bytes": squeeze(around[o].tobytes()),
            "m": int(y - x), "places": planes(zip([sorted_of[x:y] - a, *(p[mine] for p in places)], PLACE, strict=True)),
        })
    return out


def row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for some in chunks(len(rows)):
        wide = np.zeros((some.stop - some.start, -(-rows.shape[1] // 8) * 8), np.uint8)
        wide[:, : rows.shape[1]] = rows[some]
        for word in wide.view("<u8").T:
            h[some] = mixed(h[some] * np.uint64(0x9E3779B97F4A7C15) + word)
    return h


def chunks(n: int, size: int = 16_384) -> list[slice]:
    """Slices of rows, so that what is gathered beside the rows themselves stays small."""
    return [slice(a, min(n, a + size)) for a in range(0, n, size)]


def masked(view: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, side: int, depth: int) -> np.ndarray:
    """The given rows of a matrix of bytes, without the bytes outside the windows at offsets ``low`` to ``high``."""
    out = np.empty((len(rows), view.shape[1]), np.uint8)
    columns = np.arange(view.shape[1])
    for some in chunks(len(rows)):
        out[some] = view[rows[some]] * ((columns >= (side - high[some])[:, None]) & (columns < (side - low[some] + depth)[:, None]))
    return out


def same_contents(low: np.ndarray, high: np.ndarray, around: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of each different content, the content of each row, and the smallest id of each content.

    Equal contents are neighbours in the order of a hash and are compared in full; should other contents with the
    same hash come between, a content is sent twice.
    """
    order = np.argsort(mixed(row_hashes(around) + (low * 4096 + high).astype(np.uint64)))
    same = (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])
    for some in chunks(len(same)):
        same[some] &= (around[order[1:][some]] == around[order[:-1][some]]).all(axis=1)
    new = np.r_[True, ~same]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of, np.minimum.reduceat(ids[order], np.flatnonzero(new))


def send_windows(docs: pa.Table, answers: pa.Table, depth: int, gram: int, buckets: int, parts: int) -> pa.Table:
    """Step 2: for each digit that two documents have with the same neighbour, the bytes that its windows cover."""
    texts = Texts(docs)
    if not answers.num_rows or not len(texts.ref):
        return RECORDS.empty_table()
    key = docs.column("key")[0].as_py()
    by_bucket = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "shared", "hot")), strict=True))
    shared = np.concatenate([unpack(s, n) for _, n, s, _ in by_bucket])
    hot = np.concatenate([unpack(h, n) for _, n, _, h in by_bucket])
    found, sides = [], []
    for first, offset, flat, ends in texts.slices():
        p = Picks(flat, ends, depth, gram)
        known = texts.known[first + p.owner]
        p.has_left &= known
        p.has_right &= known
        sides.append(p.sides(buckets))
        found.append((first + p.owner, p.at + offset, p.at - p.last, p.at - p.first, p.hash, p.has_left, p.has_right))
    sign, split = np.concatenate(sides), [int(f[5].sum()) for f in found]
    index = np.unique(sign, return_inverse=True)[1]
    state = shared[index] + 2 * (shared[index] & hot[index])  # 0: nobody else's, 1: shared, 3: shared by very many
    left_state, right_state, at = [], [], 0
    for f, lefts in zip(found, split, strict=True):
        for out, has, n in ((left_state, f[5], lefts), (right_state, f[6], int(f[6].sum()))):
            x = np.zeros(len(has), np.int64)
            x[has] = state[at : at + n]
            out.append(x)
            at += n
    left_state, right_state = np.concatenate(left_state), np.concatenate(right_state)
    owner, at, low, high, digit = (np.concatenate([f[i] for f in found]) for i in range(5))
    # A digit's windows by offset: left of it from ``gram`` on, right of it below; one row for both where none is hot.
    rows = []
    for want in (1, 3):
        on_left, on_right = left_state == want, right_state == want
        keep = np.flatnonzero(on_left | on_right)
        rows.append((keep, np.where(on_right[keep], low[keep], np.maximum(low[keep], gram)), np.where(on_left[keep], high[keep], np.minimum(high[keep], gram - 1))))
    row, low, high = (np.concatenate(x) for x in zip(*rows, strict=True))
    if not len(row):
        return RECORDS.empty_table()
    is_hot = np.arange(len(row)) >= len(rows[0][0])
    owner, at, digit = owner[row], at[row], digit[row]
    side, width = depth - gram, 2 * depth - gram
    padded = np.concatenate([np.zeros(side, np.uint8), texts.flat, np.zeros(width, np.uint8)])
    around = masked(np.lib.stride_tricks.sliding_window_view(padded, width), at, low, high, side, depth)  # starts ``side`` bytes before the digit
    ids, local, place = texts.id[owner], texts.local[owner], at - texts.bounds[owner]
    first, of, least = same_contents(low, high, around, ids)
    late = ids > least[of]
    mine, its = np.flatnonzero(~late), np.flatnonzero(late)
    # What a smaller id of this group has too is answered here: a bucket of its own only carries the spans back.
    out = records(np.full(len(its), -1 - key), key, [ids[its], low[its], high[its]], around[its, :0], np.arange(len(its)), [local[its], place[its]])
    cool = np.flatnonzero(~is_hot[first])
    back = np.full(len(first), -1)
    back[cool] = np.arange(len(cool))
    here = mine[back[of[mine]] >= 0]
    # Picked digits have small hashes: they are mixed again to spread.
    bucket = (mixed(digit[first[cool]] + np.uint64(1)) % np.uint64(buckets * parts)).astype(np.int64)
    out += records(bucket, key, [least[cool], low[first[cool]], high[first[cool]]], around[first[cool]], back[of[here]], [local[here], place[here]])
    if len(cool) < len(first):
        hot_rows = mine[back[of[mine]] < 0]
        out += window_records(hot_rows, of, first, least, low, high, around, ids, local, place, key, buckets * parts, depth, gram)
    return pa.Table.from_pylist(out, RECORDS)


def window_records(rows, of, first, least, low, high, around, ids, local, place, key: int, buckets: int, depth: int, gram: int) -> list[dict]:
    """Contents that very many groups have, window by window, in buckets by the bytes of the window."""
    contents = np.unique(of[rows])
    many = high[first[contents]] - low[first[contents]] + 1
    each = np.repeat(contents, many)
    offset = low[first[each]] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    bytes_of = masked(around, first[each], offset, offset, depth - gram, depth)
    head, window, small = same_contents(offset, offset, bytes_of, least[each])
    begin = np.zeros(len(first) + 1, np.int64)
    begin[contents] = np.cumsum(many) - many
    count = np.zeros(len(first) + 1, np.int64)
    count[contents] = many
    times = count[of[rows]]
    r = np.repeat(rows, times)
    e = np.repeat(begin[of[rows]], times) + np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
    late = ids[r] > small[window[e]]
    out = records(np.full(int(late.sum()), -1 - key), key, [ids[r[late]], offset[e[late]], offset[e[late]]], around[r[late], :0], np.arange(int(late.sum())), [local[r[late]], place[r[late]]])
    keep = ~late
    bucket = (row_hashes(bytes_of[head]) % np.uint64(buckets)).astype(np.int64)
    return out + records(bucket, key, [small, offset[head], offset[head]], bytes_of[head], window[e[keep]], [local[r[keep]], place[r[keep]]])


SPANS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("spans", pa.binary())])


def repeated_windows(word: np.ndarray, start: np.ndarray, who: np.ndarray, depth: int) -> np.ndarray:
    """Which of the windows at ``start`` also occur for a smaller id: a radix sort, most significant digit first.

    ``word`` has the eight bytes from each place on as a big-endian number, so that keys sort as bytes do. A pass sorts
    by the number of the group so far, then by as many further bytes as fit beside it into 64 bits. Groups of one
    document are dropped after each pass; those left after ``depth`` bytes are the repeated windows.
    """
    live, done, group = np.arange(len(start)), 0, np.zeros(len(start), np.uint64)
    none, least = np.zeros(0, np.int64), None
    if not len(start):
        return none
    while done < depth:
        groups = int(group[-1]) + 1 if len(group) else 1
        size = min(8 - -(-(groups - 1).bit_length() // 8), depth - done)
        key = word[start[live] + done].astype(np.uint64) >> np.uint64(64 - 8 * size)
        if size < 8:
            key |= group << np.uint64(8 * size)
        done += size
        apart = key[1:] != key[:-1]
        if least is not None:
            if np.count_nonzero(apart) == groups - 1:  # the bytes of each group are all equal
                continue
            uneven = np.zeros(groups, bool)
            uneven[group[1:][apart & (group[1:] == group[:-1])]] = True
            rows = np.flatnonzero(uneven[group])
            order = rows[np.argsort(key[rows])]
            key[rows], live[rows] = key[order], live[order]
        else:
            live = np.argsort(key)
            key = key[live]
        edge = np.concatenate([[True], key[1:] != key[:-1]])
        several = ~edge  # not the only row of its group
        several[:-1] |= ~edge[1:]
        live, edge = live[several], edge[several]
        if not len(live):
            return none
        heads = np.flatnonzero(edge)
        who_now = who[live]
        least, most = np.minimum.reduceat(who_now, heads), np.maximum.reduceat(who_now, heads)
        name = np.cumsum(edge) - 1
        stay = (least < most)[name]
        live = live[stay]
        if not len(live):
            return none
        least = least[name[stay]]
        group = (np.cumsum(edge[stay]) - 1).astype(np.uint64)
    return live[who[live] > least]


def repeated(table: pa.Table, depth: int, gram: int) -> pa.Table:
    """Step 2, sorting side: the repeated windows of a bucket. Windows with their digit at different offsets never meet, so one offset is sorted at a time."""
    let_go()
    counts = [(table.column(c).to_pylist(), table.column(k).to_pylist(), w) for c, k, w in (("contents", "n", CONTENT), ("places", "m", PLACE))]
    (ids, low, high), (of, local, place) = ([np.concatenate(x) for x in zip(*(from_planes(r, n, w) for r, n in zip(raw, ns, strict=True)), strict=True)] for raw, ns, w in counts)
    n, m = counts[0][1], counts[1][1]
    of = of + np.repeat(np.cumsum(n) - n, m)
    key = np.repeat(np.array(table.column("key").to_pylist(), np.int64), m)
    if table.column("bucket")[0].as_py() < 0:
        return spans(key, local, place - high[of], place - low[of] + depth)
    width, side = 2 * depth - gram, depth - gram
    around = b"".join([*map(expand, table.column("bytes").to_pylist()), bytes(8)])
    word = np.ndarray(len(around) - 7, ">u8", around, strides=(1,))
    # The repeated windows of a content overlap, all over its digit: together they are one span.
    lowest, highest = np.full(len(ids), 1 << 30), np.full(len(ids), -1)
    for offset in range(int(low.min()), int(high.max()) + 1):
        row = np.flatnonzero((low <= offset) & (offset <= high))
        again = row[repeated_windows(word, row * width + side - offset, ids[row], depth)]
        lowest[again] = np.minimum(lowest[again], offset)
        highest[again] = offset
    hit = np.flatnonzero(highest[of] >= 0)
    return spans(key[hit], local[hit], place[hit] - highest[of[hit]], place[hit] - lowest[of[hit]] + depth)


def spans(key: np.ndarray, local: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Table:
    """Spans by key, those that overlap in a text put together."""
    order = np.lexsort((starts, local, key))
    key, local, starts, stops = key[order], local[order], starts[order], stops[order]
    if not len(key):
        return SPANS.empty_table()
    far = np.cumsum(np.r_[True, (local[1:] != local[:-1]) | (key[1:] != key[:-1])]) << 40  # sets texts apart on one line
    heads = np.flatnonzero(np.r_[True, (starts + far)[1:] > np.maximum.accumulate(stops + far)[:-1]])
    stops = np.maximum.reduceat(stops, heads)
    key, local, starts = key[heads], local[heads], starts[heads]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    return pa.Table.from_pylist([{"key": int(key[a]), "n": int(b - a), "spans": planes([(x[a:b], 4) for x in (local, starts, stops)])} for a, b in zip(cuts, cuts[1:], strict=False)], SPANS)


def cut(docs: pa.Table, found: pa.Table, with_text: bool) -> pa.Table:
    """Step 3: each text without its spans."""
    texts = Texts(docs)
    n = len(texts.ref)
    parts = [from_planes(x, n, (4, 4, 4)) for x, n in zip(found.column("spans").to_pylist(), found.column("n").to_pylist(), strict=True)]
    local, starts, stops = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((starts, local))
    local, starts, stops = local[order], starts[order], stops[order]
    left, right = np.searchsorted(local, texts.local, side="left"), np.searchsorted(local, texts.local, side="right")
    raw = texts.flat.tobytes()
    size, gone, runs, digest, kept_texts = [], [], [], [], []
    for i in range(n):
        lo, hi = int(texts.bounds[i]), int(texts.bounds[i + 1])
        kept, at, spans_n = [], 0, 0
        for a, b in zip(starts[left[i] : right[i]].tolist(), stops[left[i] : right[i]].tolist(), strict=True):
            if a > at or spans_n == 0:
                kept.append(raw[lo + at : lo + a])
                spans_n += 1
            at = max(at, b)
        kept.append(raw[lo + at : hi])
        rest = b"".join(kept)
        size.append(hi - lo)
        gone.append(hi - lo - len(rest))
        runs.append(spans_n)
        digest.append(hashlib.sha256(rest).hexdigest())
        if with_text:
            kept_texts.append(rest.decode("utf-8", "ignore"))
    out = {"id": pa.array(texts.id, pa.int64(), mask=~texts.known), "ref": pa.array(texts.ref), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
    if with_text:
        out |= {"kept": pa.array(kept_texts, pa.string()), "extra": docs.column("extra")}
    return pa.table(out)


def dedup(docs: DataFrame, depth: int = DEPTH, group_bytes: int = GROUP_BYTES, hot_groups: int = HOT_GROUPS, keep: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``docs``; with ``keep`` also the text that is kept.

    The texts are shuffled once, by a hash of id and text, into groups of about ``group_bytes``, one text at least; all
    three steps read that shuffle. A text may have up to 2 GiB. ``keep`` names columns to carry along, in a struct ``extra``. Removed spans may cut a character in
    two: the column ``kept`` leaves out the bytes of such halves, the digest has them.
    """
    gram = max(1, (depth + 1) // 3)
    ship(docs.sparkSession)
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    id_ = column(docs, id_col).cast("long")
    ref = F.xxhash64(id_, text)
    sizes = docs.select(ref.alias("ref"), (F.octet_length(text) + ROW_BYTES).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    buckets, parts = max(1, groups // 2), 2
    columns = [ref.alias("ref"), id_.alias("id"), text.alias("text")]
    result = T.StructType.fromDDL("id long, ref long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if keep is not None:
        columns.append(F.struct(F.lit(0).alias("none"), *(column(docs, c).alias(f"c{i}") for i, c in enumerate(keep))).alias("extra"))
    rows = docs.select(*columns)
    # Rows that repeat one id and text so often that they would fill a group are dealt out over several: at most four such pairs a group.
    often = sizes.groupBy("ref").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") > group_bytes / 4))
    salt = F.lit(0)
    if not often.isEmpty():
        often = often.select("ref", F.ceil(4 * F.col("size") / group_bytes).alias("shares"))
        rows = rows.join(broadcast_if_small(often), "ref", "left")
        salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("shares")), F.lit(0))
    keyed = rows.withColumn("key", F.pmod(F.xxhash64("ref", salt), F.lit(groups)).cast("long")).drop("shares").repartition(groups, "key")
    if keep is not None:
        result = result.add("kept", "string").add(keyed.schema["extra"])
    digits = keyed.groupBy("key").applyInArrow(lambda t: send_digits(t, depth, gram, buckets), "bucket long, key long, codes binary, several binary")
    shared = digits.groupBy("bucket").applyInArrow(lambda t: shared_digits(t, hot_groups), "key long, bucket long, n long, shared binary, hot binary")
    windows = keyed.groupBy("key").cogroup(shared.groupBy("key")).applyInArrow(
        lambda d, a: send_windows(d, a, depth, gram, buckets, parts),
        "bucket long, key long, n long, contents binary, bytes binary, m long, places binary",
    )
    found = windows.groupBy("bucket").applyInArrow(lambda t: repeated(t, depth, gram), "key long, n long, spans binary")
    return keyed.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(lambda d, f: cut(d, f, keep is not None), result)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the repeated spans cut out of the texts, all columns; rows that lose all but white space go."""
    found = dedup(docs, keep=tuple(docs.columns), id_col=id_col, text_col=text_col, **options)
    found = found.where("n_removed = 0 OR trim(kept) <> ''")
    new = {text_col: F.col("kept"), size_col: F.length("kept")}
    out = []
    for i, (name, kind) in enumerate(zip(docs.columns, docs.schema, strict=True)):
        was = F.col(f"extra.c{i}")
        out.append((F.when(F.col("n_removed") > 0, new[name].cast(kind.dataType)).otherwise(was) if name in new else was).alias(name))
    return found.select(*out)
