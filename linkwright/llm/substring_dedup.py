"""Operator 8: suffix-array dedup of long repeated byte strings.

A ``Rule`` says which strings count: those of ``length`` bytes and, if asked for, shorter
ones of ``words`` words. Each byte covered by such a string that also starts anywhere
else is reported. How the work is spread:

1. Every window (string that counts) belongs to one anchor, the least hash among the
   ``gram``-byte strings of a stretch that the window itself determines, so equal windows
   have equal anchors. A task lists, for each anchor, the stretch of windows it owns (a
   context) with a hash of it.
2. Anchors that occur once in the corpus are done. Copies of one context are merged
   before any array: a context that occurs twice or more is repeated as a whole. Contexts
   are known by two 64-bit hashes.
3. The other contexts of a repeated anchor meet in one group. What stands from the anchor
   on, and what stands before it, read backwards, are cut into overlapping phrases none of
   which begins with another; phrases are ranked by their bytes, so the suffix array of the
   ranks (linear grouping construction, ``suffix_array``) holds both sides in byte order.
   The common prefixes of neighbours, in bytes, then decide which windows are equal: those
   that reach as far to either side and stand in one run of neighbours that share as many
   bytes. No window is compared by a hash.
4. Covered stretches are merged for each text and taken out of it.

Groups of more than ``GROUP`` contexts do not go to one task: their windows are dealt by
hash and counted, after each task has combined its own (``oversized``); there, and for
merged copies, equality is that of hashes.

Defined results: a null text counts as empty; matches never cross documents;
repeated rows are other occurrences, so equal texts of ``length`` bytes or more
are emptied; words are runs of bytes that are not ASCII white space, and marks before
the letters of a window's first word and behind those of its last do not count; the
bytes that remain may break a character, so ``remove_repeats`` and the query's ``text``
drop the bytes of characters that were cut, while sizes and digests keep them. Rows with
equal texts share their result. Other columns are carried along by ``remove_repeats``,
whatever their names, and ignored by ``repeated_spans``. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_names, materialize, read_table, sorted_groups
from .suffix_array import common_prefixes, suffix_array

LENGTH = 400
#: A passage of over 50 words is a repeat, however few bytes it has.
PASSAGE_WORDS = 51
GROUP = 16_384
SEGMENT = 1 << 19
BATCH_BYTES = 1 << 20  # of contexts in one suffix array
TRIGGER = 4  # bytes that decide on a cut
PERIOD = 64  # mean bytes of a phrase

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 20) - 1)
_FAR = np.iinfo(np.int64).max >> 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1 << 20), _powers(_INVERSE, 1 << 20)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Hashes of any stretch of a buffer of at most 2 ** 20 - 1 bytes, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=self.sums[1:])

    def stretch(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * _DOWN[:n] + np.uint64(size))


def least_within(key: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least of ``key[start:end]`` for every stretch; none is empty."""
    level = np.frexp((ends - starts).astype(np.float64))[1] - 1  # the largest power of two that fits
    out = np.empty(len(starts), dtype=key.dtype)
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            key = np.minimum(key[: -(1 << (k - 1))], key[1 << (k - 1) :])
        here = level == k
        out[here] = np.minimum(key[starts[here]], key[ends[here] - (1 << k)])
    return out


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LETTER = np.array([x >= 128 or chr(x).isalnum() for x in range(256)])


@dataclass(frozen=True)
class Rule:
    """Windows of ``length`` bytes, one at every byte, and those of ``words`` words and fewer bytes, one at every word."""

    length: int = LENGTH
    words: int = 0

    def __post_init__(self) -> None:
        if not 64 <= self.length <= 511 or self.words and not 12 <= self.words <= self.length // 3:
            raise ValueError("length must be 64 to 511, words 0 or 12 to a third of it")

    @property
    def least(self) -> int:
        """Bytes of the shortest window."""
        return min(self.length, 2 * self.words - 1) if self.words else self.length

    @property
    def gap(self) -> int:
        """Bytes after the start of a window of ``length`` in which a word is looked for."""
        return min(96, self.length // 4)

    @property
    def gram(self) -> int:
        return min(48, self.length // 4, 2 * self.words - 3 if self.words else 48)

    @property
    def bits(self) -> int:
        """Of a place inside a context."""
        return (2 * self.length).bit_length()


@dataclass
class Tokens:
    """Words of a buffer: first byte, first letter, behind the last letter, behind the last byte."""

    begin: np.ndarray
    first: np.ndarray
    last: np.ndarray
    stop: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> Tokens:
        """``before`` and ``behind``: parts of words that stand outside the buffer, at its edges."""
        space = _SPACE[data]
        begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        stop = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        letter = _LETTER[data]
        places: np.ndarray | None = None
        first, last = begin.copy(), stop.copy()
        odd = np.flatnonzero(~letter[begin] | ~letter[stop - 1])
        if len(odd):
            places = np.flatnonzero(letter)
            a, b = np.searchsorted(places, begin[odd]), np.searchsorted(places, stop[odd])
            some = b > a
            first[odd[some]], last[odd[some]] = places[a[some]], places[b[some] - 1] + 1
        if before is not None and len(before) and len(begin) and begin[0] == 0 and (_LETTER[before].any() or not letter[: stop[0]].any()):
            begin, first, last, stop = begin[1:], first[1:], last[1:], stop[1:]  # this word started before the buffer
        if behind is not None and len(behind) and len(stop) and stop[-1] == len(data) and _LETTER[behind].any():
            last[-1] = _FAR
        return cls(begin, first, last, stop)

    def windows(self, rule: Rule) -> np.ndarray:
        """Numbers of the words at which a window of words starts."""
        n = len(self.first) - rule.words + 1
        if not rule.words or n <= 0:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero(self.last[rule.words - 1 :] - self.first[:n] < rule.length)


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches as maximal ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]]) - 1


def _segment(data: np.ndarray, own: int, tokens: Tokens, rule: Rule) -> tuple[np.ndarray, ...] | None:
    """Contexts of the windows that start at the first ``own`` bytes of ``data``."""
    size, reach, gram = rule.length, rule.length - rule.gap, rule.gram
    if len(data) < rule.least:
        return None
    hasher = Hasher(data)
    h = hasher.every(gram)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    least = lambda starts, ends: (least_within(key, starts, ends - gram + 1) & _LOW).astype(np.int64)

    # The stretch of a word ends before the last word of its window, or after ``reach`` bytes.
    end = tokens.first + reach
    if rule.words:
        n = max(len(end) - rule.words + 2, 0)
        end[:n] = np.minimum(end[:n], tokens.stop[rule.words - 2 :])
    sound = np.flatnonzero(end <= len(data))
    of_word = np.full(len(end) + 1, -1)
    of_word[sound] = least(tokens.first[sound], end[sound])

    found = []
    n = min(own, len(data) - size + 1)
    if n > 0:
        # A window of bytes takes the first word behind its first white space, or, if there is none near, a place counted from its start.
        flags = np.zeros(n, dtype=np.int64)
        flags[tokens.begin[tokens.begin < n]] = 1
        j = np.cumsum(flags)
        at = np.append(tokens.first, _FAR)[j]
        owner = of_word[j]
        far = np.flatnonzero(at > np.arange(n) + rule.gap)
        owner[far] = least(far + rule.gap, far + size)
        a, b = _runs(owner)
        found.append((owner[a], a, b + size, np.full(len(a), _FAR), np.full(len(a), -1)))
    w = tokens.windows(rule)
    w = w[tokens.first[w] < own]
    if len(w):
        a, b = _runs(of_word[w])
        starts, ends = tokens.first[w[a]], tokens.last[w[b] + rule.words - 1]
        found.append((of_word[w[a]], starts, ends, starts, ends))
    if not found:
        return None
    at, starts, ends, first, last = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(at, kind="stable")
    cut, _ = _runs(at[order])
    at = at[order][cut]
    starts, first = (np.minimum.reduceat(x[order], cut) for x in (starts, first))
    ends, last = (np.maximum.reduceat(x[order], cut) for x in (ends, last))
    some = last > 0
    first, last = np.where(some, first - starts, 0), np.where(some, last - starts, 0)
    bounds = (((at - starts) << 32) | (first << 16) | last).astype(np.uint64)
    context = _mix(hasher.stretch(starts, ends) + bounds * np.uint64(0x9FB21C651E98DF25))
    return hasher.stretch(at, at + gram), context, starts, ends, first, last, at - starts


def contexts(data: bytes, rule: Rule) -> tuple[np.ndarray, ...]:
    """(anchor, context, start, end, first, last, at) of a text: first and last bound the windows of words inside the context, at is the anchor's place in it."""
    whole = np.frombuffer(data, dtype=np.uint8)
    found = []
    for x in range(0, len(data) if len(data) >= rule.least else 0, SEGMENT):
        part = whole[x : x + SEGMENT + rule.length]
        left = 1 + max(data.rfind(c, 0, x) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if x else 0
        y = x + len(part)
        right = min((k for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r") if (k := data.find(c, y)) >= 0), default=len(data)) if y < len(data) else y
        got = _segment(part, SEGMENT, Tokens.of(part, whole[left:x], whole[y:right]), rule)
        if got:
            f, c, a, b, *rest = got
            found.append((f, c, a + x, b + x, *rest))
    if not found:
        return tuple(np.empty(0, dtype=t) for t in (np.uint64, np.uint64, *[np.int64] * 5))
    return tuple(np.concatenate(c) for c in zip(*found))


def _pack(starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray, rule: Rule) -> np.ndarray:
    """Start, size and bounds of the windows of words in one number."""
    k = rule.bits
    return (((((starts << k) | sizes) << k) | first) << k) | last


def _place(rule: Rule) -> tuple[Column, Column, Column, Column]:
    """The four numbers that ``_pack`` puts together, from the column ``place``."""
    k, mask = rule.bits, (1 << rule.bits) - 1
    return tuple(F.expr(x) for x in (f"shiftright(place, {3 * k})", f"shiftright(place, {2 * k}) & {mask}", f"shiftright(place, {k}) & {mask}", f"place & {mask}"))


ANCHORS = "f long, c long, n int, key long, size long, place long, at int"


def list_anchors(texts: DataFrame, rule: Rule) -> DataFrame:
    """``texts``: key, size, text. One row for each context of a text; f is null for a stretch that its own text repeats, and c is its kind.

    A task skips a text from its third occurrence on: two make everything in it a repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            keys, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin in range(0, batch.num_rows, 256):
                out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
                valid: list[np.ndarray] = []

                def add(f, c, n, place, at, who, known):
                    for column, values in zip(out, (f, c, n)):
                        column.append(values.astype(np.int64))
                    out[3].append(np.full(len(f), keys[who]))
                    out[4].append(np.full(len(f), sizes[who]))
                    out[5].append(place)
                    out[6].append(at)
                    valid.append(np.full(len(f), known))

                def add_own(starts, ends, kind, who):
                    x, y = merge(starts, ends)
                    while len(x):  # a stretch is written in parts that fit the packed size
                        z = np.minimum(x + rule.length, y)
                        zero = np.zeros(len(x), dtype=np.int64)
                        add(zero, zero + kind, zero + 2, _pack(x, z - x, zero, zero, rule), zero, who, False)
                        x, y = z[z < y], y[z < y]

                for who in range(begin, min(begin + 256, batch.num_rows)):
                    seen[keys[who], sizes[who]] += 1
                    if seen[keys[who], sizes[who]] > 2:
                        continue
                    f, c, a, b, first, last, at = contexts(batch.column(2)[who].as_py().encode(), rule)
                    if not len(f):
                        continue
                    order = np.lexsort((c, f))
                    sf, sc = f[order], c[order]
                    starts = np.flatnonzero(np.concatenate([[True], (sf[1:] != sf[:-1]) | (sc[1:] != sc[:-1])]))
                    count = np.diff(np.append(starts, len(f)))
                    if (count > 1).any():
                        own = order[np.repeat(count > 1, count)]
                        long, some = own[b[own] - a[own] >= rule.length], own[last[own] > 0]
                        add_own(a[long], b[long], 0, who)
                        add_own(a[some] + first[some], a[some] + last[some], 1, who)
                    one = order[starts]
                    add(f[one].view(np.int64), c[one].view(np.int64), np.minimum(count, 2), _pack(a[one], (b - a)[one], first[one], last[one], rule), at[one], who, True)
                if valid:
                    columns = [np.concatenate(c) for c in out]
                    arrays = [pa.array(columns[0], mask=~np.concatenate(valid)), pa.array(columns[1]), pa.array(columns[2], type=pa.int32())]
                    arrays += [*(pa.array(c) for c in columns[3:6]), pa.array(columns[6], type=pa.int32())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["f", "c", "n", "key", "size", "place", "at"])

    return texts.mapInArrow(run, ANCHORS)


def _fold(anchors: DataFrame, rows: int = 400_000) -> DataFrame:
    """Contexts with the number of their occurrences and one place, combined within each task before they are dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            f, c, n, *rest = (x.to_numpy() for x in table.columns)
            order = np.lexsort((c, f))
            f, c, n, rest = f[order], c[order], n[order].astype(np.int64), [x[order] for x in rest]
            start = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (c[1:] != c[:-1])]))
            total = np.minimum(np.add.reduceat(n, start), 2).astype(np.int32)
            columns = [f[start], c[start], total, *(x[start] for x in rest)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["f", "c", "n", "key", "size", "place", "at"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield flush()
                held = []
        if held:
            yield flush()

    width = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return anchors.where(F.col("f").isNotNull()).mapInArrow(run, ANCHORS).repartition(width, "f")


def _same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Bytes that stand alike from x and from y on, at most ``limit``."""
    out = np.zeros(len(x), dtype=np.int64)
    open_ = np.flatnonzero(limit > 0)
    step = np.arange(16)
    while len(open_):
        left = limit[open_] - out[open_]
        inside = step < left[:, None]
        ahead = np.where(inside, step, 0) + out[open_, None]
        alike = (data[x[open_, None] + ahead] == data[y[open_, None] + ahead]) & inside
        more = np.where(alike.all(axis=1), len(step), alike.argmin(axis=1))
        out[open_] += more
        open_ = open_[(more == len(step)) & (out[open_] < limit[open_])]
    return np.minimum(out, limit)


def all_windows(parts: list[bytes], first: np.ndarray, last: np.ndarray, base: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows inside contexts that stand one after another from ``base`` on."""
    sizes = np.diff(base)
    count = np.maximum(sizes - rule.length + 1, 0)
    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(base[:-1], count)
    ends = starts + rule.length
    some = np.flatnonzero(last > first)
    if rule.words and len(some):
        cut = [parts[k][first[k] : last[k]] for k in some.tolist()]
        at = np.cumsum([0] + [len(c) + 1 for c in cut])
        tokens = Tokens.of(np.frombuffer(b" ".join(cut), dtype=np.uint8))
        of = np.searchsorted(at, tokens.first, "right") - 1
        w = tokens.windows(rule)
        w = w[of[w] == of[w + rule.words - 1]]
        shift = (base[some] + first[some] - at[:-1])[of[w]]
        starts, ends = np.concatenate([starts, tokens.first[w] + shift]), np.concatenate([ends, tokens.last[w + rule.words - 1] + shift])
    return starts, ends


def byte_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each string in byte order (equal ones share it), and the bytes that the string at a place shares with the one before it.

    The order is that of the suffix array of the strings' phrases, read at the first phrase of each string.
    """
    number = {string: k for k, string in enumerate(dict.fromkeys(strings))}
    raw = b"".join(number)
    data = np.frombuffer(raw, dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum([len(x) for x in number])]).astype(np.int64)

    # A phrase starts with its string or where the next bytes hash to a chosen value, and ends behind the next such bytes.
    value = np.zeros(len(data), dtype=np.uint32)
    for k in range(TRIGGER):
        value[: len(data) - k] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    value *= np.uint32(0x9E3779B1)
    chosen = np.flatnonzero(value < np.uint32((1 << 32) // PERIOD))
    chosen = chosen[chosen + TRIGGER <= base[np.searchsorted(base, chosen, "right")]]
    cuts = np.union1d(base[:-1], chosen)
    of = np.searchsorted(base, cuts, "right") - 1
    end_of = base[1:][of]
    tail = np.append(of[1:] != of[:-1], True)
    stops = np.where(tail, end_of, np.append(cuts[1:], 0) + TRIGGER)
    # The last phrase of a string ends like no other, so none begins with another one.
    names = [(raw[a:b], 0, k) if t else (raw[a:b], 1, 0) for k, (a, b, t) in enumerate(zip(cuts.tolist(), stops.tolist(), tail.tolist()))]
    rank = {name: k for k, name in enumerate(sorted(set(names)), 1)}
    symbols = np.array([*map(rank.__getitem__, names), 0])
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order)

    opens = np.append(np.concatenate([[True], tail[:-1]]), False)
    at = np.flatnonzero(opens[order])  # strings, in order
    first = order[at]
    place = np.empty(len(number), dtype=np.int64)
    place[of[first]] = np.arange(len(number))
    common = np.zeros(len(number), dtype=np.int64)
    if len(number) > 1:
        phrases = np.minimum.reduceat(shared[: at[-1] + 1], at[:-1] + 1)
        low, high = first[:-1], first[1:]
        x, y = cuts[low + phrases], cuts[high + phrases]
        common[1:] = y - cuts[high] + _same_bytes(data, x, y, np.minimum(end_of[low] - x, end_of[high] - y))
    return place[[number[x] for x in strings]], common


def equal_windows(parts: list[bytes], at: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.ndarray) -> np.ndarray:
    """True for each window whose bytes another window repeats; ``at``: the anchors, which stand alike in equal windows."""
    split = list(zip(parts, at.tolist()))
    place_ahead, common_ahead = byte_order([p[a:] for p, a in split])
    place_behind, common_behind = byte_order([p[a::-1] for p, a in split])
    of = np.searchsorted(base, starts, "right") - 1
    anchor = (base[:-1] + at)[of]
    ahead, behind = ends - anchor, anchor - starts + 1

    # Strings that share that many bytes stand together, so equal windows have equal numbers of their runs on both sides.
    def runs(lengths: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(lengths), dtype=np.uint64)
        by = np.argsort(lengths, kind="stable")
        first, last = _runs(lengths[by])
        for a, b in zip(first.tolist(), last.tolist()):
            here = by[a : b + 1]
            out[here] = np.cumsum(common < lengths[here[0]])[place[here]]
        return out

    key = (behind.astype(np.uint64) << np.uint64(9)) | ahead.astype(np.uint64)
    key = (key << np.uint64(23)) | runs(ahead, common_ahead, place_ahead[of])
    key = (key << np.uint64(23)) | runs(behind, common_behind, place_behind[of])
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    hit = np.zeros(len(starts), dtype=bool)
    hit[by] = np.append(same, False) | np.concatenate([[False], same])
    return hit


def match_contexts(parts: list[bytes], at: np.ndarray, first: np.ndarray, last: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """(context, start, end, kind) of the stretches that another window repeats; kind 0: of bytes, 1: of words."""
    base = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    starts, ends = all_windows(parts, first, last, base, rule)
    if not len(starts):
        return (np.empty(0, dtype=np.int64),) * 4
    hit = equal_windows(parts, at, starts, ends, base)
    out = []
    for kind in (0, 1):
        mine = hit & ((ends - starts < rule.length) == bool(kind))
        a, b = merge_windows(starts[mine], ends[mine], base)
        row = np.searchsorted(base, a, "right") - 1
        out.append((row, a - base[row], b - base[row], np.full(len(row), kind)))
    return tuple(np.concatenate(c) for c in zip(*out))


def merge_windows(starts: np.ndarray, ends: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ascending windows as stretches, never across contexts."""
    if not len(starts):
        return starts, ends
    owner = np.searchsorted(base, starts, "right")
    new = np.concatenate([[True], (starts[1:] > ends[:-1]) | (np.diff(owner) > 0)])
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]


def fetch(wanted: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Bytes of the wanted contexts: f, c, at, first, last, data, large. ``wanted``: f, c, key, size, place, at, large."""
    start, size, first, last = _place(rule)
    item = F.struct("f", "c", "at", start.alias("a"), size.alias("k"), first.alias("first"), last.alias("last"), "large")
    lists = wanted.groupBy("key", "size").agg(F.collect_list(item).alias("list"))
    once = texts.dropDuplicates(["key", "size"])
    met = once.join(lists, ["key", "size"]).select("text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                rows = []
                for text, items in zip(batch.column(0).slice(begin, 128), batch.column(1).slice(begin, 128).to_pylist()):
                    data = text.as_py().encode()
                    rows += [(x["f"], x["c"], x["at"], x["first"], x["last"], data[x["a"] : x["a"] + x["k"]], x["large"]) for x in items]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["f", "c", "at", "first", "last", "data", "large"])

    return met.mapInArrow(run, "f long, c long, at int, first int, last int, data binary, large boolean")


MATCHES = "f long, c long, a int, b int, kind int"


def match_groups(found: DataFrame, rule: Rule) -> DataFrame:
    """Stretches of contexts that another context of their anchor repeats; several groups share a suffix array."""
    width = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def result(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held)
        f, c, at, first, last = (table.column(k).to_numpy() for k in range(5))
        row, a, b, kind = match_contexts(table.column(5).to_pylist(), at, first, last, rule)
        return pa.RecordBatch.from_arrays([pa.array(f[row]), pa.array(c[row]), *(pa.array(x.astype(np.int32)) for x in (a, b, kind))], names=["f", "c", "a", "b", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for group in sorted_groups(batches, 1):
            own = pc.sum(pc.binary_length(group.column("data"))).as_py()
            if held and size + own > BATCH_BYTES:
                yield result(held)
                held, size = [], 0
            held.append(group)
            size += own
        if held:
            yield result(held)

    return found.repartition(width, "f").sortWithinPartitions("f", "c").mapInArrow(run, MATCHES)


def oversized(found: DataFrame, rule: Rule) -> DataFrame:
    """The same result for groups that are too large for a task: windows are dealt by hash and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                parts = part.column(5).to_pylist()
                f, c, _, first, last = (part.column(k).to_numpy() for k in range(5))
                base = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                starts, ends = all_windows(parts, first, last, base, rule)
                h = Hasher(np.frombuffer(b"".join(parts), dtype=np.uint8)).stretch(starts, ends)
                row = np.searchsorted(base, starts, "right") - 1
                numbers = [(x - base[row]).astype(np.int32) for x in (starts, ends)] + [(ends - starts < rule.length).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), f[row], c[row], *numbers)], names=["h", "f", "c", "a", "b", "kind"])

    windows = found.mapInArrow(run, f"h long, {MATCHES}")
    twice = windows.groupBy("h", "f").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).drop("m")
    return windows.join(twice, ["h", "f"]).select("f", "c", "a", "b", "kind")


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))


def repeated_spans(df: DataFrame, text_col: str = "text", group: int = GROUP, rule: Rule = Rule()) -> DataFrame:
    """(key, size, spans): covered stretches (a, b, kind) of each text that has any; key and size identify a text.

    Stretches may overlap. Kind 0 is covered by windows of bytes, kind 1 by windows of words.
    """
    texts = keyed(df, text_col).where(F.col("size") >= rule.least)
    anchors = materialize(list_anchors(texts, rule), "anchors")
    folded = _fold(anchors).groupBy("f", "c").agg(
        F.sum("n").alias("n"), F.min(F.struct("key", "size", "place", "at")).alias("rep")
    )
    per_anchor = folded.groupBy("f").agg(F.count(F.lit(1)).alias("variants"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single"), F.sum("n").alias("total"))
    repeated = folded.join(per_anchor.where(F.col("total") > 1), "f")
    repeated = materialize(repeated.select("f", "c", F.least("n", F.lit(2)).cast("int").alias("n"), "rep.*", "variants", "single"), "repeated")

    open_ = repeated.where((F.col("variants") > 1) & (F.col("single") > 0)).withColumn("large", F.col("variants") > group)
    found = fetch(open_, texts, rule)
    if some_large := open_.where("large").limit(1).count():  # the contexts are read three times, but the texts shuffled once
        found = materialize(found, "contexts")
    matched = materialize(match_groups(found.where(~F.col("large")), rule), "matched")
    if some_large:
        matched = matched.unionByName(materialize(oversized(found.where("large"), rule), "matched-large"))
    start, size, first, last = _place(rule)
    whole = repeated.where(F.col("n") > 1).select(
        "f", "c", F.explode(F.array(F.struct(F.lit(0).alias("a"), size.alias("b"), F.lit(0).alias("kind")), F.struct(first.alias("a"), last.alias("b"), F.lit(1).alias("kind")))).alias("x")
    ).select("f", "c", F.col("x.a").cast("int").alias("a"), F.col("x.b").cast("int").alias("b"), "x.kind").where(
        F.when(F.col("kind") == 0, F.col("b") >= rule.length).otherwise(F.col("b") > 0)
    )
    stretches = whole.unionByName(matched).groupBy("f", "c").agg(F.collect_set(F.struct("a", "b", "kind")).alias("s"))

    shifted = F.transform("s", lambda x: F.struct((start + x["a"]).alias("a"), (start + x["b"]).alias("b"), x["kind"].alias("kind")))
    met = anchors.join(stretches, ["f", "c"]).select("key", "size", F.explode(shifted).alias("x"))
    own = anchors.where(F.col("f").isNull()).select("key", "size", F.struct(start.alias("a"), (start + size).alias("b"), F.col("c").cast("int").alias("kind")).alias("x"))
    return met.unionByName(own).groupBy("key", "size").agg(F.collect_set("x").alias("spans"))


def with_spans(df: DataFrame, text_col: str, rule: Rule) -> tuple[DataFrame, Column, Column, list[Column]]:
    """``df`` with the spans of its texts; the name of the text, whether it has any, and its arguments for a function over them."""
    spans = materialize(repeated_spans(df, text_col, rule=rule), "spans")
    key, size, own = fresh_names(df.columns, "cut_key", "cut_size", "cut_spans")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    met = df.join(spans.toDF(key, size, own), (F.xxhash64(text) == F.col(key)) & (F.octet_length(text).cast("long") == F.col(size)), "left")
    some = F.col(own).isNotNull()
    lists = [F.col(f"{own}.{k}").cast("array<long>") for k in ("a", "b", "kind")]
    return met, text, some, [F.when(some, text), *lists]


def _cut(text, a, b) -> tuple[bytes, bytes, np.ndarray]:
    data = text.as_py().encode()
    starts, ends = merge(a, b)
    gaps = zip([0, *ends.tolist()], [*starts.tolist(), len(data)])
    return data, b"".join(data[x:y] for x, y in gaps), starts


def _remaining(text: pa.Array, a: pa.Array, b: pa.Array, kind: pa.Array) -> pa.Array:
    """Texts without all their stretches."""
    out = [
        None if x.as_py() is None else _cut(x, starts.values.to_numpy(), ends.values.to_numpy())[1].decode("utf-8", "ignore")
        for x, starts, ends in zip(text, a, b)
    ]
    return pa.array(out, type=pa.string())


REPORT = "n_removed long, n_spans long, kept_sha256 string, text string"


def _reported(text: pa.Array, a: pa.Array, b: pa.Array, kind: pa.Array) -> pa.Array:
    """What the stretches of bytes remove, and the text without all stretches."""
    out = []
    for x, starts, ends, kinds in zip(text, a, b, kind):
        if x.as_py() is None:
            out.append(None)
            continue
        starts, ends, of_bytes = starts.values.to_numpy(), ends.values.to_numpy(), kinds.values.to_numpy() == 0
        data, kept, merged = _cut(x, starts[of_bytes], ends[of_bytes])
        rest = _cut(x, starts, ends)[1].decode("utf-8", "ignore")
        out.append({"n_removed": len(data) - len(kept), "n_spans": len(merged), "kept_sha256": hashlib.sha256(kept).hexdigest(), "text": rest})
    kinds = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "text": pa.string()}
    return pa.array(out, type=pa.struct(list(kinds.items())))


def substring_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 for strings of ``LENGTH`` bytes; then ``text``, what remains
    without those and without repeated passages of ``words`` words, and n_kept, its bytes.
    """
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    met, text, some, arguments = with_spans(rows, "text", Rule(words=words))
    cut = F.arrow_udf(_reported, REPORT)(*arguments)
    found = met.select(id_col, text.alias("whole"), some.alias("some"), cut.alias("cut"))
    zero = F.lit(0).cast("long")
    rest = F.when(F.col("some"), F.col("cut.text")).otherwise(F.col("whole"))
    return found.select(
        id_col,
        F.octet_length("whole").cast("long").alias("n_bytes"),
        F.coalesce("cut.n_removed", zero).alias("n_removed"),
        F.coalesce("cut.n_spans", zero).alias("n_spans"),
        F.coalesce("cut.kept_sha256", F.sha2("whole", 256)).alias("kept_sha256"),
        rest.alias("text"),
        F.octet_length(rest).cast("long").alias("n_kept"),
    )


def remove_repeats(df: DataFrame, text_col: str = "text", words: int = 0) -> DataFrame:
    """``df`` with the repeated bytes taken out of ``text_col``; bytes of characters that a cut divides go too.

    With ``words``, a repeat of that many words or more is taken out too, however few bytes it has.
    """
    met, _, some, arguments = with_spans(df, text_col, Rule(words=words))
    new, any_ = fresh_names(met.columns, "cut_text", "cut_any")
    cut = met.select(*[F.col(f"`{c}`") for c in df.columns], some.alias(any_), F.arrow_udf(_remaining, "string")(*arguments).alias(new))
    whole = F.when(F.col(any_), F.col(new)).otherwise(F.col(f"`{text_col}`"))
    return cut.select(*[whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(read_table(spark, sf_dir, "documents"))
