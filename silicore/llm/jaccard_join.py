"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set holds its word ``N``-grams. Documents with one set are one entry; sets
whose Jaccard similarity reaches ``NUM / DEN`` are found by prefix filtering over an
index of tokens, in an order that puts frequent tokens last. Prefixes are long enough
for similar sets to share ``SHARED`` tokens in them (or all that they must share, if
that is less), so pairs that meet less often are dropped before they are verified.

Index level: the list of a token is sorted by set size and cut into blocks that know the
furthest reach of their entries (size - position); from two reaches follows how much
two sets can still share, so a pair of blocks, or of entries, that cannot reach the
threshold is skipped without being looked at.

Answer level: sets that may be similar meet at one task. The overlaps of a leader with
all others are counted once through the index; for a set that differs from a leader
by few tokens they follow from the leader's: minus what the tokens that it lacks
share, plus what those that it adds share.

Bundles: a large family of near copies would meet as all its pairs in every list of a token
that it shares. Sets of one family (the first ``KEY`` common tokens of the set) are therefore
bundled, about ``BUNDLE`` to a bundle; a bundle has one entry in a list, with the least and the
largest size and the furthest reach of its sets, so a pair of bundles is a candidate whenever a
pair of their sets would be. Bundles that are candidates are verified set by set, as a product
of matrices, and what leaves the task is each set's number of links and its root in the task,
not the pairs. Families are found on a quarter of the texts: they decide about work, not results.

``links``, the query, gives a row for every document. ``join`` gives pairs of documents: each
pair of sets meets its sets' documents, which lie in chunks of about ``CHUNK``, so that a set of
any number of documents is spread over many tasks and no row grows with it.

Defined results
  * a word is a run of non-space characters, compared as it is; a text with fewer words
    than ``N`` has one n-gram of all its words; null and blank texts have no set and no partner;
  * ``links``: a row for every document and set of its own; ``links`` counts the other sets that
    reach the threshold, equal sets (copies) not included; ``class_id`` is the smallest doc_id that
    chains of links and copies lead to; documents without a set have no class and no link;
  * a null doc_id takes no part in the join; ``drop_near`` keeps such rows;
  * a doc_id with several texts has a set for each; ``drop_near`` drops only the rows
    whose own set is a near copy;
  * documents with equal sets have Jaccard 1, whatever their texts;
  * a pair of documents comes once; if their several texts reach the threshold more than
    once, with the highest Jaccard; a document is no partner of its own;
  * repeated rows count as one document; texts of any length are taken whole;
  * an empty table: no pair; extra columns are ignored, ``drop_near`` carries them through.

Tokens and sets are known by 64-bit hashes. The order of tokens only decides how much
work is skipped, never the result: frequencies are gathered from all documents (a
token counts where it occurs twice among the sets that a task holds at once) and the
table of frequent tokens is broadcast, its threshold doubling until it fits. Nothing
caps the partners of a set. Texts are scanned, not shuffled; what is shuffled are the
prefixes, and the sets of candidates, once for each group of candidates: a set's
group is that of its first neighbour. A group too large for one task is cut into
parts, and every two parts are verified together.

The index is partitioned by ranges of the token hash. A task ships the entries of a range as
one packed row (tokens, numbers of the sets in a dictionary, positions), which the range's
task unpacks and sorts: the JVM moves few large rows and sorts none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import BROADCAST_ROWS, fits, materialize, release, shielded, small, table
from .sentencepiece_bpe import gather, slices
from .words import scramble, split

N = 2
NUM, DEN = 11, 20
#: A token is frequent from this many sets on; the table of frequent tokens holds at most FREQUENT_ROWS.
FREQUENT = 4
FREQUENT_ROWS = 4_000_000
#: Tokens that a task holds at once to count them.
COUNTED = 6_000_000
#: Tokens that two similar sets must share within their prefixes.
SHARED = 3
#: Index entries of a partition: few large partitions, in which a pair's meetings add up.
INDEX_ROWS = 1_000_000
#: Index entries that a task holds before it ships them.
PACKED = 1_000_000
#: Documents of a set that are joined as one row.
CHUNK = 256
#: Candidates' sets that are verified together.
GROUP_SETS = 2_000
#: Index entries that a task scans, and meetings that it holds, at once.
SCANNED = 200_000
HELD = 1_000_000
BLOCK = 64
#: A token is common from this many sets on. A family's key: the first KEY common ones of a set's first LOOKED tokens.
COMMON = 64
KEY = 3
LOOKED = 64
#: Sets of fewer tokens are in no family. Sets that make a family, and sets of a bundle, about.
LEAST = 8
FAMILY = 64
BUNDLE = 512
#: A text in so many is looked at to find the families.
SAMPLE = 4
_SLICE = 1 << 20
_WORD = r"[^ \t\n\r\f]"


def sets_of(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every text; an empty array where there is none."""
    h, _, _, bound, _ = split(texts)
    out = []
    gram = _combine([h[i : len(h) - n + 1 + i] for i in range(n)]) if len(h) >= n else np.zeros(0, np.uint64)
    for a, b in zip(bound[:-1], bound[1:]):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            out.append(_combine([h[i : i + 1] for i in range(a, b)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _combine(words: list[np.ndarray]) -> np.ndarray:
    acc = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        acc = scramble(acc * np.uint64(0xFF51AFD7ED558CCD) + w)
    return acc


def set_id(tokens: np.ndarray) -> int:
    """An even number; odd ones are bundles."""
    return int(scramble(np.array([scramble(tokens ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0].astype(np.int64)) & ~1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _each_slice(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield from slices(batch, "text", _SLICE)


def _survey(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: (set, document, size). Kind 1: (token, count) of tokens met twice or more."""
    names = ["kind", "a", "b", "size"]
    held, n = np.empty(COUNTED, np.uint64), 0

    def counted() -> Iterator[pa.RecordBatch]:
        """Counts of the held tokens, which are sorted in place to save memory."""
        nonlocal n
        t, n = held[:n], 0
        t.sort()
        again = np.zeros(len(t) + 1, bool)
        again[1:-1] = t[1:] == t[:-1]
        begin, end = np.flatnonzero(again[1:] & ~again[:-1]), np.flatnonzero(again[:-1] & ~again[1:])
        k = len(begin)
        for i in range(0, k, 100_000):
            s = slice(i, i + 100_000)
            size = len(begin[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(size, np.int32)), _signed(t[begin[s]]), pa.array(end[s] - begin[s] + 1), pa.array(np.zeros(size, np.int64))], names=names)

    for part in _each_slice(it):
        sets = [s for s in sets_of(part.column("text"))]
        rows = [(set_id(s), d, len(s)) for s, d in zip(sets, part.column("doc_id").to_pylist()) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=names)
        # a set that occurs again within the slice counts once
        for s in {r[0]: s for r, s in zip(rows, (s for s in sets if len(s)))}.values():
            for a in range(0, len(s), COUNTED):
                more = s[a : a + COUNTED]
                if n + len(more) > COUNTED:
                    yield from counted()
                held[n : n + len(more)] = more
                n += len(more)
    yield from counted()
    release()


def _family(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of every set's family, and whether it has one."""
    key = np.zeros(len(sets), np.uint64)
    flat = np.concatenate([s[:LOOKED] for s in sets]) if sets else key
    if not len(common) or not len(flat):
        return key, np.zeros(len(sets), bool)
    hit = np.flatnonzero(common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] == flat)
    size = np.array([len(s) for s in sets])
    end = np.cumsum(np.minimum(size, LOOKED))
    first = np.searchsorted(hit, np.append(0, end[:-1]))
    has = (np.searchsorted(hit, end) - first >= KEY) & (size >= LEAST)
    key[has] = _combine([flat[hit[first[has] + i]] for i in range(KEY)])
    return key, has


def _units(sets: list[np.ndarray], sids: np.ndarray, families) -> np.ndarray:
    """What stands for every set in the index: its bundle, or itself."""
    common, keys, cuts = families
    out = sids.copy()
    if len(keys) and len(sets):
        key, has = _family(sets, common)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        has &= keys[at] == key
        cell = (sids.view(np.uint64) >> np.uint64(1)) % cuts[at]
        out[has] = _bundle(key, cell)[has]
    return out


def _bundle(key: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (scramble(key + cell * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).view(np.int64)


def _sampled(it: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(family, sid) of the sets that may be in a family."""
    for batch in _each_slice(it):
        sets = [s for s in sets_of(batch.column("text")) if len(s) >= LEAST]
        key, has = _family(sets, shared.value)
        sids = np.array([set_id(sets[i]) for i in np.flatnonzero(has)], np.int64)
        yield pa.RecordBatch.from_arrays([_signed(key[has]), pa.array(sids)], names=["family", "sid"])
    release()


def _prefixes(it: Iterator[pa.RecordBatch], shared, bundles, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, data): index entries packed by range of the token."""
    known, often = shared.value  # often: the frequency's class
    seen: set[int] = set()
    toks, units, sizes, places = [], [], [], []
    held = 0

    def ship() -> Iterator[pa.RecordBatch]:
        nonlocal held
        tok, count, size = np.concatenate(toks), np.array(places), np.array(sizes, np.int64)
        unit, at = np.unique(np.array(units, np.int64), return_inverse=True)
        low, high = np.full(len(unit), 1 << 62), np.zeros(len(unit), np.int64)
        np.minimum.at(low, at, size)
        np.maximum.at(high, at, size)
        # The first SHARED common tokens have this much, at least, still to come with them.
        reach = np.repeat(size + SHARED - 1 + np.cumsum(count) - count, count) - np.arange(count.sum())
        number = np.repeat(at, count)
        many = unit[number] & 1 == 1
        if many.any():
            t, k, r = tok[many], number[many], reach[many]
            order = np.lexsort((-r, k, t))
            t, k, r = t[order], k[order], r[order]
            new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))
            tok, number, reach = np.append(tok[~many], t[new]), np.append(number[~many], k[new]), np.append(reach[~many], r[new])
        order = np.argsort(tok, kind="stable")
        tok, number, reach = tok[order], number[order].astype(np.uint32), reach[order].astype(np.uint32)
        part = _part(tok, parts)
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for at in range(0, len(head), 64):
            some = [slice(x, y) for x, y in zip(head[at : at + 64], np.append(head, len(tok))[at + 1 : at + 65])]
            yield pa.RecordBatch.from_arrays([pa.array(part[head[at : at + 64]].astype(np.int32)), pa.array([_pack(tok[x], number[x], reach[x], unit, low, high) for x in some], pa.binary())], names=["part", "data"])
        seen.clear(), toks.clear(), units.clear(), sizes.clear(), places.clear()
        held = 0

    for batch in _each_slice(it):
        sets = [s for s in sets_of(batch.column("text")) if len(s)]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
        freq = np.where(known[at] == flat, often[at], 0) if len(known) else np.zeros(len(flat), np.int64)
        sids = np.array([set_id(s) for s in sets], np.int64)
        end = 0
        for s, sid, unit in zip(sets, sids.tolist(), _units(sets, sids, bundles.value).tolist()):
            begin, end = end, end + len(s)
            if sid in seen:
                continue
            seen.add(sid)
            p = min(len(s), len(s) - -(-NUM * len(s) // DEN) + SHARED)
            toks.append(s[np.argsort(freq[begin:end], kind="stable")[:p]])
            units.append(unit)
            sizes.append(len(s))
            places.append(p)
            held += p
        if held > PACKED:
            yield from ship()
    if held:
        yield from ship()
    release()


def _part(tok: np.ndarray, parts: int) -> np.ndarray:
    return ((tok >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack(tok: np.ndarray, number: np.ndarray, reach: np.ndarray, unit: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    own, at = np.unique(number, return_inverse=True)
    least = lambda x: x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4")
    at, reach = least(at), least(reach)
    head = np.array([len(tok), len(own), at.itemsize, reach.itemsize], "<u4")
    return b"".join(x.tobytes() for x in (head, tok.astype("<u8"), at, reach, unit[own].astype("<i8"), low[own].astype("<u4"), high[own].astype("<u4")))


def _unpack(data: memoryview) -> tuple[np.ndarray, ...]:
    """Tokens, units, their least and largest sizes, and reaches."""
    n, m, wide, deep = (int(x) for x in np.frombuffer(data, "<u4", 4))
    ends = np.cumsum([16, 8 * n, wide * n, deep * n, 8 * m, 4 * m])
    tok = np.frombuffer(data, "<u8", n, ends[0])
    at = np.frombuffer(data, f"<u{wide}", n, ends[1])
    reach = np.frombuffer(data, f"<u{deep}", n, ends[2]).astype(np.uint32)
    unit, low, high = np.frombuffer(data, "<i8", m, ends[3]), np.frombuffer(data, "<u4", m, ends[4]), np.frombuffer(data, "<u4", m, ends[5])
    return tok, unit[at], low[at], high[at], reach


def _enough(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The least overlap with which two sets of these sizes reach the threshold."""
    return -(-NUM * (size_a + size_b) // (NUM + DEN))


def list_pairs(tok: np.ndarray, unit: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs that meet in whole token lists, about ``HELD`` meetings at a time: smaller unit, other unit, meetings, meetings needed in all."""
    order = np.lexsort((unit, tok))
    tok, unit, low, high, reach = tok[order], unit[order], low[order], high[order], reach[order]
    new = np.flatnonzero(np.append(True, (tok[1:] != tok[:-1]) | (unit[1:] != unit[:-1])))
    tok, unit = tok[new], unit[new]
    low, high, reach = np.minimum.reduceat(low, new).astype(np.int64), np.maximum.reduceat(high, new).astype(np.int64), np.maximum.reduceat(reach, new).astype(np.int64)
    order = np.lexsort((low, tok))
    tok, unit, low, high, reach = tok[order], unit[order], low[order], high[order], reach[order]
    first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    end = np.append(first[1:], len(tok))

    def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        last = np.repeat(end, end - first)
        short = np.repeat(end - first <= 4 * BLOCK, end - first)
        i, d = np.flatnonzero(short), 0
        while len(i):
            d += 1
            i = i[i + d < last[i]]
            i = i[DEN * high[i] >= NUM * low[i + d]]
            hit = np.minimum(reach[i], reach[i + d]) >= _enough(low[i], low[i + d])
            yield i[hit], i[hit] + d
        for a, b in zip(first, end):
            if b - a > 4 * BLOCK:
                for x, y in _long_list(low[a:b], high[a:b], reach[a:b]):
                    yield x + a, y + a

    def summed(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        i, j = np.concatenate(left), np.concatenate(right)
        need = np.minimum(SHARED, _enough(low[i], low[j]))
        a, b = np.minimum(unit[i], unit[j]), np.maximum(unit[i], unit[j])
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[head], b[head], np.diff(np.append(head, len(a))), np.minimum.reduceat(need, head)

    left, right, held = [], [], 0
    for i, j in met():
        if len(i):
            left.append(i)
            right.append(j)
            held += len(i)
        if held > HELD:
            yield summed(left, right)
            left, right, held = [], [], 0
    if held:
        yield summed(left, right)


def _long_list(low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one long list, block against block; blocks out of reach are skipped."""
    cut = np.arange(0, len(low), BLOCK)
    top, least, most = np.maximum.reduceat(reach, cut), low[cut], np.maximum.reduceat(high, cut)
    for k, a in enumerate(cut):
        far = np.arange(k, len(cut))
        far = far[(DEN * most[k] >= NUM * least[far]) & (np.minimum(top[k], top[far]) >= _enough(least[k], least[far]))]
        x = slice(a, min(a + BLOCK, len(low)))
        for b in far * BLOCK:
            y = slice(b, min(b + BLOCK, len(low)))
            hit = (np.minimum(reach[x][:, None], reach[y][None, :]) >= _enough(low[x][:, None], low[y][None, :])) & (DEN * high[x][:, None] >= NUM * low[y][None, :])
            if b == a:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            if len(i):
                yield i + a, j + b


def _candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings in one range of tokens, list by list."""
    found: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        a, b, met = (np.concatenate(c) for c in zip(*found))
        found.clear()
        order = np.lexsort((b, a))
        a, b, met = a[order], b[order], met[order]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[head], b[head], np.minimum(SHARED, np.add.reduceat(met, head, dtype=np.int64)).astype(np.int8)

    def emit(most: int) -> Iterator[pa.RecordBatch]:
        """Add up what is held; give it out if it is still more than ``most``."""
        if sum(len(f[0]) for f in found) > most:
            cols = merged()
            if len(cols[0]) <= most // 2:
                found.append(cols)
                return
            for i in range(0, len(cols[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].astype(np.int64)) for c in cols], names=["a", "b", "met"])

    packed = [_unpack(memoryview(d.as_buffer())) for batch in it for d in batch.column(1)]
    if packed:
        cols = [np.concatenate(c) for c in zip(*packed)]
        packed.clear()
        # The sets of a bundle are compared with each other.
        own = np.unique(cols[1][cols[1] & 1 == 1])
        if len(own):
            found.append((own, own, np.full(len(own), SHARED, np.int8)))
        order = np.argsort(cols[0], kind="stable")
        tok = cols[0][order]
        # Tokens of one entry meet nothing.
        same = tok[1:] == tok[:-1]
        order = order[np.append(same, False) | np.append(False, same)]
        cols = [c[order] for c in cols]
        tok, end = cols[0], len(cols[0])
        at = 0
        while at < end:
            to = min(at + SCANNED, end)
            to = int(np.searchsorted(tok, tok[to - 1], "right"))
            for a, b, met, need in list_pairs(*(c[at:to] for c in cols)):
                # Pairs that need fewer meetings than SHARED are given the rest.
                found.append((a, b, np.minimum(SHARED, met + SHARED - need).astype(np.int8)))
                yield from emit(HELD)
            at = to
    yield from emit(0)
    release()


def _wanted_sets(it: Iterator[pa.RecordBatch], bundles, shared) -> Iterator[pa.RecordBatch]:
    """(comp, unit, sid, tokens) of the sets that groups want; all sets, without comp, if ``shared`` is None."""
    sent: set[int] = set()  # a task sends a set once
    for part in _each_slice(it):
        every = {i: s for s in sets_of(part.column("text")) if len(s) and (i := set_id(s)) not in sent}
        sids, sets = np.array(list(every), np.int64), list(every.values())
        unit = _units(sets, sids, bundles.value)
        if shared is None:
            at, comp = np.arange(len(sids)), None
        else:
            units, comps = shared.value
            low, high = np.searchsorted(units, unit), np.searchsorted(units, unit, "right")
            at = np.repeat(np.arange(len(sids)), high - low)
            comp = comps[np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange(len(at))]
        sent.update(sids[at].tolist())
        # no row batch of more than about 8 MB of tokens
        size = np.cumsum([len(sets[i]) for i in at]) if len(at) else np.zeros(0, np.int64)
        for x in np.split(np.arange(len(at)), np.searchsorted(size, np.arange(1 << 20, size[-1], 1 << 20)) if len(at) else []):
            if len(x):
                flat = [sets[i] for i in at[x]]
                ends = np.append(0, np.cumsum([len(s) for s in flat])).astype(np.int32)
                own = pa.nulls(len(x), pa.int64()) if comp is None else pa.array(comp[x])
                yield pa.RecordBatch.from_arrays([own, pa.array(unit[at[x]]), pa.array(sids[at[x]]), pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(flat)))], names=["comp", "unit", "sid", "tokens"])
    release()


def overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """|x & y| for pairs (indices into ``sets``, grouped by the first), leaders first."""
    if len(sets) == 2:
        return np.full(len(pairs), len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    vocab, begin = np.unique(flat[order], return_index=True)
    holders, lens = owner[order], np.diff(np.append(begin, len(flat)))

    def share(tokens: np.ndarray) -> np.ndarray:
        code = np.searchsorted(vocab, tokens)
        return np.bincount(gather(holders, begin, lens, code)[0], minlength=len(sets))

    out = np.zeros(len(pairs), np.int64)
    leaders: list[tuple[int, np.ndarray]] = []
    cut = np.append(np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0])), len(pairs))
    for a, b in zip(cut[:-1], cut[1:]):
        x = int(pairs[a, 0])
        best = max(leaders, key=lambda v: 2 * v[1][x] - size[v[0]], default=None)
        if best is not None and 4 * (size[x] + size[best[0]] - 2 * best[1][x]) <= size[x]:
            lead, known = sets[best[0]], best[1]
            mine = known - share(np.setdiff1d(lead, sets[x], assume_unique=True)) + share(np.setdiff1d(sets[x], lead, assume_unique=True))
        else:
            mine = share(sets[x])
            leaders = [*leaders[-7:], (x, mine)]
        out[a:b] = mine[pairs[a:b, 1]]
    return out


def _cross(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|x & y| for every x of one side and y of the other, as a product of matrices."""
    flats, owners = [np.concatenate(s) for s in (left, right)], [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    vocab = np.intersect1d(*flats)
    out = np.zeros((len(left), len(right)), np.float32)
    codes = []
    for k, flat in enumerate(flats):
        at = np.searchsorted(vocab, flat)
        ok = np.flatnonzero(vocab[np.minimum(at, len(vocab) - 1)] == flat) if len(vocab) else np.zeros(0, np.int64)
        codes.append(at[ok])
        owners[k] = owners[k][ok]
    for c in range(0, len(vocab), 4096):
        part = []
        for code, owner, n in zip(codes, owners, out.shape):
            own = (code >= c) & (code < c + 4096)
            m = np.zeros((n, min(4096, len(vocab) - c)), np.float32)
            m[owner[own], code[own] - c] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of 0 .. n - 1 that each is linked to by pairs (i, j)."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        low = np.minimum(lab[i], lab[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _similar_in(sets: list[np.ndarray], units: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, common) of the sets that reach the threshold; sets are sorted by unit, ``pairs`` are of units."""
    size = np.array([len(s) for s in sets])
    first, last = np.searchsorted(units, pairs), np.searchsorted(units, pairs, "right")
    single = (pairs & 1 == 0).all(axis=1) & (last > first).all(axis=1)
    if single.any():
        own, at = np.unique(first[single], return_inverse=True)
        at = at.reshape(-1, 2)
        at = at[np.lexsort((at[:, 1], at[:, 0]))]
        o, (i, j) = overlaps([sets[k] for k in own], at), own[at].T
        hit = (NUM + DEN) * o >= NUM * (size[i] + size[j])
        yield i[hit], j[hit], o[hit]
    odd, there = pairs & 1 == 1, (last > first).all(axis=1)
    # All single sets that a bundle meets are its other side at once.
    mixed = np.flatnonzero((odd[:, 0] != odd[:, 1]) & there)
    side = odd[mixed, 1].astype(int)
    begin, to, alone = first[mixed, side], last[mixed, side], first[mixed, 1 - side]
    sides = [(np.arange(a, to[begin == a][0]), alone[begin == a]) for a in np.unique(begin)]
    sides += [(np.arange(first[k, 0], last[k, 0]), np.arange(first[k, 1], last[k, 1])) for k in np.flatnonzero(odd.all(axis=1) & there)]
    for x, y in sides:
        o = _cross([sets[k] for k in x], [sets[k] for k in y])
        hit = (NUM + DEN) * o >= NUM * (size[x][:, None] + size[y][None, :])
        i, j = np.nonzero(np.triu(hit, 1) if x[0] == y[0] else hit)
        yield x[i], y[j], o[i, j]


def _verify(it: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows (comp, a, b, sid, tokens) sorted by (comp, b nulls first): a set has tokens, a pair of units has b.

    ``whole``: every pair of sets (a, b, common, size_a, size_b); else for every set with
    a link in its group its root there and its number of links (a, b, links)."""
    sets: dict[int, tuple[int, np.ndarray]] = {}
    pairs: list[np.ndarray] = []

    def close() -> Iterator[pa.RecordBatch]:
        if pairs:
            sids = np.array(list(sets), np.int64)
            units = np.array([u for u, _ in sets.values()], np.int64)
            order = np.argsort(units, kind="stable")
            each = list(sets.values())
            each, units, sids = [each[k][1] for k in order], units[order], sids[order]
            size = np.array([len(s) for s in each])
            ends, degree = [], np.zeros(len(each), np.int64)
            for i, j, o in _similar_in(each, units, np.concatenate(pairs)):
                if not whole:
                    degree += np.bincount(i, minlength=len(each)) + np.bincount(j, minlength=len(each))
                    ends.append((i.astype(np.int32), j.astype(np.int32)))
                    continue
                for x in range(0, len(i), 100_000):
                    p, q = i[x : x + 100_000], j[x : x + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (sids[p], sids[q], o[x : x + 100_000], size[p], size[q])], names=["a", "b", "common", "size_a", "size_b"])
            linked = np.flatnonzero(degree)
            if len(linked):
                root = _roots(len(each), *(np.concatenate(c) for c in zip(*ends)))
                yield pa.RecordBatch.from_arrays([pa.array(c[linked]) for c in (sids, sids[root], degree)], names=["a", "b", "links"])
        sets.clear()
        pairs.clear()

    now = None
    for batch in it:
        comp, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        pair = ~batch.column(2).is_null().to_numpy(zero_copy_only=False)
        b, tokens = batch.column(2).fill_null(0).to_numpy(), batch.column(4)
        sid = batch.column(3).fill_null(0).to_numpy()
        cut = np.flatnonzero(np.append(True, comp[1:] != comp[:-1])) if len(comp) else []
        for x, y in zip(cut, np.append(cut, len(comp))[1:].astype(int)):
            if comp[x] != now:
                yield from close()
                now = comp[x]
            own = pair[x:y]
            if own.any():
                pairs.append(np.stack([a[x:y][own], b[x:y][own]], axis=1))
            for k in x + np.flatnonzero(~own):
                if int(sid[k]) not in sets:
                    sets[int(sid[k])] = int(a[k]), tokens[int(k)].values.to_numpy().view(np.uint64).copy()
    yield from close()
    release()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that can be reached from each node of ``edges`` (a, b).

    Every round gives each node the least label among its neighbours' and then its label's
    label, so chains shrink by doubling; the labels are written each round.
    """
    both = materialize(edges.selectExpr("a AS node", "b AS other").union(edges.selectExpr("b", "a")).distinct(), "op10-edges")
    label = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("comp")), "op10-labels")
    while True:
        near = both.join(label.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", F.least("comp", "near").alias("mid"), F.col("comp").alias("old"))
        jump = step.join(label.select(F.col("node").alias("mid"), F.col("comp").alias("up")), "mid", "left")
        new = materialize(jump.select("node", F.least("mid", F.coalesce("up", "mid")).alias("comp"), "old"), "op10-labels")
        if new.where("comp <> old").isEmpty():
            return new.select("node", "comp")
        label = new.select("node", "comp")


def _similar(docs: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """The sets' documents (sid, doc) and what ``_verify`` finds among different sets."""
    spark = docs.sparkSession
    src = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    seen = materialize(src.mapInArrow(_survey, "kind int, a bigint, b bigint, size bigint"), "op10-survey")
    sets = seen.where("kind = 0").select(F.col("a").alias("sid"), F.col("b").alias("doc")).distinct()

    freq = materialize(seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= FREQUENT), "op10-frequent")
    least = FREQUENT
    while not fits(freq.where(F.col("n") >= least), FREQUENT_ROWS):
        least *= 2
    got = freq.where(F.col("n") >= least).toArrow()
    known = got.column("a").to_numpy().view(np.uint64)
    order = np.argsort(known)
    # Quarter octaves of the frequency are enough to order tokens by.
    often = np.minimum(255, 1 + 4 * np.log2(got.column("n").to_numpy())).astype(np.uint8)
    shared = spark.sparkContext.broadcast((known[order], often[order]))

    text = src.select("text")
    common = known[order][got.column("n").to_numpy()[order] >= COMMON]
    looked = spark.sparkContext.broadcast(common)
    sample = text.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(lambda it: _sampled(it, looked), "family bigint, sid bigint").distinct()
    family = sample.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SAMPLE >= FAMILY).orderBy(F.desc("n"), "family").limit(BROADCAST_ROWS).toArrow() if len(common) else None
    keys = family.column("family").to_numpy().view(np.uint64) if family else np.zeros(0, np.uint64)
    cuts = np.maximum(1, -(-SAMPLE * family.column("n").to_numpy() // BUNDLE)).astype(np.uint64) if family else keys
    sets_in = SAMPLE * family.column("n").to_numpy() / cuts if family else np.zeros(0)
    bundles = spark.sparkContext.broadcast((common, np.sort(keys), cuts[np.argsort(keys)]))
    # The prefixes' total length follows from the sets' sizes.
    total = seen.where("kind = 0").agg(F.sum("size"), F.count(F.lit(1))).first()
    length = (total[0] or 0) * (DEN - NUM) // DEN + (total[1] or 0) * SHARED
    parts = max(1, -(-length // INDEX_ROWS))
    index = text.mapInArrow(lambda it: _prefixes(it, shared, bundles, parts), "part int, data binary").repartitionById(parts, F.col("part"))
    met = index.mapInArrow(_candidates, "a bigint, b bigint, met bigint").groupBy("a", "b").agg(F.sum("met").alias("met"))
    cand = materialize(met.where(F.col("met") >= SHARED).select("a", "b"), "op10-candidates")

    # A bundle takes all single sets that it meets to one group, or to more as they are many.
    odd = {c: F.pmod(c, F.lit(2)) == 1 for c in ("a", "b")}
    mixed = cand.where(odd["a"] != odd["b"]).select(F.when(odd["a"], F.col("a")).otherwise(F.col("b")).alias("whole"), F.when(odd["a"], F.col("b")).otherwise(F.col("a")).alias("alone"))
    several = materialize(mixed.groupBy("whole").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_SETS / 2)).alias("cut")), "op10-mixed")
    mixed = mixed.join(small(several), "whole").select(F.xxhash64("whole", F.pmod(F.xxhash64("alone"), F.col("cut"))).alias("comp"), F.col("whole").alias("a"), F.col("alone").alias("b"))
    cand = cand.where(odd["a"] == odd["b"])
    lead = cand.selectExpr("a AS node", "b AS other").union(cand.selectExpr("b", "a")).groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("comp"))
    pairs = materialize(cand.join(lead.withColumnRenamed("node", "a"), "a"), "op10-groups")
    member = lambda p: p.select("comp", F.col("a").alias("unit")).union(p.select("comp", "b")).distinct()
    # The sets of every bundle, about.
    weight = pd.DataFrame({"unit": _bundle(np.repeat(keys, cuts.astype(int)), np.concatenate([np.zeros(0, np.uint64), *(np.arange(c, dtype=np.uint64) for c in cuts)])), "weight": np.repeat(sets_in, cuts.astype(int))})
    weighed = member(pairs).join(F.broadcast(spark.createDataFrame(weight, "unit bigint, weight double")), "unit", "left")
    cut = F.ceil(F.sum(F.coalesce("weight", F.lit(1.0))) / F.lit(GROUP_SETS / 2)).cast("int").alias("cut")
    large = materialize(weighed.groupBy("comp").agg(cut).where("cut > 2"), "op10-large")
    if not large.isEmpty():
        x, y = (F.pmod(F.xxhash64(c), F.col("cut")) for c in ("a", "b"))
        pairs = pairs.join(small(large), "comp", "left")
        pairs = materialize(pairs.withColumn("comp", F.when(F.col("cut").isNull(), F.col("comp")).otherwise(F.xxhash64("comp", F.least(x, y), F.greatest(x, y)))).drop("cut"), "op10-parts")
    pairs = pairs.select("comp", "a", "b").unionByName(mixed)
    comp = materialize(member(pairs), "op10-members")
    sets_ddl = "comp bigint, unit bigint, sid bigint, tokens array<bigint>"
    if fits(comp, 4 * BROADCAST_ROWS):
        got = comp.toArrow()
        units, comps = got.column("unit").to_numpy(), got.column("comp").to_numpy()
        order = np.argsort(units)
        want = spark.sparkContext.broadcast((units[order], comps[order]))
        full = text.mapInArrow(lambda it: _wanted_sets(it, bundles, want), sets_ddl)
    else:
        every = text.mapInArrow(lambda it: _wanted_sets(it, bundles, None), sets_ddl).drop("comp").dropDuplicates(["sid"])
        full = every.join(comp, "unit")

    rows = full.select("comp", F.col("unit").alias("a"), F.lit(None).cast("bigint").alias("b"), "sid", "tokens").unionByName(pairs.select("comp", "a", "b", F.lit(None).cast("bigint").alias("sid"), F.lit(None).cast("array<bigint>").alias("tokens")))
    out = rows.repartition("comp").sortWithinPartitions("comp", F.col("b").asc_nulls_first())
    return sets, materialize(out.mapInArrow(lambda it: _verify(it, whole), "a bigint, b bigint, common bigint, size_a bigint, size_b bigint" if whole else "a bigint, b bigint, links bigint"), "op10-pairs")


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, links): a row for every document and set of its own."""
    sets, found = _similar(docs, whole=False)
    sets = materialize(sets, "op10-sets")
    comp = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "sid")
    many = found.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    each = sets.join(comp.join(many, "sid", "full"), "sid", "left").select("doc", F.coalesce("comp", "sid").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))
    least = each.groupBy("comp").agg(F.min("doc").alias("class_id"))
    out = each.join(least, "comp").select(F.col("doc").alias("doc_id"), "class_id", "links")
    bare = docs.where(F.col("doc_id").isNotNull() & ~F.coalesce(F.col("text").rlike(_WORD), F.lit(False)))
    bare = bare.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("links")).distinct()
    return out.unionByName(bare)


def _chunks(members: DataFrame) -> DataFrame:
    """(sid, many, chunk, docs): a set's documents in chunks by hash; ``many``: documents of several sets."""
    members = materialize(members, "op10-sets")
    several = members.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("many"))
    several = materialize(several, "op10-several")
    large = materialize(members.groupBy("sid").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CHUNK))).cast("int").alias("cut")).where("cut > 1"), "op10-copied")
    cut = members.join(small(several), "doc", "left").join(small(large), "sid", "left")
    chunk = F.pmod(F.xxhash64("doc"), F.coalesce("cut", F.lit(1))).cast("int")
    cut = cut.groupBy("sid", F.coalesce("many", F.lit(False)).alias("many"), chunk.alias("chunk")).agg(F.collect_list("doc").alias("docs"))
    return materialize(cut, "op10-chunks")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard): every pair of documents, doc_id_a < doc_id_b, whose sets
    reach the threshold, equal sets included."""
    sets, pairs = _similar(docs, whole=True)
    chunks = _chunks(sets)
    side = lambda x: chunks.select(F.col("sid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("many", "chunk", "docs")])
    j = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    ids = materialize(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "op10-paired")
    # Only sets with a partner take part in the joins, on either side.
    paired = lambda x: side(x).join(ids.withColumnRenamed("sid", x), x, "left_semi")
    far = pairs.select("a", "b", j.alias("j"), F.lit(False).alias("once")).join(paired("a"), "a").join(paired("b"), "b")
    own = chunks.where("chunk > 0 OR many OR size(docs) > 1").select(F.col("sid").alias("a")).distinct()
    same = side("a").join(own, "a", "left_semi").join(side("b"), F.col("a") == F.col("b")).where("(chunk_a, many_a) <= (chunk_b, many_b)")
    same = same.withColumn("j", F.lit(1.0)).withColumn("once", F.expr("chunk_a = chunk_b AND many_a = many_b"))
    both = far.unionByName(same).drop("chunk_a", "chunk_b")

    def documents(df: DataFrame) -> DataFrame:
        each = df.select("once", "j", F.explode("docs_a").alias("x"), "docs_b").select("once", "j", "x", F.explode("docs_b").alias("y"))
        # A chunk with itself has every pair in both orders.
        each = each.where("x < y OR (x > y AND NOT once)")
        return each.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), (F.round(F.col("j") * 1e6) / 1e6).alias("jaccard"))

    if chunks.where("many").isEmpty():
        return documents(both)
    # Only pairs with a document of several sets can come twice.
    twice = F.col("many_a") | F.col("many_b")
    return documents(both.where(~twice)).unionByName(documents(both.where(twice)).groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard")))


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group of documents linked by
    similar pairs the one with the smallest doc_id stays. Where a doc_id has several texts,
    each row is judged by its own text's set; null and blank texts stay. All columns unchanged."""
    sets, pairs = _similar(docs, whole=False)
    comp = components(pairs.where("a <> b").select("a", "b"))
    each = sets.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("comp", "sid").alias("comp"), F.col("doc").alias("__j_doc"))
    keep = each.groupBy("comp").agg(F.min("__j_doc").alias("__j_keep"))
    # A document id may have several sets: those go that lie in a group that it does not keep.
    gone = F.collect_list(F.when(F.col("__j_doc") != F.col("__j_keep"), F.col("sid"))).alias("__j_sids")
    out = each.join(keep, "comp").groupBy("__j_doc").agg(gone, F.count(F.lit(1)).alias("__j_n")).where("size(__j_sids) > 0")
    out = materialize(out, "op10-dropped")
    inner, given = shielded(docs, "doc_id", "text")
    all_ = out.where("size(__j_sids) = __j_n").select("__j_doc")
    kept = inner.join(small(all_, 4 * BROADCAST_ROWS), (F.col("doc_id") == F.col("__j_doc")) & F.col("text").rlike(_WORD), "left_anti")
    some = out.where("size(__j_sids) < __j_n").drop("__j_n")
    if some.isEmpty():
        return given(kept)
    rows = kept.join(small(some), F.col("doc_id") == F.col("__j_doc"), "left")
    rows = rows.withColumn("__j_sid", _set_of(F.when(F.col("__j_doc").isNotNull(), F.col("text"))))
    return given(rows.where(~F.coalesce(F.array_contains("__j_sids", F.col("__j_sid")), F.lit(False))))


@F.pandas_udf(LongType())
def _set_of(texts: pd.Series) -> pd.Series:
    sets = (None if t is None else sets_of(pa.array([t], pa.string()))[0] for t in texts)
    return pd.Series([set_id(s) if s is not None and len(s) else None for s in sets], dtype="Int64")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"))


def sql(docs: str = "documents") -> str:
    """CTEs with op10_set (doc_id, sid) and op10_pair (a, b, jaccard over sids) over ``docs``."""
    return rf"""
op10_w AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
op10_g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END)) AS s FROM op10_w WHERE len(w) > 0),
op10_set AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS sid FROM op10_g),
op10_one AS (SELECT sid, any_value(s) AS s, list_sort(list(DISTINCT doc_id)) AS docs FROM op10_set GROUP BY sid),
op10_t AS (SELECT sid, len(s) AS n, unnest(s) AS t FROM op10_one),
op10_c AS (SELECT x.sid AS a, y.sid AS b, count(*) AS o, any_value(x.n) AS na, any_value(y.n) AS nb FROM op10_t x JOIN op10_t y ON x.t = y.t AND x.sid < y.sid GROUP BY x.sid, y.sid),
op10_pair AS (SELECT a, b, o / CAST(na + nb - o AS DOUBLE) AS jaccard FROM op10_c WHERE {NUM + DEN} * o >= {NUM} * (na + nb))"""


ORACLE = f"""WITH RECURSIVE {sql()},
op10_near AS (SELECT a AS x, b AS y FROM op10_pair UNION SELECT b, a FROM op10_pair),
op10_reach AS (SELECT x AS sid, x AS other FROM op10_near UNION SELECT r.sid, n.y FROM op10_reach r JOIN op10_near n ON r.other = n.x),
op10_comp AS (SELECT s.sid, coalesce(min(r.other), s.sid) AS comp FROM op10_one s LEFT JOIN op10_reach r USING (sid) GROUP BY s.sid),
op10_deg AS (SELECT x AS sid, count(*) AS links FROM op10_near GROUP BY x),
op10_doc AS (SELECT DISTINCT sid, doc_id FROM op10_set),
op10_class AS (SELECT comp, min(doc_id) AS class_id FROM op10_doc JOIN op10_comp USING (sid) GROUP BY comp)
SELECT doc_id, class_id, coalesce(links, 0) AS links FROM op10_doc JOIN op10_comp USING (sid) JOIN op10_class USING (comp) LEFT JOIN op10_deg USING (sid)
UNION ALL SELECT DISTINCT doc_id, CAST(NULL AS BIGINT), 0 FROM documents WHERE doc_id IS NOT NULL AND coalesce(NOT regexp_matches(text, '[^ \\t\\n\\r\\f]'), true)"""
