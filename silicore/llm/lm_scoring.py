"""Language-model scoring with a weighted backoff automaton.

A model of word ``ORDER``-grams with interpolated Witten-Bell smoothing is counted over all
training documents: every context is a state, every n-gram an arc, and a context's
failure arc, weighted with T / (c + T), leads to the state of its suffix.

    p(w | h) = (c(hw) + T(h) p(w | h')) / (c(h) + T(h)),   p over nothing = 1 / SYMBOLS

Words are known by buckets of their MD5, so an n-gram is one number of ``ORDER`` x ``BITS``
bits from which all its suffixes follow.

The automaton grows with the corpus and no task holds it. It is partitioned by the last
word of a state, so a state and all that its failure arcs lead to, down to the root,
lie together; the root's arcs are an array with a place for every bucket, broadcast. Words
are counted first, so that partitions are ranges of words with about equally many
transitions. A task that reads documents sends every transition of a batch of them, in the
order of the texts, to the partition that owns its state. There each is taken once, over
failure arcs where there is no arc, and the log-probabilities go back added up by document;
then each document's sums are added. It is the same at every size.

A word so frequent that its partition holds over twice its share has its states dealt out
to pieces by the word before it. A partition's pieces are taken one after another, and what
they have in common, the arcs of the word itself, is counted beside them: no piece is held
with another.

Defined results
  * a word is a run of non-space characters; a text's end is scored as one more symbol;
    null text: n_words 0 and null scores; empty and blank text: only the end is scored;
  * texts of any length are scored whole; repeated rows count as often as they occur,
    in the counts and in the result;
  * words of one bucket are not told apart; words never seen in training still have
    p > 0, by the failure arcs down to 1 / SYMBOLS;
  * empty training documents: a uniform model; empty documents: an empty result;
  * extra columns are ignored.

What travels are the transitions, in seven or eight bytes each, and at most as many sums of
six bytes. Texts are read twice: for the words and for the transitions.
Limits: all states of one word are one task's work, so a very frequent word makes a task
longer than the rest; and all transitions from one state are held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table
from .sentencepiece_bpe import slices
from .words import split

ORDER = 3
BITS = 21
MASK = (1 << BITS) - 1
START, END = MASK, MASK - 1
#: Buckets of words, and what may follow a state: a bucket or the end.
VOCAB = MASK - 1
SYMBOLS = VOCAB + 1
#: Positions that a task packs at once, and bytes of text for each partition of the automaton.
PACKED = 2_000_000
PART_BYTES = 12 << 20
_SLICE = 1 << 20
#: Transitions that are taken at once.
_TAKEN = 1_000_000
#: Words whose bucket a process remembers.
KNOWN = 1_000_000
_ROWS = "kind int, batch bigint, part int, piece int, data binary"
DOCS, COUNTED, ASKED, LOW = 0, 1, 2, 4
#: Symbols are summed in ranges of so many bits; beyond the last range the bytes of text.
_RANGE = 15


class _Buckets:
    """Buckets of words by their 64-bit hash: of the first ``KNOWN`` words that came."""

    def __init__(self) -> None:
        self.hash, self.bucket, self.new, self.count = np.zeros(1, np.uint64), np.full(1, -1, np.int64), [], 0

    def of(self, h: np.ndarray, s: np.ndarray, e: np.ndarray, raw: bytes) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        out = np.where(self.hash[at] == h, self.bucket[at], -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            digest = b"".join([hashlib.md5(raw[a:b]).digest()[:3] for a, b in zip(s[miss].tolist(), e[miss].tolist())])
            x = np.frombuffer(digest, np.uint8).reshape(-1, 3).astype(np.int64)
            out[miss] = (x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2]) % VOCAB
            if len(self.hash) < KNOWN:
                self.new.append((h[miss], out[miss]))
                self.count += len(miss)
                if self.count > len(self.hash) // 4:
                    self._merge()
        return out

    def _merge(self) -> None:
        h, b = (np.concatenate(x) for x in zip((self.hash, self.bucket), *self.new))
        self.hash, at = np.unique(h, return_index=True)
        self.bucket, self.new, self.count = b[at], [], 0


_known = _Buckets()


def _runs(x: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words' buckets and counts; all words in their order; where each text's begin."""
    h, s, e, bound, view = split(texts)
    order = np.argsort(h)
    ends = _runs(h[order])
    first = order[ends[:-1]]
    return _known.of(h[first], s[first], e[first], view.tobytes()), np.diff(ends), order, bound


def _ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, and where each text's words begin."""
    bucket, n, order, bound = _distinct(texts)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(bucket, n)
    return out, bound


def _codes(ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's transitions, end included, one text after another, and their numbers.

    A transition's state comes first, its last word foremost: the states of a suffix are a range."""
    n = np.diff(bound)
    begin = np.append(0, np.cumsum(n + ORDER))
    x = np.full(begin[-1], START, np.int64)
    x[np.repeat(begin[:-1] + ORDER - 1 - bound[:-1], n) + np.arange(bound[0], bound[-1])] = ids
    x[begin[1:] - 1] = END
    code = np.zeros(max(0, len(x) - ORDER + 1), np.int64)
    for i in [*range(ORDER - 2, -1, -1), ORDER - 1]:
        code = code << BITS | x[i : i + len(code)]
    keep = np.ones(len(x), bool)
    for i in range(1, ORDER):
        keep[begin[1:] - i] = False
    return code[keep[: len(code)]], n + 1


def _arc(code: np.ndarray, n: int) -> np.ndarray:
    """A transition as an arc of the ``n``-grams."""
    return code >> BITS * (ORDER - n + 1) << BITS | code & MASK


def _layout(count: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every word the partition that owns the states that end in it; of every partition its pieces."""
    load = count.copy()
    load[START], load[END] = load[END], 0
    total = max(1, int(load.sum()))
    part = np.minimum((np.cumsum(load) - load) * parts // total, parts - 1)
    own = np.bincount(part, load, parts) * parts / total
    return part, np.where(own > 2, np.ceil(own), 1).astype(np.int64)


def _wide(x: np.ndarray) -> int:
    """Bytes that the largest of some numbers takes."""
    return (int(x.max()).bit_length() + 7) // 8 if len(x) else 0


def _planes(x: np.ndarray, wide: int) -> bytes:
    """The low bytes, those of equal rank side by side: they compress better."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


class _Reader:
    """What ``_planes`` and ``_marks`` wrote, one after another."""

    def __init__(self, data: memoryview) -> None:
        self.data, self.at = data, 0

    def raw(self, n: int) -> memoryview:
        self.at += n
        return self.data[self.at - n : self.at]

    def numbers(self, n: int) -> list[int]:
        return np.frombuffer(self.raw(4 * n), "<u4").tolist()

    def planes(self, n: int, wide: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :wide] = np.frombuffer(self.raw(n * wide), np.uint8).reshape(wide, n).T
        return out.view("<i8").ravel()

    def marks(self) -> np.ndarray:
        n, wide = self.numbers(2)
        return np.cumsum(self.planes(n, wide)) if wide else np.flatnonzero(np.unpackbits(np.frombuffer(self.raw(n), np.uint8)))


def _marks(x: np.ndarray) -> bytes:
    """Ascending numbers, as gaps or as bits, whichever is shorter."""
    gap = np.diff(x, prepend=0)
    wide = max(1, _wide(gap))
    if wide * len(x) <= int(x[-1]) // 8:
        return np.array([len(x), wide], "<u4").tobytes() + _planes(gap, wide)
    bits = np.zeros(int(x[-1]) + 1, bool)
    bits[x] = True
    packed = np.packbits(bits)
    return np.array([len(packed), 0], "<u4").tobytes() + packed.tobytes()


def _rows(rows: list[tuple[int, int, int, int, bytes | memoryview]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "batch", "part", "piece", "data"])


def _gather(it: Iterator[pa.RecordBatch], role: int, parts: int, packed: int, shared) -> Iterator[pa.RecordBatch]:
    """Batches of documents. ``role``: COUNTED, ASKED or both."""
    task, serial = TaskContext.get().partitionId(), 0
    part, pieces = _layout(shared.value, parts)
    low, first = np.searchsorted(part, np.arange(parts)), np.cumsum(pieces) - pieces
    owner, piece = np.repeat(np.arange(parts), pieces), np.arange(pieces.sum()) - np.repeat(first, pieces)
    base, fold = first[part].astype(np.int32), pieces[part].astype(np.int32)
    ids, dead, codes, lens = [], [], [], []
    held = rows = 0

    def ship() -> Iterator[pa.RecordBatch]:
        nonlocal held, rows, serial
        batch = task << 32 | serial
        code, n = np.concatenate(codes), np.concatenate(lens)
        codes.clear()
        if role & ASKED:
            who = pa.concat_arrays(ids)
            own = [np.array([len(n)], "<u4").tobytes(), who.is_null().to_numpy(zero_copy_only=False).tobytes(), np.concatenate(dead).tobytes(), who.fill_null(0).to_numpy().astype("<i8").tobytes(), n.astype("<i8").tobytes()]
            yield _rows([(DOCS, batch, (task + serial) % parts, -2, b"".join(own))])
        word = code >> BITS * (ORDER - 1)
        to = base[word]
        if len(owner) > parts:
            many = fold[word]
            to += ((code >> BITS * (ORDER - 2) & MASK) * many >> BITS).astype(np.int32)
            if role & COUNTED:
                yield from common(batch, code[many > 1])
        order = np.argsort(to.astype(np.uint16) if len(owner) <= 1 << 16 else to, kind="stable")
        to, code, doc = to[order], code[order], np.repeat(np.arange(len(n)), n)[order]
        ends = _runs(to)
        begin = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (doc[1:] != doc[:-1]))) if len(to) else ends[:0]
        length, cut = np.diff(np.append(begin, len(to))), np.searchsorted(begin, ends)
        out = []
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            at = int(to[a])
            x = code[a:b] - (int(low[owner[at]]) << BITS * (ORDER - 1))
            wide = _wide(x)
            data = np.array([len(x), wide], "<u4").tobytes() + _planes(x, wide)
            if role & ASKED:
                run = length[cut[i] : cut[i + 1]]
                wide = _wide(run)
                data += np.array([len(run), wide], "<u4").tobytes() + _planes(run, wide) + _marks(doc[begin[cut[i] : cut[i + 1]]])
            out.append((role, batch, int(owner[at]), int(piece[at]), data))
            if len(out) == 64 or i == len(ends) - 2:
                yield _rows(out)
                out = []
        ids.clear(), dead.clear(), lens.clear()
        held, rows, serial = 0, 0, serial + 1

    def common(batch: int, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The arcs that the pieces of a partition share."""
        arc, n = np.unique(_arc(code, 2), return_counts=True)
        own = part[arc >> BITS]
        ends = _runs(own)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            x = arc[a:b] - (int(low[own[a]]) << BITS)
            wides = _wide(x), _wide(n[a:b])
            yield _rows([(LOW, batch, int(own[a]), -1, np.array([b - a, *wides], "<u4").tobytes() + _planes(x, wides[0]) + _planes(n[a:b], wides[1]))])

    for batch in it:
        for x in slices(batch, "text", _SLICE):
            null = x.column("text").is_null().to_numpy(zero_copy_only=False)
            code, n = _codes(*_ids(x.column("text").drop_null()))
            every = np.zeros(len(null), np.int64)
            every[~null] = n
            ids.append(x.column("doc_id"))
            dead.append(null)
            codes.append(code)
            lens.append(every)
            held, rows = held + len(code), rows + len(null)
            if held >= packed or rows >= packed:
                yield from ship()
    if rows:
        yield from ship()
    release()


def _weights(it: Iterator[pa.RecordBatch], shared, most: int) -> Iterator[pa.RecordBatch]:
    """A partition's rows sorted by piece: the documents' rows, and by document the sums of
    the log-probabilities of the transitions that were asked for."""
    root, common, rest, now, more = None, [], [], None, 0

    def taken() -> Iterator[pa.RecordBatch]:
        """What the piece in ``rest`` is asked for."""
        nonlocal common, root
        if root is None:
            root = _root(shared.value)
        counted = [r[4] for r in rest if r[0] & COUNTED]
        keys, sums = _summed(np.concatenate(counted)) if counted else (np.zeros(0, np.int64),) * 2
        del counted
        if len(common) > 1:
            common = [_together(common)]
        levels = [common[0] if n == 2 and common else (keys, sums) if n == ORDER else _summed(_arc(keys, n), sums) for n in range(2, ORDER + 1)]
        levels = [(n, k, s, *_states(k, s)) for n, (k, s) in enumerate(levels, 2) if len(k)]
        asked = [r for r in rest if r[0] & ASKED]
        bound = np.cumsum([0] + [len(r[4]) for r in asked])
        cut = np.flatnonzero(np.diff(bound[:-1] // most, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(asked)]):
            code = np.concatenate([r[4] for r in asked[a:b]])
            order = np.argsort(code)
            code = code[order]
            ends = _runs(code)
            step = np.empty(len(code))
            step[order] = np.repeat(np.log(_taken(code[ends[:-1]], levels, root)), np.diff(ends))
            out, at = [], 0
            for _, batch, part, piece, x, run, marks in asked[a:b]:
                got = np.add.reduceat(step[at : at + len(x)], np.cumsum(run) - run)
                at += len(x)
                # Sums keep 36 bits of their fractions, ten digits, and so travel as six bytes.
                out.append((ASKED, batch, part, piece, np.array([len(run)], "<u4").tobytes() + _planes(got.view(np.int64) + (1 << 15) >> 16, 6) + marks))
            for i in range(0, len(out), 64):
                yield _rows(out[i : i + 64])
        rest.clear()

    for rows in it:
        for kind, batch, part, piece, data in zip(*(rows.column(i).to_pylist() for i in range(4)), rows.column(4)):
            raw = memoryview(data.as_buffer())
            if kind == DOCS:
                yield _rows([(DOCS, batch, -1, piece, raw.tobytes())])
                continue
            r = _Reader(raw)
            if kind == LOW:
                n, wide, wider = r.numbers(3)
                common.append((r.planes(n, wide), r.planes(n, wider)))
                more += n
                if more > max(most, len(common[0][0])):
                    common, more = [_together(common)], 0
                continue
            if piece != now:
                if rest:
                    yield from taken()
                    release()
                now = piece
            code, run, marks = r.planes(*r.numbers(2)), None, None
            if kind & ASKED:
                run = r.planes(*r.numbers(2)).astype(np.int32)
                marks = raw[r.at :].tobytes()
            rest.append((kind, batch, part, piece, code, run, marks))
    if rest:
        yield from taken()
    release()


def _states(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The states of sorted arcs, their totals and their numbers of arcs."""
    ends = _runs(keys >> BITS)
    return keys[ends[:-1]] >> BITS, np.add.reduceat(sums, ends[:-1]).astype(float), np.diff(ends).astype(float)


def _taken(code: np.ndarray, levels: list[tuple], root: np.ndarray) -> np.ndarray:
    """p of sorted transitions."""
    p = root[code & MASK]
    for n, keys, sums, state, total, kinds in levels:
        arc = _arc(code, n)
        at = np.minimum(np.searchsorted(keys, arc), len(keys) - 1)
        count = np.where(keys[at] == arc, sums[at], 0)
        own = np.minimum(np.searchsorted(state, arc >> BITS), len(state) - 1)
        p = np.where(state[own] == arc >> BITS, (count + kinds[own] * p) / (total[own] + kinds[own]), p)
    return p


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their counts; without counts each is one."""
    if counts is None:
        keys = np.sort(keys)
        ends = _runs(keys)
        return keys[ends[:-1]], np.diff(ends)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = _runs(keys)[:-1]
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _together(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(*(np.concatenate(x) for x in zip(*some)))


def _walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch, its documents first: each document's sums are added up."""
    who = none = n = dead = total = None

    def walked() -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(who, mask=none), pa.array(n), pa.array(total, mask=dead)], names=["doc_id", "n_words", "s"])

    for rows in it:
        for kind, data in zip(rows.column(0).to_pylist(), rows.column(4)):
            r = _Reader(memoryview(data.as_buffer()))
            if kind == DOCS:
                yield from walked()
                k = r.numbers(1)[0]
                none, dead, who, n = (np.frombuffer(r.raw(k * w), t).copy() for w, t in ((1, bool), (1, bool), (8, "<i8"), (8, "<i8")))
                total = np.zeros(k)
            else:
                got = (r.planes(r.numbers(1)[0], 6) << 16).view("<f8")
                total[r.marks()] += got
    yield from walked()
    release()


def _words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(span, data): a task's symbols with their counts, and its bytes of text."""
    total = np.zeros(MASK + 1 + (1 << _RANGE), np.int64)
    for batch in it:
        for x in slices(batch, "text", _SLICE):
            texts = x.column("text").drop_null()
            bucket, n, _, _ = _distinct(texts)
            np.add.at(total, bucket, n)
            total[END] += len(texts)
            total[MASK + 1] += pc.sum(pc.binary_length(texts)).as_py() or 0
    spans, out = total.reshape(-1, 1 << _RANGE), []
    for i in np.flatnonzero(spans.any(1)).tolist():
        at = np.flatnonzero(spans[i])
        wide = _wide(spans[i][at])
        out.append((i, np.array([len(at), wide], "<u4").tobytes() + _planes(at, 2) + _planes(spans[i][at], wide)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["span", "data"])
    release()


def _added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for rows in it:
        for span, data in zip(rows.column(0).to_pylist(), rows.column(1)):
            r = _Reader(memoryview(data.as_buffer()))
            n, wide = r.numbers(2)
            at = r.planes(n, 2)
            total.setdefault(span, np.zeros(1 << _RANGE, np.int64))[at] += r.planes(n, wide)
    for span, x in total.items():
        wide = _wide(x)
        yield pa.RecordBatch.from_arrays([pa.array([span], pa.int32()), pa.array([np.array([wide], "<u4").tobytes() + _planes(x, wide)], pa.binary())], names=["span", "data"])
    release()


def _counts(training: DataFrame) -> tuple[np.ndarray, int]:
    """How often every symbol occurs, in a fixed number of places whatever the corpus; and the bytes of text."""
    schema = "span int, data binary"
    got = training.select("text").mapInArrow(_words, schema).repartitionById(16, F.col("span") % 16).mapInArrow(_added, schema).toArrow()
    total = np.zeros((MASK + 1 >> _RANGE) + 1 << _RANGE, np.int64).reshape(-1, 1 << _RANGE)
    for span, data in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        r = _Reader(memoryview(data))
        total[span] = r.planes(1 << _RANGE, r.numbers(1)[0])
    return total.ravel()[: MASK + 1].copy(), int(total[-1, 0])


def _root(count: np.ndarray) -> np.ndarray:
    """p of every symbol at the root."""
    kinds, total = float(np.count_nonzero(count)), float(count.sum())
    uniform = 1.0 / SYMBOLS
    return (count + kinds * uniform) / (total + kinds) if total else np.full(MASK + 1, uniform)


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_words, mean_logprob, perplexity), one row a document of ``docs``."""
    count, size = _counts(training)
    parts, packed, most = max(1, -(-size // PART_BYTES)), PACKED, _TAKEN
    own = parts if docs is training else max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(count)
    seen = lambda df, role: df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(lambda it: _gather(it, role, parts, packed, shared), _ROWS)
    asks = seen(docs, COUNTED | ASKED) if docs is training else seen(docs, ASKED).unionByName(seen(training.select(F.lit(None).alias("doc_id"), "text"), COUNTED))
    back = asks.repartitionById(parts, F.col("part")).sortWithinPartitions("piece").mapInArrow(lambda it: _weights(it, shared, most), _ROWS)
    out = back.repartition(own, "batch").sortWithinPartitions("batch", "part", "piece").mapInArrow(_walk, "doc_id bigint, n_words bigint, s double")
    mean = F.col("s") / F.col("n_words")
    return out.select("doc_id", "n_words", (F.round(mean * 1e6) / 1e6).alias("mean_logprob"), (F.round(F.exp(-mean) * 1e3) / 1e3).alias("perplexity"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, docs)


def _oracle() -> str:
    word = rf"CAST('0x' || substr(md5(x), 1, 6) AS BIGINT) % {VOCAB}"
    ctes = [
        rf"t AS (SELECT row_number() OVER () AS rid, doc_id, text, list_concat({[START] * (ORDER - 1)}, list_concat(list_transform(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> ''), lambda x: {word}), [{END}])) AS x FROM documents)",
        f"pos AS (SELECT rid, {' + '.join(f'x[i + {k}] * {1 << BITS * (ORDER - 1 - k)}' for k in range(ORDER))} AS g FROM (SELECT rid, x, unnest(range(1, len(x) - {ORDER - 2})) AS i FROM t WHERE text IS NOT NULL))",
        "each AS (SELECT rid, g, count(*) AS n FROM pos GROUP BY rid, g)",
        "full0 AS (SELECT g, sum(n) AS c FROM each GROUP BY g)",
    ]
    prev = f"(SELECT g, 1.0::DOUBLE / {SYMBOLS} AS p FROM full0)"
    for n in range(1, ORDER + 1):
        tail = f"g % {1 << BITS * n}" if n < ORDER else "g"
        ctes.append(f"c{n} AS (SELECT {tail} AS k, sum(c) AS c FROM full0 GROUP BY 1)")
        ctes.append(f"h{n} AS (SELECT k >> {BITS} AS h, sum(c) AS ch, count(*) AS th FROM c{n} GROUP BY 1)")
        ctes.append(f"p{n} AS (SELECT q.g, (c.c + h.th * q.p) / CAST(h.ch + h.th AS DOUBLE) AS p FROM {prev} q JOIN c{n} c ON c.k = {tail.replace('g', 'q.g')} JOIN h{n} h ON h.h = c.k >> {BITS})")
        prev = f"p{n}"
    ctes.append(f"s AS (SELECT rid, sum(n * ln(p)) / sum(n) AS m, CAST(sum(n) AS BIGINT) AS n_words FROM each JOIN {prev} USING (g) GROUP BY rid)")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, coalesce(n_words, 0) AS n_words, round(m, 6) AS mean_logprob, round(exp(-m), 3) AS perplexity FROM t LEFT JOIN s USING (rid)"


ORACLE = _oracle()
