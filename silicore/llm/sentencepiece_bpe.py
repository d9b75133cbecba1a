"""SentencePiece (merge-type) encoding and decoding by a prefix table.

For every prefix of a text the last token of the prefix's encoding is unique. The
table stores it: an automaton gives the pieces that end at a position, and the one
piece whose predecessor (the last token of the prefix before it) could stand beside
it, with no merge across their border being chosen earlier, is the entry. Ids are
recovered backwards from the end. The time is linear in the text, where a merge queue
needs a logarithm.

A piece holds a space mark at its start only, so text is cut before each run of
spaces and equal cuts are encoded once per batch; the cuts and the gathering of ids run
on Arrow buffers in numpy. Runs of space marks have pieces that tie in score; they are
merged apart, leftmost first, after everything else.

Defined results
  * null text: null ids, null decoded text; empty text: no ids, decoded to empty text;
  * characters without a piece become byte pieces;
  * the space mark U+2581 in a text equals a space, as in the model's own normalizer;
  * decoding gives the text back but for that mark; ids that are no bytes of a whole
    character decode to U+FFFD; control ids decode to nothing;
  * texts of any length are encoded whole; repeated rows are each encoded;
  * a model whose merges tie in score (but for runs of the mark) is refused: which of two
    equal merges comes first would not follow from prefixes;
  * an empty table: an empty result; extra columns are ignored.

Everything is a map over the scan: nothing is shuffled. The model's path is a
parameter; each Python worker builds its automaton once.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Distinct cuts that a task remembers, and pairs of tokens whose fit a worker remembers.
MEMO = 200_000
FITS = 300_000
#: Bytes of text that are encoded at once.
SLICE = 2 << 20


class Encoder:
    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unk = sp.unk_id()
        self.byte: dict[int, int] = {}
        text: dict[str, int] = {}
        self.pieces: list[bytes] = []
        for i in range(n):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(s[1:-1], 16)] = i
                self.pieces.append(bytes([int(s[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.pieces.append(b"")
            else:
                if s.strip(MARK) and MARK in s.lstrip(MARK):
                    raise ValueError(f"piece {i} holds a space mark after its start")
                text[s] = i
                self.pieces.append(s.replace(MARK, " ").encode())
        self.runs = {len(s): i for s, i in text.items() if not s.strip(MARK)}
        words = {s: i for s, i in text.items() if len(s) == 1 or s.strip(MARK)}
        order = sorted((i for s, i in words.items() if len(s) > 1), key=lambda i: (-sp.get_score(i), i))
        if len({sp.get_score(i) for i in order}) < len(order):
            raise ValueError("merge pieces tie in score")
        # rank 0: characters; a merge piece's rank grows as its priority falls.
        self.rank = [0] * n
        for r, i in enumerate(order, 1):
            self.rank[i] = r
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fit: dict[int, bool] = {}
        string = {i: s for s, i in words.items()}
        reached = {i for s, i in words.items() if len(s) == 1}
        for i in order:
            s = string[i]
            for k in range(1, len(s)):
                a, b = words.get(s[:k]), words.get(s[k:])
                if a in reached and b in reached and self.rank[a] < self.rank[i] > self.rank[b] and self.compatible(a, b):
                    self.split[i] = (a, b)
                    self.joined[a, b] = self.rank[i]
                    reached.add(i)
                    break
        self.fit.clear()
        self.automaton = ahocorasick.Automaton()
        for i in reached:
            self.automaton.add_word(string[i], (i, -len(string[i])))
        self.automaton.make_automaton()
        self.chars = [len(string.get(i, "")) for i in range(n)]
        self.memo: dict[str, list[int]] = {}
        self.piece_flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.piece_len = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging left to right text never joins across the border of two tokens.

        Undo the later of the two tokens' merges step by step; a joined pair at the
        border that comes before the merge just undone would have been taken.
        """
        rank, split, joined = self.rank, self.split, self.joined
        bound = len(rank) + 1
        while True:
            r = joined.get((left, right))
            if r is not None and r < bound:
                return False
            a, b = rank[left], rank[right]
            if a == 0 and b == 0:
                return True
            if a > b:
                bound, left = a, split[left][1]
            else:  # on equal ranks the left token's merge comes first
                bound, right = b + 1, split[right][0]

    def word(self, s: str) -> list[int]:
        """Ids of a cut with at most one leading space mark. Negative: the complement of a code point without a piece."""
        last: list[int | None] = [None] * len(s)
        fit = self.fit
        for end, (tok, at) in self.automaton.iter(s):
            if last[end] is not None:
                continue
            at += end
            if at >= 0:
                prev = last[at]
                if prev is None:
                    last[at] = ~ord(s[at])
                elif prev >= 0:
                    pair = prev << 20 | tok
                    ok = fit.get(pair)
                    if ok is None:
                        ok = fit[pair] = self.compatible(prev, tok)
                    if not ok:
                        continue
            last[end] = tok
        out, i, chars = [], len(s) - 1, self.chars
        while i >= 0:
            tok = last[i]
            if tok is None or tok < 0:
                out.append(~ord(s[i]))
                i -= 1
            else:
                out.append(tok)
                i -= chars[tok]
        out.reverse()
        return out

    @functools.lru_cache(4096)  # noqa: B019
    def run(self, n: int) -> tuple[int, ...]:
        """Ids of n space marks: pieces of one score merge leftmost first."""
        if not n:
            return ()
        size, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(i, 1, 1) for i in range(n - 1)] if 2 in self.runs else []
        heapq.heapify(queue)
        while queue:
            i, a, b = heapq.heappop(queue)
            j = nxt[i]
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j] = a + b, 0
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y < n and size[x] + size[y] in self.runs:
                    heapq.heappush(queue, (x, size[x], size[y]))
        return tuple(self.runs[k] for k in size if k)

    def cut(self, s: str) -> list[int]:
        """Ids of one cut: a run of spaces, then text without spaces."""
        if s[0] != " ":
            out = self.word(s)
        elif s[-1] == " ":
            return list(self.run(len(s)))
        else:
            spaces = len(s) - len(s.lstrip(" "))
            out = self.word(MARK + s[spaces:])
            if spaces > 1:
                lone = out[0] == self.runs[1]
                out = [*self.run(spaces - (not lone)), *out[lone:]]
        if min(out) >= 0:
            return out
        flat: list[int] = []
        for i in out:
            if i >= 0:
                flat.append(i)
            else:
                flat.extend(self.byte.get(b, self.unk) for b in chr(~i).encode())
        return flat

    def cuts(self, strings: list[str]) -> list[list[int]]:
        memo, out = self.memo, []
        if len(memo) + len(strings) > MEMO:
            memo.clear()
        if len(self.fit) > FITS:
            self.fit.clear()
        for s in strings:
            ids = memo.get(s)
            if ids is None:
                ids = memo[s] = self.cut(s)
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        nulls = texts.is_null()
        texts = texts.fill_null("")
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        off, data, raw = buffers(texts)
        lo, hi = int(off[0]), int(off[-1])
        view = data[lo:hi]
        space = view == 0x20
        heads = off[:-1][off[1:] > off[:-1]].astype(np.int64) - lo
        begins = np.zeros(len(view), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[heads] = True
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, hi - lo)
        cuts = pa.StringArray.from_buffers(len(starts), pa.py_buffer((bounds + lo).astype(np.int32)), raw)
        enc = cuts.dictionary_encode()
        code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.searchsorted(starts, heads)
        code[first] = np.arange(len(first)) + len(enc.dictionary)
        ids = self.cuts(enc.dictionary.to_pylist()) + self.cuts([" " + s for s in cuts.take(pa.array(first)).to_pylist()])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lens.sum()))
        gathered, ends = gather(flat, np.cumsum(lens) - lens, lens, code)
        at = np.searchsorted(starts, off.astype(np.int64) - lo)
        return pa.ListArray.from_arrays(pa.array(ends[at].astype(np.int32), mask=None), pa.array(gathered), mask=nulls)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of id lists; the space that stands for a text's start is taken away."""
        nulls = ids.is_null()
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out, ends = gather(self.piece_flat, self.piece_at, self.piece_len, flat)
        bound = ends[np.append(0, np.cumsum(count))]
        data = out.tobytes()
        whole = []
        for a, b, dead in zip(bound[:-1], bound[1:], nulls.to_pylist()):
            part = data[a:b]
            whole.append(None if dead else part.removeprefix(b" ").decode("utf-8", "replace"))
        return pa.array(whole, pa.string())


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """Offsets, bytes and the byte buffer of a string array without nulls."""
    _, offsets, data = texts.buffers()
    data = data if data is not None else pa.py_buffer(b"")
    return np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(data, np.uint8), data


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[at[c]:at[c]+lens[c]] for c in code, joined; and the places where each begins, with the end."""
    n = lens[code]
    ends = np.append(0, np.cumsum(n))
    where = np.repeat(at[code] - ends[:-1], n)
    where += np.arange(ends[-1])
    return flat[where], ends


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text, at least one row each."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lens) // size
    cut = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ids array<int> and n_tokens, one row a document."""
    src = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", ids array<int>, n_tokens int"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in it:
            for part in slices(batch, "text"):
                ids = enc.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids, pc.list_value_length(ids)], names=[*keep, "ids", "n_tokens"])
        enc.memo.clear()
        release()

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the decoded text of ``ids``."""
    src = encoded.select(*keep, "ids")
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.select(*keep).dtypes) + ", text string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in it:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), enc.decode(batch.column("ids"))], names=[*keep, "text"])

    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded), encoding and decoding within one pass."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in it:
            for part in slices(batch, "text"):
                ids = enc.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pc.list_value_length(ids), enc.decode(ids)], names=["doc_id", "ids", "n_tokens", "decoded"])
        enc.memo.clear()
        release()

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens int, decoded string")


def op5_sentencepiece_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every text encoded and decoded again."""
    return round_trip(table(spark, sf_dir, "documents")).select("doc_id", F.col("decoded").alias("text"))


#: The meta symbol for a blank is read as a blank.
ROUND_TRIP_ORACLE = "SELECT doc_id, replace(text, chr(9601), ' ') AS text FROM documents"


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
