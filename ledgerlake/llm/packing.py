"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens.
Full pieces are windows of their own. The others are packed in *rounds* of
about 256 windows by the largest differencing method: every piece starts as a
partial partition (the piece in one of ``k`` windows, nothing in the others);
the two partial partitions with the largest imbalance are merged again and
again, the fullest window of one with the emptiest of the other, so that
opposing imbalances cancel. One partition into ``k`` near-equal windows is
left. While its fullest window is above the capacity, ``k`` rises by one and
the round is packed anew.

Whole documents alone leave windows uneven by some 70 tokens. So a small share
of the tokens (1.7 %) is cut into short pieces, which differencing merges last
and which level the windows out to a few tokens; a round therefore is closed
when its tokens fall short of whole windows by 8 to 24 tokens a window.

In Spark: one pass over the texts makes narrow piece rows (no shuffle); they
are written to the shared folder, read back in about as many tasks as there
are millions of tokens, and each task packs its rounds as it streams its
pieces (no shuffle, no key, so no hot key). A task holds the pieces of one
round. The counts of windows of the tasks (a row a task) are broadcast to
number the windows without gaps.

Defined cases: null and empty texts are documents of the closing id alone; a
null id is kept; repeated rows are packed each; an empty table gives no rows;
extra columns are ignored; very long texts are cut like others, and
tokenized word by word. Which pieces share a window depends on how Spark
splits the input; a rerun over the same files and settings agrees.
"""

from __future__ import annotations

import functools
import heapq
import os
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .common import kept, table

CAPACITY = 4096
END_ID = 2
#: Windows of a round.
WINDOWS = 256
#: Lengths of the short pieces, and the share of all tokens cut so.
SHORT = (48, 16, 6)
SHORT_SHARE = sum(SHORT) / CAPACITY
#: A round closes when its windows would stay this empty on average (tokens).
SLACK = (8, 24)
#: Rounds of a task, on average.
ROUNDS = 8
#: Words that a worker remembers the ids of, and their length at most.
MEMO_WORDS, MEMO_LENGTH = 300_000, 64
#: ASCII marks, which the tokenizer keeps together; an apostrophe may begin an
#: ending of its own ('s).
MARKS = string.punctuation.replace("'", "")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# -- tokenization -----------------------------------------------------------

class WordIds:
    """Ids of texts by a tokenizer whose words never cross a blank: each
    distinct blank-separated word is tokenized once and remembered.

    Texts of Latin characters are read in lower case (the tokenizer lowers
    them itself, once it has found the special tokens, which begin by ``<|``).
    Words of Latin letters are tokenized without the ASCII marks at their end,
    which are a piece apart, and by the tokenizer's model alone: they are one
    piece to its pattern, which need not be matched. Past ``MEMO_WORDS`` words a new memory is begun, which takes
    over from the older one what is met again.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)        # for lower-case words of letters, between blanks
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)    # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")

    def _apart(self, words: list[str]) -> dict[str, bytes]:
        """Ids of any words, each an input of its own."""
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(words, encoded)}

    def _joined(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of Latin letters, a hundred in a text."""
        found = {}
        groups = [words[i:i + 100] for i in range(0, len(words), 100)]
        for group, e in zip(groups, self.letters.encode_batch_fast([" ".join(g) for g in groups],
                                                                   add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            raw, begin = ids.tobytes(), 0
            for word, end in zip(group, ends):
                found[word] = raw[4 * begin:4 * end]
                begin = end
        return found

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain, cores, ends, odd = [], [], [], []        # no tuples, which the collector of garbage would visit
        for w in words:
            core = w.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or _latin(core)):
                plain.append(w)
                cores.append(core.lower())
                ends.append(w[len(core):])
            else:
                odd.append(w)
        memo = self.memo
        known = self._joined(list(set(cores).difference(memo)))
        known.update(self._apart(odd))
        end_ids = self._apart(list(set(ends)))
        for w, core, end in zip(plain, cores, ends):
            if w not in known:
                known[w] = (known[core] if core in known else memo[core]) + end_ids[end]
        return known

    def __call__(self, text_list: list[str]) -> Iterator[np.ndarray]:
        split = [_lower(t).replace("\n", " ").split(" ") for t in text_list]
        memo, seen = self.memo, set().union(*split)
        new = seen.difference(memo)
        if len(memo) + len(new) > MEMO_WORDS:
            self.older, self.memo = memo, {"": b""}
            memo, new = self.memo, seen
        for w in filter(self.older.__contains__, new):
            memo[w] = self.older[w]
        new = new.difference(memo)
        memo.update(self._learn(list(new)))
        for words in split:
            yield np.frombuffer(b"".join(map(memo.__getitem__, words)), dtype="<u4")
        for w in new:
            if len(w) > MEMO_LENGTH:
                del memo[w]


def _latin(word: str) -> bool:
    """Whether all characters are of Latin-1, whose letters stay single
    letters in normal form and lower case."""
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _lower(text: str) -> str:
    """The text in lower case if that leaves its ids alone."""
    return text.lower() if (text.isascii() or _latin(text)) and "<|" not in text else text


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def cuts(length: int, capacity: int, short: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, then up to
    ``short`` tokens of short pieces, then the rest."""
    at = 0
    while length - at >= capacity:
        yield at, capacity
        at += capacity
    stop, k = min(length, at + short), 0
    while at < stop:
        n = min(SHORT[k % len(SHORT)], stop - at)
        yield at, n
        at, k = at + n, k + 1
    if at < length:
        yield at, length - at


def _cut(batches: Iterable[pa.RecordBatch], path: str, end_id: int, capacity: int,
         with_ids: bool) -> Iterator[pa.RecordBatch]:
    ids_of = _word_ids(path)
    owed = 0.0                      # tokens still to be cut short
    for part in arrow.slices(batches, "text"):
        out: list[tuple] = []
        for doc_id, ids in zip(part.column("doc_id").to_pylist(), ids_of(arrow.texts(part.column("text")))):
            ids = np.append(ids, np.array([end_id], dtype="<u4"))
            n = len(ids)
            owed += (n % capacity) * SHORT_SHARE
            short = int(owed) if owed >= sum(SHORT) else 0
            owed -= min(short, n % capacity)
            for start, length in cuts(n, capacity, short):
                raw = ids[start:start + length].tobytes()
                out.append((doc_id, start, length, zlib.crc32(raw), n) + ((raw,) if with_ids else ()))
        columns = list(zip(*out))
        types = [pa.int64()] * 5 + [pa.binary()] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens
    and, if asked for, ``ids`` (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _cut(it, path, end_id, capacity, with_ids),
                           PIECES + (", ids binary" if with_ids else ""))


# -- differencing -----------------------------------------------------------

def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each size by multiway differencing.

    A partial partition is the vector of its windows' sums, fullest first and
    less the emptiest. Merges keep the permutation that sorted them; the
    windows are handed down the tree of merges at the end.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    heap, merges = [], []
    for i, size in enumerate(sizes.tolist()):
        first = np.zeros(k, np.int64)
        first[0] = size
        heap.append((-size, i, first))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        both = a + b[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        merges.append((i, j, order))
        heapq.heappush(heap, (-int(both[0]), n + len(merges) - 1, both))
    window = np.zeros(n, np.int64)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        node, slots = todo.pop()
        if node < n:
            window[node] = slots[0]
            continue
        i, j, order = merges[node - n]
        unsorted = np.empty(k, np.int64)
        unsorted[order] = slots
        todo += [(i, unsorted), (j, unsorted[::-1])]
    return window


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of near-equal sums, none above the capacity: (window of each
    size, number of windows). The count rises until all fit."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        found = differencing(sizes, k)
        if np.bincount(found, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return found, k
        k += 1


def _ready(total: int, capacity: int) -> bool:
    """Whether a round of so many tokens fills its windows well."""
    k = -(-total // capacity)
    return k >= WINDOWS and SLACK[0] * k <= k * capacity - total <= SLACK[1] * k


def _pack(batches: Iterable[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    used, waiting, lengths, total = 0, [], [], 0

    def numbered(rows: pa.Table | pa.RecordBatch, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        columns = [rows.column(i) for i in range(rows.num_columns)]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        more = [pa.array(np.full(rows.num_rows, part, np.int64)), pa.array(sequence), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns + more, rows.schema.names + ["part", "sequence", "offset"])

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal used, waiting, lengths, total
        if not waiting:
            return
        rows, sizes = pa.Table.from_batches(waiting).combine_chunks(), np.concatenate(lengths)
        found, k = windows(sizes, capacity)
        order = np.lexsort((np.arange(len(sizes)), found))
        sums = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, found[order][1:] != found[order][:-1]] if len(order) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(first, sums, 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = sums - begin
        # windows that got no piece (fewer pieces than windows) get no number
        _, found = np.unique(found, return_inverse=True)
        out = numbered(rows, used + found.astype(np.int64), offset)
        used += int(found.max()) + 1
        waiting, lengths, total = [], [], 0
        yield out

    for batch in batches:
        size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
        full = np.flatnonzero(size == capacity)
        if len(full):
            yield numbered(batch.take(pa.array(full)), used + np.arange(len(full), dtype=np.int64),
                           np.zeros(len(full), np.int64))
            used += len(full)
        rest = np.flatnonzero(size != capacity)
        batch, size = batch.take(pa.array(rest)), size[rest]
        start = 0
        for i, n in enumerate(size.tolist()):
            total += n
            # a round that finds no good moment is closed at twice its windows
            if _ready(total, capacity) or total >= 2 * WINDOWS * capacity:
                waiting.append(batch.slice(start, i + 1 - start))
                lengths.append(size[start:i + 1])
                start = i + 1
                yield from close()
        if start < len(size):
            waiting.append(batch.slice(start))
            lengths.append(size[start:])
    yield from close()


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack pieces (any columns, with ``length`` from 1 to ``capacity``) into
    windows: adds ``sequence_id`` (0, 1, ... without gaps) and ``offset``."""
    cut = kept(cut)
    total = cut.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, int(total // (ROUNDS * WINDOWS * capacity)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    packed = kept(cut.coalesce(tasks).mapInArrow(
        lambda it: _pack(it, capacity), schema + ", part long, sequence long, offset long"))
    counts = packed.groupBy("part").agg((F.max("sequence") + 1).alias("n")).collect()   # a row for each task
    base, at = [], 0
    for row in sorted(counts, key=lambda r: r["part"]):
        base.append((row["part"], at))
        at += row["n"]
    bases = cut.sparkSession.createDataFrame(base, "part long, base long")
    return (packed.join(F.broadcast(bases), "part")
            .select(*[F.col(f"`{c}`") for c in cut.columns],
                    (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset"))


def token_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from packed pieces that carry ``ids``:
    sequence_id, length, ids (one binary, at most 4 bytes x capacity)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id")
            .agg(F.sum("length").alias("length"), parts.alias("p"))
            .select("sequence_id", "length",
                    F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers
    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
