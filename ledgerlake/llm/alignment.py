"""Alignment of two tokenizers' tokens by sparse incidence products.

Both tokenizers cut the bytes of ``space + text``. Their token-byte incidence
matrices A (tokens x bytes) and B are built by hand in CSR form (row pointers,
column numbers). Row products after Gustavson give

* **overlap links** A x B-transposed: token pairs and the bytes they share;
* **groups**: the text is cut after a byte where a token of either side ends.
  In the overlap matrix that is a pair (i, j) where j is the last column of
  row i and i the last row of column j;
* **shared-group links** GA x GB-transposed, of the token-group incidence
  matrices: all pairs of tokens whose bytes share a group.

In Spark: one pass over the texts (Arrow function, a megabyte of text at a
time) gives a row per document with its counts, the digest of its groups and
its distinct linked id pairs; the rows are written to the shared folder. Pairs
are counted in each task and summed by pair through a shuffle, so no pair is
hot. The table of pair counts (bounded by the product of the vocabularies) is
then broadcast in chunks of ``PAIRS_AT_A_TIME`` and the document rows are
scanned once for each chunk: usually once, and never with a shuffle of links.

Defined cases: a text that is null or empty, or whose pieces do not spell
``space + text`` again, has no tokens: zeros, and an empty digest. Rows with a
null id and repeated rows are documents of their own. An empty table gives no
rows. Extra columns are ignored. A very long text needs memory in proportion
to its length; groups of many tokens are multiplied by distinct ids, not by
occurrences, so that a long unaligned run does not cost its square.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .common import kept, table

#: Bytes of text worked on at a time; products of a block of rows.
TEXT_BYTES, PRODUCTS = 1 << 20, 1 << 21
#: Pairs of ids in one broadcast (16 bytes each).
PAIRS_AT_A_TIME = 1 << 20
#: Groups of more token pairs than this are multiplied by distinct ids.
LARGE_GROUP = 256


# -- sparse products --------------------------------------------------------

def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges in one array."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def products(a_ptr: np.ndarray, a_idx: np.ndarray, b_ptr: np.ndarray, b_idx: np.ndarray,
             most: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's row products A x B of two CSR matrices of ones: for each
    row of A the rows of B that its columns name, side by side. Yields (row,
    column, times) in row order, summed up, for blocks of rows of at most
    ``most`` products (a single row may have more)."""
    width = b_ptr[a_idx + 1] - b_ptr[a_idx]
    done = np.concatenate([[0], np.cumsum(width)])[a_ptr]          # products before each row
    row, rows = 0, len(a_ptr) - 1
    columns = int(b_idx.max()) + 1 if len(b_idx) else 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(done, done[row] + most, side="right")) - 1)
        entries = slice(a_ptr[row], a_ptr[stop])
        sizes = width[entries]
        of = np.repeat(np.arange(row, stop), done[row + 1:stop + 1] - done[row:stop])
        at = of * columns + b_idx[_ranges(b_ptr[a_idx[entries]], sizes)]
        if len(at) > 1 and (at[1:] < at[:-1]).any():
            at.sort()
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(at)))
        yield at[first] // columns, at[first] % columns, times
        row = stop


def token_bytes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token-byte incidence in CSR: each token a row, its bytes the columns."""
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    return ptr, np.arange(ptr[-1])


def transposed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-token incidence in CSR: each byte a row with its one token."""
    return np.arange(int(sizes.sum()) + 1), np.repeat(np.arange(len(sizes)), sizes)


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlap links of tokens that cut the same bytes: (A token, B token,
    bytes shared), in byte order."""
    blocks = list(products(*token_bytes(a_sizes), *transposed(b_sizes)))
    if not blocks:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*blocks))


def groups(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A and each B token from the overlap links."""
    last_b, last_a = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    last_b[a], last_a[b] = b, a                                    # the last of equal places stays
    ends_a = last_a[last_b] == np.arange(n_a)
    ends_b = last_b[last_a] == np.arange(n_b)
    return np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b


def _rows(group: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the token-group incidence: (group, id, times). Tokens of large
    groups are merged by id."""
    merge = large[group]
    times = np.ones(len(ids), np.int64)
    if merge.any():
        key, n = np.unique(group[merge] << 32 | ids[merge], return_counts=True)
        group = np.concatenate([group[~merge], key >> 32])
        ids = np.concatenate([ids[~merge], key & 0xFFFFFFFF])
        times = np.concatenate([times[~merge], n])
        order = np.argsort(group, kind="stable")
        group, ids, times = group[order], ids[order], times[order]
    return group, ids, times


def linked_ids(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray,
               document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared-group links by id: (document, A id << 16 | B id, times), sorted.
    ``document`` gives the document of each group."""
    n = len(document)
    large = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n) > LARGE_GROUP
    ga, ia, ta = _rows(group_a, ids_a, large)
    gb, ib, tb = _rows(group_b, ids_b, large)
    b_ptr = np.searchsorted(gb, np.arange(n + 1))
    keys, times = [], []
    for row, column, _ in products(np.arange(len(ga) + 1), ga, b_ptr, np.arange(len(gb))):
        key = document[ga[row]] << 32 | ia[row] << 16 | ib[column]
        key, inverse = np.unique(key, return_inverse=True)
        keys.append(key)
        times.append(np.bincount(inverse, weights=ta[row] * tb[column]).astype(np.int64))
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    if len(keys) > 1:
        key, inverse = np.unique(key, return_inverse=True)
        times = [np.bincount(inverse, weights=np.concatenate(times)).astype(np.int64)]
    return key >> 32, key & 0xFFFFFFFF, times[0] if times else key


# -- tokenizers -------------------------------------------------------------

class Side:
    """A tokenizer: ``encode`` gives ids of texts, ``spell[id]`` the bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], spell: list[bytes]):
        self.encode, self.spell = encode, spell
        self.sizes = np.array([len(x) for x in spell], dtype=np.int64)


@functools.lru_cache(maxsize=2)
def byte_ranks(path: str, pattern: str) -> Side:
    """Byte-level tokenizer from a rank file; it tokenizes ``space + text``."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    spell = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        spell[i] = token
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda batch: [coder.encode_ordinary(" " + t) for t in batch], spell)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """Piece tokenizer, which adds the space itself."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spell = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
             else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return Side(lambda batch: model.encode(batch, num_threads=1), spell)


# -- documents --------------------------------------------------------------

ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, "
           "groups_sha256 string, pairs binary, times binary")


class Aligner:
    """Aligns texts by two tokenizers; ids of both must be below 65 536."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        na, nb = len(a.spell), len(b.spell)
        # a token and what follows it: , or | within A, , or ; within B
        self.words = ([f"{i}," for i in range(na)] + [f"{i}|" for i in range(na)]
                      + [f"{i}," for i in range(nb)] + [f"{i};" for i in range(nb)])

    def __call__(self, texts: list[str]) -> list[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, n_overlaps, digest,
        distinct linked pairs (A id << 16 | B id) and their times."""
        a_ids, b_ids = self.a.encode(texts), self.b.encode(texts)
        spell_a, spell_b, good = self.a.spell, self.b.spell, []
        for k, (text, x, y) in enumerate(zip(texts, a_ids, b_ids)):
            whole = b" " + text.encode()
            good.append(bool(text) and b"".join([spell_b[i] for i in y]) == whole
                        and b"".join([spell_a[i] for i in x]) == whole)
            if not good[k]:
                a_ids[k] = b_ids[k] = []
        count_a, count_b = np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])
        ids_a = np.array([i for x in a_ids for i in x], dtype=np.int64)
        ids_b = np.array([i for x in b_ids for i in x], dtype=np.int64)
        del a_ids, b_ids
        over_a, over_b, _ = overlaps(self.a.sizes[ids_a], self.b.sizes[ids_b])
        ga, gb = groups(over_a, over_b, len(ids_a), len(ids_b))
        n_groups = int(ga[-1]) + 1 if len(ga) else 0
        in_a, in_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        a_ptr, b_ptr = np.concatenate([[0], np.cumsum(in_a)]), np.concatenate([[0], np.cumsum(in_b)])
        doc_a = np.repeat(np.arange(len(texts)), count_a)
        document = doc_a[a_ptr[:-1]]
        per_doc = [np.bincount(document, weights=w, minlength=len(texts)).astype(np.int64)
                   for w in (None, in_a * in_b)]
        shared = np.bincount(doc_a[over_a], minlength=len(texts))

        # all tokens in the order of the digest, by what is written for them
        written = np.empty(len(ids_a) + len(ids_b), np.int64)
        ends_a, ends_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        ends_a[a_ptr[1:] - 1], ends_b[b_ptr[1:] - 1] = True, True
        na, nb = len(spell_a), len(spell_b)
        written[np.arange(len(ids_a)) + b_ptr[ga]] = ids_a + ends_a * na
        written[np.arange(len(ids_b)) + a_ptr[gb + 1]] = 2 * na + ids_b + ends_b * nb
        written, words = written.tolist(), self.words
        begin = np.concatenate([[0], np.cumsum(count_a + count_b)]).tolist()

        of, pair, times = linked_ids(ga, ids_a, gb, ids_b, document)
        at = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
        pair = pair.astype("<u4")
        rows = []
        for k in range(len(texts)):
            if not good[k]:
                rows.append((0, 0, 0, 0, 0, "", b"", b""))
                continue
            digest = hashlib.sha256("".join([words[i] for i in written[begin[k]:begin[k + 1]]])[:-1].encode())
            t = times[at[k]:at[k + 1]]
            rows.append((int(count_a[k]), int(count_b[k]), int(per_doc[0][k]), int(per_doc[1][k]), int(shared[k]),
                         digest.hexdigest(), pair[at[k]:at[k + 1]].tobytes(), packed(t)))
        return rows


def packed(times: np.ndarray) -> bytes:
    """Counts in bytes if all are below 256, else in 64 bits."""
    return times.astype("u1" if times.max(initial=0) < 256 else "<i8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "u1" if len(raw) == n else "<i8").astype(np.int64)


def _align(batches: Iterable[pa.RecordBatch], aligner: Callable[[], Aligner]) -> Iterator[pa.RecordBatch]:
    align, task = aligner(), TaskContext.get()
    row = (task.partitionId() if task else 0) << 40
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    types = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]
    for part in arrow.slices(batches, "text", TEXT_BYTES):
        columns = list(zip(*align(arrow.texts(part.column("text")))))
        arrays = [pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id")]
        arrays += [pa.array(c, t) for c, t in zip(columns, types[2:])]
        row += part.num_rows
        yield pa.RecordBatch.from_arrays(arrays, names)


def align_documents(docs: DataFrame, aligner: Callable[[], Aligner]) -> DataFrame:
    """A row per document with its counts, digest and distinct linked pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _align(it, aligner), ALIGNED)


def _links(batches: Iterable[pa.RecordBatch], aligner: Callable[[], Aligner]) -> Iterator[pa.RecordBatch]:
    align = aligner()
    names = ["doc_id", "a_index", "b_index", "a_id", "b_id", "bytes_shared", "group"]
    for part in arrow.slices(batches, "text", TEXT_BYTES):
        for doc_id, text in zip(part.column("doc_id").to_pylist(), arrow.texts(part.column("text"))):
            x, y = align.a.encode([text])[0], align.b.encode([text])[0]
            whole = b" " + text.encode()
            if not text or any(b"".join([s.spell[i] for i in z]) != whole for s, z in ((align.a, x), (align.b, y))):
                continue
            ids_a, ids_b = np.array(x, np.int64), np.array(y, np.int64)
            a, b, n = overlaps(align.a.sizes[ids_a], align.b.sizes[ids_b])
            ga, _ = groups(a, b, len(ids_a), len(ids_b))
            columns = [pa.array([doc_id] * len(a), pa.int64())] + [
                pa.array(c.astype(np.int64)) for c in (a, b, ids_a[a], ids_b[b], n, ga[a])]
            yield pa.RecordBatch.from_arrays(columns, names)


def overlap_links(docs: DataFrame, aligner: Callable[[], Aligner]) -> DataFrame:
    """The overlap links themselves: a row for each pair of token occurrences
    that share bytes, with both positions and ids, the bytes shared and the
    number of their group in the document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _links(it, aligner),
                           "doc_id long, a_index long, b_index long, a_id long, b_id long, "
                           "bytes_shared long, `group` long")


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents holding each pair, counted a few million entries at a time."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

    for batch in batches:
        for raw in batch.column("pairs").to_pylist():
            held.append(np.frombuffer(raw, "<u4"))
            size += len(held[-1])
            if size > PRODUCTS * 4:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (A id << 16 | B id), n (documents that hold it linked) and best
    (no pair of its A id is held by more)."""
    counts = kept(aligned.select("pairs").mapInArrow(_count, "pair long, n long")
                  .groupBy("pair").agg(F.sum("n").alias("n")))
    a_id = F.shiftright("pair", 16)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))    # a row for each A id at most
    return (counts.withColumn("a", a_id).join(most, "a")
            .select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _score(batches: Iterable[pa.RecordBatch], lookup) -> Iterator[pa.RecordBatch]:
    pair, n, best = lookup.value
    for batch in batches:
        out = []
        for raw, counts in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
            own = np.frombuffer(raw, "<u4")
            times = unpacked(counts, len(own))
            if not len(own) or not len(pair):
                out.append((0, 0))
                continue
            at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
            hit = pair[at] == own
            at, times = at[hit], times[hit]
            out.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
        keep = [i for i, c in enumerate(batch.schema.names) if c not in ("pairs", "times")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))],
            [batch.schema.names[i] for i in keep] + ["n_best", "count_sum"])


def scored(aligned: DataFrame, pairs: DataFrame, at_a_time: int = PAIRS_AT_A_TIME) -> DataFrame:
    """The aligned documents (kept rows) with ``n_best`` and ``count_sum``
    summed over their links, a chunk of the pair counts at a time."""
    sc = aligned.sparkSession.sparkContext
    pairs = kept(pairs)
    chunks = max(1, -(-pairs.count() // at_a_time))
    chunk_of = F.pmod(F.xxhash64("pair"), F.lit(chunks))
    columns = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in columns)
    found = []
    for chunk in range(chunks):
        part = pairs.where(chunk_of == chunk) if chunks > 1 else pairs
        got = part.toArrow()                       # about at_a_time rows
        pair = got["pair"].to_numpy()
        order = np.argsort(pair)
        lookup = sc.broadcast((pair[order].astype(np.uint32), got["n"].to_numpy()[order],
                               got["best"].to_numpy()[order]))
        rows = aligned if chunk == 0 else aligned.select("row", "pairs", "times")
        kind = schema if chunk == 0 else "row long"
        found.append(rows.mapInArrow(lambda it, x=lookup: _score(it, x), kind + ", n_best long, count_sum long"))
    out = found[0]
    if chunks > 1:
        more = functools.reduce(DataFrame.union, found[1:])
        sums = more.groupBy("row").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
        out = (out.join(sums, "row", "left")
               .withColumn("n_best", F.col("n_best") + F.col("more_best"))
               .withColumn("count_sum", F.col("count_sum") + F.col("more_sum")))
    return out.select(*columns, "n_best", "count_sum")


def _public() -> Aligner:
    import public_tokenizers as p
    return _aligner(p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("piece_bpe_32k.model"))


@functools.lru_cache(maxsize=1)
def _aligner(ranks: str, pattern: str, model: str) -> Aligner:
    return Aligner(byte_ranks(ranks, pattern), pieces(model))


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Links of the byte-level and the piece tokenizer over all documents."""
    aligned = kept(align_documents(table(spark, sf_dir, "documents"), _public))
    return scored(aligned, pair_counts(aligned)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
