"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time.

Every document is ranked for every item of a query set. The corpus is split
by documents; each task holds *blocks* of documents with the postings of the
queries' terms, and finds each query's best documents of the block:

* **term at a time**: the postings of the query's short lists are summed into
  accumulators, which then act as one sorted list with the largest sum as its
  bound;
* **document at a time**: that list and the long ones are ordered by their
  bounds. Lists whose bounds together stay under the score of the worst of
  the best documents so far cannot bring in a document alone; the others
  propose candidates, window of documents by window. The remaining lists are
  entered by binary search for the candidates only, largest bound first, and
  a candidate is dropped as soon as what it has and what may still come stay
  under that score. Windows whose own largest postings stay under it are
  skipped.

Scores are 64-bit integers; nothing but documents that cannot be among the
best is skipped, so results are those of an exhaustive ranking.

In Spark: one pass tokenizes the documents (Arrow function) and keeps, for
each, its length and the counts of terms that some query holds; document
frequencies are counted by a map-side aggregate. A second pass ranks, and the
best of all tasks are ranked by a window whose rows Spark limits before the
shuffle. The query set's terms are broadcast in batches of at most
``BATCH_TERMS`` entries and the corpus is scanned once for each batch.

Defined cases: null and empty texts have no terms and are never found; an
item without terms, or whose terms are in no document, gets no rows; repeated
rows of documents are ranked each (equal scores by id, null ids last); repeated
rows of items are one item; an empty table gives no rows; extra columns are
ignored; very long texts are tokenized whole.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrow
from .common import LOWER, UPPER, ascii_lower, kept, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Distinct (item, term) pairs of one scan; they and their terms are broadcast.
BATCH_TERMS = 200_000
#: Postings of a block, and of a task on average.
BLOCK, TASK = 2_000_000, 8_000_000
#: Lists are short up to this share of a block's documents.
SHORT = 1 / 32
#: Documents of a window of the document-at-a-time part.
STEP = 4096


# -- queries ----------------------------------------------------------------

def item_terms(items: DataFrame, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """(item, item_id, batch, term, times): the distinct terms of each distinct
    (item_id, text); ``item`` is 0, 1, ... inside its batch."""
    words = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"),
                        F.col("text").cast("string").alias("text")).distinct()
    terms = kept(rows.select("item_id", F.sha2("text", 256).alias("of"), words.alias("term"))
                 .groupBy("item_id", "of", "term").agg(F.count("*").alias("times")))
    batches = max(1, -(-terms.count() // batch_terms))
    return terms.withColumn("batch", F.pmod(F.xxhash64("item_id", "of"), F.lit(batches)).cast("int"))


class Queries:
    """A batch of items for the tasks: their terms are numbered, ``of[q]``
    lists the (term number, times) of query q."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.names = sorted({item for item, _, _ in rows})
        self.terms = {t: i for i, t in enumerate(sorted({t for _, t, _ in rows}))}
        number = {item: q for q, item in enumerate(self.names)}
        self.of: list[list[tuple[int, int]]] = [[] for _ in self.names]
        for item, term, times in sorted(rows):
            self.of[number[item]].append((self.terms[term], times))


# -- postings ---------------------------------------------------------------

@functools.lru_cache(maxsize=1)
def _pattern():
    return re.compile(TERM), str.maketrans(UPPER, LOWER)


def _postings(batches: Iterable[pa.RecordBatch], queries) -> Iterator[pa.RecordBatch]:
    """doc_id, n (terms with repeats), and the query terms' numbers and counts."""
    known = queries.value.terms
    pattern, lower = _pattern()
    for part in arrow.slices(batches, "text"):
        lengths, numbers, counts = [], [], []
        for text in arrow.texts(part.column("text")):
            words = pattern.findall(text.translate(lower))
            held = Counter(map(known.get, words))
            held.pop(None, None)
            lengths.append(len(words))
            numbers.append(list(held.keys()))
            counts.append(list(held.values()))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(lengths, pa.int64()),
             pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
            ["doc_id", "n", "terms", "tfs"])


class Corpus:
    """What the ranking needs of the whole corpus."""

    def __init__(self, documents: int, length: int, weight: np.ndarray):
        self.documents, self.length, self.weight = documents, length, weight


class Block:
    """Postings of a block of documents: for each term a sorted list of
    documents and what the term adds to each document's score."""

    def __init__(self, ids: pa.Array, n: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray,
                 corpus: Corpus):
        self.ids, self.size = ids, len(n)
        norm = 75 + 25 * n * corpus.documents // corpus.length
        order = np.argsort(term, kind="stable")                      # documents stay sorted in each list
        self.ptr = np.searchsorted(term[order], np.arange(len(corpus.weight) + 1))
        self.doc = doc[order]
        tf = tf[order]
        self.adds = corpus.weight[term[order]] * (1_000_000_000 * tf // (1000 * tf + 12 * norm[self.doc]))

    def lists(self, terms: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for t, times in terms:
            span = slice(self.ptr[t], self.ptr[t + 1])
            if span.start < span.stop:
                out.append((self.doc[span], self.adds[span] * times))
        return out


# -- ranking ----------------------------------------------------------------

def accumulators(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Short lists summed term at a time: one sorted list."""
    doc = np.concatenate([d for d, _ in lists])
    adds = np.concatenate([a for _, a in lists])
    order = np.argsort(doc, kind="stable")
    doc, adds = doc[order], adds[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[first], np.add.reduceat(adds, first)


def _entered(doc: np.ndarray, adds: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """What a list adds to the wanted documents, found by binary search."""
    at = np.searchsorted(doc, wanted)
    at[at == len(doc)] = 0
    return np.where(doc[at] == wanted, adds[at], 0)


def best_of(block: Block, terms: list[tuple[int, int]], top: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the block that may be among the ``top`` with a
    score of at least ``floor``."""
    lists = block.lists(terms)
    short = [x for x in lists if len(x[0]) <= max(16, SHORT * block.size)]
    lists = [x for x in lists if len(x[0]) > max(16, SHORT * block.size)]
    found_doc, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short:
        lists.append(accumulators(short))
        sums = lists[-1][1]
        if len(sums) >= top:                # scores are at least these sums
            floor = max(floor, int(np.partition(sums, len(sums) - top)[len(sums) - top]))
    lists.sort(key=lambda x: int(x[1].max()))
    bounds = [int(x[1].max()) for x in lists]
    upto = np.cumsum([0, *bounds])          # upto[i]: what the first i lists may bring together
    for begin in range(0, block.size, STEP):
        cut = [(np.searchsorted(d, begin), np.searchsorted(d, begin + STEP)) for d, _ in lists]
        spans = [(d[i:j], a[i:j]) for (d, a), (i, j) in zip(lists, cut)]
        largest = [int(a.max()) if len(a) else 0 for _, a in spans]
        if sum(largest) < floor:
            continue
        # lists before this one cannot reach the floor without a later one
        lead = int(np.searchsorted(upto[1:], floor, side="left"))
        sums = np.zeros(STEP, np.int64)
        for d, a in spans[lead:]:
            sums[d - begin] += a
        rest = int(np.cumsum([0, *largest])[lead])
        wanted = np.flatnonzero((sums > 0) & (sums + rest >= floor))
        have = sums[wanted]
        wanted = wanted + begin
        for i in range(lead - 1, -1, -1):
            if not len(wanted):
                break
            if largest[i]:
                have = have + _entered(*spans[i], wanted)
                rest -= largest[i]
                stay = have + rest >= floor
                wanted, have = wanted[stay], have[stay]
        stay = have >= floor
        found_doc, found = np.concatenate([found_doc, wanted[stay]]), np.concatenate([found, have[stay]])
        if len(found) > top:
            floor = max(floor, int(np.partition(found, len(found) - top)[len(found) - top]))
            stay = found >= floor
            found_doc, found = found_doc[stay], found[stay]
    return found_doc, found


def _blocks(batches: Iterable[pa.RecordBatch], corpus: Corpus, most: int) -> Iterator[Block]:
    held, size = [], 0

    def block() -> Block:
        rows = pa.Table.from_batches(held).combine_chunks()
        term, tf = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks()
        if isinstance(term, pa.ChunkedArray):
            term, tf = pa.concat_arrays(term.chunks), pa.concat_arrays(tf.chunks)
        count = np.diff(term.offsets.to_numpy())
        return Block(rows["doc_id"], rows["n"].to_numpy(), term.flatten().to_numpy().astype(np.int64),
                     np.repeat(np.arange(rows.num_rows), count), tf.flatten().to_numpy(), corpus)

    for batch in batches:
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= most:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def _rank(batches: Iterable[pa.RecordBatch], queries, corpus, top: int, most: int) -> Iterator[pa.RecordBatch]:
    """The best documents of a task for each query: item, doc_id, score. A
    query's floor rises from block to block."""
    of = queries.value.of
    best: list[list[tuple[int, bool, int]]] = [[] for _ in of]     # (-score, id is null, id)
    for block in _blocks(batches, corpus.value, most):
        for q, terms in enumerate(of):
            floor = -best[q][-1][0] if len(best[q]) == top else 1
            doc, score = best_of(block, terms, top, floor)
            if len(doc):
                ids = block.ids.take(pa.array(doc)).to_pylist()
                best[q] = sorted(best[q] + [(-s, i is None, i or 0) for i, s in zip(ids, score.tolist())])[:top]
    rows = [(queries.value.names[q], None if null else i, -s) for q, x in enumerate(best) for s, null, i in x]
    if rows:
        item, doc, score = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(doc, pa.int64()),
                                          pa.array(score, pa.int64())], ["item", "doc_id", "score"])


def _weight(documents: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * df + 1))).cast("long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, batch_terms: int = BATCH_TERMS,
           block: int = BLOCK, task: int = TASK) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = kept(item_terms(items, batch_terms)
                 .withColumn("item", F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "of")))
    found = []
    for (batch,) in sorted(terms.select("batch").distinct().collect()):      # one for each BATCH_TERMS entries
        part = terms.where(F.col("batch") == batch).select("item", "term", "times").toArrow().to_pydict()
        queries = Queries(list(zip(part["item"], part["term"], part["times"])))
        sent = sc.broadcast(queries)
        postings = kept(rows.mapInArrow(lambda it, q=sent: _postings(it, q),
                                        "doc_id long, n long, terms array<int>, tfs array<long>"))
        totals = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length"),
                              F.sum(F.size("terms")).alias("postings")).first()
        if not totals["postings"]:
            continue
        df = postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        weight = np.zeros(len(queries.terms), np.int64)
        got = df.select("t", _weight(totals["documents"], F.col("df")).alias("w")).toArrow()   # a row a term
        weight[got["t"].to_numpy()] = got["w"].to_numpy()
        corpus = sc.broadcast(Corpus(totals["documents"], totals["length"], weight))
        tasks = max(2 * sc.defaultParallelism, -(-totals["postings"] // task))
        found.append(postings.coalesce(tasks).mapInArrow(
            lambda it, q=sent, c=corpus: _rank(it, q, c, top, block), "item string, doc_id long, score long"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    item_id = F.nullif(F.substring_index("item", ":", 1), F.lit("")).cast("long")
    return (functools.reduce(DataFrame.union, found)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select(item_id.alias("item_id"), "rank", "doc_id", "score"))


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM len),
m AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM len, corpus),
w AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus
), q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
        FROM benchmark)
  GROUP BY ALL
), s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
       doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= {TOP}
"""
