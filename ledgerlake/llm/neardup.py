"""Near-duplicate documents by b-bit MinHash.

1. Sign: one pass over the texts makes each document's set of word shingles
   (64-bit hashes) and, from that, the set's size, a 128-bit digest of the
   set, ``bands * ROWS`` minima reduced to their low ``BITS`` bits and packed
   into longs, and one 64-bit key per band of ``ROWS`` full minima. Documents
   of equal digest are one *node* from here on, so exact copies cost nothing
   more, however many there are.
2. Candidates: nodes that share a band key. A bucket gives a star (each member
   with the bucket's earliest document), never all pairs.
3. Filter: the packed signatures of a pair are compared by bit counts. Two
   different minima agree in their low bits with chance 2^-BITS; the similarity
   corrected for that must not lie so far under the threshold that a true link
   would come out there once in a million pairs.
4. Confirm: whole shingle sets of the remaining pairs are compared exactly.
5. Rest: after the star links are joined into components, some buckets hold
   more than one component. Shingles that at most ``SCARCE`` nodes of those
   buckets hold are set apart. A pair that shares one of them is found by a
   join on scarce shingles (the first ones of each node, which such a pair
   must share); any other pair has only its common shingles to share, and is
   decided without a comparison where these are too few for the threshold.
   A second star is made with the member that shares most; then every member
   outside its centre's component is compared with the members of all other
   components (filter and confirmation as above). Pairs inside one component
   can change nothing and are not made, so every candidate pair that could
   join two components is decided exactly.

The number of bands is chosen so that a pair at the threshold shares no band
once in a million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrow
from .common import beside, few, forget, kept, small_side, table

ROWS = 4           # minima in a band
BITS = 4           # low bits kept of each minimum; 16 of them fill a long
TEXT_BYTES = 2 << 20   # text that a function holds at a time
RARE = 1e-6        # chance to lose a pair at the threshold, for bands and for the filter
LONG = 64 // BITS
SCARCE = 8         # nodes that hold a scarce shingle, at most; any number gives the same links


def bands_for(threshold: float) -> int:
    """Fewest bands that lose a pair at ``threshold`` with chance ``RARE`` at
    most, rounded up to fill whole longs of signature."""
    n = math.ceil(math.log(RARE) / math.log(1 - threshold ** ROWS))
    return math.ceil(n * ROWS / LONG) * LONG // ROWS


def least_matches(threshold: float, minima: int) -> int:
    """Largest m such that a pair at the threshold agrees in fewer than m of
    the reduced minima with chance ``RARE`` at most."""
    c = 2.0 ** -BITS
    p = c + (1 - c) * threshold       # collision-corrected similarity, inverted
    below = 0.0
    for m in range(minima + 1):
        below += math.comb(minima, m) * p ** m * (1 - p) ** (minima - m)
        if below > RARE:
            return m
    return minima


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text:
    A-Z lower-cased, words between ASCII blanks; fewer than k words make one
    shingle, no word makes none."""
    words = text.lower().split()      # of bytes: A-Z only, and x20, x09-x0D only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    mult = _MULT[:min(n, k)]
    s = np.full(max(1, n - k + 1), _MULT[-1 - min(n, k)], np.uint64)
    for i, a in enumerate(mult):
        s += h[i:i + len(s)] * a
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    return np.unique(s)


_MULT = _constants(64, 7)


def _signer(k: int, bands: int):
    n = bands * ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, mult = _constants(n, 11)[None, :], _constants(n, 13)[None, :]
        shift = (np.arange(n, dtype=np.uint64) % np.uint64(LONG)) * np.uint64(BITS)
        fold = _constants(ROWS, 17)
        number = _constants(bands, 19)
        for batch in arrow.slices(batches, "_ll_text", TEXT_BYTES):
            sizes, digests, minima = [], [], np.zeros((batch.num_rows, n), np.uint64)
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                s = shingles(text, k) if text else shingles(b"", k)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    least = None
                    for at in range(0, len(s), 512):
                        m = s[at:at + 512, None] ^ flip
                        m *= mult
                        m = m.min(axis=0)
                        least = m if least is None else np.minimum(least, m)
                    minima[row] = least
            low = (minima ^ (minima >> np.uint64(32))) & np.uint64((1 << BITS) - 1)
            packed = np.bitwise_or.reduce((low << shift).reshape(batch.num_rows, n // LONG, LONG), axis=2)
            key = (minima.reshape(batch.num_rows, bands, ROWS) * fold).sum(axis=2, dtype=np.uint64)
            key = (key ^ (key >> np.uint64(32)) ^ number) * np.uint64(0x9E3779B97F4A7C15)

            def lists(x):
                return pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(packed), lists(key)],
                names=["_ll_id", "_ll_tag", "_ll_n", "_ll_node", "_ll_sig", "_ll_bands"])
    return sign


def _sets(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "_ll_text", TEXT_BYTES):
            sets = [shingles(t or b"", k) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))],
                names=["node", "set"])
    return make


def text_tag(text_col: str) -> Column:
    """What tells rows of one id and different text apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def signatures(docs: DataFrame, k: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(_ll_id, _ll_tag, _ll_n, _ll_node, _ll_sig, _ll_bands) of every row. Rows
    without words, or without id, have no node."""
    rows = docs.select(F.col(id_col).alias("_ll_id"), F.col(text_col).cast("string").alias("_ll_text"),
                       text_tag(text_col).alias("_ll_tag"))
    kind = rows.schema["_ll_id"].dataType.simpleString()
    out = rows.mapInArrow(_signer(k, bands_for(threshold)),
                          f"_ll_id {kind}, _ll_tag long, _ll_n long, _ll_node binary, _ll_sig array<long>, _ll_bands array<long>")
    return out.withColumn("_ll_node", F.when(F.col("_ll_id").isNotNull(), F.col("_ll_node")))


def agreeing(a: Column, b: Column, longs: int) -> Column:
    """Reduced minima in which two packed signatures agree, by bit counts."""
    ones = F.lit(int("1" * (64 // BITS), 16) if BITS == 4 else 0)
    out = F.lit(longs * LONG)
    for i in range(1, longs + 1):
        x = F.element_at(a, i).bitwiseXOR(F.element_at(b, i))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        out = out - F.bit_count(x.bitwiseAND(ones))
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): (node, label), label the smallest node.
    Each round takes the least label of the neighbours and then the label's
    own label, so paths shrink by doubling; rounds run until nothing changes.
    Labels stay distributed, checkpointed each round."""
    both = few(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
               .unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    label = few(both.groupBy("src").agg(F.min("dst").alias("m"))
                .select(F.col("src").alias("node"), F.least("src", "m").alias("label")))
    while True:
        near = (both.join(beside(label.select(F.col("node").alias("dst"), "label"), label), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near")))
        step = (near.join(beside(label, label), "node")
                .select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid")))
        up = beside(label.select(F.col("node").alias("mid"), F.col("label").alias("up")), label)
        new = few(step.join(up, "mid").select("node", "old", F.least("mid", "up").alias("label")))
        done = new.where("old <> label").limit(1).count() == 0
        forget(label)
        label = new.select("node", "label")
        label._ll_whole, label._ll_rows = new._ll_whole, new._ll_rows
        if done:
            forget(both)
            return label


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have
    ``den * |intersection| >= num * |union|``.

    Returns one row per row of ``docs``: ``id_col``, ``n_shingles`` (set
    size), ``component_id`` (smallest id reachable, itself included), ``kept``
    (``id = component_id``).

    Defined cases: a text without words (or null) has an empty set and is
    linked with nothing; a row without id is linked with nothing, has a null
    component and is kept; rows of equal text are linked; rows of equal id and
    different text are separate nodes; an empty table gives no rows.
    """
    found = linked(docs, k, num, den, id_col, text_col)
    comp = F.coalesce("_ll_least", "_ll_id")
    return found.select(F.col("_ll_id").alias(id_col), F.col("_ll_n").alias("n_shingles"),
                        comp.alias("component_id"), F.col("_ll_id").eqNullSafe(comp).alias("kept"))


def linked(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Every row's id, text tag and set size with the smallest id of its
    component (_ll_least) and the component's node (_ll_label); both are null
    for rows without words or id."""
    threshold = num / den
    bands = bands_for(threshold)
    longs, enough = bands * ROWS // LONG, least_matches(threshold, bands * ROWS)
    signed = kept(signatures(docs, k, threshold, id_col, text_col))
    nodes = signed.where("_ll_node IS NOT NULL")
    reps = few(nodes.groupBy("_ll_node").agg(
        F.min("_ll_id").alias("_ll_first"), F.any_value("_ll_sig").alias("_ll_sig"),
        F.any_value("_ll_bands").alias("_ll_bands")).withColumnRenamed("_ll_node", "node"))
    sig = reps.select("node", F.col("_ll_sig").alias("sig"))
    spread = reps.select("node", "_ll_first", F.explode("_ll_bands").alias("key"))
    bucket = few(spread.groupBy("key").agg(F.min(F.struct("_ll_first", "node"))["node"].alias("centre"),
                                            F.count("*").alias("c")).where("c > 1").select("key", "centre"))
    members = few(spread.drop("_ll_first").join(beside(bucket, bucket), "key"))

    def filtered(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        pairs = pairs.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        return few(pairs.where(agreeing(F.col("sa"), F.col("sb"), longs) >= enough).select("a", "b"))

    def sets_of(asked: DataFrame) -> DataFrame:
        """Whole shingle sets (node, set) of distinct nodes."""
        ids = small_side(asked.join(reps, "node").select(F.col("_ll_first").alias("_ll_ask")).distinct())
        texts = docs.join(ids, F.col(id_col) == F.col("_ll_ask"), "left_semi").select(
            F.col(text_col).cast("string").alias("_ll_text"))
        return texts.mapInArrow(_sets(k), "node binary, set array<long>").join(asked, "node", "left_semi")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
        pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return few(pairs.where(both * den >= (F.size("sa") + F.size("sb") - both) * num)
                    .select("a", "b").distinct())

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def labelled(frame: DataFrame, of: str, to: str) -> DataFrame:
        return (frame.join(beside(label.select(F.col("node").alias(of), F.col("label").alias(to)), label), of, "left")
                .withColumn(to, F.coalesce(to, of)))

    def merged(edges: DataFrame) -> DataFrame:
        """``label`` with the components that the edges join put together."""
        across = labelled(labelled(edges, "a", "la"), "b", "lb").select(*ordered("la", "lb")).where("a <> b")
        if across.limit(1).count() == 0:
            return label
        top = components(across)
        moved = label.join(beside(top.select(F.col("node").alias("label"), F.col("label").alias("top")), top),
                           "label", "left")
        return few(moved.select("node", F.coalesce("top", "label").alias("label"))
                    .unionByName(top.join(label.select("node"), "node", "left_anti")))

    # first stars: each bucket's earliest document
    star = filtered(members.where("node <> centre").select(*ordered("node", "centre")).distinct())
    ends = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    label = components(confirmed(star, sets_of(ends)))

    # buckets that still hold several components
    named = labelled(labelled(members, "node", "own"), "centre", "main")
    several = few(named.where("own <> main").select("key").distinct())
    mixed = few(named.join(beside(several, several), "key", "left_semi").select("key", "node"))
    if mixed.limit(1).count():
        sets = kept(sets_of(mixed.select("node").distinct()).dropDuplicates(["node"]))
        # shingles that few nodes of these buckets have
        tokens = sets.select(F.xxhash64("node").alias("nid"), F.explode("set").alias("token"))
        scarce = few(tokens.join(tokens.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") <= SCARCE), "token"))
        sizes = few(sets.select("node", F.xxhash64("node").alias("nid"), F.size("set").alias("n"))
                     .join(scarce.groupBy("nid").agg(F.count("*").alias("few")), "nid", "left")
                     .select("node", "nid", "n", (F.col("n") - F.coalesce("few", F.lit(0))).alias("share")))
        # a pair that shares no scarce shingle has only these to share
        able = few(mixed.join(beside(sizes.where(F.col("share") * den >= F.col("n") * num).drop("nid"), sizes), "node"))

        def possible(x: str, y: str) -> Column:
            """The shareable shingles of both suffice for the threshold."""
            return (F.least(f"share_{x}", f"share_{y}") * (num + den)
                    >= (F.col(f"n_{x}") + F.col(f"n_{y}")) * num)

        def side(frame: DataFrame, x: str) -> DataFrame:
            return frame.select("key", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in frame.columns
                                                                 if c not in ("key", "node")])
        # second stars: the member whose shingles the others share most
        best = side(able.groupBy("key").agg(F.max(F.struct(
            (F.col("share") / F.col("n")).alias("ratio"), "node", "n", "share")).alias("m")).select("key", "m.*"), "c")
        pairs = side(able, "x").join(best, "key").where((F.col("x") != F.col("c")) & possible("x", "c"))
        pairs = labelled(labelled(pairs, "x", "own_x"), "c", "own_c").where("own_x <> own_c")
        label = merged(confirmed(filtered(pairs.select(*ordered("x", "c")).distinct()), sets))

        # the rest: members outside the centre's component against all other components
        full = (labelled(labelled(able.join(best.select("key", F.col("c").alias("centre")), "key"), "node", "own"), "centre", "main")
                .join(reps.select("node", F.col("_ll_sig").alias("sig"), F.col("_ll_bands").alias("bands")), "node"))
        full = few(full.drop("centre"))
        x, y = side(full.where("own <> main"), "x"), side(full, "y")
        rest = x.join(y, (x["key"] == y["key"]) & (F.col("own_x") != F.col("own_y"))
                      & ((F.col("own_y") == F.col("main_y")) | (F.col("own_x") < F.col("own_y"))) & possible("x", "y")
                      & (agreeing(F.col("sig_x"), F.col("sig_y"), longs) >= enough)
                      # a pair is made in the first bucket it shares
                      & (F.array_min(F.array_intersect("bands_x", "bands_y")) == x["key"]))
        # a pair that shares scarce shingles has the first it shares, in order
        # of their counts, among the first n - ceil(threshold * n) + 1 of both
        first = Window.partitionBy("nid").orderBy("c", "token")
        prefix = (scarce.join(beside(sizes.select("nid", "node", "n"), sizes), "nid").withColumn("at", F.row_number().over(first))
                  .where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1).where("c > 1"))
        prefix = few(labelled(prefix.select("token", "node"), "node", "own"))
        x, y = (prefix.select("token", F.col("node").alias(v), F.col("own").alias(f"own_{v}")) for v in "xy")
        near = x.join(y, (x["token"] == y["token"]) & (F.col("x") < F.col("y")) & (F.col("own_x") != F.col("own_y")))
        near = filtered(near.select(*ordered("x", "y")).distinct())
        rest = few(rest.select(*ordered("x", "y")).unionByName(near).distinct())
        if rest.limit(1).count():
            label = merged(confirmed(rest, sets))

    named = (reps.select("node", "_ll_first").join(label, "node", "left")
             .select("node", "_ll_first", F.coalesce("label", "node").alias("label")))
    least = named.groupBy("label").agg(F.min("_ll_first").alias("_ll_least"))
    where = named.join(least, "label").select(F.col("node").alias("_ll_node"), F.col("label").alias("_ll_label"),
                                              "_ll_least")
    return signed.select("_ll_id", "_ll_tag", "_ll_n", "_ll_node").join(where, "_ll_node", "left")


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns) with one row of each component: that of the
    smallest id and, among rows of that id, of the smallest text tag. Rows
    that share an id but are not near each other stay both; rows without words
    or id stay."""
    found = linked(docs, k, num, den, id_col, text_col).where("_ll_label IS NOT NULL")
    chosen = F.struct("_ll_id", "_ll_tag")
    # a row for each (id, text): how often it is there
    rows = found.groupBy("_ll_label", "_ll_id", "_ll_tag").agg(F.count("*").alias("c"))
    best = rows.groupBy("_ll_label").agg(F.min(chosen).alias("best"))
    rows = kept(rows.join(best, "_ll_label").select(
        F.col("_ll_id").alias("_ll_of"), F.col("_ll_tag").alias("_ll_with"), (chosen == F.col("best")).alias("stays"),
        "c"))
    this = (F.col(id_col) == F.col("_ll_of")) & (text_tag(text_col) == F.col("_ll_with"))
    left = docs.join(small_side(rows.where("NOT stays").select("_ll_of", "_ll_with")), this, "left_anti")
    again = few(rows.where("stays AND c > 1").select("_ll_of", "_ll_with"))
    if not again._ll_rows:
        return left
    again = beside(again, again)
    tag = "_ll_tag"
    return (left.join(again, this, "left_anti")
            .unionByName(left.join(again, this, "left_semi").withColumn(tag, text_tag(text_col))
                         .dropDuplicates([id_col, tag]).drop(tag)))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles,
    similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100)
