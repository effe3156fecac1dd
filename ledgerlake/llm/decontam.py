"""Benchmark decontamination with a broadcast hash set of item n-grams.

The windows of the benchmark (``n`` consecutive normalised words; an item of
fewer words is one window) are hashed into a table that every executor holds.
Each document is split into words once; the hash of each of its windows is
looked up in that table inside the same codegen stage, and a hit is verified
by comparing the words themselves, so hash collisions never count. Only hits
and one marker row per document leave the scan, so the one shuffle carries a
few dozen bytes per document.

The table holds each distinct window once, with a number in place of its
items, and is broadcast in parts of at most ``MAX_BROADCAST_WINDOWS`` windows
(by hash), one scan of the documents for each part: a benchmark collection of
any size is matched whole with a bounded broadcast, also where one
instruction text stands in most of its items. Which items hold a window is a
table of its own that the distinct (document, window) hits are joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, kept, small_side, table

#: What separates words after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

MAX_BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def benchmark_windows(bench: DataFrame, n: int = 10, id_col: str = "item_id",
                      text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (_ll_wid, _ll_len, _ll_win words, _ll_hash), and which
    items hold them: distinct (_ll_wid, _ll_item id as a string)."""
    items = bench.select(F.col(id_col).cast("string").alias("_ll_item"),
                         words(F.col(text_col)).alias("_ll_w")).where(F.size("_ll_w") > 0)
    size = F.least(F.size("_ll_w"), F.lit(n))
    at = F.explode(F.sequence(F.lit(1), F.size("_ll_w") - size + 1)).alias("_ll_at")
    spots = (items.select("_ll_item", "_ll_w", size.alias("_ll_len"), at)
             .select("_ll_item", "_ll_len", F.slice("_ll_w", F.col("_ll_at"), F.col("_ll_len")).alias("_ll_win")))
    # numbers are fixed once the table is kept
    wins = kept(spots.select("_ll_len", "_ll_win").distinct().select(
        F.monotonically_increasing_id().alias("_ll_wid"), "*", F.xxhash64("_ll_win").alias("_ll_hash")))
    links = (spots.where("_ll_item IS NOT NULL").distinct()
             .join(wins.select("_ll_wid", "_ll_win"), "_ll_win").select("_ll_wid", "_ll_item"))
    return wins, links


def window_hits(docs: DataFrame, wins: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified hits, one row per distinct (document id, text): ``_ll_id``,
    ``_ll_key`` (hash of the text), ``copies``, ``n_words``, ``spans``,
    ``n_hit`` and ``wids`` (numbers of the windows that hit)."""
    sizes = wins.groupBy("_ll_len").agg(F.count("*").alias("n")).collect()   # at most n rows
    lengths = sorted(r["_ll_len"] for r in sizes)
    parts = max(1, -(-sum(r["n"] for r in sizes) // MAX_BROADCAST_WINDOWS))
    marker = docs.sparkSession.createDataFrame(
        [(None, 0, [], 0)], "_ll_wid long, _ll_len int, _ll_win array<string>, _ll_hash long")

    found = None
    for part in range(parts):
        side = wins.where(F.pmod("_ll_hash", F.lit(parts)) == part).select(*marker.columns)
        # length 0 stands for the marker row of the document itself
        wanted = [0, *lengths] if part == 0 else lengths
        side = side.unionByName(marker) if part == 0 else side
        w = docs.select(F.col(id_col).alias("_ll_id"), F.xxhash64(text_col).alias("_ll_key"),
                        words(F.col(text_col)).alias("_ll_w"))
        w = w.select("*", F.explode_outer(F.array(*[F.lit(x) for x in wanted])).alias("_ll_l"))
        starts = (F.when(F.col("_ll_l") == 0, F.array(F.lit(0)))
                  .when(F.size("_ll_w") >= F.col("_ll_l"),
                        F.sequence(F.lit(1), F.size("_ll_w") - F.col("_ll_l") + 1)))
        w = w.select("*", F.explode_outer(starts).alias("_ll_at")).where("_ll_at IS NOT NULL")
        here = F.slice("_ll_w", F.col("_ll_at"), F.col("_ll_l"))
        w = w.withColumn("_ll_h", F.when(F.col("_ll_l") == 0, F.lit(0).cast("long"))
                         .otherwise(F.xxhash64(F.slice("_ll_w", F.greatest("_ll_at", F.lit(1)), F.col("_ll_l")))))
        same = (F.col("_ll_l") == 0) | (F.slice("_ll_w", F.greatest("_ll_at", F.lit(1)), F.col("_ll_l")) == F.col("_ll_win"))
        hits = (w.join(F.broadcast(side), (F.col("_ll_h") == F.col("_ll_hash"))
                       & (F.col("_ll_l") == F.col("_ll_len")) & same)
                .select("_ll_id", "_ll_key", F.size("_ll_w").alias("_ll_n"), "_ll_at", "_ll_len", "_ll_wid"))
        found = hits if found is None else found.unionByName(hits)

    start = F.col("_ll_at").cast("int") - 1
    per = found.groupBy("_ll_id", "_ll_key").agg(
        F.max("_ll_n").alias("n_words"), F.count_if(F.col("_ll_len") == 0).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("_ll_len") > 0, F.struct(
            start.alias("start"), (start + F.col("_ll_len")).alias("end"))))).alias("spans"),
        F.collect_set("_ll_wid").alias("wids"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct(
        F.greatest(a["end"], x["end"]).alias("end"),
        (a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("hit")),
        lambda a: a["hit"])
    return per.select("_ll_id", "_ll_key", "copies", F.col("n_words").cast("long").alias("n_words"),
                      "spans", covered.alias("n_hit"), "wids")


def contamination(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Hits of benchmark windows in documents, one row per distinct
    (document id, text): ``id_col``, ``_ll_key`` (hash of the text),
    ``copies`` (rows with that id and text), ``n_words``, ``spans`` (verified
    windows as (start word from 0, end word exclusive), sorted), ``n_hit``
    (words inside any of them) and ``items`` (ids of the items, as strings,
    sorted).

    Defined cases: null and empty texts have no words and no hits; items
    without words have no window; an item without id still makes words hit
    but is not listed; repeated items and rows change nothing but ``copies``;
    an empty benchmark hits nothing; a text of any length is scanned whole.
    """
    wins, links = benchmark_windows(bench, n, text_col="text")
    per = kept(window_hits(docs, wins, id_col, text_col))
    of = (per.where("n_hit > 0").select("_ll_id", "_ll_key", F.explode("wids").alias("_ll_wid"))
          .join(links, "_ll_wid").select("_ll_id", "_ll_key", "_ll_item").distinct())
    # the items of a document meet its row in one grouping, which takes a null id as a value
    same = per.drop("wids").withColumn("_ll_item", F.lit(None).cast("string")).unionByName(
        of, allowMissingColumns=True)
    own = ("copies", "n_words", "spans", "n_hit")
    out = same.groupBy("_ll_id", "_ll_key").agg(*[F.max(c).alias(c) for c in own],
                                                F.array_sort(F.collect_set("_ll_item")).alias("items"))
    return out.select(F.col("_ll_id").alias(id_col), "_ll_key", *own, "items")


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, action: str = "document",
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns) without what the benchmark contains.

    ``action="document"`` drops each document with a verified hit;
    ``action="span"`` keeps it without the hit words (what separated them
    stays). Cases are defined as in :func:`contamination`; clean rows are
    returned untouched, repeated rows as often as they came.
    """
    wins, _ = benchmark_windows(bench, n, text_col="text")
    hit = window_hits(docs, wins, id_col, text_col).where("n_hit > 0").select(
        "_ll_id", F.col("_ll_key").alias("_ll_hit_key"), F.col("spans").alias("_ll_spans"))
    same = F.col(id_col).eqNullSafe(F.col("_ll_id")) & (F.xxhash64(text_col) == F.col("_ll_hit_key"))
    if action == "document":
        return docs.join(small_side(hit.drop("_ll_spans")), same, "left_anti")
    if action != "span":
        raise ValueError(f"action: document or span, not {action!r}")
    raw = F.regexp_extract_all(text_col, F.lit(RAW_WORD), F.lit(0))
    gaps = F.split(text_col, RAW_WORD, -1)
    rest = F.concat(F.element_at(gaps, 1), F.array_join(F.transform(raw, lambda w, i: F.concat(
        F.when(F.exists("_ll_spans", lambda s: (s["start"] <= i) & (i < s["end"])), F.lit("")).otherwise(w),
        F.element_at(gaps, i + 2))), ""))
    return (docs.join(hit, same, "left")
            .withColumn(text_col, F.when(F.col("_ll_spans").isNull(), F.col(text_col)).otherwise(rest))
            .select(*docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """One row per document row, from :func:`contamination`."""
    one = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return found.select("*", one.alias("_ll_copy")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM wins),
spots AS (
  SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, lens WHERE len(w) >= l),
hits AS (
  SELECT doc_id, p, s.l, item_id FROM spots s JOIN wins ON wins.l = s.l AND wins.win = array_to_string(w[p:p + s.l - 1], ' ')),
n_hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(p, p + l)) AS at FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
