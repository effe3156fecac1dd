"""Secret scans through a trigram inverted index.

1. Each rule's regex is turned into a Boolean trigram query: which strings
   must occur in any match (an OR of alternatives, each an AND of trigrams).
2. The inverted index lists, for every trigram some rule asks for, the
   documents that contain it (letters folded): (trigram, document) postings.
3. The postings of each alternative's trigrams are intersected; a document
   in all of them is a candidate for the rule.
4. Candidates are verified with the regex itself, on the whole text. Rules
   without a mandatory trigram scan every text in the same pass.

All of it is SQL expressions. Postings and candidates are narrow rows keyed by
document id; the candidate list is broadcast only up to a checked number of
rows, and joined by a shuffle beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, table


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base kinds. A run of at least m characters of a
#: class is the same as a maximal run of them that has m or more.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
BASE = ("assign", "access", "hex")

MOST_STRINGS = 256     # alternatives one clause may have before it is cut
MOST_ALTERNATIVES = 64


def _one(op, arg) -> tuple[set[str] | None, list[set[str]]]:
    """(strings this element can match if they are few, else None; clauses
    that any match of it fulfils)."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, []
    if op is sre.AT:
        return {""}, []
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, []
        return (out, []) if len(out) <= 8 else (None, [])
    if op is sre.SUBPATTERN:
        return _all(arg[-1])
    if op is sre.BRANCH:
        each = [_all(x) for x in arg[1]]
        if all(strings is not None for strings, _ in each):
            return set().union(*[strings for strings, _ in each]), []
        best = [strings if strings is not None else max(clauses, key=lambda c: min(map(len, c)), default=None)
                for strings, clauses in each]
        return None, ([set().union(*best)] if all(best) else [])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, clauses = _all(inner)
        if low == 0:
            return ({"", *strings}, []) if strings is not None and high == 1 else (None, [])
        if strings is not None:
            return (strings, []) if low == high == 1 else (None, [strings])
        return None, clauses
    return None, []


def _all(parts) -> tuple[set[str] | None, list[set[str]]]:
    run, clauses, whole = {""}, [], True
    for op, arg in parts:
        strings, inner = _one(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        clauses += [run, *inner]
        run, whole = strings if strings is not None else {""}, False
    return (run, []) if whole else (None, [*clauses, run])


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each the trigrams (of the folded text) that must all
    occur; empty if the regex has no mandatory trigram."""
    strings, clauses = _all(_parser.parse(pattern))
    out = [frozenset()]
    for clause in [strings] if strings is not None else clauses:
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in clause}
        if not all(sets):
            continue           # some alternative is too short to ask for
        sets = {x for x in sets if not any(y < x for y in sets)}
        if len(out) * len(sets) <= MOST_ALTERNATIVES:
            out = [a | b for a in out for b in sets]
    return sorted((x for x in out if x), key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Postings (_ll_tri, _ll_id) of the given trigrams."""
    folded = docs.select(F.col(id_col).alias("_ll_id"), F.lower(text_col).alias("_ll_low"))
    has = F.array_compact(F.array(*[F.when(F.contains("_ll_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select("_ll_id", F.explode(has).alias("_ll_tri"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Intersect postings: (_ll_id, _ll_rules), the rules whose trigram query
    a document fulfils. An alternative asks for 62 trigrams at most."""
    asked = [(t, kind, n, 1 << bit, (1 << min(62, len(alt))) - 1)
             for kind, alts in queries.items() for n, alt in enumerate(alts)
             for bit, t in enumerate(sorted(alt)[:62])]
    terms = index.sparkSession.createDataFrame(
        asked, "_ll_tri string, _ll_rule string, _ll_alt int, _ll_bit long, _ll_full long")
    return (index.join(F.broadcast(terms), "_ll_tri")          # a row per term of the rules
            .groupBy("_ll_id", "_ll_rule", "_ll_alt", "_ll_full").agg(F.bit_or("_ll_bit").alias("_ll_bits"))
            .where("_ll_bits = _ll_full")
            .groupBy("_ll_id").agg(F.collect_set("_ll_rule").alias("_ll_rules")))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Verified matches as (start, order, end, kind), in code points: matches
    and the pieces between them, laid end to end."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a, i):
        start = a["at"] + F.char_length(F.element_at(between, i))
        end = start + F.char_length(F.element_at(found, i))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"),
                        F.lit(rule.kind).alias("kind"))
        keep = F.char_length(F.element_at(value, i)) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(a["out"], F.array(span)))
                        .otherwise(a["out"]).alias("out"))
    laid = F.aggregate(F.sequence(F.lit(1), F.size(found)), first, step, lambda a: a["out"])
    return F.when(F.rlike(text, F.lit(rule.pattern)), laid).otherwise(none)


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Secrets of every document: ``id_col`` and ``spans``, an array of
    (start, ord, end, kind) by start, then rule order; offsets count code
    points, end exclusive.

    Defined cases: null texts count as empty and have no span; rows with a
    null or repeated id are scanned each on their own text (the index may
    offer more candidates, never fewer); empty tables give no rows.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    rows = docs.select(F.col(id_col).alias("_ll_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_ll_text"))
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    if queries:
        asked = sorted({t for alts in queries.values() for alt in alts for t in alt})
        hits = small_side(candidates(trigram_index(docs, asked, id_col, text_col), queries)
                          .withColumnRenamed("_ll_id", "_ll_hit"))
        rows = rows.join(hits, F.col("_ll_id").eqNullSafe(F.col("_ll_hit")), "left")
    else:
        rows = rows.withColumn("_ll_rules", F.expr("cast(null as array<string>)"))

    def of(order, rule):
        spans = _spans(F.col("_ll_text"), rule, order)
        if rule.kind not in queries:
            return spans
        return F.when(F.array_contains("_ll_rules", rule.kind), spans).otherwise(none)
    spans = F.array_sort(F.concat(*[of(i, r) for i, r in enumerate(rules)]))
    return rows.select(F.col("_ll_id").alias(id_col), spans.alias("spans"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return digest(scan(table(spark, sf_dir, "documents")))


def digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                     for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    base = {"assign": rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
            "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
            "github": "gh[oprsu]_[A-Za-z0-9]{36,}", "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
            "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----"}
    least = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24)}
    parts = []
    for order, (kind, p) in enumerate(base.items()):
        group, n = least.get(kind, (0, 1))
        parts.append(f"""
  SELECT doc_id, '{kind}' AS kind, {order} AS ord, v, {n} AS least, m,
    sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS fin
  FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[:len(ms)]) AS gap
    FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {group}) AS vs,
      regexp_split_to_array(text, '{p}') AS gaps FROM documents WHERE regexp_matches(text, '{p}')))""")
    return f"""
WITH spans AS (SELECT doc_id, kind, ord, (fin - length(m))::BIGINT AS s, fin::BIGINT AS e
  FROM ({' UNION ALL '.join(parts)}) WHERE length(v) >= least),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""


ORACLE = _oracle()
