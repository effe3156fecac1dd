"""URL filters: rules, and empirical-Bayes host reputation for the rest.

Labelled page outcomes (bad or good) are counted per host. The bad rate of a
host has a beta-binomial prior from the other hosts of its registered domain,
those have one from the other domains of the public suffix, and those one from
the other suffixes, over the flat prior Beta(1/2, 1/2). The strength of each
prior comes from that level's own spread (method of moments for over-dispersed
proportions) and is never more than the evidence it stands on:

* no label counts twice: each prior leaves out what it is the prior of;
* labels of one child are alike, so on the way up ``n`` of them count as
  ``n * (k + 1) / (n + k)``, their effective number at strength ``k``;
* where no spread can be estimated (a single child, one outcome only) the
  strength is the smallest, not the largest.

A host is blocked if its bad rate exceeds ``max_bad`` with at least the normal
probability of ``z`` (1.64: 95 %) under its posterior, so neither a host
without evidence nor one with a bad page or two is blocked. The beta
distribution is taken by the cube-root normal approximation (Abramowitz and
Stegun 26.5.21); near the 5 % it is off by less than 0.01 for posteriors of
two and more pseudo-counts (asserted in a test).

Everything is DataFrame operations: one aggregation to hosts (map-side
combine: a hot host is a handful of partial rows), which is kept and read by
the tiny aggregations above it, and one join of pages with their host's
verdict. Only three prior strengths and two sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, few, table

#: (verdict, host, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Public suffixes of two labels; any other last label is a suffix itself.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn",
                      "com.mx", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]

STRENGTH_MIN, STRENGTH_MAX = 1.0, 10_000.0


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or no ``://``."""
    rest = F.expr("substring(_ll_url, locate('://', _ll_url) + 3)")
    host = ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    rest = F.expr("substring(_ll_url, locate('://', _ll_url) + 3)")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null if none."""
    def pick(value):
        return F.coalesce(*[
            F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(value(v, h, p)))
            for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))], F.lit(None).cast("string"))
    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


def registered_domain(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host, without user and port.
    A host of one label, or an IPv4 address, is its own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":[0-9]*\z", "")
    ip = bare.rlike(r"\A[0-9]+(\.[0-9]+){3}\z")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(TWO_LABEL_SUFFIXES)
    domain = F.when(ip, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    suffix = F.when(ip, bare).when(long, two).otherwise(F.substring_index(bare, ".", -1))
    return domain, suffix


def _strength(counts: DataFrame) -> float:
    """Beta prior strength from children's (n, bad): method of moments for
    over-dispersed proportions, kept within 1 and 10 000; 1 where the children
    do not show any spread to estimate it from."""
    r = counts.where("n > 0").agg(
        F.sum("n").alias("N"), F.sum("bad").alias("K"), F.count("*").alias("M"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("N2"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("KK")).first()
    if not r["N"] or r["M"] < 2 or r["K"] in (0, r["N"]):
        return STRENGTH_MIN
    mu = r["K"] / r["N"]
    spread, even = r["KK"] - r["K"] * mu, mu * (1 - mu)
    room = even * (r["N"] - r["N2"] / r["N"] - (r["M"] - 1))
    if room <= 0:
        return STRENGTH_MIN
    share = (spread - even * (r["M"] - 1)) / room
    if share <= 0:
        return STRENGTH_MAX
    return min(STRENGTH_MAX, max(STRENGTH_MIN, 1 / share - 1))


def _upwards(bad: Column, good: Column, k: float) -> tuple[Column, Column]:
    """A child's counts as their effective number at strength ``k``."""
    weight = F.lit(k + 1.0) / (bad + good + F.lit(k))
    return bad * weight, good * weight


def _others(whole: Column, own: Column) -> Column:
    """``whole`` without ``own``; sums of doubles may fall short of zero."""
    return F.greatest(whole - own, F.lit(0.0))


def _prior(a: Column, b: Column, k: float) -> tuple[Column, Column]:
    """Beta(a, b) weakened to strength ``k`` where it has more."""
    scale = F.least(F.lit(1.0), F.lit(k) / (a + b))
    return a * scale, b * scale


def within_z(a: Column, b: Column, rate: float) -> Column:
    """Normal quantile of the chance that a Beta(a, b) value is at most ``rate``."""
    u, v = F.cbrt(b * rate), F.cbrt(a * (1 - rate))
    return 3 * (u * (1 - 1 / (9 * b)) - v * (1 - 1 / (9 * a))) / F.sqrt(u * u / b + v * v / a)


def host_reputation(outcomes: DataFrame, max_bad: float = 0.3, z: float = 1.64) -> DataFrame:
    """``outcomes``: (host, bad: boolean, null if the page has no label).
    Returns (host, n, bad_rate posterior mean, within_z normal quantile of the
    chance that the rate is at most ``max_bad``, verdict), one row per host.

    Without any label every host has the flat prior and is allowed.
    """
    domain, suffix = registered_domain(F.col("host"))
    hosts = few(outcomes.groupBy("host")
                .agg(F.count("bad").alias("n"), F.count_if(F.col("bad")).alias("bad"))
                .withColumn("domain", domain).withColumn("suffix", suffix))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ks, kd, kh = (_strength(x) for x in (suffixes, domains, hosts))

    own_bad, own_good = F.col("bad").cast("double"), (F.col("n") - F.col("bad")).cast("double")
    hb, hg = _upwards(own_bad, own_good, kh)
    h = hosts.select("*", hb.alias("hb"), hg.alias("hg"))
    db, dg = _upwards(F.col("d_bad"), F.col("d_good"), kd)
    d = (h.groupBy("domain", "suffix").agg(F.sum("hb").alias("d_bad"), F.sum("hg").alias("d_good"))
         .select("*", db.alias("db"), dg.alias("dg")))
    sb, sg = _upwards(F.col("s_bad"), F.col("s_good"), ks)
    s = (d.groupBy("suffix").agg(F.sum("db").alias("s_bad"), F.sum("dg").alias("s_good"))
         .select("*", sb.alias("sb"), sg.alias("sg")))
    whole = s.agg(F.sum("sb").alias("bad"), F.sum("sg").alias("good")).first()

    a, b = _prior(_others(F.lit(float(whole["bad"] or 0)), F.col("sb")) + 0.5,
                  _others(F.lit(float(whole["good"] or 0)), F.col("sg")) + 0.5, ks)
    s = s.select("suffix", "s_bad", "s_good", a.alias("s_a"), b.alias("s_b"))
    a, b = _prior(F.col("s_a") + _others(F.col("s_bad"), F.col("db")),
                  F.col("s_b") + _others(F.col("s_good"), F.col("dg")), kd)
    d = d.join(s, "suffix").select("domain", "d_bad", "d_good", a.alias("d_a"), b.alias("d_b"))
    a, b = _prior(F.col("d_a") + _others(F.col("d_bad"), F.col("hb")),
                  F.col("d_b") + _others(F.col("d_good"), F.col("hg")), kh)
    a, b = a + own_bad, b + own_good
    return (h.join(d, "domain").select("host", "n", a.alias("a"), b.alias("b"))
            .select("host", "n", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"),
                    within_z(F.col("a"), F.col("b"), max_bad).alias("within_z"))
            .withColumn("verdict", F.when(F.col("within_z") < -z, "block").otherwise("allow")))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id",
               max_bad: float = 0.3, z: float = 1.64) -> DataFrame:
    """Verdict for every row of ``pages`` (``id_col``, ``url``).

    ``outcomes``: (``id_col``, bad boolean), the labelled pages. Returns
    ``id_col``, host, path, rule, verdict.

    Defined cases: a null url, or one without ``://``, has an empty host and
    path, fits no rule and is judged as the host ''; null ids never carry a
    label; a page with several labels counts as bad if any label says so;
    repeated pages count as evidence each; an empty table gives no rows.
    """
    marks = (outcomes.select(F.col(id_col).alias("_ll_id"), F.col("bad").alias("_ll_bad"))
             .where("_ll_id IS NOT NULL AND _ll_bad IS NOT NULL")
             .groupBy("_ll_id").agg(F.bool_or("_ll_bad").alias("bad")))
    parts = pages.select(F.col(id_col).alias("_ll_id"), F.col("url").alias("_ll_url")).select(
        "_ll_id", url_host(F.col("_ll_url")).alias("host"), url_path(F.col("_ll_url")).alias("path"))
    reputation = host_reputation(parts.join(marks, "_ll_id", "left").select("host", "bad"), max_bad, z)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (parts.join(reputation.select("host", F.col("verdict").alias("_ll_own")), "host", "left")
            .select(F.col("_ll_id").alias(id_col), "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.col("_ll_own")).alias("verdict")))


def op9_host_reputation(spark, sf_dir: str) -> DataFrame:
    """Verdict of every url of ``pages``; a page's outcome is bad if the
    ``labels`` row of its id is toxic or of quality 0."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), labels)


def oracle() -> str:
    """The same verdicts in DuckDB SQL."""
    rest = "substr(url, strpos(url, '://') + 3)"
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
            for _, h, p in rules]
    rule = "CASE " + " ".join(f + f"'{h}{p}'" for f, (_, h, p) in zip(fits, rules)) + " END"
    verdict = "CASE " + " ".join(f + f"'{v}'" for f, (v, _, _) in zip(fits, rules)) + " END"

    def strength(t):
        return f"""(SELECT CASE WHEN N IS NULL OR M < 2 OR K = 0 OR K = N OR room <= 0 THEN 1.0
            WHEN share <= 0 THEN 10000.0 ELSE least(10000.0, greatest(1.0, 1 / share - 1)) END FROM (
          SELECT *, (KK - K * K / N - K / N * (1 - K / N) * (M - 1)) / nullif(room, 0) AS share FROM (
            SELECT *, K / N * (1 - K / N) * (N - N2 / N - (M - 1)) AS room FROM (
              SELECT sum(n)::DOUBLE AS N, sum(bad)::DOUBLE AS K, count(*) AS M, sum(n::DOUBLE * n) AS N2,
                     sum(bad::DOUBLE * bad / n) AS KK FROM {t} WHERE n > 0))))"""
    return f"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
marks AS (
  SELECT doc_id AS page_id, bool_or(toxic = 1 OR quality = 0) AS bad FROM labels
  WHERE doc_id IS NOT NULL GROUP BY 1),
counted AS (
  SELECT host, count(bad) AS n, count(*) FILTER (bad) AS bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
  FROM parts LEFT JOIN marks USING (page_id) GROUP BY host),
labelled AS (
  SELECT *, array_to_string(string_split(bare, '.')[-2:], '.') AS two,
    regexp_matches(bare, '^[0-9]+(\\.[0-9]+){{3}}$') AS ip FROM counted),
hosts AS (
  SELECT host, n, bad,
    CASE WHEN ip THEN bare WHEN two IN ({two}) THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE two END AS domain,
    CASE WHEN ip THEN bare WHEN two IN ({two}) THEN two ELSE string_split(bare, '.')[-1] END AS suffix
  FROM labelled),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
priors AS (SELECT {strength('suffixes')}::DOUBLE AS ks, {strength('domains')}::DOUBLE AS kd,
  {strength('hosts')}::DOUBLE AS kh),
h AS (SELECT host, domain, suffix, bad, n - bad AS good, bad * (kh + 1) / (n + kh) AS hb,
  (n - bad) * (kh + 1) / (n + kh) AS hg FROM hosts, priors),
d AS (SELECT domain, suffix, d_bad, d_good, d_bad * (kd + 1) / (d_bad + d_good + kd) AS db,
    d_good * (kd + 1) / (d_bad + d_good + kd) AS dg
  FROM (SELECT domain, suffix, sum(hb) AS d_bad, sum(hg) AS d_good FROM h GROUP BY ALL), priors),
s AS (SELECT suffix, s_bad, s_good, s_bad * (ks + 1) / (s_bad + s_good + ks) AS sb,
    s_good * (ks + 1) / (s_bad + s_good + ks) AS sg
  FROM (SELECT suffix, sum(db) AS s_bad, sum(dg) AS s_good FROM d GROUP BY ALL), priors),
sp AS (SELECT *, greatest((SELECT sum(sb) FROM s) - sb, 0) + 0.5 AS a, greatest((SELECT sum(sg) FROM s) - sg, 0) + 0.5 AS b FROM s),
sq AS (SELECT suffix, s_bad, s_good, a * least(1, ks / (a + b)) AS sa, b * least(1, ks / (a + b)) AS sc FROM sp, priors),
dp AS (SELECT domain, d_bad, d_good, sa + greatest(s_bad - db, 0) AS a, sc + greatest(s_good - dg, 0) AS b FROM d JOIN sq USING (suffix)),
dq AS (SELECT domain, d_bad, d_good, a * least(1, kd / (a + b)) AS da, b * least(1, kd / (a + b)) AS dc FROM dp, priors),
hp AS (SELECT host, bad, good, da + greatest(d_bad - hb, 0) AS a, dc + greatest(d_good - hg, 0) AS b FROM h JOIN dq USING (domain)),
post AS (SELECT host, a * least(1, kh / (a + b)) + bad AS a, b * least(1, kh / (a + b)) + good AS b FROM hp, priors),
root AS (SELECT host, a, b, cbrt(b * 0.3::DOUBLE) AS u, cbrt(a * 0.7::DOUBLE) AS v FROM post),
own AS (SELECT host, CASE WHEN 3 * (u * (1 - 1 / (9 * b)) - v * (1 - 1 / (9 * a))) / sqrt(u * u / b + v * v / a) < -1.64
  THEN 'block' ELSE 'allow' END AS own FROM root)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, own) AS verdict
FROM parts LEFT JOIN own USING (host)
"""
