"""URL rules, and a character language-model ratio for the rest (operator 10).

DataFrame functions only. A rule ``host/path`` fits its host and all subdomains
where the URL's path starts with the rule's path; the longest rule that fits
decides. The URLs that rules allow and block train two Markov models of variable
order over characters: the probability of a character is the Witten-Bell mixture
of its relative frequencies after the last ``ORDER``, ..., 1, 0 characters and the
uniform distribution. A URL without a rule is judged by the difference of its two
log-likelihoods per character against a cut that is calibrated on a quarter of the
ruled URLs, held out of the counts: midway between the two classes' means.

Counts are summed per string before any join; a string's contexts are the
characters it can be followed by, so no group grows with the table.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and is judged by the method; if rules leave one class without URLs the
method allows all; repeated rows are judged each; an empty table gives no rows;
columns other than id and URL are never looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlake.llm.storage import written

#: Fixed rules of the query: verdict, host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))

ORDER = 4
#: Characters assumed for the uniform distribution below order zero.
ALPHABET = 256
#: Ruled URLs whose MD5 starts with one of these digits, a quarter, calibrate the cut.
CALIBRATION_DIGITS = ("0", "1", "2", "3")

_START, _END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple:
    """Column expressions of a URL's host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _fits(rule: str, host, path):
    rule_host, rule_path = rule[:rule.index("/")], rule[rule.index("/"):]
    return (((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path))


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """id and url with host, path, and the longest rule that fits with its verdict."""
    host, path = host_and_path(F.col("url"))
    named = urls.withColumns({"host": host, "path": path})
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def chosen(value):
        return reduce(lambda rest, r: F.when(_fits(r[1], F.col("host"), F.col("path")), value(r)).otherwise(rest),
                      reversed(longest), F.lit(None).cast("string"))

    return named.withColumns({"rule": chosen(lambda r: F.lit(r[1])), "ruled": chosen(lambda r: F.lit(r[0]))})


def _strings(rows: DataFrame, order: int) -> DataFrame:
    """One row per character of each URL, and its end: the character with its context."""
    padded = F.concat(F.lit(_START * order), F.coalesce("url", F.lit("")), F.lit(_END))
    return rows.withColumn("padded", padded).select(
        "*", F.explode(F.transform(F.sequence(F.lit(1), F.length("padded") - order),
                                   lambda i: F.substring(F.col("padded"), i, F.lit(order + 1))))
        .alias("string")).drop("padded")


def log_ratios(strings: DataFrame, order: int = ORDER) -> DataFrame:
    """Per distinct string, log P(last character | context) of the accepted minus the
    rejected model. strings: string, accepted, rejected (how often each class has it)."""
    total = strings.groupBy("string").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    levels = [total]
    for k in range(order - 1, -1, -1):
        levels.append(levels[-1].groupBy(F.expr(f"right(string, {k + 1})").alias("string"))
                      .agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    lower = None
    for k, level in enumerate(reversed(levels)):
        same = W.partitionBy(F.expr(f"left(string, {k})")) if k else None
        if k:
            sums = {f"n_{c}": F.sum(c).over(same) for c in ("accepted", "rejected")}
            sums |= {f"t_{c}": F.sum((F.col(c) > 0).cast("long")).over(same) for c in ("accepted", "rejected")}
            rows = level.withColumns(sums).join(
                lower.select(F.col("string").alias("shorter"), "p_accepted", "p_rejected"),
                F.expr(f"right(string, {k})") == F.col("shorter"))
        else:       # at most a row per character there is
            one = level.agg(*(F.sum(c).alias(f"n_{c}") for c in ("accepted", "rejected")),
                            *(F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}")
                              for c in ("accepted", "rejected"))).first()
            rows = level.withColumns({n: F.lit(one[n] or 0) for n in
                                      ("n_accepted", "n_rejected", "t_accepted", "t_rejected")}
                                     | {f"p_{c}": F.lit(1.0 / ALPHABET) for c in ("accepted", "rejected")})
        lower = rows.select("string", *(
            F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}"))
                   / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"p_{c}")).alias(f"p_{c}")
            for c in ("accepted", "rejected")))
    return lower.select("string", (F.ln("p_accepted") - F.ln("p_rejected")).alias("ratio"))


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               order: int = ORDER) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the method's score."""
    rows = with_rules(pages.select(F.col(id_col).cast("long").alias("page_id"),
                                   F.col(url_col).cast("string").alias("url")), rules)
    # Equal URLs are scored once.
    urls = rows.groupBy("url", "ruled").agg(F.count("*").alias("n"))
    calibrates = F.col("ruled").isNotNull() & (
        F.md5("url").substr(1, 1).isin(*CALIBRATION_DIGITS))
    urls = urls.withColumn("calibrates", F.coalesce(calibrates, F.lit(False)))
    single = _strings(urls, order)
    learnt = F.when(F.col("calibrates"), 0).otherwise(F.col("n"))
    strings = single.select("string", F.when(F.col("ruled") == "allow", learnt).otherwise(0).alias("accepted"),
                            F.when(F.col("ruled") == "block", learnt).otherwise(0).alias("rejected"))
    ratios = written(log_ratios(strings, order), "url-strings")
    scores = written(single.join(ratios, "string").groupBy("url")
                     .agg(F.avg("ratio").alias("score"), F.first("ruled").alias("ruled"),
                          F.first("calibrates").alias("calibrates")), "url-scores")
    means = {r["ruled"]: r["m"] for r in
             scores.where("calibrates").groupBy("ruled").agg(F.avg("score").alias("m")).collect()}
    cut = (means["allow"] + means["block"]) / 2 if len(means) == 2 else None
    own = F.lit("allow") if cut is None else F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    return (rows.join(scores.select(F.col("url").alias("scored"), "score"),
                      F.col("url").eqNullSafe(F.col("scored")), "left")
            .select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"),
                    F.round("score", 6).alias("score")))


def oracle_sql(rules=RULES, order: int = ORDER) -> str:
    """DuckDB SQL for ``judge_urls`` over ``pages``."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> str:
        host, path = rule[:rule.index("/")], rule[rule.index("/"):]
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest)
    digits = ", ".join(f"'{d}'" for d in CALIBRATION_DIGITS)
    counts, mixed = [], []
    for k in range(order - 1, -1, -1):
        counts.append(f"""c{k} AS (SELECT right(string, {k + 1}) AS string, sum(a) AS a, sum(r) AS r
  FROM c{k + 1} GROUP BY 1)""")
    for k in range(order + 1):
        over = f"OVER (PARTITION BY left(string, {k}))" if k else "OVER ()"
        lower = (f"JOIN p{k - 1} q ON right(x.string, {k}) = q.string" if k
                 else f"CROSS JOIN (SELECT 1.0::DOUBLE / {ALPHABET} AS pa, 1.0::DOUBLE / {ALPHABET} AS pr) q")
        one = ", ".join(f"CASE WHEN n{c} > 0 THEN ({c}::DOUBLE + t{c}::DOUBLE * q.p{c}) / (n{c} + t{c})::DOUBLE "
                        f"ELSE q.p{c} END AS p{c}" for c in "ar")
        mixed.append(f"""p{k} AS (SELECT x.string, {one} FROM (
  SELECT *, sum(a) {over} AS na, sum(r) {over} AS nr, count(*) FILTER (WHERE a > 0) {over} AS ta,
         count(*) FILTER (WHERE r > 0) {over} AS tr FROM c{k}) x {lower})""")
    return f"""
WITH split AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages), named AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
judged AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM named),
urls AS (SELECT url, ruled, count(*) AS n,
         coalesce(ruled IS NOT NULL AND substr(md5(url), 1, 1) IN ({digits}), false) AS calibrates
  FROM judged GROUP BY url, ruled),
single AS (SELECT *, unnest(list_transform(range(1, length(padded) - {order} + 1),
                                           lambda i: substr(padded, i, {order + 1}))) AS string
  FROM (SELECT *, repeat(chr(2), {order}) || coalesce(url, '') || chr(3) AS padded FROM urls)),
c{order} AS (SELECT string, sum(CASE WHEN ruled = 'allow' AND NOT calibrates THEN n ELSE 0 END) AS a,
         sum(CASE WHEN ruled = 'block' AND NOT calibrates THEN n ELSE 0 END) AS r FROM single GROUP BY string),
{", ".join(counts)},
{", ".join(mixed)},
scores AS (SELECT url, any_value(ruled) AS ruled, any_value(calibrates) AS calibrates,
         avg(ln(pa) - ln(pr)) AS score FROM single JOIN p{order} USING (string) GROUP BY url),
cut AS (SELECT CASE WHEN count(DISTINCT ruled) = 2 THEN (avg(score) FILTER (WHERE ruled = 'allow')
         + avg(score) FILTER (WHERE ruled = 'block')) / 2 END AS cut FROM scores WHERE calibrates)
SELECT page_id, host, path, rule, coalesce(judged.ruled,
         CASE WHEN cut IS NULL OR score >= cut THEN 'allow' ELSE 'block' END) AS verdict,
       round(score, 6) AS score
FROM judged JOIN scores ON judged.url IS NOT DISTINCT FROM scores.url CROSS JOIN cut"""
