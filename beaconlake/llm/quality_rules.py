"""Host-level quality rules, in DataFrame functions only.

Each text gets counts (words, symbols, repeated lines, words in repeated windows) and is held
against a list of rules. Failures are added up by host; a host's rate of failing a rule is shrunk
towards the rate over all hosts with a beta prior whose strength comes from the spread of the hosts'
own rates. Verdicts rest on the posterior's lower bound (its mean less ``CERTAIN`` standard deviations),
held against the rate of all other hosts, so that a host is not measured by itself:

* A host is rejected, and so are all its documents, if the bound of any rule is above ``TIMES`` times the
  others' rate, but at least above ``LEAST_RATE`` and no more than ``MOST_RATE`` need be exceeded.
* A host is suspect in a rule if the bound is above the others' rate. There, documents that fail the rule go;
  elsewhere, failing a rule beyond the base rules is no reason to go.

Verdicts join back to documents by host. Documents that fail a base rule always go.

Defined cases: a null or blank text has no words and fails ``short``; null hosts are one host of
their own; a single host is held against a rate of 0 of the others; repeated rows count as often as they occur; an
empty table gives an empty result; input columns of any name are left alone by :func:`keep_good` and left out by
:func:`quality`, but for those it is told to carry. Windows are told apart by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import SPACE_CHARS, let, materialize, of, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Each rule is true for a text that fails it.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeats")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Standard deviations below a posterior's mean; multiples of the others' rate; and bounds on what must be exceeded.
CERTAIN, TIMES, LEAST_RATE, MOST_RATE = 1.645, 3.0, 0.25, 0.5
#: Pseudo-documents of the prior: the least, the most, and those where hosts do not differ at all.
PRIOR_LEAST, PRIOR_MOST = 10.0, 1000.0
#: Up to so many rejected or suspect hosts are sent to every executor; more go through a shuffled join.
BROADCAST_HOSTS = 10_000


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more: sorts (hash, place) and looks at neighbours."""
    sort = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda i: (F.get(s, i - 1)["h"] == F.get(s, i)["h"]) | (F.get(s, i + 1)["h"] == F.get(s, i)["h"])
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), same), lambda i: F.get(s, i)["i"]))

    def total(p: Column) -> Column:
        step = lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW)))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), step)

    return let(let(sort, places), total)


def counted(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows has doc, the input's row. Adds quality: a struct of the counts and of the rules each text fails."""
    body = F.coalesce(of(text).cast("string"), F.lit(""))
    step = rows.select(
        "*",
        words_of(of(text).cast("string")).alias("words"),
        F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("symbols"),
    )
    window = lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(WINDOW)))
    step = step.withColumn(
        "windows",
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), window)),
    )
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    counts = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("symbols").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(again, _covered(F.col("windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    step = step.select(*rows.columns, counts.alias("quality"))
    fails = [F.expr(rule_on(rule)).alias(f"fails_{name}") for name, rule in RULES.items()]
    return step.withColumn("quality", F.struct("quality.*", *fails))


def rule_on(rule: str) -> str:
    for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"):
        rule = rule.replace(name, f"quality.{name}")
    return rule


def host_rates(scored: DataFrame) -> DataFrame:
    """One row per host: host, n (documents), and for each rule f_ (failures), rate_ (the posterior's mean), low_
    (its lower bound) and others_ (the rate of all other hosts).

    The prior of a rule has the mean of all documents; its strength follows from the variance of the
    hosts' rates (method of moments). Only a few sums a rule come to the driver.
    """
    names = list(RULES)
    hosts = scored.groupBy("host").agg(
        F.count("*").alias("n"), *(F.sum(F.col(f"quality.fails_{r}").cast("long")).alias(f"f_{r}") for r in names)
    )
    hosts = materialize(hosts, "hosts")
    prior = hosts.agg(
        *(F.sum(f"f_{r}").alias(f"f_{r}") for r in names),
        F.sum("n").alias("n"),
        *(F.var_pop(F.col(f"f_{r}") / F.col("n")).alias(f"v_{r}") for r in names),
    ).first()
    total = prior["n"] or 0
    for r in names:
        failed = prior[f"f_{r}"] or 0
        mean, spread = failed / max(total, 1), prior[f"v_{r}"] or 0.0
        strength = min(max(mean * (1 - mean) / spread - 1, PRIOR_LEAST), PRIOR_MOST) if spread > 0 else PRIOR_MOST
        rate = (F.col(f"f_{r}") + mean * strength) / (F.col("n") + strength)
        hosts = hosts.withColumn(f"rate_{r}", rate)
        deviation = F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (F.col("n") + strength + 1))
        hosts = hosts.withColumn(f"low_{r}", F.col(f"rate_{r}") - CERTAIN * deviation)
        rest = F.lit(float(total)) - F.col("n")
        hosts = hosts.withColumn(f"others_{r}", F.when(rest > 0, (F.lit(float(failed)) - F.col(f"f_{r}")) / rest).otherwise(0.0))
    return hosts


def verdicts(rates: DataFrame) -> DataFrame:
    """Hosts that lose documents: host, host_rejected, and suspect_ for each rule."""
    limit = lambda r: F.least(F.lit(MOST_RATE), F.greatest(F.lit(LEAST_RATE), TIMES * F.col(f"others_{r}")))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(f"low_{r}") > limit(r))
    suspect = {r: F.col(f"low_{r}") > F.col(f"others_{r}") for r in RULES}
    told = rates.select("host", rejected.alias("host_rejected"), *(c.alias(f"suspect_{r}") for r, c in suspect.items()))
    return told.filter(F.col("host_rejected") | F.greatest(*(F.col(f"suspect_{r}") for r in RULES)))


def judged(scored: DataFrame) -> DataFrame:
    """scored (with host and quality) and host_rejected and kept; scored must be cheap to read twice."""
    bad = materialize(verdicts(host_rates(scored)).withColumnRenamed("host", "bad_host"), "bad-hosts")
    few = F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad
    out = scored.join(few, scored["host"].eqNullSafe(few["bad_host"]), "left")
    failed = F.greatest(*(F.col(f"quality.fails_{r}") for r in BASE))
    at_suspect = F.greatest(*(F.coalesce(F.col(f"suspect_{r}"), F.lit(False)) & F.col(f"quality.fails_{r}") for r in RULES))
    rejected = F.coalesce("host_rejected", F.lit(False))
    return out.select(*scored.columns, failed.alias("base_failed"), rejected.alias("host_rejected"), (~failed & ~rejected & ~at_suspect).alias("kept"))


def quality(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", host: str = "source") -> DataFrame:
    """Per row: the carried columns, the counts, base_failed, host_rejected and kept. A carried column that has the name
    of a result is left out."""
    outs = [*COUNTS, "n_lines", "base_failed", "host_rejected", "kept"]
    narrow = docs.select(F.struct(*dict.fromkeys([*carry, text, host])).alias("doc"))
    scored = counted(narrow, text).select(
        F.struct(*([of(c).alias(c) for c in carry] or [F.lit(0)])).alias("carried"), of(host).alias("host"), "quality"
    )
    out = judged(materialize(scored, "quality"))
    return out.select(
        *(of(c, "carried").alias(c) for c in carry if c.lower() not in outs), *(F.col(f"quality.{c}").alias(c) for c in [*COUNTS, "n_lines"]),
        "base_failed", "host_rejected", "kept",
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that pass, with the columns of docs. Rows are written once with their counts, as verdicts need all
    of them first; the other way, to join verdicts to the rows, would shuffle whole texts."""
    rows = docs.select(F.struct("*").alias("doc"))
    scored = counted(rows, text).select("doc", of(host).alias("host"), "quality")
    return judged(materialize(scored, "quality")).filter("kept").select("doc.*")


#: The counts and verdicts in DuckDB's SQL, word by word. What stands in braces are the parameters above.
SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] || chr(10) || w[i+3] || chr(10) || w[i+4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
c AS (
  SELECT t.doc_id, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
f AS (
  SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2,
         10 * n_symbols > word_chars AS f3, 10 * n_dup_lines > 3 * n_lines AS f4 FROM c),
h AS (
  SELECT source AS host, count(*) AS n, unnest([1, 2, 3, 4]) AS rule,
         unnest([sum(f1::INT), sum(f2::INT), sum(f3::INT), sum(f4::INT)])::DOUBLE AS bad FROM f GROUP BY source),
p AS (SELECT rule, sum(bad) AS failed, sum(n) AS total, sum(bad) / sum(n) AS m, var_pop(bad / n) AS v FROM h GROUP BY rule),
s AS (
  SELECT rule, failed, total, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, {least}), {most}) ELSE {most} END AS k FROM p),
b AS (SELECT host, rule, n, k, (bad + m * k) / (n + k) AS rate,
             CASE WHEN total > n THEN (failed - bad) / (total - n) ELSE 0 END AS others FROM h JOIN s USING (rule)),
l AS (SELECT host, rule, others, rate - {certain} * sqrt(rate * (1 - rate) / (n + k + 1)) AS low FROM b),
r AS (SELECT host, bool_or(low > least({most_rate}, greatest({least_rate}, {times} * others))) AS rejected,
             bool_or(rule = 1 AND low > others) AS s1, bool_or(rule = 2 AND low > others) AS s2,
             bool_or(rule = 3 AND low > others) AS s3, bool_or(rule = 4 AND low > others) AS s4 FROM l GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
       f1 OR f2 AS base_failed, rejected AS host_rejected,
       NOT (f1 OR f2) AND NOT rejected AND NOT (f1 AND s1 OR f2 AND s2 OR f3 AND s3 OR f4 AND s4) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.host
"""
for _name, _value in {
    "least": PRIOR_LEAST, "most": PRIOR_MOST, "certain": CERTAIN, "times": TIMES, "least_rate": LEAST_RATE, "most_rate": MOST_RATE
}.items():
    SQL = SQL.replace("{" + _name + "}", str(_value))
