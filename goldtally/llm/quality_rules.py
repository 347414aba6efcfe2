"""Operator 9: host-level quality rules, in DataFrame functions only.

Per document, the rules' measures are taken inside the row.  Per host (the
``source`` column) rule failures are counted, and the failure rate is shrunk
towards the corpus with an empirical beta prior: the prior's mean and weight
come from the hosts' own rates by moments.  A host whose shrunk rate reaches
``HOST_RATE`` is rejected, and that verdict is joined back: a document of a
rejected host must also pass the soft rules, so that its clean documents stay.

Base rule: under 10 words, or over 20 % of the words in 5-word windows that
repeat.  Soft rules: mean word length outside 2 to 14 characters, more than
one symbol for ten words, or more than 30 % of the lines copies of earlier ones.

Defined cases: a null text has no words (base rule fails); null hosts make one
host of their own; repeated rows count as rows; an empty table gives an empty
result; other columns are kept out of the result and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table

HOST_RATE = 0.5
#: Rejected hosts up to this number are broadcast (a host name and no more); beyond it the join shuffles.
BROADCAST_HOSTS = 10_000

_BLANK = " \t\n\u000b\f\r"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words within 5-word windows whose five words occur twice or more."""

    def covered(starts):
        gaps = F.transform(starts, lambda at, k: F.least(F.lit(5), F.coalesce(F.get(starts, k + 1) - at, F.lit(5))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def marked(ordered):
        def start(window, k):
            twin = [F.coalesce(F.get(ordered, k + d)["h"] == window["h"], F.lit(False)) for d in (-1, 1)]
            return F.when(twin[0] | twin[1], window["i"])

        return F.array_sort(F.filter(F.transform(ordered, start), lambda i: i.isNotNull()))

    def of_hashes(hashes):
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, lambda o: _let(marked(o), covered)))

    def of_words(ws):
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 5), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(5))))
        return F.when(F.size(ws) < 6, F.lit(0)).otherwise(_let(windows, of_hashes))

    return _let(words, of_words)


def measures(text: Column) -> Column:
    """One struct with the measures of a text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(ws):
        ws = F.filter(ws, lambda w: w != "")
        return _let(ws, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words")))

    def of_lines(ls):
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANK)) != "")
    return F.struct(_let(F.split(text, "[\\x20\\x09-\\x0D]+"), of_words).alias("w"), _let(lines, of_lines).alias("l"),
                    F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))


def _flags(df: DataFrame, name: str) -> DataFrame:
    """``name``: one struct with the measures and both verdicts that need no host."""
    m = F.col(name)
    n, l = m["w"]["n_words"], m["l"]
    base = (n < 10) | (100 * m["w"]["n_repeat_words"] > 20 * n)
    soft = ((m["w"]["word_chars"] < 2 * n) | (m["w"]["word_chars"] > 14 * n) | (10 * m["n_symbols"] > n) | (10 * l["n_dup_lines"] > 3 * l["n_lines"]))
    return df.withColumn(name, F.struct(
        n.alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), l["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"), base.alias("base_failed"), soft.alias("soft_failed")))


def rejected_hosts(flagged: DataFrame, name: str, host_col: str, host_rate: float = HOST_RATE) -> DataFrame:
    """Hosts whose failure rate, shrunk by an empirical beta prior, reaches ``host_rate``."""
    hosts = flagged.groupBy(host_col).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(name)["base_failed"].cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if mean is None:
        return hosts.select(host_col)
    # moments of a beta distribution; with no spread between hosts the prior outweighs any host
    weight = max(1.0, mean * (1 - mean) / var - 1) if var else 1e9
    shrunk = (F.col("f") + mean * weight) / (F.col("n") + weight)
    return hosts.filter(shrunk >= host_rate).select(host_col)


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: list[str] | None = None,
           host_rate: float = HOST_RATE) -> tuple[DataFrame, str]:
    """``docs`` (columns ``keep`` or all) with one struct column of measures and verdicts, and that column's name."""
    keep = keep or docs.columns
    name, host, bad = (free_name(c, docs.columns) for c in ("_quality", "_host", "_bad"))
    measured = docs.withColumn(name, measures(F.col(text_col))).select(*dict.fromkeys([*keep, host_col]), name)
    flagged = stored(_flags(measured, name), "quality")
    hosts = rejected_hosts(flagged, name, host_col, host_rate)
    hosts = stored(hosts.select(F.col(host_col).alias(host), F.lit(True).alias(bad)), "hosts")
    few = hosts.count() <= BROADCAST_HOSTS
    joined = flagged.join(F.broadcast(hosts) if few else hosts, F.col(host_col).eqNullSafe(F.col(host)), "left")
    host_bad = F.coalesce(F.col(bad), F.lit(False))
    q = F.col(name)
    out = joined.withColumn(name, q.withField("host_rejected", host_bad).withField("kept", ~q["base_failed"] & ~(host_bad & q["soft_failed"])))
    return out.select(*keep, name), name


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    q = F.col(name)
    return out.select("doc_id", *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")))


def quality_ctes(docs: str, prefix: str = "q") -> str:
    """DuckDB CTEs that judge the rows of ``docs`` (unique doc_id): ``{prefix}_judged`` has the result."""
    p = prefix
    return f"""
{p}_words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM {docs}),
{p}_windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, w[i] || chr(9) || w[i+1] || chr(9) || w[i+2] || chr(9) || w[i+3] || chr(9) || w[i+4] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM {p}_words))),
{p}_repeats AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM {p}_windows WHERE c > 1) GROUP BY doc_id),
{p}_measures AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM {p}_words LEFT JOIN {p}_repeats USING (doc_id)),
{p}_flags AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines AS soft_failed
  FROM {p}_measures),
{p}_hosts AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM {p}_flags GROUP BY source),
{p}_prior AS (SELECT avg(f / n) AS m, CASE WHEN var_pop(f / n) > 0 THEN greatest(1.0, avg(f / n) * (1 - avg(f / n)) / var_pop(f / n) - 1) ELSE 1e9 END AS k FROM {p}_hosts),
{p}_bad AS (SELECT source, (f + m * k) / (n + k) >= {HOST_RATE} AS host_rejected FROM {p}_hosts, {p}_prior),
{p}_judged AS (
  SELECT x.*, host_rejected, NOT base_failed AND NOT (host_rejected AND soft_failed) AS kept
  FROM {p}_flags x JOIN {p}_bad b ON x.source IS NOT DISTINCT FROM b.source)"""


SQL = f"WITH {quality_ctes('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rejected FROM q_judged"
