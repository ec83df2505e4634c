"""Quality rules judged by host.

Each document gets word and repetition counts and a base rule verdict.  Failures are summed by host, the hosts' failure
rates are shrunk towards the common rate with a beta prior whose strength comes from the spread between hosts (method
of moments), and hosts whose shrunk rate is above ``max_rate`` are rejected.  The verdict is joined back: a document
stays if it passes the base rule and its host is not rejected.

Defined results: null and empty texts have no words and fail (fewer than ``MIN_WORDS``); null hosts are one host;
repeated rows count each; very long texts are counted whole, one at a time; an empty table gives no rows; other columns,
whatever their names, pass through ``keep_good`` untouched.

Every text is counted once: rows are written with their counts, and the hosts' verdicts are joined to what was written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import column, join_small, scratch, whole_row

#: Fixed values of the base rule.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in windows of ``WINDOW`` words found at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) == len(words):
        return 0
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + row[i : i + n].astype(np.uint64)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, dtype=bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    windows = row[at[:, None] + np.arange(WINDOW)]  # equal hashes are checked word by word
    _, group, size = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[size[group.ravel()] > 1]
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space only
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    chars = sum(map(len, words)) - len(data) + len(data.decode("utf-8", "surrogatepass"))  # bytes less the continuation bytes, which words hold all of
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), dup, repeated_words(words)


def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    for texts in batches:
        yield pd.DataFrame([text_counts(x) for x in texts], columns=names, dtype="int64")


def rule_counts(text: Column) -> Column:
    """A struct of the counts of ``text``."""
    return F.pandas_udf(counted, COUNTS).asNondeterministic()(text)


def base_failed(counts: str = "counts") -> Column:
    n, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


def host_verdicts(failures: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row per host of (host, failed): n_docs, n_failed, shrunk_rate, host_rejected."""
    hosts = failures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    n, k = F.col("n_docs"), F.col("n_failed")
    total = hosts.agg(F.sum(n).alias("all_docs"), F.sum(k).alias("all_failed"), F.count("*").alias("hosts"), F.sum(k * k / n).alias("squares"))
    mean = F.col("all_failed") / F.col("all_docs")
    between = F.col("squares") / F.col("all_docs") - mean * mean - mean * (1 - mean) * F.col("hosts") / F.col("all_docs")
    noise = mean * (1 - mean)
    strength = F.when(between > 1e-9 * noise, F.least(F.lit(1e6), F.greatest(F.lit(1.0), noise / between - 1))).otherwise(F.lit(1e6))
    prior = total.select(mean.alias("mean"), strength.alias("strength"))
    shrunk = (k + F.col("mean") * F.col("strength")) / (n + F.col("strength"))
    judged = hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"))  # prior: one row
    return judged.withColumn("host_rejected", F.col("shrunk_rate") > max_rate)


def judged(rows: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Rows of (row, host, counts), written first, with ``failed`` and ``verdict`` (host figures and ``kept``)."""
    rows = scratch(rows.withColumn("failed", base_failed()), "ruled")
    hosts = host_verdicts(rows.select("host", "failed"), max_rate)
    hosts = hosts.select("host", F.struct("n_docs", "n_failed", "shrunk_rate", "host_rejected").alias("found"))
    kept = ~F.col("failed") & ~F.col("found.host_rejected")
    return join_small(rows, hosts, "host").select("row", "counts", "failed", F.struct("found.*", kept.alias("kept")).alias("verdict"))


def ruled(docs: DataFrame, text_col: str = "text", host_col: str = "source", row: Column | None = None) -> DataFrame:
    """(row, host, counts) of each row: ``row`` is all its columns, or what is given."""
    return docs.select(whole_row(docs) if row is None else row.alias("row"), column(host_col).alias("host"), rule_counts(column(text_col)).alias("counts"))


def keep_good(docs: DataFrame, max_rate: float = 0.5, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return judged(ruled(docs, text_col, host_col), max_rate).where("verdict.kept").select("row.*")


def rules_digest(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the host's shrunk rate."""
    j = judged(ruled(docs, row=F.struct("doc_id")), max_rate)
    counts = [f"counts.{c.split()[0]}" for c in COUNTS.split(", ")]
    return j.select("row.doc_id", *counts, F.col("failed").alias("base_failed"), "verdict.kept", F.round("verdict.shrunk_rate", 6).alias("shrunk_rate"))


ORACLE = rf"""
with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') as window_words from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as p from w where len(ws) >= {WINDOW})),
twice as (select doc_id, p from (select *, count(*) over (partition by doc_id, window_words) as n from win) where n > 1),
repeated as (select doc_id, count(distinct p + o) as n_repeat_words from twice, range({WINDOW}) as r(o) group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
dup as (select doc_id, sum(n - 1) as n_dup_lines from (select doc_id, line, count(*) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by all) group by doc_id),
counts as (
  select doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join dup using (doc_id) left join repeated using (doc_id)),
base as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from counts),
hosts as (select source, count(*)::double as n, count(*) filter (base_failed)::double as k from base group by source),
total as (select sum(n) as n, sum(k) / sum(n) as mean, count(*) as h, sum(k * k / n) as kk from hosts),
prior as (select mean, mean * (1 - mean) as noise, kk / n - mean * mean - mean * (1 - mean) * h / n as spread from total),
strength as (select mean, case when spread > 1e-9 * noise then least(1e6, greatest(1.0, noise / spread - 1)) else 1e6 end as s from prior),
judged as (select source, (k + mean * s) / (n + s) as shrunk_rate from hosts, strength)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not shrunk_rate > 0.5 as kept, round(shrunk_rate, 6) as shrunk_rate
from base b join judged j on b.source is not distinct from j.source
"""
