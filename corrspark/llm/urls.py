"""URL filter: smoothed variable-order Markov models of characters, one for accepted and one for rejected URLs.

URLs that a rule decides teach both models. A URL's score is the difference of its log-likelihoods under the
two, divided by its length; the least score of an accepted URL is calibrated on rule-decided URLs held out.
Counts live in tables of a fixed number of buckets, so what goes to the tasks does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.llm.common import lower_ascii
from corrspark.session import cut

#: Fixed values: (verdict, rule); a rule is a host, then a path that the url's path starts with.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


@dataclass(frozen=True)
class UrlModel:
    """``order``: characters of the longest context. ``buckets``: entries of a count table, a power of two.

    ``weight``: pseudo-counts that a context's shorter context brings in. ``held_out``: one in so many
    rule-decided URLs sets the threshold.
    """

    order: int = 4
    buckets: int = 1 << 18
    weight: float = 4.0
    held_out: int = 10
    bins: int = 2000


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled: the parts of the url and the longest rule that fits, with its verdict."""
    at = F.instr("url", "://")
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    parts = pages.select(
        "page_id",
        "url",
        F.coalesce(F.when(at > 0, lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1))), F.lit("")).alias("host"),
        F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)), F.lit("")).alias("path"),
    )
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, ruled = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return parts.select("*", rule.alias("rule"), ruled.alias("ruled"))


def _grams(urls: list[str], model: UrlModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of all urls: its url's number, and the buckets of its context and of context and character, by order."""
    codes = [np.frombuffer(u.encode("utf-8", "surrogatepass"), np.uint8) for u in urls]
    owner = np.repeat(np.arange(len(urls)), [len(c) + 1 for c in codes])
    text = np.concatenate([np.append(c, 0) for c in codes]).astype(np.uint64) if codes else np.empty(0, np.uint64)
    context, joint = np.empty((model.order + 1, len(text)), np.int64), np.empty((model.order + 1, len(text)), np.int64)
    shifted = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(model.order + 1):
            if k:
                back = np.full(len(text), 256, np.uint64)
                back[k:] = np.where(owner[k:] == owner[:-k], text[:-k], np.uint64(256))
                shifted = shifted * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(1)
            seed = shifted + np.uint64(k << 32)
            for out, key in ((context, seed), (joint, seed * np.uint64(0xD6E8FEB86659FD93) + text + np.uint64(0xA5A5))):
                mixed = key ^ (key >> np.uint64(32))
                mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
                out[k] = ((mixed ^ (mixed >> np.uint64(29))) & np.uint64(model.buckets - 1)).astype(np.int64)
    return owner, context, joint


def count_tables(taught: DataFrame, model: UrlModel) -> dict[tuple[str, str], np.ndarray]:
    """(verdict, kind of table) -> counts. taught: url, ruled. Each task sums its own buckets before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {(v, k): np.zeros(model.buckets, np.int64) for v in ("allow", "block") for k in ("context", "joint")}
        for x in batches:
            for verdict in ("allow", "block"):
                _, context, joint = _grams(x.loc[x["ruled"] == verdict, "url"].tolist(), model)
                sums[verdict, "context"] += np.bincount(context.ravel(), minlength=model.buckets)
                sums[verdict, "joint"] += np.bincount(joint.ravel(), minlength=model.buckets)
        for (verdict, kind), counts in sums.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"verdict": verdict, "kind": kind, "bucket": at, "n": counts[at]})

    found = taught.mapInPandas(run, "verdict string, kind string, bucket long, n long").groupBy("verdict", "kind", "bucket").agg(F.sum("n").alias("n"))
    tables = {(v, k): np.zeros(model.buckets, np.int64) for v in ("allow", "block") for k in ("context", "joint")}
    for (verdict, kind), part in found.toArrow().to_pandas().groupby(["verdict", "kind"]):  # 4 * buckets rows at most
        tables[verdict, kind][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return tables


def _scores(urls: list[str], tables, model: UrlModel) -> np.ndarray:
    """Log-likelihood difference a character; 0 for an empty url."""
    owner, context, joint = _grams(urls, model)
    logs = {}
    for verdict in ("allow", "block"):
        p = np.full(len(owner), 1 / 257)
        for k in range(model.order + 1):
            p = (tables[verdict, "joint"][joint[k]] + model.weight * p) / (tables[verdict, "context"][context[k]] + model.weight)
        logs[verdict] = np.log(np.minimum(p, 1.0))
    n = np.bincount(owner, minlength=len(urls))
    score = np.bincount(owner, logs["allow"] - logs["block"], minlength=len(urls)) / np.maximum(n, 1)
    return np.where(np.array([len(u) for u in urls], np.int64) == 0, 0.0, score) if urls else np.empty(0)


def score_urls(pages: DataFrame, tables, model: UrlModel) -> DataFrame:
    """``pages`` (with url) and score."""
    shared = pages.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in tables.items()})  # of a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(score=_scores([u or "" for u in x["url"]], shared.value, model))

    return pages.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema) + ", score double")


def calibrate(scored: DataFrame, bins: int) -> float:
    """The score that best tells held-out accepted from rejected URLs (balanced accuracy), from a histogram of ``bins``."""
    edge = 8.0
    slot = F.least(F.greatest(F.floor((F.col("score") + edge) * bins / (2 * edge)), F.lit(0)), F.lit(bins - 1))
    good, bad = np.zeros(bins), np.zeros(bins)
    for row in scored.groupBy(slot.alias("slot"), "ruled").count().collect():
        (good if row["ruled"] == "allow" else bad)[row["slot"]] = row["count"]
    if not good.sum() or not bad.sum():
        return 0.0
    below_good, below_bad = np.append(0, np.cumsum(good)) / good.sum(), np.append(0, np.cumsum(bad)) / bad.sum()
    gain = below_bad - below_good
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2] * 2 * edge / bins - edge)


def judge_urls(pages: DataFrame, rules=RULES, model: UrlModel = UrlModel()) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    A null url, or one without ``://``, has an empty host and path and no rule; a null or empty one scores 0.
    Repeated rows and null ids are judged row by row; other columns are not read. Without both kinds of
    rule-decided URLs the threshold is 0. An empty table gives an empty table.
    """
    parts = cut(with_rules(pages, rules), "urls")
    taught = parts.where("ruled is not null").select("url", "ruled", (F.pmod(F.xxhash64("url"), F.lit(model.held_out)) == 0).alias("held"))
    tables = count_tables(taught.where("not held").select("url", "ruled"), model)
    least = calibrate(score_urls(taught.where("held").select("url", "ruled"), tables, model), model.bins)
    scored = score_urls(parts, tables, model)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
