"""Unique token substrings and the least context that tells an anchor apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrspark.operators.context import in_tasks
from corrspark.session import cut

BY = ["sample", "chrom"]

#: Tokens up to which all substrings are counted at once, whatever shorter ones have shown.
FIRST_ROUND = 6


def window_tokens(k: int) -> int:
    """Tokens in an anchor's window of k: longer substrings do not lie in it."""
    return 4 * k + 1


def _substrings(tokens: DataFrame, longest: int, found: DataFrame | None = None, over: int = 0) -> DataFrame:
    """by, t, size, text of the token substrings of up to a length; with ``found`` (by, s), of over ``over`` tokens and from other tokens only."""
    w = Window.partitionBy(*BY).orderBy("t").rowsBetween(0, longest - 1)
    ahead = [*BY, "t", F.collect_list("token").over(w).alias("_ahead")]
    if found is None:
        ahead = tokens.select(*ahead)
    else:
        own = found.select(*BY, F.col("s").alias("t"), F.lit(True).alias("_found"))
        marked = tokens.join(own.hint("merge"), [*BY, "t"], "left")  # a row for almost each token, not to be broadcast
        ahead = marked.select(*ahead, "_found").where(F.col("_found").isNull() & (F.size("_ahead") > over))
    return ahead.select(*BY, "t", F.explode(F.sequence(F.lit(over + 1), F.size("_ahead"))).alias("size"), "_ahead").select(*BY, "t", "size", F.array_join(F.slice("_ahead", F.lit(1), F.col("size")), "|").alias("text"))


def substring_counts(tokens: DataFrame, longest: int) -> DataFrame:
    """by, size, text, n."""
    return _substrings(tokens, longest).groupBy(*BY, "size", "text").agg(F.count(F.lit(1)).alias("n"))


def minimal_unique(tokens: DataFrame, longest: int) -> DataFrame:
    """by, s, e: for each token, the shortest substring from it that occurs once, both ends inclusive, ``longest`` tokens at most.

    All places of a substring that occurs again have its shorter beginnings in common, which occur again too. So sizes go in rounds,
    and after the first only tokens that have found none yet are looked at; they hold all places of what is counted.
    """
    found, over = None, 0
    while over < longest:
        upto = min(max(3 * over, FIRST_ROUND), longest)
        own = _substrings(tokens, upto, found, over)
        once = own.groupBy(*BY, "size", "text").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t")).where("n = 1")
        new = once.groupBy(*BY, "t").agg(F.min("size").alias("_size")).select(*BY, F.col("t").alias("s"), (F.col("t") + F.col("_size") - 1).alias("e"))
        found, over = new if found is None else found.unionByName(new), upto
        if over < longest:
            found = cut(found, "unique-substrings")
    return found


def disjoint_count(intervals: Column) -> Column:
    """How many of an array of closed (s, e) can be picked without overlap, earliest ends first."""
    ordered = F.array_sort(F.transform(intervals, lambda x: F.struct(x["e"].cast("long").alias("e"), x["s"].cast("long").alias("s"))))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    fold = lambda a, x: F.when(x["s"] > a["end"], F.struct(x["e"].alias("end"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(ordered, start, fold, lambda a: a["n"])


def _near_unique(ordered: DataFrame, unique: DataFrame, most: int) -> DataFrame:
    """by, anchor_id, idx, n, _mus: the unique substrings in an anchor's widest window, earliest ends first, each with the least k it needs.

    The window of k is the 2k tokens on both sides. Substrings that reach it are found by an equi-join on blocks of tokens, so
    no contig is paired with itself as a whole.
    """
    reach = 2 * most
    width = max(2 * reach, 64)
    anchors = ordered.select(*BY, "anchor_id", "idx", "n", (2 * F.col("idx")).alias("t0"))
    spread = anchors.withColumn("_block", F.explode(F.sequence(F.floor(F.greatest(F.col("t0") - reach, F.lit(0)) / width), F.floor((F.col("t0") + reach) / width))))
    mus = unique.withColumn("_block", F.floor(F.col("s") / width))
    rows, keys = ordered.count(), [*BY, "_block"]
    near = in_tasks(spread, keys, rows).join(in_tasks(mus, keys, rows), keys).where((F.col("s") >= F.col("t0") - reach) & (F.col("e") <= F.col("t0") + reach))
    need = F.greatest(F.ceil(F.greatest(F.col("t0") - F.col("s"), F.col("e") - F.col("t0")) / 2), F.lit(1)).cast("int")
    return near.withColumn("need", need).groupBy(*BY, "anchor_id", "idx", "n").agg(F.array_sort(F.collect_list(F.struct("e", "s", "need"))).alias("_mus"))


def least_contexts(ordered: DataFrame, unique: DataFrame, most: int, targets: list[int], shown: int = 3) -> DataFrame:
    """sample, chrom, anchor_id, idx, gid, target, k_min, alpha, evidence: for each target the least k whose window has as many
    unique substrings apart.

    Windows of growing k are nested; the picks of each are folded once and serve all targets. k_min and alpha are 0 and evidence empty where
    no k up to ``most`` will do or the group is empty. evidence names the contig, the window and the first picks.
    """
    fits = F.least(F.col("idx"), F.col("n") - 1 - F.col("idx"), F.lit(most)).cast("int")
    ks = F.when(fits >= 1, F.sequence(F.lit(1), fits)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("used"))

    def pick(a: Column, x: Column) -> Column:
        text = F.concat(F.lit("("), x["s"].cast("string"), F.lit(", "), x["e"].cast("string"), F.lit(")"))
        used = F.when(a["n"] < shown, F.concat(a["used"], F.array(text))).otherwise(a["used"])
        return F.when(x["s"] > a["end"], F.struct(x["e"].cast("long").alias("end"), (a["n"] + 1).alias("n"), used.alias("used"))).otherwise(a)

    picks = F.transform(ks, lambda k: F.struct(k.alias("k"), F.aggregate(F.filter("_mus", lambda x: x["need"] <= k), start, pick).alias("p")))
    found = _near_unique(ordered, unique, most).select(*BY, "anchor_id", picks.alias("_picks"))
    wanted = F.explode(F.array(*[F.lit(t) for t in targets]))
    rows = ordered.select(*BY, "anchor_id", "idx", "gid", wanted.alias("target")).join(found, [*BY, "anchor_id"], "left")
    first = F.when(F.col("gid") != "", F.try_element_at(F.filter("_picks", lambda x: x["p"]["n"] >= F.col("target")), F.lit(1)))
    rows = rows.withColumn("_first", first)
    k, n, t0 = F.col("_first.k"), F.col("_first.p.n"), 2 * F.col("idx")
    evidence = F.concat(F.lit("chrom="), F.col("chrom").cast("string"), F.lit(" win=["), (t0 - 2 * k).cast("string"), F.lit(","), (t0 + 2 * k).cast("string"), F.lit("] mus_picked=["), F.array_join("_first.p.used", ", "), F.lit("] (n="), n.cast("string"), F.lit(")"))
    return rows.select(*BY, "anchor_id", "idx", "gid", "target", F.coalesce(k, F.lit(0)).alias("k_min"), F.coalesce(n, F.lit(0).cast("long")).alias("alpha"), F.coalesce(evidence, F.lit("")).alias("evidence"))


def least_context(ordered: DataFrame, unique: DataFrame, most: int, longest: int, target: int = 1) -> DataFrame:
    """least_contexts() for one target."""
    return least_contexts(ordered, unique, most, [target]).drop("target")


def dictionary(contexts: DataFrame) -> DataFrame:
    """Adds uid (anchor00001 and on over anchors that are not ambiguous, by contig, then order) and ambiguous.

    Numbers are counted for each contig first, so the one window over contigs has a row for each of them.
    """
    clear = contexts.withColumn("ambiguous", F.col("k_min") == 0)
    sizes = clear.groupBy(*BY).agg(F.count(F.when(~F.col("ambiguous"), 1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("sample").orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.sum(F.when(~F.col("ambiguous"), 1).otherwise(0)).over(Window.partitionBy(*BY).orderBy("idx"))
    joined = clear.withColumn("_number", number).join(sizes.select(*BY, before.alias("_before")), BY)
    return joined.withColumn("uid", F.when(F.col("ambiguous"), "").otherwise(F.format_string("anchor%05d", F.col("_before") + F.col("_number")))).drop("_number", "_before")
