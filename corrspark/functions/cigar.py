"""CIGAR algebra as higher-order functions. An operation list is array<struct<n:int, op:string>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = "array<struct<n:int,op:string>>"


def parse(text: Column) -> Column:
    """The operations of text that matches ([0-9]+[M=XID])+ in full with positive lengths, else null."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)[M=XID]"), F.lit(1)), lambda x: x.cast("int"))
    kinds = F.regexp_extract_all(text, F.lit("[0-9]+([M=XID])"), F.lit(1))
    ops = F.zip_with(sizes, kinds, lambda n, op: F.struct(n.alias("n"), op.alias("op")))
    return F.when(text.rlike(r"^([0-9]{1,9}[M=XID])+$") & F.forall(sizes, lambda n: n > 0), ops)


def render(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["n"].cast("string"), F.when(o["op"] == "M", "=").otherwise(o["op"]))), "")


def normalize(ops: Column) -> Column:
    """M as =, equal neighbours merged, empty operations dropped."""
    empty = F.array().cast(OPS)

    def add(held: Column, o: Column) -> Column:
        op = F.when(o["op"] == "M", "=").otherwise(o["op"])
        last = F.try_element_at(held, F.lit(-1))
        grown = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.struct((last["n"] + o["n"]).alias("n"), op.alias("op"))))
        fresh = F.concat(held, F.array(F.struct(o["n"].alias("n"), op.alias("op"))))
        return F.when(o["n"] <= 0, held).when((F.size(held) > 0) & (last["op"] == op), grown).otherwise(fresh).cast(OPS)

    return F.aggregate(ops, empty, add)


def _total(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0).cast("long"), lambda a, o: a + o["n"])


def reference_bases(ops: Column) -> Column:
    return _total(ops, "M=XD")


def query_bases(ops: Column) -> Column:
    return _total(ops, "M=XI")


def matches(ops: Column) -> Column:
    return _total(ops, "M=")


def alignment_length(ops: Column) -> Column:
    return _total(ops, "M=XID")


def dominant(ops: Column) -> Column:
    """The longest operation, the first of equals."""
    most = F.array_max(F.transform(ops, lambda o: o["n"]))
    return F.try_element_at(F.filter(ops, lambda o: o["n"] == most), F.lit(1))


def is_pure_insertion(ops: Column) -> Column:
    return render(normalize(ops)).rlike(r"^[0-9]+=[0-9]+I[0-9]+=$")


def simplify(ops: Column, min_net: int = 100, max_opposite: int = 50, max_mismatch: int = 200) -> Column:
    """Struct of ops and mode, from normal operations (see normalize): one net gap between matches where one kind of gap dominates.

    Mode is 1I or 1D, or raw where the gap is smaller or other operations are too many; then the operations stay. The
    gap stands behind as many bases as align before the longest gap of its kind, the first of equals.
    """
    ref, qry = reference_bases(ops), query_bases(ops)
    net = qry - ref
    kind = F.when(net > 0, "I").otherwise("D")
    opposite = F.when(net > 0, _total(ops, "D")).otherwise(_total(ops, "I"))
    simple = (F.abs(net) >= min_net) & (opposite <= max_opposite) & (_total(ops, "X") <= max_mismatch)
    longest = F.array_max(F.transform(F.filter(ops, lambda o: o["op"] == kind), lambda o: o["n"]))
    at = F.array_position(ops, F.struct(longest.alias("n"), kind.alias("op"))).cast("int")
    shared = F.least(ref, qry)
    left = F.least(_total(F.slice(ops, F.lit(1), F.greatest(at - 1, F.lit(0))), "=X"), shared)
    piece = lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op"))
    made = F.filter(F.array(piece(left, F.lit("=")), piece(F.abs(net), kind), piece(shared - left, F.lit("="))), lambda o: o["n"] > 0)
    return F.struct(F.when(simple, made).otherwise(ops).alias("ops"), F.when(ops.isNull(), None).when(simple, F.concat(F.lit("1"), kind)).otherwise("raw").alias("mode"))


def _trimmed(ops: Column, ref: Column, qry: Column, whole_gaps: bool) -> Column:
    """ops without what lies before ``ref`` and ``qry`` more bases of the axes; and how many bases of each went.

    A match takes bases of both axes, as many as the needier one wants. A gap on an axis that wants no more goes as a
    whole if ``whole_gaps``, as the other axis still does; else what is left of it stops the trimming.
    """
    state = F.struct(F.array().cast(OPS).alias("rest"), ref.cast("long").alias("ref"), qry.cast("long").alias("qry"), F.lit(0).cast("long").alias("gone_ref"), F.lit(0).cast("long").alias("gone_qry"), F.lit(False).alias("stuck"))

    def step(a: Column, o: Column) -> Column:
        n = o["n"].cast("long")
        active = ((a["ref"] > 0) | (a["qry"] > 0)) & ~a["stuck"]
        gap = lambda own, other: F.when((other > 0) & F.lit(whole_gaps), n).otherwise(F.least(n, F.greatest(own, F.lit(0))))
        take = F.when(~active, 0).when(o["op"] == "D", gap(a["ref"], a["qry"])).when(o["op"] == "I", gap(a["qry"], a["ref"])).otherwise(F.least(n, F.greatest(a["ref"], a["qry"])))
        other = F.when(o["op"] == "D", a["qry"]).when(o["op"] == "I", a["ref"]).otherwise(0)
        of_ref, of_qry = F.when(o["op"] == "I", 0).otherwise(take), F.when(o["op"] == "D", 0).otherwise(take)
        rest = F.when(take < n, F.concat(a["rest"], F.array(F.struct((n - take).cast("int").alias("n"), o["op"].alias("op"))))).otherwise(a["rest"])
        return F.struct(
            rest.cast(OPS).alias("rest"),
            (a["ref"] - of_ref).cast("long").alias("ref"),
            (a["qry"] - of_qry).cast("long").alias("qry"),
            (a["gone_ref"] + of_ref).cast("long").alias("gone_ref"),
            (a["gone_qry"] + of_qry).cast("long").alias("gone_qry"),
            (a["stuck"] | (active & (take < n) & (other > 0))).alias("stuck"),
        )

    return F.aggregate(ops, state, step)


def trim_to_window(df: DataFrame, window: tuple[Column, Column, Column, Column], ops: str = "ops") -> DataFrame:
    """Trims the operations of records with tstart, tend, qstart, qend to a window (target low, high, query low, high).

    ops and the four ends are replaced; ops is null where nothing is left or the window cannot be met.
    """
    t_low, t_high, q_low, q_high = window
    zero = F.lit(0)
    first = df.withColumn("_l", _trimmed(F.col(ops), F.greatest(t_low - F.col("tstart"), zero), F.greatest(q_low - F.col("qstart"), zero), True))
    both = first.withColumn("_r", _trimmed(F.reverse("_l.rest"), F.greatest(F.col("tend") - t_high, zero), F.greatest(F.col("qend") - q_high, zero), False))
    ends = both.withColumns({"_t": F.col("tstart") + F.col("_l.gone_ref"), "_u": F.col("tend") - F.col("_r.gone_ref"), "_q": F.col("qstart") + F.col("_l.gone_qry"), "_w": F.col("qend") - F.col("_r.gone_qry")})
    good = (F.size("_r.rest") > 0) & (F.col("_u") > F.col("_t")) & (F.col("_w") > F.col("_q")) & (F.col("_t") >= t_low) & (F.col("_u") <= t_high) & (F.col("_q") >= q_low) & (F.col("_w") <= q_high)
    ends = ends.withColumn("_ok", good)
    made = {ops: F.when(F.col("_ok"), F.reverse("_r.rest"))} | {c: F.when(F.col("_ok"), F.col(x)).otherwise(F.col(c)) for c, x in (("tstart", "_t"), ("tend", "_u"), ("qstart", "_q"), ("qend", "_w"))}
    return ends.withColumns(made).drop("_l", "_r", "_t", "_u", "_q", "_w", "_ok")
