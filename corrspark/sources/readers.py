"""Readers of the text formats. Files may be gzipped; rows that do not parse are dropped, as are comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.functions.text import numeric
from corrspark.operators.kmers import last_by_name
from corrspark.sources import blockgzip


def _place() -> Column:
    """The order of rows in files: by path, then where the file's part begins, then row by row."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def fasta(spark: SparkSession, paths: str | list[str], upper: bool = True) -> DataFrame:
    """path, name (first token of the header), seq, place (the order in and of files). A record is a row, whatever lines it has.

    Files that end in .bgz are read block by block in several tasks; gzip and plain text by Spark.
    """
    every = [paths] if isinstance(paths, str) else list(paths)
    blocks = [p for p in every if p.endswith(".bgz")]
    plain = [p for p in every if not p.endswith(".bgz")]
    found = None
    if plain:
        raw = spark.read.option("lineSep", ">").text(plain).withColumns({"path": F.col("_metadata.file_path"), "place": _place()}).where(F.length(F.trim("value")) > 0)
        header = F.substring_index("value", "\n", 1)
        body = F.substring(F.col("value"), F.length(header) + 1, F.length("value"))
        found = raw.select("path", header.alias("header"), body.alias("body"), "place")
    if blocks:
        own = blockgzip.fasta_records(spark, blocks).select("path", "header", "body", F.struct("path", F.lit(0).cast("long").alias("block"), F.col("place").alias("row")).alias("place"))
        found = own if found is None else found.unionByName(own)
    text = F.regexp_replace("body", r"\s", "")
    return found.select("path", F.regexp_extract("header", r"^\s*(\S*)", 1).alias("name"), (F.upper(text) if upper else text).alias("seq"), "place")


def fasta_lengths(spark: SparkSession, paths: str | list[str], first_only: bool = False) -> DataFrame:
    """path, name, length. ``first_only``: of each file's first record alone."""
    rows = fasta(spark, paths).select("path", "name", F.length("seq").cast("long").alias("length"), "place")
    if not first_only:
        return rows.drop("place")
    return rows.groupBy("path").agg(F.min_by(F.struct("name", "length"), "place").alias("r")).select("path", "r.*")


def fasta_dictionary(spark: SparkSession, paths: str | list[str], upper: bool = False) -> DataFrame:
    """name, seq: of records with one name the last, by file and place."""
    return last_by_name(fasta(spark, paths, upper), "name", "place").select("name", "seq")


def _fields(spark: SparkSession, paths: str | list[str], separator: str = "\t") -> DataFrame:
    lines = spark.read.text(paths).withColumn("place", _place()).where((F.length(F.trim("value")) > 0) & ~F.col("value").rlike(r"^\s*(#|track|browser)"))
    return lines.select(F.split(F.trim("value") if separator == r"\s+" else F.col("value"), separator, -1).alias("c"), "place")


def _at(i: int) -> Column:
    return F.get("c", F.lit(i))


def _long(i: int) -> Column:
    return _at(i).try_cast("long")


def bed(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """chrom, start, end, name, score, strand, extra. Strict: fewer than four columns are an error."""
    rows = _fields(spark, paths)
    if strict:
        rows = rows.where(F.when(F.size("c") >= 4, True).otherwise(F.raise_error(F.lit("a BED row has fewer than 4 columns")).cast("boolean")))
    text = lambda i, other: F.coalesce(F.nullif(_at(i), F.lit("")), F.lit(other))
    out = rows.select(_at(0).alias("chrom"), _long(1).alias("start"), _long(2).alias("end"), text(3, "").alias("name"), text(4, "0").alias("score"), text(5, "+").alias("strand"), F.slice("c", F.lit(7), F.greatest(F.size("c") - 6, F.lit(0))).alias("extra"))
    return out.where("end > start")


def bedgraph(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = _fields(spark, paths, r"\s+")
    return rows.select(_at(0).alias("chrom"), _long(1).alias("start"), _long(2).alias("end"), _at(3).try_cast("double").alias("value")).where("end > start and value is not null")


def fai(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _fields(spark, paths).select(_at(0).alias("name"), _long(1).alias("length")).where("length is not null")


def paf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    whole = {1: "qlen", 2: "qstart", 3: "qend", 6: "tlen", 7: "tstart", 8: "tend", 9: "nmatch", 10: "alen", 11: "mapq"}
    names = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "nmatch", "alen", "mapq"]
    rows = _fields(spark, paths).where("size(c) >= 12").select(*[(_long(i) if i in whole else _at(i)).alias(n) for i, n in enumerate(names)], F.slice("c", F.lit(13), F.greatest(F.size("c") - 12, F.lit(0))).alias("tags"))
    return rows.where(" and ".join(f"{n} is not null" for n in whole.values()))


def tag_map(tags: Column) -> Column:
    """Tags ``xx:T:v`` as a map from xx:T to v."""
    pairs = F.transform(tags, lambda t: F.struct(F.substring(t, 1, 4).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v")))
    return F.map_from_entries(F.array_distinct(pairs))


def table(spark: SparkSession, paths: str | list[str], required: list[str] = (), aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """A TSV with a header. aliases: other headers that a column may have; a missing required column is an error."""
    df = spark.read.options(header=True, sep="\t").csv(paths)
    for name, others in (aliases or {}).items():
        found = next((o for o in others if name not in df.columns and o in df.columns), None)
        if found:
            df = df.withColumnRenamed(found, name)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def bundles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The bundle table, with whole coordinates from numbers like 12.0, and strand + where it is not -."""
    df = table(spark, paths, ["chrom", "ref_start", "ref_end", "qry_start", "qry_end", "strand"], {"chrom": ["ref_chrom", "contig"]})
    for c in ("ref_start", "ref_end", "qry_start", "qry_end"):
        df = df.withColumn(c, F.col(c).try_cast("double").cast("long"))
    return df.withColumn("strand", F.when(F.col("strand") == "-", "-").otherwise("+"))


def metrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """anchor_id, fraction, n_unique, n_kmers; text for no number is null."""
    return _fields(spark, paths).where(~F.lower(_at(0)).isin("anchor_id")).select(_at(0).alias("anchor_id"), numeric(_at(1)).alias("fraction"), _long(2).alias("n_unique"), _long(3).alias("n_kmers"))


def kmer_existence(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """anchor_id, n_unique, n_kmers, fraction from four columns (id, k-mers, k-mers of the set, hits) or from >id and lines of 0 and 1."""
    raw = spark.read.option("lineSep", ">").text(paths).where(F.length(F.trim("value")) > 0)
    first = F.substring_index("value", "\n", 1)
    bits = F.regexp_replace(F.substring(F.col("value"), F.length(first) + 1, F.length("value")), r"[^01]", "")
    is_bits = ~first.contains("\t")
    from_bits = raw.where(is_bits).select(F.regexp_extract(first, r"^\s*(\S*)", 1).alias("anchor_id"), F.length(F.regexp_replace(bits, "0", "")).cast("long").alias("n_unique"), F.length(bits).cast("long").alias("n_kmers"))
    lines = raw.where(~is_bits).select(F.explode(F.split("value", "\n")).alias("value")).select(F.split("value", "\t").alias("c")).where("size(c) >= 4")
    both = from_bits.unionByName(lines.select(_at(0).alias("anchor_id"), _long(3).alias("n_unique"), _long(1).alias("n_kmers")))
    return both.withColumn("fraction", F.when(F.col("n_kmers") > 0, F.col("n_unique") / F.col("n_kmers")))


def clusters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """label, group_id from cluster (.uc) rows; the last row of a label counts."""
    rows = _fields(spark, paths).where("size(c) >= 9").select(_at(8).alias("label"), _at(1).try_cast("int").alias("cluster"), F.col("place").alias("_row")).where("label <> '*' and cluster is not null")
    return rows.groupBy("label").agg(F.max_by("cluster", "_row").alias("cluster")).select("label", F.format_string("VS:%06d", "cluster").alias("group_id"))


def blast6(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tabular hits; four columns are enough, further ones that a row lacks are null."""
    names = ["qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore"]
    kinds = ["string", "string", "double", "long", "long", "long", "long", "long", "long", "long", "double", "double"]
    return _fields(spark, paths).where("size(c) >= 4").select(*[_at(i).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]).where("length is not null")


def families(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The wide table of families as it is: see operators.families."""
    return spark.read.options(header=True, sep="\t").csv(paths)


def placed_centers(spark: SparkSession, root: str, pattern: str = "*.bed") -> DataFrame:
    """lane (the folder's name), anchor_id, center from all BED files below ``root``; of an id that repeats in a lane the last file counts."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).withColumn("place", _place())
    rows = lines.select(F.split("value", "\t", -1).alias("c"), "place").where("size(c) >= 4")
    placed = rows.select(F.regexp_extract("place.path", r"([^/]+)/[^/]+$", 1).alias("lane"), _at(3).alias("anchor_id"), ((_at(1).try_cast("double") + _at(2).try_cast("double")) / 2).alias("center"), "place").where("center is not null")
    return placed.groupBy("lane", "anchor_id").agg(F.max_by("center", "place").alias("center"))


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Flat ``key: value`` lines of a configuration file; comments and blank lines are passed over, quotes go, the last of a key counts."""
    rows = spark.read.text(path).withColumn("place", _place()).select(F.regexp_extract("value", r"^\s*([A-Za-z_][\w.-]*)\s*:", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_extract("value", r"^[^:]*:(.*)$", 1), r"\s+#.*$", "")).alias("v"), "place")
    return {r["k"]: r["v"].strip("\"'") for r in rows.where("k <> ''").orderBy("place").collect()}  # a small file of settings


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, sample (the folder's name), sha256 of files below ``root`` whose name fits the pattern."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sample"), F.sha2("content", 256).alias("sha256"))
