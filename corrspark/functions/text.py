"""Names, paths and numbers in text."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that a file's stem loses.
SUFFIXES = (".fasta.gz", ".fa.gz", ".fna.gz", ".fasta", ".fa", ".fna")


def stem(path: Column) -> Column:
    """A sequence file's name without folder and ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), "(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$", "")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def numeric(text: Column) -> Column:
    """A double, or null for text that is no number or means none (nan, na, null, none, empty)."""
    clean = F.lower(F.trim(text))
    value = F.when(clean.isin("", "nan", "na", "null", "none"), None).otherwise(clean).try_cast("double")
    return F.when(~F.isnan(value), value)


def distinct_names(names: list[str]) -> list[str]:
    """Repeated names get _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def expand_inputs(values: list[str]) -> list[str]:
    """Paths from repeated, quoted or joined values (by commas or blanks), glob patterns and @files with a path on each line.

    What a pattern finds is sorted; a pattern that finds nothing stays as it is, so that the reader reports it.
    """
    out: list[str] = []
    for value in values:
        for part in (p.strip("'\"") for p in re.split(r"[,\s]+", value)):
            if part.startswith("@"):
                with open(part[1:]) as lines:
                    out += expand_inputs([x.split("#")[0].strip() for x in lines if x.split("#")[0].strip()])
            elif any(c in part for c in "*?["):
                out += sorted(glob.glob(part)) or [part]
            elif part:
                out.append(part)
    return list(dict.fromkeys(out))


def sample_and_base(path: str, ending: str) -> tuple[str, str]:
    """The sample (folder) and base name of <sample>/<base><ending>."""
    folder, name = os.path.split(path)
    if not folder or not name.endswith(ending) or name == ending:
        raise ValueError(f"{path!r} is not <sample>/<base>{ending}")
    return os.path.basename(folder), name[: -len(ending)]


def human(n: float) -> str:
    for unit in ("", "k", "M", "G"):
        if abs(n) < 1000:
            return f"{n:.4g}{unit}"
        n /= 1000
    return f"{n:.4g}T"


def size_class(length: Column, limits: list[tuple[int, object]], other: object) -> Column:
    """The value of the first limit that a length is below."""
    out = F.lit(other)
    for limit, value in sorted(limits, reverse=True, key=lambda x: x[0]):
        out = F.when(length < limit, F.lit(value)).otherwise(out)
    return out
