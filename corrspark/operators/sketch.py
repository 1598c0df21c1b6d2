"""Similarity groups: MinHash signatures over k-mer sets and band hashes as group ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrspark.operators.kmers import CODED, blocks, map_windows, positions, texts

#: The modulus of the permutations, a prime.
PRIME = np.uint64((1 << 61) - 1)


def permutations(num_perm: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors, then offsets, from one generator."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, int(PRIME), num_perm, dtype=np.uint64), rng.integers(0, int(PRIME), num_perm, dtype=np.uint64)


def minhash_groups(df: DataFrame, by: list[str], k: int, num_perm: int = 80, bands: int = 40, group_bands: int = 1, seed: int = 42, seq: str = "seq") -> DataFrame:
    """by, group_id: rows whose first bands agree share it. An empty k-mer set has a group of its own kind.

    Only the permutations of the bands in use are evaluated, though all are drawn.
    """
    if num_perm % bands:
        raise ValueError("num_perm must be a multiple of bands")
    used = min(group_bands, bands) * (num_perm // bands)
    factors, offsets = (x[:used] for x in permutations(num_perm, seed))

    flip = str.maketrans("ACGTacgt", "TGCAtgca")

    def canonical(sequence: str | None) -> set[str]:
        up = (sequence or "").upper()
        back = up.translate(flip)[::-1]
        n = len(up)
        both = ((up[i : i + k], back[n - i - k : n - i]) for i in range(n - k + 1))
        return {min(a, b) for a, b in both if "N" not in a}

    def hashed(kmers: list[bytes]) -> np.ndarray:
        h = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=8).digest() for s in kmers), "<u8")
        with np.errstate(over="ignore"):
            return (h[:, None] * factors + offsets) % PRIME

    def signatures(seqs: list[str | None]) -> np.ndarray:
        """A row for each sequence. A k-mer is hashed once in a block, however often it occurs there."""
        out = np.full((len(seqs), used), np.iinfo(np.uint64).max)
        if k > CODED:
            for i, kmers in enumerate(map(canonical, seqs)):
                if kmers:
                    out[i] = hashed([s.encode() for s in kmers]).min(axis=0)
            return out
        for codes, row, _, others in blocks([(s or "").upper().encode() for s in seqs], k):
            found, inverse = np.unique(codes, return_inverse=True)
            if len(found):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out[row[first]] = np.minimum(out[row[first]], np.minimum.reduceat(hashed(texts(found, k))[inverse], first, axis=0))
            for i, _, kmer in others:
                out[i] = np.minimum(out[i], hashed([kmer.encode()])[0])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ids = []
            for signature in signatures(x["_seq"].tolist()):
                rows = signature.reshape(min(group_bands, bands), -1)
                ids.append("LSH:" + "-".join(hashlib.blake2b(r.tobytes(), digest_size=8).hexdigest() for r in rows))
            yield x.drop(columns="_seq").assign(group_id=ids)

    keyed = df.select(*by, F.col(seq).alias("_seq"))
    return keyed.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.drop("_seq").schema) + ", group_id string")


def md5_groups(df: DataFrame, by: list[str], k: int, rows: int = 2, seq: str = "seq") -> DataFrame:
    """by, group_id: the least md5 of seed and k-mer for each seed.

    A k-mer is hashed once in a block, and the shuffle has a row for each piece of a sequence.
    """
    names = [f"_m{i}" for i in range(rows)]
    if k > CODED:
        own = positions(df, by, k, seq).select(*by, *[F.md5(F.concat(F.lit(f"{i}:"), F.col("kmer"))).alias(c) for i, c in enumerate(names)])
    else:

        def found(codes: np.ndarray, piece: np.ndarray, pos: np.ndarray, others: list) -> pd.DataFrame:
            kmers, inverse = np.unique(codes, return_inverse=True)
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            out, known = {"_piece": piece[first]}, texts(kmers, k)
            for i, c in enumerate(names):
                digests = [hashlib.md5(b"%d:%s" % (i, s)).digest() for s in known]
                words = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
                order = np.lexsort((words[:, 1], words[:, 0]))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                out[c] = [digests[j].hex() for j in order[np.minimum.reduceat(rank[inverse], first)]] if len(first) else []
            more = [(i, *[hashlib.md5(f"{j}:{kmer}".encode()).hexdigest() for j in range(rows)]) for i, _, kmer in others]
            return pd.concat([pd.DataFrame(out), pd.DataFrame(more, columns=list(out))]) if more else pd.DataFrame(out)

        own = map_windows(df, by, k, seq, found, ", ".join(f"{c} string" for c in names))
    least = own.groupBy(*by).agg(*[F.min(c).alias(c) for c in names])
    joined = df.select(*by).join(least, by, "left")
    return joined.select(*by, F.concat(F.lit("LSH:"), F.md5(F.concat_ws("-", *names))).alias("group_id"))
