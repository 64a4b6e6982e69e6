"""64-bit hashes of k-mers for users that bucket by them; Spark's own, as no result depends on which hash is taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kmer_hash(enc: Column, seed: int = 7) -> Column:
    """xxHash64 of an encoded k-mer under a seed."""
    return F.xxhash64(F.lit(seed), enc)
