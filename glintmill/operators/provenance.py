"""What an index was made from: hashes of the corpus and of the vectors, the encoder, its settings and versions."""

from __future__ import annotations

import subprocess
from importlib import metadata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.operators.fingerprint import merkle
from glintmill.operators.segment import BUDGET

#: Libraries whose versions may change vectors.
LIBRARIES = ("pyspark", "numpy", "pandas", "pyarrow")
#: Vectors are hashed at so many steps a unit, so that the hash doesn't depend on how numbers are printed.
STEPS = 1_000_000


def vector_fingerprint(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """One hash, ``vectors_sha256``, of all vectors (key, embedding) in the order of their keys, by hashes of hashes."""
    steps = F.transform("embedding", lambda x: F.floor(x.cast("double") * STEPS + 0.5).cast("long").cast("string"))
    return merkle(vectors.select(F.col(key).alias("k"), F.sha2(F.concat_ws(",", steps), 256).alias("h")), "vectors_sha256")


def versions() -> dict[str, str]:
    out = {}
    for name in LIBRARIES:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = "unknown"
    return out


def git_sha(folder: str = ".") -> str:
    """The commit that ``folder`` is at, ``unknown`` outside a repository."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def manifest(corpus_sha256: str, chunks: DataFrame, vectors: DataFrame, model: str, query_prefix: str = "", passage_prefix: str = "", key: str = "vec_id") -> DataFrame:
    """One row: hashes, model, embedding_dim, normalized, prefixes, token_limit, n_chunks, n_vectors, versions, git_sha.

    Chunks per document and groups of equal chunks grow with the corpus; they are tables beside it.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    v = vectors.agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("embedding_dim"), F.coalesce(F.bool_and(F.abs(norm - 1) <= 1e-4), F.lit(False)).alias("normalized"))
    named = F.create_map(*[F.lit(x) for pair in versions().items() for x in pair])
    one = vector_fingerprint(vectors, key).crossJoin(v).crossJoin(chunks.agg(F.count("*").alias("n_chunks")))  # one row each
    return one.select(F.lit(corpus_sha256).alias("corpus_sha256"), "vectors_sha256", F.lit(git_sha()).alias("git_sha"), F.lit(model).alias("model"), "embedding_dim", "normalized", F.lit(query_prefix).alias("query_prefix"),
                      F.lit(passage_prefix).alias("passage_prefix"), F.lit(BUDGET).alias("token_limit"), "n_chunks", "n_vectors", named.alias("versions"))
