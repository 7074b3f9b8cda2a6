"""Reports in markdown, from tables of a few rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.functions.text import shown


def markdown(df: DataFrame, order: list[str], digits: int = 3, most: int = 1000) -> str:
    """A table with fixed digits, ``undefined`` for null; refuses more than ``most`` rows, since they come to the driver."""
    columns = [shown(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("undefined")).alias(n) for n, t in df.dtypes]
    rows = df.orderBy(*order).select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(r) + " |" for r in rows)]
    return "\n".join(lines) + "\n"


def baseline(totals: DataFrame, scores: DataFrame, header: dict) -> str:
    """A run: what it was made from, the means and counts of its variant, and a row a question."""
    a = totals.filter(F.col("variant") == header["variant"]).first()
    means = "".join(f"| {m} | {a[f'mean_{m}']:.3f} |\n" for m in ("recall_3", "recall_10", "precision_3", "reciprocal_rank"))
    rows = scores.filter(F.col("variant") == header["variant"]).drop("variant", "answerable")
    return (f"# {header['variant']}\n\nCorpus `{(header.get('corpus_sha256') or 'unknown')[:16]}`, vectors `{(header.get('vectors_sha256') or 'unknown')[:16]}`, model `{header.get('model')}`, top {header.get('top')}.\n\n"
            f"Means are over {a.n_answerable} answerable questions.\n\n| metric | value |\n|---|---|\n{means}\n"
            f"{a.no_gold_10} of {a.n_answerable} have no gold in the first ten, {a.no_gold_at_all} none at all; {a.gold_at_1} have gold first. The surface takes {a.surface_hits} of {a.surface_slots} places.\n\n{markdown(rows, ['item_id'])}")  # fmt: skip


def confidence(intervals: DataFrame, differences: DataFrame, seeds: DataFrame | None = None, clustered: DataFrame | None = None, needed: DataFrame | None = None) -> str:
    """Intervals, then paired differences, and how many of these exclude zero; then, where given, how far this depends on the seed and on
    correlated questions, and how many questions would settle it."""
    n, out = differences.count(), differences.filter("excludes_zero").count()
    text = f"# Intervals\n\n{markdown(intervals, ['metric', 'variant'])}\n# Paired differences\n\n{markdown(differences, ['metric', 'comparison'])}\n{out} of {n} exclude zero.\n"
    parts = [("Under other seeds", seeds, "seed"), ("With correlated questions drawn as one", clustered, "metric"), ("Questions needed", needed, "metric")]
    if any(df is not None for _, df, _ in parts):
        text += "\n# Sensitivity\n" + "".join(f"\n## {name}\n\n{markdown(df, [by])}" for name, df, by in parts if df is not None)
    return text


def inspection(picked: DataFrame, most: int = 10) -> str:
    """Sampled chunks (bucket, id, block_type, tokens_embed, text_raw, text_embed) for reading, both renderings, the beginning of each."""
    out = []
    for r in picked.orderBy("bucket").limit(most).collect():
        out.append(f"## `{r.id}`: {r.bucket}\n\n{r.block_type}, {r.tokens_embed} tokens\n\n**text_raw**\n```\n{r.text_raw[:900].rstrip()}\n```\n\n**text_embed**\n```\n{r.text_embed[:900].rstrip()}\n```\n")
    return "# Chunks\n\n" + "\n".join(out)


def shown_path(path: str, root: str) -> str:
    """Relative to ``root`` where it lies below it, as it is elsewhere."""
    return str(Path(path).relative_to(root)) if Path(path).is_relative_to(root) else path


def corpus_index(docs: DataFrame, corpus_sha256: str, top: DataFrame) -> str:
    """The index of a corpus: its hash, the share of the largest documents, a row a document."""
    share = top.first()
    return f"SHA-256 `{corpus_sha256}`; the three largest documents hold {share.share:.1%} of {share.total_chars} characters.\n\n" + markdown(docs, [docs.columns[0]])
