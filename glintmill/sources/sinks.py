"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_lines(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def text_per_document(docs: DataFrame, path: str) -> None:
    """A folder a document, with its text as one file."""
    docs.select("doc_id", "text").repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").option("maxRecordsPerFile", 1).text(path)


def ranking_file(rankings: DataFrame, path: str, header: dict | None = None) -> None:
    """One JSON payload, a run: its header, and for each question its ranked list, scores rounded to 6 places. For question sets of evaluations, not of any size."""
    item = F.struct("rank", "chunk_id", F.round("score", 6).alias("score"))
    lists = rankings.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("retrieved"))
    questions = F.array_sort(F.collect_list(F.struct("id", "retrieved"))).alias("questions")
    named = [F.lit(v).alias(k) for k, v in (header or {}).items()]
    lists.groupBy().agg(questions).select(*named, "questions").coalesce(1).write.mode("overwrite").json(path)


def gold_text(entries: DataFrame, manifest: dict) -> DataFrame:
    """One row, ``value``: a gold set as JSON, byte for byte the same for the same labels; which corpus and index it is of, counts, and the entries in order. Hand-made, so few."""
    fields = ("id", "question", "type", "answerable", "gold_chunks", "gold_docs", "gold_answer", "not_covered_because", "question_author", "answer_author")
    by = lambda who: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.collect_list(who))), lambda x: F.struct(x.alias("k"), F.size(F.filter(F.collect_list(who), lambda y: y == x)).alias("n"))))
    counts = F.struct(F.count("*").alias("questions"), F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"), F.sum(F.when(F.col("answerable"), F.size("gold_chunks")).otherwise(0)).alias("gold_chunks_total"),
                      F.count_if(F.col("answerable") & (F.size("gold_chunks") > 1)).alias("multi_chunk_answerable"), by("question_author").alias("question_author"), by("answer_author").alias("answer_author"))
    questions = F.transform(F.array_sort(F.collect_list(F.struct("pos", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    one = entries.groupBy().agg(counts.alias("counts"), questions.alias("questions"))
    said = [F.lit(manifest.get(k)).alias(k) for k in ("corpus_sha256", "vectors_sha256", "model", "embedding_dim", "token_limit", "n_chunks")]
    return one.select(F.to_json(F.struct(*said, "counts", "questions"), {"ignoreNullFields": "false"}).alias("value"))


def gold_file(entries: DataFrame, manifest: dict, path: str) -> None:
    gold_text(entries, manifest).coalesce(1).write.mode("overwrite").text(path)


def gold_is_current(entries: DataFrame, manifest: dict, path: str) -> bool:
    """Whether a written gold set is, byte for byte, what would be written now."""
    return entries.sparkSession.read.text(path).collect() == gold_text(entries, manifest).collect()  # one row each


def index(manifest: DataFrame, chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """An index: manifest (one row), chunk records, vectors (id, embedding), and beside them chunks per document and groups of equal chunks."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks")).write.mode("overwrite").json(f"{path}/chunks_per_doc")
    groups = chunks.groupBy("sha256_norm").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")
    chunks.select("id", "sha256_norm").join(groups, "sha256_norm").write.mode("overwrite").json(f"{path}/duplicate_groups")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def combined_file(lines: DataFrame, markers: DataFrame, path: str) -> None:
    """Writes numbered lines (line_no, line) as text parts in order, and reads them again: each marker (line_no, line) must be where it was said to be."""
    from glintmill.operators import guards
    from glintmill.operators.ordered import running_total

    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
    # Within a part lines keep their order; ids of rows follow it.
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    read = lines.sparkSession.read.option("maxPartitionBytes", str(1 << 40)).text(path).select(part.alias("part"), F.monotonically_increasing_id().alias("row"), "value")
    read = running_total(read.withColumn("_all", F.lit(0)), ["_all"], "row", F.lit(1), bucket=F.struct("part", F.expr("row div 65536")))
    found = read.select((F.col("before") + 1).alias("line_no"), "value")
    guards.none_of(markers.join(found, "line_no", "left").filter(~F.col("line").eqNullSafe(F.col("value"))).select("line_no", "line", "value"), "markers at other lines")


def append_labels(labels: DataFrame, path: str) -> None:
    labels.select("question_id", "chunk_id", "necessary").write.mode("append").option("header", True).csv(path)


def pools(pool: DataFrame, key: DataFrame, path: str) -> None:
    """Pools without, and beside them the key with, the gold marks."""
    pool.drop("gold").write.mode("overwrite").json(f"{path}/pools")
    key.write.mode("overwrite").json(f"{path}/key")


def is_stale(new: DataFrame, old: DataFrame) -> bool:
    """Whether a written table differs from what would be written now."""
    return not (new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty())
