"""Readers of tables, documents, chunks, rankings, labels and gold files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join of at most so many rows is broadcast, after a count; a larger one is shuffled.
BROADCAST_ROWS = 100_000
#: Up to so many patterns, each text is searched for every one as it is read. The words of a corpus grow with it, so comparing patterns with them costs more.
FEW = 2_000

# Fixed formats: the fields of chunk, ranking and label files.
CHUNK_SCHEMA = "id string, doc_id string, slug string, text_raw string, text_embed string, char_start long, char_end long, chars_raw long, tokens_embed int, block_type string, sha256 string, sha256_norm string"
RANKING_SCHEMA = "variant string, corpus_sha256 string, vectors_sha256 string, model string, top int, questions array<struct<id:string, question:string, answerable:boolean, gold_chunks:array<string>, retrieved:array<struct<rank:int, chunk_id:string, score:double>>>>"
LABEL_SCHEMA = "question_id string, chunk_id string, necessary int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Batches to Python workers are bounded in rows and bytes, since texts can be long. The session keeps this."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) a file; line ends are made ``\\n``."""
    read = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    return read


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def rankings(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """A ranking file in long form: variant, question_id, rank, chunk_id, score."""
    rows = spark.read.schema(RANKING_SCHEMA).json(path, multiLine=True).select(F.explode("questions").alias("q"))
    return rows.select(F.lit(variant).alias("variant"), F.col("q.id").alias("question_id"), F.explode("q.retrieved").alias("r")).select("variant", "question_id", "r.rank", "r.chunk_id", "r.score")


def label_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).csv(path, header=True)


def gold_entries(text: F.Column) -> F.Column:
    """The ``## Qnn`` sections of a gold file, as an array of struct(id, body)."""
    # The first piece is what comes before the first section.
    heads = F.regexp_extract_all(text, F.lit(r"(?md)^## (Q\d+)[ \t]*$"), F.lit(1))
    bodies = F.slice(F.split(text, r"(?md)^## Q\d+[ \t]*$", -1), 2, 1_000_000)
    return F.arrays_zip(heads.alias("id"), bodies.alias("body"))


def gold_field(body: F.Column, name: str) -> F.Column:
    """The rest of the line after ``**name:**``, trimmed; null if missing or blank. It never runs on to the next line."""
    found = F.trim(F.regexp_extract(body, rf"(?md)^\*\*{name}:\*\*[ \t]*([^\n]*)$", 1))
    return F.when(found != "", found)


def gold_answer(body: F.Column) -> F.Column:
    """The answer over all its lines up to the next field, white space squeezed."""
    found = F.trim(F.regexp_replace(F.regexp_extract(body, r"(?msd)^\*\*Gold answer:\*\*(.*?)(?=^\*\*)", 1), r"[ \t\n\r\f\x0b]+", " "))
    return F.when(found != "", found)


def parsed_gold(files: DataFrame) -> DataFrame:
    """Gold files (text) as rows: pos, id, question, type, answerable, gold_chunks, gold_docs, gold_answer, not_covered_because, authors.

    An entry without its Authorship line raises when read: who wrote a label isn't guessed.
    """
    rows = files.select(F.posexplode(gold_entries(F.col("text"))).alias("pos", "e")).select("pos", "e.id", "e.body")
    b = F.col("body")
    listed = F.regexp_extract_all(F.coalesce(gold_field(b, "Gold chunks"), F.lit("")), F.lit(r"`(doc-\d+:c\d+)`"), F.lit(1))
    why = gold_field(b, "Not covered because")
    said = lambda which: F.regexp_extract(b, r"(?md)^\*\*Authorship:\*\* question=(\w+), answer=(\w+)$", which)
    author = lambda which: F.when(said(which) != "", said(which)).otherwise(F.raise_error(F.concat("id", F.lit(": no Authorship line"))).cast("string"))
    return rows.select(
        "pos", "id", gold_field(b, "Question").alias("question"), gold_field(b, "Type").alias("type"), F.coalesce(F.lower(gold_field(b, "Answerable")) == "yes", F.lit(False)).alias("answerable"),
        listed.alias("gold_chunks"), F.array_sort(F.array_distinct(F.transform(listed, lambda c: F.split_part(c, F.lit(":"), F.lit(1))))).alias("gold_docs"),
        gold_answer(b).alias("gold_answer"), F.when(F.lower(why) != "n/a", why).alias("not_covered_because"), author(1).alias("question_author"), author(2).alias("answer_author"))


def index_table(text: F.Column) -> F.Column:
    """Rows of a markdown index, ``| doc-nn | `slug` |``: array of struct(doc_id, slug)."""
    pattern = r"(?md)^\|[ \t]*(doc-\d+)[ \t]*\|[ \t]*`([^`]*)`"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("doc_id"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("slug"))


def recorded_hash(text: F.Column) -> F.Column:
    """The 64 hex digits that an index file records, or null."""
    return F.nullif(F.regexp_extract(text, r"\b([0-9a-f]{64})\b", 1), F.lit(""))


def run_header(spark: SparkSession, path: str) -> dict[str, str | None]:
    """What a ranking file says it was made from."""
    row = spark.read.schema(RANKING_SCHEMA).json(path, multiLine=True).select("variant", "corpus_sha256", "vectors_sha256", "model", "top").first()
    return row.asDict() if row else {}


GOLD_SCHEMA = ("corpus_sha256 string, vectors_sha256 string, questions array<struct<id:string, question:string, type:string, answerable:boolean, gold_chunks:array<string>, gold_docs:array<string>, gold_answer:string, "
               "not_covered_because:string, question_author:string, answer_author:string>>")  # fmt: skip


def gold_set(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """The corpus hash that a written gold set is of, and its entries."""
    read = spark.read.schema(GOLD_SCHEMA).json(path, multiLine=True)
    first = read.select("corpus_sha256").first()
    return (first.corpus_sha256 if first else None), read.select(F.explode("questions").alias("q")).select("q.*")


def index(spark: SparkSession, path: str, corpus_sha256: str | None = None, model: str | None = None) -> tuple[dict, DataFrame, DataFrame]:
    """Manifest, chunks and vectors of a written index, refused if they don't belong together: another corpus or encoder than asked for, ids
    of one side only, or lengths other than the manifest's."""
    from glintmill.operators import guards

    manifest = spark.read.json(f"{path}/manifest").first().asDict(recursive=True)
    if corpus_sha256 is not None:
        guards.same_fingerprint(manifest["corpus_sha256"], corpus_sha256, "the index")
    if model is not None:
        guards.same_fingerprint(manifest["model"], model, "the index's vectors")
    stored, vectors = spark.read.schema(CHUNK_SCHEMA).json(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors")
    guards.same_ids(stored.select("id"), vectors.select("id"), "id")
    guards.none_of(vectors.filter(F.size("embedding") != manifest["embedding_dim"]).select("id"), "vectors of another length")
    return manifest, stored, vectors
