"""Terms, vocabulary, plural folding, document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmill.functions import text as T
from glintmill.sources.holding import hold
from glintmill.sources.tables import beside


def term_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.explode(T.terms(F.col(text))).alias("term"))


def vocabulary(docs: DataFrame) -> DataFrame:
    return term_rows(docs).select("term").distinct()


def plural_fold(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds ``folded``: a term of over three letters that ends in s becomes the singular if the unfolded vocabulary has that."""
    singular = vocab.select(F.col("term").alias("singular"))
    stem = F.when((F.length("term") > 3) & F.col("term").endswith("s"), F.expr("substring(term, 1, length(term) - 1)"))
    return terms.withColumn("stem", stem).join(singular, F.col("stem") == F.col("singular"), "left").withColumn("folded", F.coalesce("singular", "term")).drop("stem", "singular")


def related(terms: DataFrame) -> DataFrame:
    """(term): what decides how ``terms`` fold and what folds to them: themselves, with an s, and without one or two at their ends."""
    cut = lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1))
    t = F.col("term")
    return terms.select(F.explode(F.array_compact(F.array(t, F.concat(t, F.lit("s")), cut(t), cut(cut(t))))).alias("term")).distinct()


def document_frequency(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, df): documents that hold a folded term; rows of one doc_id are one document. With ``only`` (term) no others are counted; it must hold
    whatever is :func:`related` to the terms that are asked for.

    Each document's terms are made distinct, and the pairs of a plural and its singular that it holds are counted, on the spot. Documents of a
    term and of its plural, less those of both, are the documents of the folded term, so nothing but terms with counts is shuffled. Where
    documents have several rows, their terms are brought together first.
    """
    rows = docs.select("doc_id", F.array_distinct(T.terms(F.coalesce("text", F.lit("")))).alias("ts"))
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (counts or 0) > 1:
        rows = rows.select("doc_id", F.explode("ts").alias("t")).groupBy("doc_id").agg(F.collect_set("t").alias("ts"))
    both = F.filter("ts", lambda t: (F.length(t) > 3) & t.endswith("s") & F.array_contains(F.col("ts"), F.substr(t, F.lit(1), F.length(t) - 1)))
    each = rows.select(F.explode(F.concat(F.transform("ts", lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("b"))), F.transform(both, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("b"))))).alias("x"))
    each = each.select("x.*")
    if only is not None:
        each = each.join(beside(only), "term", "left_semi")
    counted = hold(each.groupBy("term").agg(F.sum("d").alias("d"), F.sum("b").alias("b")))
    folded = plural_fold(counted, counted.select("term"))
    return folded.groupBy(F.col("folded").alias("term")).agg((F.sum("d") - F.sum(F.when(F.col("term") != F.col("folded"), F.col("b")).otherwise(0))).alias("df"))


def anchors(text: F.Column, most: int = 8) -> F.Column:
    """The longest runs of letters and digits of a text: what a text that contains it must have within its own runs. None if it has no such run."""
    longest = F.array_sort(F.transform(F.array_distinct(T.runs(text)), lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r"))))
    return F.transform(F.slice(longest, 1, most), lambda x: x["r"])


def candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, doc_id): documents that may hold all ``anchor`` s of an ``id``, each within one of their runs: those with the rarest.

    Anchors are looked for in the runs of the corpus, each once however often it occurs; where these stand comes from postings.
    """
    runs = docs.select("doc_id", F.explode(F.array_distinct(T.runs(F.coalesce("text", F.lit(""))))).alias("run"))
    known = runs.groupBy("run").agg(F.count("*").alias("df"))
    within = hold(known.join(beside(wanted.select("anchor").distinct()), F.col("run").contains(F.col("anchor"))))
    weight = within.groupBy("anchor").agg(F.sum("df").alias("df"))
    rarest = wanted.join(weight, "anchor", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "anchor")).alias("least")).select("id", "least.anchor")
    return runs.join(beside(rarest.join(within, "anchor").select("id", "run")), "run").select("id", "doc_id").distinct()
