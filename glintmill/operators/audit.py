"""Audits of labels: shared rare terms, restatements, gold invariants, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintmill.operators import guards
from glintmill.operators.lexical import anchors, candidates, document_frequency, plural_fold, related, term_rows
from glintmill.operators.ordered import ranked_in_buckets, running_total
from glintmill.operators.seeking import holding_all
from glintmill.sources.tables import beside, few

# Fixed pattern: slash commands, flags, file names, camel case.
IDENTIFIER = r"/[a-z][a-z0-9-]{2,}|--[a-z][a-z0-9-]{2,}|[A-Za-z_][A-Za-z0-9_]*\.[a-z]{2,4}\b|\b[a-z]+[A-Z][A-Za-z]+\b|\b[A-Z][a-z]+[A-Z][A-Za-z]+\b"
RARE_DF, BROAD, FLAG_TERMS = 12, 20, 3


def shared_terms(docs: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """(item_id, term, df): folded terms that a question shares with its gold documents, with their document frequency.

    Of the corpus only words are counted that decide how a question's terms fold.
    """
    only = beside(related(term_rows(questions, "item_id", "question").select("term").distinct()))
    vocab = term_rows(docs).select("term").join(only, "term", "left_semi").distinct()
    fold = lambda rows, key: plural_fold(rows, vocab).select(key, F.col("folded").alias("term")).distinct()
    asked = fold(term_rows(questions, "item_id", "question").distinct(), "item_id")
    held = fold(term_rows(docs.join(beside(gold.select("doc_id").distinct()), "doc_id", "left_semi")).join(only, "term", "left_semi").distinct(), "doc_id")
    pairs = gold.join(held, "doc_id").select("item_id", "term").distinct()
    return asked.join(pairs, ["item_id", "term"]).join(document_frequency(docs, only), "term").select("item_id", "term", "df")


def leak_flags(shared: DataFrame, df_max: int, least: int = FLAG_TERMS) -> DataFrame:
    """Questions that share at least so many rare terms: item_id, n_rare, rarest; the rarest first."""
    r = shared.filter(F.col("df") <= df_max).groupBy("item_id").agg(F.count("*").alias("n_rare"), F.min("df").alias("rarest")).filter(F.col("n_rare") >= least)
    placed = ranked_in_buckets(r.withColumn("_all", F.lit(0)), ["_all"], F.col("rarest"), [F.desc("n_rare"), "item_id"])
    return placed.withColumnRenamed("rank", "place").drop("_all")


def leak_sweep(shared: DataFrame, n_docs: int, least: int = FLAG_TERMS) -> DataFrame:
    """(df_max, flagged): how many questions would be flagged, where the number changes as df_max grows."""
    # A question is flagged from the df of its least-th rarest term on.
    nth = shared.withColumn("i", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "term"))).filter(F.col("i") == least).filter(F.col("df") <= n_docs)
    steps = nth.groupBy(F.col("df").alias("df_max")).agg(F.count("*").alias("c"))
    summed = running_total(steps.withColumn("_all", F.lit(0)), ["_all"], "df_max", F.col("c"))
    return summed.select("df_max", (F.col("before") + F.col("c")).alias("flagged"))


def answer_keys(answers: DataFrame, frequency: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, key): identifiers in an answer, and backticked single words that look like names or are rare; three letters or digits at least."""
    names = answers.select("id", F.explode(F.regexp_extract_all("answer", F.lit(IDENTIFIER), F.lit(0))).alias("key"))
    spans = answers.select("id", F.explode(F.regexp_extract_all("answer", F.lit("`([^`]+)`"), F.lit(1))).alias("key")).withColumn("key", F.trim("key")).filter(~F.col("key").contains(" "))
    tokens = plural_fold(term_rows(spans.select("key").distinct(), "key", "key"), vocab).join(frequency.withColumnRenamed("term", "folded"), "folded", "left")
    rare = tokens.groupBy("key").agg(F.max(F.coalesce("df", F.lit(0))).alias("df")).filter(F.col("df") <= RARE_DF).select("key")
    # Fixed pattern: signs of a name.
    punctuated = spans.filter(F.col("key").rlike(r"[/\-.@:+_]"))
    kept = names.union(punctuated).union(spans.join(rare, "key", "left_semi").select("id", "key")).distinct()
    return kept.filter(F.length(F.regexp_replace("key", "[^A-Za-z0-9]", "")) >= 3)


def restatements(docs: DataFrame, keys: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, doc_id): documents outside the gold that hold every key of a question, in any case. A question without keys has none.

    Few questions are looked for in every text, as it is read; nothing but hits is shuffled. Of many, candidates come from postings.
    """
    sets = keys.groupBy("id").agg(F.collect_set(F.lower("key")).alias("keys"))  # keys of one answer
    if few(sets):
        pairs = holding_all(docs, sets)
        return pairs.join(gold.select(F.col("item_id").alias("id"), "doc_id"), ["id", "doc_id"], "left_anti")
    sets = beside(sets)
    holds = F.forall("keys", lambda k: F.lower("text").contains(k))
    near = candidates(docs, keys.select("id", F.explode(anchors(F.col("key"), 1)).alias("anchor")))
    pairs = docs.join(beside(near), "doc_id").join(sets, "id").filter(holds).select("id", "doc_id")
    # Keys without any letter or digit of ASCII have no postings: such questions are looked for in every text.
    bare = beside(sets.filter(F.forall("keys", lambda k: F.size(anchors(k, 1)) == 0)))
    pairs = pairs.union(docs.crossJoin(bare).filter(holds).select("id", "doc_id")).distinct()
    return pairs.join(gold.select(F.col("item_id").alias("id"), "doc_id"), ["id", "doc_id"], "left_anti")


def triage(questions: DataFrame, keys: DataFrame, found: DataFrame) -> DataFrame:
    k = keys.groupBy("id").agg(F.count("*").alias("n_keys"))
    f = found.groupBy("id").agg(F.count("*").alias("n_found"))
    out = questions.select("id").join(k, "id", "left").join(f, "id", "left").na.fill(0)
    return out.withColumn("status", F.when(F.col("n_keys") == 0, "no key").when(F.col("n_found") > BROAD, "too broad").otherwise("readable"))


def find(docs: DataFrame, needle: str) -> DataFrame:
    """Documents with ``needle`` in any case, and the text around its first hit."""
    from glintmill.functions.text import snippet

    return docs.filter(F.contains(F.lower("text"), F.lit(needle.lower()))).select("doc_id", snippet(F.col("text"), needle).alias("snippet"))


def gold_violations(entries: DataFrame, chunk_ids: DataFrame, expected: int | None = None) -> DataFrame:
    """(id, violation) of a gold set: answerable means chunks, an answer, an author; unanswerable means none, and evidence; ids are Q01, Q02 and so on
    in the order of the file, ``expected`` of them."""
    checks = [
        (F.col("answerable") & (F.size("gold_chunks") == 0), "answerable without gold"), (F.col("answerable") & F.col("gold_answer").isNull(), "answerable without an answer"),
        (F.col("answerable") & F.coalesce(F.col("answer_author") == "none", F.lit(True)), "answerable without an author"), (~F.col("answerable") & (F.size("gold_chunks") > 0), "unanswerable with gold"),
        (~F.col("answerable") & F.coalesce(F.col("answer_author") != "none", F.lit(False)), "unanswerable with an author"), (~F.col("answerable") & F.col("not_covered_because").isNull(), "unanswerable without evidence")]
    named = entries.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))).alias("violation"))
    unknown = entries.select("id", F.explode("gold_chunks").alias("chunk_id")).join(chunk_ids, "chunk_id", "left_anti").select("id", F.concat(F.lit("unknown chunk "), "chunk_id").alias("violation"))
    repeated = entries.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("violation"))
    due = F.concat(F.lit("Q"), F.lpad((F.col("pos") + 1).cast("string"), F.greatest(F.lit(2), F.length((F.col("pos") + 1).cast("string"))), F.lit("0")))
    order = entries.filter(F.col("id") != due).select("id", F.concat(F.lit("stands where "), due, F.lit(" is due")).alias("violation"))
    out = named.union(unknown).union(repeated).union(order)
    if expected is not None:
        counted = entries.agg(F.count("*").alias("n")).filter(F.col("n") != expected)
        out = out.union(counted.select(F.lit("").alias("id"), F.concat(F.col("n").cast("string"), F.lit(f" entries, not {expected}")).alias("violation")))
    return out


def checked_gold(entries: DataFrame, chunk_ids: DataFrame, expected: int | None = None) -> DataFrame:
    """``entries``, refused with the first violations if there are any."""
    guards.none_of(gold_violations(entries, chunk_ids, expected), "the gold set")
    return entries


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href) of every link."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


def paths(pages: DataFrame) -> DataFrame:
    """Paths that pages of the corpus have, without host, query and fragment."""
    return pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "").alias("href")).distinct()


def dangling(pages: DataFrame) -> DataFrame:
    """(href, n_links, n_pages) of link targets that aren't in the corpus."""
    return links(pages).join(paths(pages), "href", "left_anti").groupBy("href").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))
