"""Small cases, worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from glintmill.functions import markup as M
from glintmill.functions import text as T
from glintmill.operators import audit, bootstrap, evaluation, guards, judging, lexical, provenance, segment
from glintmill.operators import retrieval as R
from glintmill.sources import sinks
from glintmill.sources import tables as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def questions(spark, rows):
    q = spark.createDataFrame(rows, "item_id long, question string")
    return q.withColumn("terms", T.terms(F.col("question")))


def test_terms(spark):
    assert one(spark, T.terms(F.lit("The cat-sat 123 on A1b2 the MAT"))) == ["the", "cat", "sat", "a1b2", "the", "mat"]


def test_blank_text_has_no_tokens(spark):
    assert one(spark, T.token_count(F.lit(" \n\t"))) == 0
    assert one(spark, T.token_count(F.lit("don't stop."))) == 5
    assert segment.count_tokens("don't stop.") == 5


def test_plural_is_folded_only_if_the_unfolded_corpus_has_the_singular(spark):
    d = docs(spark, ["hook hooks", "hooks bus", "buses gas gass"])
    df = {r.term: r.df for r in lexical.document_frequency(d).collect()}
    assert df["hook"] == 2 and "hooks" not in df
    assert df["bus"] == 1 and df["buses"] == 1 and df["gas"] == 1 and "gass" not in df


def test_bm25_by_hand(spark):
    d = docs(spark, ["the cat sat on the mat", "the dog ran", "the bird sang"])
    scores = {(r.item_id, r.doc_id): r.score for r in R.bm25(d, questions(spark, [(0, "cat"), (1, "cat cat"), (2, "zebra")])).collect()}
    # five terms of three letters at least in the first document, three in the others
    weight = 0.980829 * 1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / (11 / 3)))
    assert scores[0, 0] == pytest.approx(weight, abs=1e-5)
    assert scores[1, 0] == pytest.approx(2 * scores[0, 0], abs=1e-8)  # each occurrence counts
    assert set(scores) == {(0, 0), (1, 0)}


def test_unscored_documents_are_ranked_last_by_id(spark):
    d = docs(spark, ["bird", "dog", "cat", "cat"])
    q = questions(spark, [(0, "cat"), (1, "zebra")])
    top = R.ranked(R.with_unscored(R.bm25(d, q), q, d, 3), "item_id", "doc_id", 3).orderBy("item_id", "rank").collect()
    assert [r.doc_id for r in top] == [2, 3, 0, 0, 1, 2]
    deep = R.ranked(R.full_depth(R.bm25(d, q), q, d), "item_id", "doc_id").filter("item_id = 1").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in deep] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_an_empty_corpus_raises(spark):
    with pytest.raises(Exception, match="an empty corpus"):
        R.statistics(docs(spark, []).select("doc_id", "text")).collect()


def test_rrf_by_hand(spark):
    lists = [spark.createDataFrame(rows, "item_id long, doc_id long, rank int") for rows in ([(0, 1, 1), (0, 2, 2)], [(0, 1, 10), (0, 2, 2)])]
    got = R.ranked(R.rrf(lists), "item_id", "doc_id").orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1]
    assert got[1].score == pytest.approx(1 / 61 + 1 / 70, abs=1e-12)
    with pytest.raises(ValueError):
        R.rrf([])


def test_dense_order_and_ties(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.7071, 0.7071]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q long, qv array<float>")
    assert [r.vec_id for r in R.ranked(R.dense(v, q), "q", "vec_id").orderBy("rank").collect()] == [0, 4, 1, 2, 3]


def test_collapse_keeps_the_best_rank_and_may_return_fewer(spark):
    hits = spark.createDataFrame([(0, 5, 1), (0, 7, 2), (0, 5, 3)], "q long, doc long, rank int")
    got = R.collapse(hits, "q", "doc", 3).orderBy("rank").collect()
    assert [(r.doc, r.rank, r.hit_rank) for r in got] == [(5, 1, 1), (7, 2, 2)]


def test_drift(spark):
    make = lambda ids: spark.createDataFrame([(0, i + 1, x) for i, x in enumerate(ids)], "item_id long, rank int, doc_id long")
    assert R.drift(make([1, 2, 3]), make([1, 3, 2])).first().first_difference == 2
    assert R.drift(make([1, 2]), make([1, 2, 3])).first().first_difference == 3
    assert R.drift(make([1, 2]), make([1, 2])).first().first_difference is None


@pytest.fixture
def scored(spark):
    runs = [("a", q, d, r) for q, ids in ((1, [10, 11, 12, 13]), (2, [20, 21, 22, 23]), (3, [30, 31, 32, 33])) for r, d in enumerate(ids, 1)]
    rankings = spark.createDataFrame(runs, "variant string, item_id long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 10), (1, 10), (1, 99), (2, 98)], "item_id long, doc_id long")
    q = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    return evaluation.score_rows(rankings, gold, q, spark.createDataFrame([(11,), (30,)], "doc_id long"))


def test_undefined_is_not_zero(scored):
    s = {r.item_id: r for r in scored.collect()}
    assert (s[1].n_gold, s[1].recall_3, s[1].reciprocal_rank, s[1].first_rank) == (2, 0.5, 1.0, 1)  # gold is deduplicated
    assert (s[2].recall_3, s[2].reciprocal_rank, s[2].first_rank) == (0.0, 0.0, None)
    assert (s[3].recall_3, s[3].precision_3, s[3].reciprocal_rank) == (None, None, None)
    assert [s[i].surface_hits for i in (1, 2, 3)] == [1, 0, 1]


def test_aggregate_counts_answerable_questions(scored, spark):
    a = evaluation.aggregate(scored).first()
    assert (a.n_answerable, a.mean_recall_3, a.no_gold_10, a.no_gold_at_all, a.gold_at_1, a.surface_hits, a.surface_slots) == (2, 0.25, 1, 1, 1, 1, 20)
    with pytest.raises(Exception, match="no answerable"):
        evaluation.aggregate(scored.filter("item_id = 3")).collect()


def test_cutoff_guard():
    guards.cutoff(3, 3)
    for k in (0, -1, 4):
        with pytest.raises(guards.GuardError):
            guards.cutoff(k, 3)


def values(spark, xs, clusters=None):
    return spark.createDataFrame([("m", c, float(x)) for c, x in zip(clusters or range(len(xs)), xs, strict=True)], "k string, cluster long, value double")


def test_interval_of_constants(spark):
    r = bootstrap.intervals(values(spark, [0.25] * 8), ["k"], reps=50).first()
    assert (r.mean, r.lo, r.hi, r.excludes_zero) == (0.25, 0.25, 0.25, True)


def test_interval_of_zeros_does_not_exclude_zero(spark):
    r = bootstrap.intervals(values(spark, [0.0] * 8), ["k"], reps=50).first()
    assert (r.lo, r.hi, r.excludes_zero) == (0.0, 0.0, False)


def test_one_cluster_collapses_the_interval(spark):
    r = bootstrap.intervals(values(spark, [0, 1, 0, 1], [7] * 4), ["k"], reps=50).first()
    assert (r.lo, r.hi) == (0.5, 0.5)


def test_interval_is_about_that_of_the_binomial(spark):
    r = bootstrap.intervals(values(spark, [0, 1] * 12), ["k"], reps=2000).first()
    assert abs(r.lo - 0.3) < 0.03 and abs(r.hi - 0.7) < 0.03


def test_clusters_must_cover_exactly(spark):
    members = spark.createDataFrame([(0,), (1,)], "member long")
    ok = [(0, 0), (0, 1)]
    guards.exact_cover(spark.createDataFrame(ok, "cluster long, member long"), members)
    for bad in ([(0, 0)], [*ok, (1, 1)], [*ok, (1, 2)]):
        with pytest.raises(guards.GuardError):
            guards.exact_cover(spark.createDataFrame(bad, "cluster long, member long"), members)


def test_needed(spark):
    d = spark.createDataFrame([("c", 0.0), ("c", 1.0), ("z", 1.0), ("z", -1.0)], "k string, diff double")
    got = {r.k: r.needed for r in bootstrap.needed(d, ["k"]).collect()}
    assert got == {"c": round((1.96 * 0.5**0.5 / 0.5) ** 2), "z": None}


@pytest.mark.parametrize("line, cells", [
    ("| a | b |", ["a", "b"]), ("| `a|b` | c |", ["a|b", "c"]), (r"| a \| b | c |", ["a | b", "c"]), ("|  a   b |  |", ["a b", ""]), ("|\ta\t| x `` y |", ["a", "x  y"]), ("a | b", ["a", "b"]), (r"| a \|", ["a |"]), ("| `open | x |", ["open | x"])])
def test_cells(spark, line, cells):
    assert one(spark, M.cells(F.lit(line))) == cells


def test_rendered_row(spark):
    row = M.rendered_row(F.array(F.lit("Key"), F.lit(""), F.lit("What")), F.array(F.lit("k"), F.lit("v"), F.lit(""), F.lit("more")))
    assert one(spark, row) == "k\nv\nColumn 4: more"


def test_separator_and_table(spark):
    assert one(spark, M.is_separator(F.lit("|---|:-:|"))) and not one(spark, M.is_separator(F.lit("| | |")))
    assert one(spark, M.is_table(F.lit("caption\n| a |\n|---|\n\n| b |"))) and not one(spark, M.is_table(F.lit("| a |\n| b |")))


@pytest.mark.parametrize("text, out", [
    ('<Tab title="npm">x</Tab><Tab>y</Tab>', "\nAlternative (npm):\nx\nAlternative:\ny"), ('<Step title="s">x</Step>', "\ns\nx"), ("a{/* b\nc */}d", "ad"), ("<Note>x</Note><br /><article>", "x<article>"),
    ("<BR/>", "<BR/>"), ('<Card icon="i" title="T" href="h">d</Card>', "\nT\nd"), ("```\n<div>{/* x */}\n```\n<div>y</div>", "```\n<div>{/* x */}\n```\ny"), ("```\n<div>open", "```\nopen"),
    ('<Steps><Step title="a"></Step><Step></Step></Steps> <Steps><Step title="b"></Step></Steps>', "\n1. a\n\n2.\n \n1. b\n")])
def test_transform(spark, text, out):
    assert one(spark, M.transform(F.lit(text))) == out


def test_rules_on_strings_are_those_on_columns(spark):
    """Random mixtures of what the rules look at."""
    import random

    from glintmill.functions import plain as P

    rng = random.Random(3)
    parts = ['<Tab title="a">', "<Tab>", "</Tabs>", "<Tabs x>", "<Steps>", '<Step title="s">', "<Step>", "</Step>", "</Steps>", '<Card icon="i" title="T">', "</Card>", '<Accordion title="w">', "{/* c", "*/}", "<Note>", "<br />", "<DIV a>", "```", "\n", "\n```\n", "x", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    got = docs(spark, texts).select("doc_id", M.transform(F.col("text")).alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == {i: P.transform(t) for i, t in enumerate(texts)}
    rows = ["".join(rng.choice(["|", "`", "\\", "\\|", "a", "  ", " ", "\t", "-", ":"]) for _ in range(rng.randint(1, 20))) for _ in range(600)]
    got = docs(spark, rows).select("doc_id", M.cells(F.col("text")).alias("c"), M.is_separator(F.col("text")).alias("s")).collect()
    assert {r.doc_id: (r.c, r.s) for r in got} == {i: (P.cells(t), P.is_separator(t)) for i, t in enumerate(rows)}


def test_markdown_units_tile_and_keep_fences_whole():
    text = "# T\n\nprose\nmore\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n\nstill\n```\nafter\n```\nopen"
    units = segment.markdown_units(text)
    assert "".join(text[u.start : u.end] for u in units) == text
    assert [u.kind for u in units] == ["prose", "whitespace", "prose", "whitespace", "table_scaffold", "table_scaffold", "table_row", "whitespace", "code", "prose"]
    assert [u.shown for u in units] == ["# T", "", "prose\nmore", "", "", "", "1\nb: 2", "", "```\ncode\n\nstill\n```\n", "after\n```\nopen"]


def test_what_is_embedded(spark):
    text = "<Note>one</Note>\n\n\n\n| a | b |\n|---|---|\n| 1 | <b>2{/* x */} |\n\n```\ncode\n\nmore\n```\n\nlast"
    row = segment.greedy_chunks(docs(spark, [text]), markdown=True).first()
    assert row.text == text and row.text_embed == "one\n\n1\nb: <b>2\n\n```\ncode\n\nmore\n```\n\nlast"
    assert row.n_tokens == segment.count_tokens(row.text_embed) and row.block_type == "prose"


def test_a_split_fence_keeps_its_blank_lines(spark):
    text = "before\n\n```\n" + "word word word word\n\n" * 100 + "```\n"
    chunks = segment.greedy_chunks(docs(spark, [text]), markdown=True).orderBy("idx").collect()
    assert "".join(c.text for c in chunks) == text and len(chunks) == 2 and all(c.n_tokens <= segment.BUDGET for c in chunks)
    assert chunks[0].text_embed.startswith("before\n\n```\nword word word word\n\nword") and "\n\n\n" not in chunks[0].text_embed


def test_dense_lines_fit(spark):
    """Punctuation and letters of other scripts are a token each."""
    texts = ["?!" * 700, "é" * 1200, "| a | b |\n|---|---|\n| x | " + "?" * 1000 + " |", "{/* " + "!" * 900 + " */}end"]
    for markdown in (False, True):
        chunks = segment.greedy_chunks(docs(spark, texts), markdown)
        guards.within_tokens(chunks, segment.BUDGET)
        assert all(r.whole for r in segment.partition_check(chunks, docs(spark, texts)).collect())


def test_line_spans_of_rows_that_share_an_id(spark):
    d = spark.createDataFrame([(1, "a\nbc"), (1, "xyz\n"), (2, ""), (3, None), (4, "\n" * 600)], "doc_id long, text string")
    rows = segment.line_spans(d).collect()
    assert sorted((r.line_no, r.start, r.end) for r in rows if r.doc_id == 1) == [(0, 0, 2), (0, 0, 4), (1, 2, 4)]
    assert sorted((r.line_no, r.start, r.end) for r in rows if r.doc_id == 4) == [(i, i, i + 1) for i in range(600)] and {r.doc_id for r in rows} == {1, 4}


def test_titles(spark):
    for text, title in (("x\n#  Hello \n# b", "Hello"), ("#no\n## no", "(untitled)"), ("# ", ""), ("a\r\n# b\r\nc", "b"), ("", "(untitled)")):
        assert one(spark, T.title(F.lit(text))) == title


def test_packing(spark):
    u = lambda n: segment.Unit(0, 0, "prose", "x" * bool(n), n)
    assert [[x.tokens for x in c] for c in segment.packed([u(200), u(0), u(54), u(0), u(1), u(254), u(0)])] == [[200, 0, 54, 0], [1], [254, 0]]
    assert segment.packed([]) == []
    long = docs(spark, ["word " * 900 + "\n\n" + "x" * 1200, "", "\n\n"])
    chunks = segment.greedy_chunks(long)
    assert all(r.whole for r in segment.partition_check(chunks, long).collect())
    guards.within_tokens(chunks, segment.BUDGET)


def test_block_type_is_by_units_and_then_by_name():
    u = lambda k, n: segment.Unit(0, 0, k, "x", n)
    assert segment.block_type([u("prose", 1), u("prose", 1), u("code", 5)]) == "prose"
    assert segment.block_type([u("prose", 2), u("code", 2)]) == "code"
    assert segment.block_type([]) == "whitespace"


def test_no_keys_no_restatement(spark):
    keys = spark.createDataFrame([(1, "Alpha"), (1, "b.md")], "id long, key string")
    gold = spark.createDataFrame([(1, 0)], "item_id long, doc_id long")
    d = docs(spark, ["alpha B.MD", "ALPHA b.md", "alpha"])
    found = audit.restatements(d, keys, gold)
    assert [(r.id, r.doc_id) for r in found.collect()] == [(1, 1)]
    status = audit.triage(spark.createDataFrame([(1,), (2,)], "id long"), keys, found).orderBy("id").collect()
    assert [r.status for r in status] == ["readable", "no key"]


def test_answer_keys(spark):
    d = docs(spark, ["the bash thing"] * 20 + ["rare rewinding"])
    a = spark.createDataFrame([(1, "Use /init and CLAUSE.md, `bash`, `rewinding`, `two words`, `-x` or `--fork`; fooBarBaz.")], "id long, answer string")
    got = {r.key for r in audit.answer_keys(a, lexical.document_frequency(d), lexical.vocabulary(d)).collect()}
    assert got == {"/init", "CLAUSE.md", "rewinding", "--fork", "fooBarBaz"}


@pytest.mark.parametrize("raw, error, picked", [
    ("1 3", None, [1, 3]), ("2,1", None, [2, 1]), (" NONE ", None, []), ("", "blank", []), ("  ", "blank", []), ("0", "out of range", []), ("4", "out of range", []), ("1 1", "repeated", []), ("x", "not a number", []),
    ("99999999999", "out of range", [])])
def test_selection(spark, raw, error, picked):
    got = one(spark, judging.parsed_selection(F.lit(raw), F.lit(3)))
    assert (got.error, got.picked) == (error, picked)


def test_pools_hold_all_gold_and_enough_others(spark):
    gold = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (2, 22)], "item_id long, doc_id long")
    ranking = spark.createDataFrame([(q, d) for q in (1, 2, 3) for d in range(10 * q, 10 * q + 8)], "item_id long, doc_id long")
    pool = judging.pools(gold, ranking)
    assert {(r.item_id, r.c, r.g) for r in pool.groupBy("item_id").agg(F.count("*").alias("c"), F.count_if("gold").alias("g")).collect()} == {(1, 3, 1), (2, 6, 3)}
    with pytest.raises(Exception, match="too few"):
        judging.pools(gold, ranking.filter("doc_id < 12")).collect()
    with pytest.raises(Exception, match="unknown document"):
        judging.with_text(pool, docs(spark, ["x"])).collect()


def test_a_question_whose_ranking_is_all_gold_raises(spark):
    gold = spark.createDataFrame([(1, 10), (2, 20)], "item_id long, doc_id long")
    ranking = spark.createDataFrame([(1, 10), *[(2, d) for d in range(20, 26)]], "item_id long, doc_id long")
    with pytest.raises(Exception, match="too few"):
        judging.pools(gold, ranking).collect()
    assert judging.pools(gold.filter("item_id = 2"), ranking).count() == 3


@pytest.mark.parametrize("wave", [1 << 22, 40])
def test_dense_top_is_that_of_all_pairs(spark, monkeypatch, wave):
    """No row for every pair: candidates are picked in the tasks, ties and odd vectors included."""
    from glintmill.operators import nearest

    monkeypatch.setattr(nearest, "WAVE", wave)
    draw = random.Random(7)
    made = [[float(draw.randint(-2, 2)) / 3 for _ in range(5)] for _ in range(120)]
    made[3], made[50], made[51], made[52], made[80] = None, [1.0, None, 0.0, 0.0, 0.0], [1.0], [float("inf"), 0.0, 0.0, 0.0, 1.0], made[20]
    v = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    want = R.ranked(R.dense(v, q).filter("q <> vec_id"), "q", "vec_id", 7)
    got = nearest.dense_top(v, q, 7)
    key = lambda df: sorted((r.q, r["rank"], r.vec_id, str(r.score)) for r in df.select("q", "rank", "vec_id", "score").collect())
    assert key(got) == key(want)
    few = nearest.dense_top(v.filter("vec_id < 4"), q, 7)
    assert {(r.q, r.vec_id) for r in few.collect()} == {(a, b) for a in range(0, 120, 10) for b in range(4) if a != b}
    clean = nearest.dense_top(v.filter("vec_id > 90"), q.filter("q > 90"), 7)
    assert "NestedLoop" not in clean._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in clean._jdf.queryExecution().executedPlan().toString()


def test_scores_in_tasks_are_those_of_joins(spark, monkeypatch):
    from glintmill.operators import scored

    monkeypatch.setattr(scored, "CELLS", 20)
    monkeypatch.setattr(scored, "REMEMBERED", 5)
    draw = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "K\u0130ng", "\u212aelvin", "x1", "123", "eps"]
    d = docs(spark, [" ".join(draw.choice(words) for _ in range(draw.randint(0, 12))) for _ in range(60)] + [None, "alpha"]).repartition(3)
    q = spark.createDataFrame([(1, ["alpha", "beta", "beta"]), (2, ["kelvin", "none"]), (3, []), (4, ["eps"])], "item_id long, terms array<string>")
    asked = scored.Asked(d, q)
    keyword, dense = R.full_depth(R.bm25(d, q), q, d), R.dense_by_terms(d, q)
    key = lambda df, *names: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("item_id", "doc_id", "score", *names).collect())
    assert key(scored.full_scores(d, asked)) == key(keyword)
    fused = R.rrf([R.ranked(keyword, "item_id", "doc_id"), R.ranked(dense, "item_id", "doc_id")])
    assert key(scored.fused_scores(d, asked)) == key(fused)
    tops = scored.variants(d, asked, 7)
    for name, scores in (("bm25", keyword), ("dense", dense), ("hybrid", fused)):
        want = key(R.ranked(scores, "item_id", "doc_id", 7), "rank")
        assert key(tops.filter(F.col("variant") == name), "rank") == want
        if name != "hybrid":
            assert key(scored.top_scores(d, asked, 7, dense=name == "dense"), "rank") == want
    named = d.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert key(scored.top_scores(named, scored.Asked(named, q), 7), "rank") == key(R.ranked(R.full_depth(R.bm25(named, q), q, named), "item_id", "doc_id", 7), "rank")
    with pytest.raises(ValueError, match="empty corpus"):
        scored.Asked(d.limit(0), q)
    assert "Join" not in scored.fused_scores(d, asked)._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_made_in_small_batches(spark):
    """A worker holds the chunks of one batch: of ten thousand texts these are gigabytes."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    segment.greedy_chunks(docs(spark, ["one"])).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20


def test_density_counts_texts_once(spark):
    d = docs(spark, ["a b", "abc", "x y z"]).withColumn("lang", F.lit("en"))
    df = segment.density(d, "lang")
    assert "InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString()
    row = df.first()
    assert (row.n, row.least) == (3, 1.5) and row.median == 1.666667


def test_token_count_is_that_of_the_pattern(spark):
    texts = ["", " \t\x0b", "ab1 c\u00e9d \U0001f600\u00a0x_y--z\r\n$1 \\a", "e\u0301 \u0130 \u200b", None]
    df = docs(spark, texts).select(T.token_count(F.col("text")).alias("a"), F.coalesce(F.regexp_count("text", F.lit(T.TOKEN)), F.lit(0)).alias("b"))
    assert [r.a for r in df.collect()] == [r.b for r in df.collect()]
    assert "regexp_count" not in df.select("a")._jdf.queryExecution().analyzed().toString().split("AS a")[0]


def test_frequency_of_what_is_asked_is_that_of_all(spark):
    """Words of the corpus that no question's term folds to aren't counted."""
    d = docs(spark, ["clas class classs", "class classs cat", "cats dogs", "other words cat cats", "dogss"])
    terms = spark.createDataFrame([(t,) for t in ("class", "classs", "cat", "dogs", "none")], "term string")
    whole = {r.term: r["df"] for r in lexical.document_frequency(d).collect()}
    part = {r.term: r["df"] for r in lexical.document_frequency(d, lexical.related(terms)).collect()}
    asked = {"clas", "class", "classs", "cat", "dogs", "dog", "none"}
    assert {t: n for t, n in part.items() if t in asked} == {t: n for t, n in whole.items() if t in asked}
    assert "words" in whole and "words" not in part


def test_a_short_pool_holds_all_that_there_is(spark):
    gold = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (2, 22)], "item_id long, doc_id long")
    ranking = spark.createDataFrame([(1, 10), *[(2, d) for d in range(20, 25)]], "item_id long, doc_id long")
    pool = judging.pools(gold, ranking, short=True)
    assert {(r.item_id, r.doc_id, r.gold) for r in pool.collect()} == {(1, 10, True), *[(2, d, d < 23) for d in range(20, 25)]}
    assert sorted(r.place for r in pool.filter("item_id = 2").collect()) == [1, 2, 3, 4, 5]


def test_few_questions_are_looked_for_in_each_text_without_postings(spark):
    """What is compared with the vocabulary grows with questions times words: no text may be taken apart for a few questions."""
    d = docs(spark, ["one two three", "Two THREE one", "two"])
    q = spark.createDataFrame([(1, "two three"), (2, "two"), (3, "")], "item_id long, question string")
    gold = evaluation.gold_by_containment(d, q)
    assert {(r.item_id, r.doc_id) for r in gold.collect()} == {(1, 0), (2, 0), (2, 2)}
    keys = spark.createDataFrame([(1, k) for k in ("one", "two", "three", "tw", "hre", "e", "o", "ne")] + [(2, "two")], "id long, key string")
    found = audit.restatements(d, keys, gold)
    assert {(r.id, r.doc_id) for r in found.collect()} == {(1, 1), (2, 1)}
    for df in (gold, found):
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_many_questions_give_the_same_by_postings(spark, monkeypatch):
    d = docs(spark, ["one two three", "Two THREE one", "two"])
    q = spark.createDataFrame([(1, "two three"), (2, "two")], "item_id long, question string")
    monkeypatch.setattr(S, "FEW", 1)
    gold = evaluation.gold_by_containment(d, q)
    assert {(r.item_id, r.doc_id) for r in gold.collect()} == {(1, 0), (2, 0), (2, 2)}
    keys = spark.createDataFrame([(1, "one"), (1, "hre"), (2, "two")], "id long, key string")
    assert {(r.id, r.doc_id) for r in audit.restatements(d, keys, gold).collect()} == {(1, 1), (2, 1)}


def test_labelling_goes_on_where_it_stopped(spark, tmp_path):
    from glintmill.operators import labelling

    pools = spark.createDataFrame([(q, p, f"{q}-{p}", f"text {p}") for q in ("Q01", "Q02", "Q03") for p in (1, 2, 3)], "question_id string, place int, chunk_id string, text string")
    asked = spark.createDataFrame([(q, f"What {q}?", "This.") for q in ("Q01", "Q02", "Q03")], "question_id string, question string, gold_answer string")
    path, said = str(tmp_path / "labels"), []

    def session(answers, only=None):
        left = iter(answers)
        return labelling.label_pools(pools, asked, path, only, lambda _: next(left), said.append)

    assert session(["", "1 9", "1 3", "q"]) == 1 and said[1:3] == ["  blank", "  out of range"] and "What Q01?" in said[0] and "[3] Q01-3" in said[0]
    assert session(["none"], "Q03") == 1 and session(["2"]) == 1 and session([]) == 0
    assert {(r.question_id, r.chunk_id) for r in S.label_file(spark, path).filter("necessary = 1").collect()} == {("Q01", "Q01-1"), ("Q01", "Q01-3"), ("Q02", "Q02-2")} and S.label_file(spark, path).count() == 9
    for only in ("Q01", "Q09"):
        with pytest.raises(ValueError):
            session([], only)


def test_pages_are_fetched_and_failures_kept(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from glintmill.sources.web import fetch_pages

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.path == "/docs/a.md" and self.headers["User-Agent"].startswith("glintmill")
            self.send_response(200 if known else 404)
            self.end_headers()
            self.wfile.write("# Ä\n".encode() if known else b"")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    slugs = spark.createDataFrame([("a",), ("b",)], "slug string")
    got = {r.slug: (r.text, r.error) for r in fetch_pages(slugs, f"http://127.0.0.1:{server.server_port}/docs").collect()}
    server.shutdown()
    server.server_close()
    assert got == {"a": ("# Ä\n", None), "b": (None, "HTTP 404")}
    gone = fetch_pages(slugs, f"http://127.0.0.1:{server.server_port}/docs", timeout=2).collect()
    assert all(r.text is None and r.error for r in gone) and len(gone) == 2


def test_shown_paths():
    from glintmill.operators.report import shown_path

    assert shown_path("/a/b/c.json", "/a") == "b/c.json" and shown_path("/tmp/x.json", "/a") == "/tmp/x.json"


def test_majority(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 1, 0), (1, 2, 1), (1, 2, 0)], "item_id long, doc_id long, necessary int")
    assert {(r.doc_id, r.necessary) for r in judging.majority(rows).collect()} == {(1, 1), (2, 0)}


def test_readers_and_writers(spark, tmp_path):
    labels = spark.createDataFrame([("Q01", "d:c1", 1)], S.LABEL_SCHEMA)
    for _ in range(2):
        sinks.append_labels(labels, str(tmp_path / "labels"))
    assert S.label_file(spark, str(tmp_path / "labels")).count() == 2
    r = spark.createDataFrame([("Q01", 2, "b", 0.1234567), ("Q01", 1, "a", 0.5)], "question_id string, rank int, chunk_id string, score double")
    sinks.ranking_file(r, str(tmp_path / "runs"))
    line = spark.read.json(str(tmp_path / "runs")).first()
    assert [(x.rank, x.chunk_id, x.score) for x in line.questions[0].retrieved] == [(1, "a", 0.5), (2, "b", 0.123457)]
    (tmp_path / "t.md").write_text("a\r\nb")
    assert S.whole_texts(spark, str(tmp_path / "t.md")).first().text == "a\nb"
    assert not sinks.is_stale(r, r) and sinks.is_stale(r, r.limit(1))


@pytest.fixture
def small_index(spark):
    texts = ["# A\n\none two\n\n| k | v |\n|---|---|\n| a | 1 |", "<Note>b</Note>", "<Note>b</Note> "]
    records = segment.chunk_records(segment.greedy_chunks(docs(spark, texts), markdown=True))
    vectors = records.select("id").withColumn("embedding", F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>"))
    numbered = vectors.withColumn("vec_id", F.split_part("id", F.lit(":"), F.lit(1)).cast("long"))
    return records, vectors, provenance.manifest("c" * 64, records, numbered, "hashed-terms")


def test_an_index_is_read_as_it_was_written(spark, small_index, tmp_path):
    records, vectors, manifest = small_index
    path = str(tmp_path / "index")
    sinks.index(manifest, records, vectors, path)
    m, chunks, back = S.index(spark, path, "c" * 64, "hashed-terms")
    assert (m["n_chunks"], m["embedding_dim"], m["normalized"], m["token_limit"]) == (3, 2, True, 254) and set(m["versions"]) == set(provenance.LIBRARIES)
    assert sorted(chunks.collect()) == sorted(records.withColumn("slug", F.lit(None).cast("string")).select(*chunks.columns).collect()) and back.count() == 3
    assert sorted(r.id for r in spark.read.json(f"{path}/duplicate_groups").collect()) == ["1:c000", "2:c000"]
    for bad in ({"corpus_sha256": "d" * 64}, {"model": "another"}):
        with pytest.raises(guards.GuardError):
            S.index(spark, path, **bad)
    vectors.limit(2).write.mode("overwrite").parquet(f"{path}/vectors")
    with pytest.raises(guards.GuardError, match="left only"):
        S.index(spark, path)


def test_vectors_have_one_hash_whatever_their_partitions(spark):
    v = spark.createDataFrame([(i, [i / 7, -0.5]) for i in range(3000)], "vec_id long, embedding array<float>")
    one_ = provenance.vector_fingerprint(v).first()
    assert provenance.vector_fingerprint(v.repartition(7)).first() == one_ != provenance.vector_fingerprint(v.limit(2999)).first()


GOLD = """# Gold

## Q01

**Question:** What?
**Type:** fact
**Answerable:** Yes
**Gold chunks:** `doc-02:c001`, `doc-01:c002`
**Gold answer:** This
and that.
**Not covered because:** n/a
**Authorship:** question=human, answer=human

## Q02

**Question:** Why?
**Type:**
**Answerable:** no
**Gold chunks:**
**Gold answer:**
**Not covered because:** nothing says so
**Authorship:** question=human, answer=none
"""


def test_a_gold_set_is_written_the_same_each_time(spark, tmp_path):
    entries = S.parsed_gold(spark.createDataFrame([(GOLD,)], "text string"))
    ids = spark.createDataFrame([("doc-02:c001",), ("doc-01:c002",)], "chunk_id string")
    manifest, path = {"corpus_sha256": "c" * 64, "n_chunks": 2}, str(tmp_path / "gold")
    sinks.gold_file(audit.checked_gold(entries, ids, 2), manifest, path)
    assert sinks.gold_is_current(entries.repartition(3), manifest, path)
    assert not sinks.gold_is_current(entries, manifest | {"n_chunks": 3}, path)
    corpus, back = S.gold_set(spark, path)
    rows = back.collect()
    assert corpus == "c" * 64 and [r.id for r in rows] == ["Q01", "Q02"] and rows[0].gold_docs == ["doc-01", "doc-02"] and rows[0].gold_answer == "This and that." and rows[1].type is None
    counts = spark.read.json(path).first().counts
    assert (counts.questions, counts.answerable, counts.unanswerable, counts.gold_chunks_total, counts.multi_chunk_answerable) == (2, 1, 1, 2, 1) and counts.answer_author.asDict() == {"human": 1, "none": 1}


def test_gold_that_is_wrong_is_refused(spark):
    ids = spark.createDataFrame([("doc-02:c001",), ("doc-01:c002",)], "chunk_id string")
    read = lambda text: S.parsed_gold(spark.createDataFrame([(text,)], "text string"))
    found = {(r.id, r.violation) for r in audit.gold_violations(read(GOLD.replace("## Q02", "## Q03")), ids, 3).collect()}
    assert found == {("Q03", "stands where Q02 is due"), ("", "2 entries, not 3")}
    with pytest.raises(guards.GuardError):
        audit.checked_gold(read(GOLD.replace("doc-01:c002", "doc-01:c009")), ids)
    with pytest.raises(Exception, match="no Authorship"):
        read(GOLD.replace("**Authorship:** question=human, answer=none", "")).collect()


def test_runs_say_what_they_are_of(spark, tmp_path):
    r = spark.createDataFrame([("Q01", 2, "b", 0.25), ("Q01", 1, "a", 0.5), ("Q02", 1, "c", None)], "question_id string, rank int, chunk_id string, score double")
    path = str(tmp_path / "run")
    sinks.ranking_file(r, path, {"variant": "dense", "corpus_sha256": "c" * 64, "top": 20})
    header = S.run_header(spark, path)
    assert header == {"variant": "dense", "corpus_sha256": "c" * 64, "vectors_sha256": None, "model": None, "top": 20}
    assert [tuple(x) for x in S.rankings(spark, path, "dense").orderBy("question_id", "rank").collect()] == [("dense", "Q01", 1, "a", 0.5), ("dense", "Q01", 2, "b", 0.25), ("dense", "Q02", 1, "c", None)]
    with pytest.raises(guards.GuardError):
        guards.same_fingerprint(header["corpus_sha256"], "d" * 64, "gold and run")


def test_lists_must_reach_the_cutoff(spark):
    r = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 1)], "variant string, item_id long, rank int")
    guards.lists_reach(r.filter("item_id = 1"), 2)
    for rows, k in ((r, 2), (r, 0)):
        with pytest.raises(guards.GuardError):
            guards.lists_reach(rows, k)


def test_combined_file_verifies_its_markers(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"p{i}", f"# T{i}\n" + "line\n" * (i * 7 % 5)) for i in range(1, 13)], "n long, slug string, text string")
    lines = segment.combined_lines(pages, ["# All", ""])
    got = [r.line for r in lines.orderBy("line_no").collect()]
    expected = ["# All", ""]
    for i in range(1, 13):
        expected += ["", f"@@PAGE {i:02d}/12 :: p{i}", "", f"# T{i}", *["line"] * (i * 7 % 5)]
    assert got == expected and [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, len(expected) + 1))
    markers = lines.filter(F.col("line").startswith("@@PAGE"))
    assert sorted(r.line_no for r in markers.collect()) == sorted(r.body_line for r in segment.combined_offsets(pages.select("n", "text"), 2).collect())
    sinks.combined_file(lines, markers, str(tmp_path / "all"))
    with pytest.raises(guards.GuardError):
        sinks.combined_file(lines, markers.withColumn("line_no", F.col("line_no") + 1), str(tmp_path / "all"))


def test_deep_ranks_are_those_of_a_sort(spark, monkeypatch):
    import random

    from glintmill.operators import ordered

    monkeypatch.setattr(ordered, "BUCKET", 10)
    rng = random.Random(4)
    rows = [(q, d, rng.choice([0.0, 0.0, -0.3, 0.25, rng.random() / 1000, rng.random() * 9])) for q in (1, 2) for d in range(120)]
    got = {(r.q, r.d): r.rank for r in ordered.deep_ranks(spark.createDataFrame(rows, "q long, d long, score double"), "q", "d").collect()}
    for q in (1, 2):
        order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert [got[q, d] for _, d, _ in order] == list(range(1, 121))


def test_depth_of_gold_is_that_of_a_sort(spark):
    scores = spark.createDataFrame([(1, 3, 2.0), (1, 5, 2.0), (1, 8, 1.0), (2, 0, 1.0)], "item_id long, doc_id long, score double")
    d = docs(spark, ["x"] * 10)
    gold = spark.createDataFrame([(1, 5), (1, 8), (1, 0), (1, 4), (1, 9), (2, 9), (3, 2)], "item_id long, doc_id long")
    got = {(r.item_id, r.doc_id): r["rank"] for r in R.depth_of(scores, d, gold).collect()}
    assert got == {(1, 5): 2, (1, 8): 3, (1, 0): 4, (1, 4): 7, (1, 9): 10, (2, 9): 10, (3, 2): 3}


def test_gold_is_found_whatever_the_question_is_made_of(spark):
    """Parts of words at its ends, other scripts, signs only, capitals, repeats; an empty question is in nothing."""
    texts = ["bobcat satin here", "Bobcat Satin", "中文字", "a中文b", "?!", "x ?! y", "", None, "cat sat cat sat"]
    asked = [(0, "cat sat"), (1, "中文"), (2, "?!"), (3, ""), (4, "Cat Sat"), (5, "zebra"), (6, "cat sat cat")]
    got = {(r.item_id, r.doc_id) for r in evaluation.gold_by_containment(docs(spark, texts), spark.createDataFrame(asked, "item_id long, question string")).collect()}
    assert got == {(i, d) for i, q in asked for d, t in enumerate(texts) if q and t and q in t}


def test_restatements_with_signs_only(spark):
    keys = spark.createDataFrame([(1, "--"), (2, "b.md"), (2, "É"), (3, "lph")], "id long, key string")
    gold = spark.createDataFrame([], "item_id long, doc_id long")
    found = {(r.id, r.doc_id) for r in audit.restatements(docs(spark, ["x -- y", "B.MD é", "ab.mdx --É", "ALPHA"]), keys, gold).collect()}
    assert found == {(1, 0), (1, 2), (2, 1), (2, 2), (3, 3)}


def test_document_frequency_of_documents_in_several_rows(spark):
    d = spark.createDataFrame([(1, "hook"), (1, "hooks bus"), (2, "hooks"), (3, "hook hooks"), (4, None)], "doc_id long, text string")
    assert {r.term: r.df for r in lexical.document_frequency(d).collect()} == {"hook": 3, "bus": 1}
    one_row = d.filter("doc_id > 1")
    assert {r.term: r.df for r in lexical.document_frequency(one_row).collect()} == {"hook": 2}


def test_kept_frames_follow_their_tables(spark, tmp_path):
    from glintmill.sources import holding

    path = str(tmp_path / "documents.parquet")
    make = lambda: holding.kept(spark, str(tmp_path), "n", lambda: spark.read.parquet(path).selectExpr("count(*) AS n"), ("documents",)).first().n
    spark.range(3).write.parquet(path)
    assert make() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert make() == 5
    holding.release(spark)
    assert make() == 5


def test_an_empty_type_does_not_take_the_next_line(spark):
    body = "\n**Type:**\n**Source:** x\n"
    assert one(spark, S.gold_field(F.lit(body), "Type")) is None
    assert one(spark, S.gold_field(F.lit(body), "Source")) == "x"


def test_chunks_of_a_stream(spark, tmp_path):
    from glintmill.streaming.ingest import chunk_stream

    docs(spark, ["one two", "three " * 400]).write.parquet(str(tmp_path / "in"))
    query = chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == segment.greedy_chunks(docs(spark, ["one two", "three " * 400])).count()


def test_running_totals_and_order_statistics(spark):
    import random

    from glintmill.operators import ordered

    rng = random.Random(1)
    rows = [(k, i * 50_000, rng.random() * 9) for i in range(40) for k in "ab"]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    got = {(r.k, r.i): r.before for r in ordered.running_total(df, ["k"], "i", F.lit(2)).collect()}
    assert got == {(k, i): 2 * (i // 50_000) for k, i, _ in rows}
    stats = ordered.order_statistics(df, "k", "x", {"first": F.lit(0), "tenth": F.floor(F.col("n") * 0.1), "last": F.col("n") - 1}).collect()
    for r in stats:
        xs = sorted(x for k, _, x in rows if k == r.k)
        assert (r["first"], r.tenth, r.last) == (xs[0], xs[4], xs[-1])


def test_reports(spark):
    from glintmill.operators import report

    df = spark.createDataFrame([("b", 1234.5678, 1), ("a", None, 2)], "variant string, mean double, n int")
    assert report.markdown(df, ["variant"]) == "| variant | mean | n |\n|---|---|---|\n| a | undefined | 2 |\n| b | 1234.568 | 1 |\n"
    with pytest.raises(ValueError):
        report.markdown(df, ["n"], most=1)
    diffs = spark.createDataFrame([("x-y", "m", True), ("x-z", "m", False)], "comparison string, metric string, excludes_zero boolean")
    assert report.confidence(df.withColumn("metric", F.lit("m")), diffs).endswith("1 of 2 exclude zero.\n")
    whole = report.confidence(df.withColumn("metric", F.lit("m")), diffs, seeds=spark.createDataFrame([(7, 0.5)], "seed int, lo double"), needed=spark.createDataFrame([("m", 106)], "metric string, needed long"))
    assert "## Under other seeds\n\n| seed | lo |\n|---|---|\n| 7 | 0.500 |" in whole and "| m | 106 |" in whole and "drawn as one" not in whole


def test_baseline_report(spark, scored):
    from glintmill.operators import report

    text = report.baseline(evaluation.aggregate(scored), scored, {"variant": "a", "corpus_sha256": "c" * 64, "model": "m", "top": 4})
    assert "Corpus `cccccccccccccccc`" in text and "| recall_3 | 0.250 |" in text and "1 of 2 have no gold in the first ten" in text and "undefined" in text.splitlines()[-1]


def test_inspection(spark, small_index):
    from glintmill.operators import report

    text = report.inspection(segment.inspected(small_index[0], ("1",), ("<Note",)))
    assert text.count("## `") == 3 and "document 1" in text and "<Note> region" in text and "block_type=prose" in text and "**text_embed**\n```\nb\n```" in text


def test_interval_of_reciprocal_ranks(spark):
    ranks = [1, 1, 2, 3, 5, 8, 10, 15, None, None]
    rows = [("v", i, "r", True, 1.0 / r if r else 0.0) for i, r in enumerate(ranks)]
    values_ = spark.createDataFrame([(v, i, m, x) for v, i, m, _, x in rows], "k string, cluster long, metric string, value double")
    r = bootstrap.intervals(values_, ["k"], reps=400).first()
    assert r.mean == pytest.approx(sum(1.0 / x for x in ranks if x) / len(ranks), abs=1e-6) and r.lo < r.mean < r.hi


def test_texts_are_not_compared_with_each_question(spark):
    """Work that grows with texts times questions is a nested loop in the plan."""
    d = docs(spark, ["one two three", "Two THREE one", "two"])
    gold = evaluation.gold_by_containment(d, spark.createDataFrame([(1, "two three")], "item_id long, question string"))
    found = audit.restatements(d, spark.createDataFrame([(1, "one"), (1, "hre")], "id long, key string"), gold)
    assert [(r.id, r.doc_id) for r in found.collect()] == [(1, 1)]
    for df in (gold, found):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_seeking_by_runs_is_seeking_each(monkeypatch):
    from glintmill.operators import seeking

    monkeypatch.setattr(seeking, "REMEMBERED", 7)
    monkeypatch.setattr(seeking, "SHORT", 6)
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab1 -é") for _ in range(rng.randrange(n))).encode()
    for _ in range(800):
        passages, sets = [some(8) for _ in range(6)], [[some(6) for _ in range(rng.randrange(4))] for _ in range(6)]
        passage, keys = seeking.Passages(passages).finder(), seeking.KeySets(sets).finder()
        for text in (some(40), some(6) + rng.choice(passages) + some(6), b"".join(k + some(3) for k in sets[0])):
            assert sorted(passage(text)) == [i for i, p in enumerate(passages) if p and p in text]
            assert sorted(keys(text)) == [i for i, s in enumerate(sets) if s and all(k in text for k in s)]


def test_depths_are_counted_without_ranking(spark, monkeypatch):
    from glintmill.operators import scored

    monkeypatch.setattr(scored, "CELLS", 20)
    draw = random.Random(3)
    d = docs(spark, [" ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(draw.randint(0, 5))) for _ in range(80)] + [None]).repartition(3)
    q = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["none"]), (3, []), (4, ["delta"])], "item_id long, terms array<string>")
    gold = spark.createDataFrame([(1, 7), (1, 60), (2, 9), (3, 70), (3, 80), (1, 7)], "item_id long, doc_id long")
    ranks = R.ranked(R.full_depth(R.bm25(d, q), q, d), "item_id", "doc_id").join(gold, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("depth"))
    for rows, wanted in ((d, gold), (d.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 3, "0")), gold.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 3, "0")))):
        got = scored.depths(rows, scored.Asked(rows, q), wanted)
        assert {(r.item_id, r.depth) for r in got.collect()} == {(r.item_id, r.depth) for r in ranks.collect()}
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_drift_reads_the_corpus_twice(spark, sf_dir, monkeypatch):
    from glintmill.operators import scored
    from glintmill.plans import retrieval as plans

    asked, count = [], scored.Asked._count
    monkeypatch.setattr(scored.Asked, "_count", lambda *a: asked.append(1) or count(*a))
    assert plans.ranking_drift(spark, sf_dir).columns == ["item_id", "first_difference"] and len(asked) == 1


def test_words_in_columns_are_those_of_patterns():
    import hashlib
    import re

    import pyarrow as pa

    from glintmill.operators import wordwise

    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ19 -éİK\n\tß\x1c\x00q") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " ", "  abc  ", "x" * 55 + " " + "y" * 56 + " " + "z" * 300]
    for a in range(0, len(texts), 61):
        column = pa.array(texts)[a : a + 61]
        words, at = wordwise.words(column, wordwise.LOWER)
        real = wordwise.are_terms(words)
        for row, t in enumerate(column.to_pylist()):
            want = [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) >= 3 and not w.isdigit()]
            assert [w for w, i, k in zip(words.to_pylist(), at, real, strict=True) if k and i == row] == want
        assert wordwise.hashes(words, {}).tolist() == [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words.to_pylist()]
    assert [len(x) for x in wordwise.words(pa.array([], pa.string()), wordwise.LOWER)] == [0, 0]


def test_passages_are_found_by_eight_bytes():
    import numpy as np

    from glintmill.operators import seeking

    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("ab -é") for _ in range(rng.randrange(n))).encode()
    for _ in range(200):
        passages = [some(14) for _ in range(8)] + [b"        ", b"aaaaaaaaaa"]
        whole = [some(30) + rng.choice(passages) + some(9) for _ in range(6)] + [b"", b"a" * 30]
        cut = rng.choice(passages)  # begins in one text and ends in the next: not found
        texts = [*whole, some(9) + cut[:4], cut[4:] + some(9)]
        got = seeking.Passages(passages).found(b"".join(texts), np.cumsum([0, *map(len, texts)]))
        assert got == [(i, row) for i, p in enumerate(passages) for row, t in enumerate(texts) if p and p in t]


def test_heads_of_lists_are_enough_for_fusion(spark, monkeypatch):
    """Where a list's leading documents stand in the other one is counted; nothing is ranked at full depth, and held texts aren't read again."""
    from glintmill.operators import scored

    monkeypatch.setattr(scored, "CELLS", 60)
    draw = random.Random(23)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 9))) for _ in range(150)]
    d = docs(spark, texts + texts[:40] + [None, ""] * 5).repartition(3)
    q = spark.createDataFrame([(5, ["alpha", "beta", "beta"]), (6, ["none"]), (7, []), (8, ["eps", "zeta"]), (9, ["gamma"])], "item_id long, terms array<string>")
    keyword, dense = R.full_depth(R.bm25(d, q), q, d), R.dense_by_terms(d, q)
    key = lambda df: sorted((r.item_id, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect())
    ranks = [R.ranked(x, "item_id", "doc_id") for x in (keyword, dense)]
    kept, again = scored.Asked(d, q, keep=True), scored.Asked(d, q)
    assert "InMemoryTableScan" in scored.variants(d, kept, 3, k=1)._jdf.queryExecution().executedPlan().toString()
    for top, k in ((3, 1), (1, 0), (4, 9)):
        want = [("bm25", keyword), ("dense", dense), ("hybrid", R.rrf(ranks, k))]
        for asked in (kept, again):
            got = scored.variants(d, asked, top, k).persist()
            for name, scores in want:
                assert key(got.filter(F.col("variant") == name).drop("variant")) == key(R.ranked(scores, "item_id", "doc_id", top).select("item_id", "doc_id", "score", "rank"))
        assert all(len(n.ids) <= 2 * (k + 2 * top) < 200 and len(n.ids) < 60 for n in scored._near(d, kept, top, k))


def test_what_stands_before_is_counted_through_ties():
    import numpy as np

    from glintmill.operators import scored

    rng = np.random.default_rng(4)
    for _ in range(200):
        score, ids = rng.integers(0, 5, 40) / 4, rng.permutation(40)
        some = rng.choice(40, rng.integers(1, 20), replace=False)
        some = some[np.lexsort((ids[some], -score[some]))]
        got = scored._before(score, ids, -score[some], ids[some])
        want = [sum((-score[j], ids[j]) <= (-score[i], ids[i]) for j in some) for i in range(40)]
        assert got.tolist() == want
