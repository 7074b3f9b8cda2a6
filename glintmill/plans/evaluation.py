"""Queries that score rankings, and put intervals on the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintmill.operators import bootstrap as B
from glintmill.operators import evaluation as E
from glintmill.operators import guards
from glintmill.plans import retrieval as R
from glintmill.plans import sql
from glintmill.sources.holding import kept

VARIANTS = ("bm25", "dense", "hybrid")
SEEDS = tuple(B.SEED + i for i in range(8))


def scores(spark, d):
    surface = R.docs_of(spark, d).filter("source IN ('src0', 'src1')")

    def make():
        guards.lists_reach(R.runs(spark, d), E.CUT)
        return E.score_rows(R.runs(spark, d), R.gold(spark, d), R.questions(spark, d), surface)

    return kept(spark, d, "scores", make)


def diffs(spark, d):
    return E.differences(scores(spark, d), VARIANTS)


def values(spark, d, cluster="item_id"):
    return E.long_scores(scores(spark, d)).withColumn("cluster", F.expr(cluster))


def recall_precision(spark, d):
    return scores(spark, d).select("variant", "item_id", "n_gold", *[F.round(c, 6).alias(c) for c in ("recall_3", "recall_10", "precision_3")])


def first_relevant(spark, d):
    return scores(spark, d).select("variant", "item_id", "first_rank")


def reciprocal_rank(spark, d):
    return scores(spark, d).select("variant", "item_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def score_rows(spark, d):
    return scores(spark, d).select("variant", "item_id", "n_gold", "answerable", *[F.round(c, 6).alias(c) for c in E.METRICS], "first_rank", "surface_hits")


def eval_aggregate(spark, d):
    return E.aggregate(scores(spark, d))


def variant_comparison(spark, d):
    return E.comparison(scores(spark, d), VARIANTS)


def subset_sensitivity(spark, d):
    return E.comparison(scores(spark, d).filter("item_id % 7 <> 0"), VARIANTS)


def paired_movement(spark, d):
    return E.movement(diffs(spark, d))


def prevalence_by_band(spark, d):
    return E.prevalence(R.runs(spark, d), R.gold(spark, d))


def bootstrap_ci(spark, d):
    return B.intervals(values(spark, d), ["variant", "metric"]).drop("seed", "excludes_zero")


def paired_bootstrap(spark, d):
    v = diffs(spark, d).select("comparison", "metric", F.col("item_id").alias("cluster"), F.col("diff").alias("value"))
    return B.intervals(v, ["comparison", "metric"]).drop("seed")


def bootstrap_seeds(spark, d):
    return B.intervals(values(spark, d).filter("metric = 'recall_10'"), ["variant", "metric"], seeds=SEEDS).drop("excludes_zero")


def cluster_bootstrap(spark, d):
    """Questions in pairs, each pair drawn as one."""
    members = R.questions(spark, d).select(F.col("item_id").alias("member"))
    guards.exact_cover(members.select(F.expr("member div 2").alias("cluster"), "member"), members)
    return B.intervals(values(spark, d, "item_id div 2"), ["variant", "metric"]).drop("seed", "excludes_zero")


def sample_size_needed(spark, d):
    return B.needed(diffs(spark, d), ["comparison", "metric"])


QUERIES = [recall_precision, first_relevant, reciprocal_rank, score_rows, eval_aggregate, variant_comparison, subset_sensitivity, paired_movement, prevalence_by_band,
           bootstrap_ci, paired_bootstrap, bootstrap_seeds, cluster_bootstrap, sample_size_needed]


def _draws(source: str, keys: str, cluster: str, seeds: tuple[int, ...]) -> str:
    return f"""vals AS (SELECT {keys}, {cluster} AS cluster, sum(value::DECIMAL(20,12)) AS s, count(value) AS c FROM {source} GROUP BY ALL),
      num AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS slot FROM (SELECT DISTINCT cluster FROM vals)), nn AS (SELECT count(*) AS n FROM num),
      drawn AS (SELECT seed, rep, ('0x' || substr(md5(seed || ':' || rep || ':' || place), 1, 8))::BIGINT % n AS slot FROM (SELECT unnest(range({B.REPS})) AS rep), (SELECT unnest({list(seeds)}) AS seed), nn, LATERAL (SELECT unnest(range(n)) AS place)),
      pick AS (SELECT seed, rep, slot, count(*) AS times FROM drawn GROUP BY ALL),
      means AS (SELECT {keys}, seed, rep, sum(s * times)::DOUBLE / sum(c * times) AS mean FROM pick JOIN num USING (slot) JOIN vals USING (cluster) GROUP BY ALL),
      ci AS (SELECT {keys}, seed, round(quantile_cont(mean, 0.025) + 1e-10, 6) AS lo, round(quantile_cont(mean, 0.975) + 1e-10, 6) AS hi FROM means GROUP BY ALL),
      obs AS (SELECT {keys}, {sql.mean('value')} AS mean FROM {source} GROUP BY ALL)"""


def _compare(where: str) -> str:
    cols = ", ".join(f"round((sum(value::DECIMAL(20,12)) FILTER (variant = '{v}') / count(value) FILTER (variant = '{v}'))::DOUBLE, 6) AS {v}" for v in VARIANTS)
    return f"WITH {sql.LONG} SELECT metric, {cols} FROM long WHERE {where} GROUP BY 1"


_AVG = lambda m: f"round((sum({m}::DECIMAL(20,12)) FILTER (answerable) / count({m}) FILTER (answerable))::DOUBLE, 6) AS mean_{m}"
SQL = {
    "recall_precision": f"WITH {sql.SCORES} SELECT variant, item_id, n_gold, round(recall_3, 6) AS recall_3, round(recall_10, 6) AS recall_10, round(precision_3, 6) AS precision_3 FROM scores",
    "first_relevant": f"WITH {sql.SCORES} SELECT variant, item_id, first_rank::INT AS first_rank FROM scores",
    "reciprocal_rank": f"WITH {sql.SCORES} SELECT variant, item_id, round(reciprocal_rank, 6) AS reciprocal_rank FROM scores",
    "score_rows": f"WITH {sql.SCORES} SELECT variant, item_id, n_gold, answerable, {', '.join(f'round({m}, 6) AS {m}' for m in sql.METRICS)}, first_rank::INT AS first_rank, surface_hits FROM scores",
    "eval_aggregate": f"""WITH {sql.SCORES} SELECT variant, count(*) FILTER (answerable) AS n_answerable, {', '.join(_AVG(m) for m in sql.METRICS)}, count(*) FILTER (answerable AND recall_10 = 0) AS no_gold_10,
      count(*) FILTER (answerable AND first_rank IS NULL) AS no_gold_at_all, count(*) FILTER (first_rank = 1) AS gold_at_1, coalesce(sum(surface_hits) FILTER (answerable), 0)::BIGINT AS surface_hits, 10 * count(*) FILTER (answerable) AS surface_slots FROM scores GROUP BY 1""",
    "variant_comparison": _compare("true"),
    "subset_sensitivity": _compare("item_id % 7 <> 0"),
    "paired_movement": f"WITH {sql.DIFFS} SELECT comparison, metric, count(*) FILTER (diff > 0) AS better, count(*) FILTER (diff < 0) AS worse, count(*) FILTER (diff = 0) AS unchanged FROM diffs GROUP BY ALL",
    "prevalence_by_band": f"WITH {sql.RUNS}, {sql.GOLD} SELECT variant, CASE WHEN rank <= 3 THEN '01-03' WHEN rank <= 10 THEN '04-10' ELSE '11-20' END AS band, count(*) AS n, round(count(g.doc_id) / count(*), 6) AS gold_share FROM runs r LEFT JOIN gold g USING (item_id, doc_id) WHERE item_id IN (SELECT item_id FROM gold) GROUP BY ALL",
    "bootstrap_ci": f"WITH {sql.LONG}, {_draws('long', 'variant, metric', 'item_id', (B.SEED,))} SELECT variant, metric, mean, lo, hi FROM ci JOIN obs USING (variant, metric)",
    "paired_bootstrap": f"WITH {sql.DIFFS}, dv AS (SELECT comparison, metric, item_id, diff AS value FROM diffs), {_draws('dv', 'comparison, metric', 'item_id', (B.SEED,))} SELECT comparison, metric, mean, lo, hi, lo > 0 OR hi < 0 AS excludes_zero FROM ci JOIN obs USING (comparison, metric)",
    "bootstrap_seeds": f"WITH {sql.LONG}, lv AS (SELECT * FROM long WHERE metric = 'recall_10'), {_draws('lv', 'variant, metric', 'item_id', SEEDS)} SELECT variant, metric, seed::INT AS seed, mean, lo, hi FROM ci JOIN obs USING (variant, metric)",
    "cluster_bootstrap": f"WITH {sql.LONG}, {_draws('long', 'variant, metric', 'item_id // 2', (B.SEED,))} SELECT variant, metric, mean, lo, hi FROM ci JOIN obs USING (variant, metric)",
    "sample_size_needed": f"WITH {sql.DIFFS} SELECT comparison, metric, count(*) AS n, round(avg(diff), 6) AS mean_diff, CASE WHEN round(avg(diff), 6) <> 0 THEN round(pow(1.96 * stddev_samp(diff) / avg(diff), 2))::BIGINT END AS needed FROM diffs GROUP BY ALL",
}
