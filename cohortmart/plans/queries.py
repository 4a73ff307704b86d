"""The registered queries over the test tables, with the SQL of the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmart.functions.literals import infer_types, literal
from cohortmart.functions.literals import without_comments as comments_off
from cohortmart.functions.variants import modifiers, speed_class, variant_key
from cohortmart.operators import bitmaps, cohort, cooccurrence, quality, recommend, serving, sketches
from cohortmart.operators.marts import Names, best_plays, item_statistics, item_user_sets, stage_scores, user_topk
from cohortmart.plans import mapping
from cohortmart.plans.pipeline import Job, run_pipeline
from cohortmart.sources import dump, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K, DIGITS = 5, 2
SEED_PP = 20000.0
SEED = 7


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def with_tables(select: str) -> str:
    return f"WITH {mapping.SQL}\n{select}"


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_plays(stage_scores(mapping.plays(spark, sf_dir)))


def _saved_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart on disk, for queries that use it more than once."""
    return files.save_table(_best(spark, sf_dir), files.scratch_path(spark, "best"))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.plays(spark, sf_dir).where("playmode = 0")


STATS = "item_id, variant_key, user_count, avg_pp, std_pp, min_pp, round(median_pp, 4) AS median_pp, round(p75_pp, 4) AS p75_pp, round(p90_pp, 4) AS p90_pp"


def _rounded(df: DataFrame) -> DataFrame:
    """Percentiles to four decimals: engines interpolate with different last bits."""
    return df.withColumns({c: F.round(c, 4) for c in ("median_pp", "p75_pp", "p90_pp")})


@registered(with_tables("SELECT id, user_id, item_id, score, pp, playmode, data, variant_key, speed_mod FROM stg"))
def stage_scores_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_scores(mapping.plays(spark, sf_dir))


@registered(with_tables("SELECT * FROM best"))
def best_plays_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


TOPK = f"""SELECT id, user_id, item_id, score, pp, data, variant_key, speed_mod FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, speed_mod ORDER BY pp DESC NULLS LAST, score DESC NULLS LAST, id NULLS LAST, item_id, variant_key) AS rn FROM best) WHERE rn <= {K}"""


@registered(with_tables(TOPK))
def user_topk_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_topk(_best(spark, sf_dir), K)


@registered(with_tables(f"SELECT user_ids, {STATS} FROM stats"))
def item_user_sets_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(item_user_sets(_saved_best(spark, sf_dir), DIGITS))


@registered(with_tables(f"SELECT {STATS} FROM stats"))
def item_statistics_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(item_statistics(_best(spark, sf_dir), DIGITS))


@registered(with_tables(f"SELECT DISTINCT user_id FROM best WHERE item_id = {SEED} AND pp >= {SEED_PP} AND variant_key = 'R'"))
def cohort_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_users(_best(spark, sf_dir), SEED, SEED_PP, None, "R")


ALL_COHORTS = """SELECT DISTINCT seed_id, s.item_id, user_id FROM best b JOIN seeds s ON b.item_id = s.item_id
  AND (pp_low IS NULL OR pp >= pp_low) AND (variant IS NULL OR b.variant_key = variant)"""


@registered(with_tables(ALL_COHORTS))
def seed_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.seed_cohorts(_best(spark, sf_dir), mapping.seeds(spark, sf_dir))


ONE_COHORT = f"(SELECT DISTINCT user_id FROM best WHERE item_id = {SEED})"


@registered(with_tables(f"SELECT item_id, variant_key, count(*) AS cohort_overlap FROM best WHERE user_id IN {ONE_COHORT} GROUP BY ALL"))
def cohort_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _saved_best(spark, sf_dir)
    return cohort.cohort_overlap(best, cohort.cohort_users(best, SEED))


@registered(with_tables(f"SELECT item_id, variant_key, count(*) AS cohort_overlap FROM best WHERE user_id IN {ONE_COHORT} GROUP BY ALL"))
def bitmap_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of a cohort with every item as bits in common, from numbered plays and their bitmaps in tables."""
    best = _saved_best(spark, sf_dir)
    plays = files.save_table(bitmaps.numbered_plays(best, bitmaps.dense_numbers(best, "user_id")), files.scratch_path(spark, "numbered"))
    items = files.save_table(bitmaps.item_bitmaps(plays), files.scratch_path(spark, "bitmaps"))
    return bitmaps.bitmap_overlap(items, bitmaps.cohort_bitmap(plays, cohort.cohort_filter(SEED)))


@registered(with_tables("SELECT item_id, variant_key, count(DISTINCT user_id) AS n_users FROM best GROUP BY ALL"))
def bitmap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _saved_best(spark, sf_dir)
    plays = bitmaps.numbered_plays(best, bitmaps.dense_numbers(best, "user_id"))
    return bitmaps.bitmap_sizes(bitmaps.item_bitmaps(plays), "item_id", "variant_key")


@registered(with_tables("SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_no FROM (SELECT DISTINCT user_id FROM best)"))
def dense_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmaps.dense_numbers(_best(spark, sf_dir), "user_id")


@registered(
    with_tables(
        f"""SELECT seed_id, p.item_id, p.variant_key, count(*) AS cohort_overlap FROM ({ALL_COHORTS}) c JOIN best p ON c.user_id = p.user_id
  JOIN stats s ON p.item_id = s.item_id AND p.variant_key = s.variant_key WHERE user_count >= 5 GROUP BY ALL HAVING count(*) >= 3"""
    )
)
def seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in common of every seed and item, from pairs of user blocks; blocks of 8, so that most users have several."""
    best = _saved_best(spark, sf_dir)
    members = cohort.seed_cohorts(best, mapping.seeds(spark, sf_dir)).select("seed_id", "user_id")
    popular = best.groupBy("item_id", "variant_key").agg(F.count("*").alias("user_count")).where("user_count >= 5")
    return cooccurrence.seed_overlaps(members, best, popular, 3, block=8)


@registered(with_tables("SELECT item_id, count(pp) AS n_rows, TRUE AS median_near, TRUE AS p75_near, TRUE AS p90_near FROM best GROUP BY ALL"))
def merged_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of items from the sketches of their variants; near is a rank in all plays of within 2 % of the one asked for."""
    best = _saved_best(spark, sf_dir)
    wanted = {"median": 0.5, "p75": 0.75, "p90": 0.9}
    parts = files.save_table(sketches.score_sketches(best, "item_id", "variant_key"), files.scratch_path(spark, "sketches"))
    merged = sketches.with_quantiles(sketches.merged_scores(parts, "item_id"), **wanted)
    ranks = [F.count_if(F.col("pp") < F.col(n)).alias(f"below_{n}") for n in wanted] + [F.count_if(F.col("pp") <= F.col(n)).alias(f"upto_{n}") for n in wanted]
    placed = best.join(merged.drop("quantiles"), "item_id").groupBy("item_id", "n_rows").agg(*ranks)
    near = [((F.col(f"below_{n}") <= (q + 0.02) * F.col("n_rows")) & (F.col(f"upto_{n}") >= (q - 0.02) * F.col("n_rows"))).alias(f"{n}_near") for n, q in wanted.items()]
    return placed.select("item_id", "n_rows", *near)


@registered(with_tables("SELECT item_id, count(DISTINCT user_id) AS n_users FROM best GROUP BY ALL"))
def merged_user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of items from the theta sketches of their variants; exact up to 4,096 users of an item."""
    parts = files.save_table(sketches.user_sketches(_best(spark, sf_dir), "item_id", "variant_key"), files.scratch_path(spark, "sketches"))
    return sketches.distinct_users(sketches.merged_users(parts, "item_id")).select("item_id", "n_users")


@registered(with_tables(f"SELECT item_id, variant_key, count(DISTINCT CASE WHEN user_id IN {ONE_COHORT} THEN user_id END) AS cohort_overlap FROM best GROUP BY ALL"))
def sketched_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort and all items by their theta sketches alone; exact up to 4,096 users of each."""
    best = _saved_best(spark, sf_dir)
    users = sketches.user_sketches(cohort.cohort_users(best, SEED))
    return sketches.sketched_overlap(sketches.user_sketches(best, "item_id", "variant_key"), users).select("item_id", "variant_key", "cohort_overlap")


FULL = """SELECT b.item_id, b.variant_key, version, artist, title, difficultyrating, user_count AS total_players, cohort_overlap, avg_pp, std_pp, min_pp,
  round(median_pp, 4) AS median_pp, round(p75_pp, 4) AS p75_pp, round(p90_pp, 4) AS p90_pp, 1.0 - CAST(cohort_overlap AS DOUBLE) / user_count AS novelty_score"""


@registered(
    with_tables(
        f"""{FULL} FROM (SELECT item_id, variant_key, count(*) AS cohort_overlap FROM best WHERE user_id IN {ONE_COHORT} GROUP BY ALL) b
  JOIN stats s ON b.item_id = s.item_id AND b.variant_key = s.variant_key JOIN items i ON b.item_id = i.item_id JOIN sets t ON i.set_id = t.set_id
  WHERE user_count >= 5 AND cohort_overlap >= 3 ORDER BY cohort_overlap DESC, avg_pp DESC, b.item_id, b.variant_key LIMIT 100"""
    )
)
def recommend_from_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _saved_best(spark, sf_dir)
    users = cohort.cohort_users(best, SEED)
    return _rounded(recommend.recommend_from_cohort(best, users, mapping.items(spark, sf_dir), mapping.item_sets(spark, sf_dir), digits=DIGITS))


@registered(
    with_tables(
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY cohort_overlap DESC, avg_pp DESC, item_id, variant_key) AS place FROM (
  SELECT seed_id, {FULL[7:]} FROM (SELECT c.seed_id, p.item_id, p.variant_key, count(*) AS cohort_overlap FROM ({ALL_COHORTS}) c JOIN best p ON c.user_id = p.user_id GROUP BY ALL) b
  JOIN stats s ON b.item_id = s.item_id AND b.variant_key = s.variant_key JOIN items i ON b.item_id = i.item_id JOIN sets t ON i.set_id = t.set_id
  WHERE user_count >= 5 AND cohort_overlap >= 3)) WHERE place <= 10"""
    )
)
def recommend_for_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _saved_best(spark, sf_dir)
    found = recommend.recommend_for_seeds(best, mapping.seeds(spark, sf_dir), mapping.items(spark, sf_dir), mapping.item_sets(spark, sf_dir), limit=10, digits=DIGITS)
    return _rounded(found)


@registered(with_tables("SELECT i.item_id, i.set_id, version, difficultyrating, artist, title FROM items i JOIN sets s ON i.set_id = s.set_id WHERE item_id IN (SELECT item_id FROM best)"))
def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.item_metadata(_best(spark, sf_dir), mapping.items(spark, sf_dir), mapping.item_sets(spark, sf_dir))


def _profile_sql(measure: str, digits: str) -> str:
    half = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
    return with_tables(
        f"""SELECT item_id, count(*) AS cohort_size, {half(f"min({measure})")} AS min_{measure}, {half(f"max({measure})")} AS max_{measure},
  {half(f"CAST(sum(CAST({measure} AS DECIMAL(18,2))) AS DOUBLE) / count({measure})")} AS mean_{measure}, {half(f"quantile_cont({measure}, 0.5)")} AS median_{measure}
  FROM stg WHERE pp BETWEEN 0 AND 50000 AND variant_key = 'R' GROUP BY item_id"""
    )


@registered(_profile_sql("pp", "2"))
def cohort_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_profile(_staged(spark, sf_dir), mapping.items(spark, sf_dir), digits=DIGITS, pp_high=50000.0, mods=["R"])


@registered(_profile_sql("accuracy", "2"))
def cohort_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_profile(_staged(spark, sf_dir), mapping.items(spark, sf_dir), "accuracy", DIGITS, pp_high=50000.0, mods=["R"])


SIMILAR = """SELECT seed_id, row_number() OVER (PARTITION BY seed_id ORDER BY play_count DESC, a DESC, item_id) AS place, item_id, version, difficultyrating, play_count,
  floor(a * 100 + 0.5) / 100 AS avg_pp, floor(b * 100 + 0.5) / 100 AS avg_accuracy, floor(CAST(play_count AS DOUBLE) / cohort_size * 100 + 0.5) / 100 AS similarity_score
  FROM (SELECT c.seed_id, p.item_id, count(DISTINCT p.user_id) AS play_count, CAST(sum(CAST(pp AS DECIMAL(18,2))) AS DOUBLE) / count(pp) AS a,
    CAST(sum(CAST(accuracy AS DECIMAL(18,2))) AS DOUBLE) / count(accuracy) AS b
  FROM (SELECT DISTINCT item_id AS seed_id, user_id FROM stg WHERE pp BETWEEN 0 AND 50000) c JOIN stg p ON c.user_id = p.user_id AND p.item_id <> c.seed_id AND p.pp BETWEEN 0 AND 50000 GROUP BY ALL) x
  JOIN (SELECT item_id AS seed_id, count(DISTINCT user_id) AS cohort_size FROM stg WHERE pp BETWEEN 0 AND 50000 GROUP BY ALL) y USING (seed_id) JOIN items USING (item_id)"""


@registered(with_tables(f"SELECT * FROM ({SIMILAR}) WHERE place <= 10"))
def recommend_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = mapping.items(spark, sf_dir)
    plays = files.save_table(_staged(spark, sf_dir), files.scratch_path(spark, "plays"))
    return recommend.recommend_similar(plays, items, items, pp_high=50000.0, digits=DIGITS)


@registered(
    with_tables(
        f"""SELECT seed_id, place, item_id, version, difficultyrating, play_count, avg_pp, CASE WHEN avg_accuracy IS NULL OR avg_accuracy = 0 THEN 95.0 ELSE avg_accuracy END AS avg_accuracy,
  similarity_score, 'https://covers.example.org/' || item_id || '.jpg' AS cover_url, '' AS mods FROM ({SIMILAR}) WHERE place <= 10"""
    )
)
def card_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a request whose lower end is that of the scale and whose upper end is not."""
    items = mapping.items(spark, sf_dir)
    plays = files.save_table(_staged(spark, sf_dir), files.scratch_path(spark, "plays"))
    asked = serving.asked_range(0.0, 50000.0, highest=100000.0)
    return serving.card_view(recommend.recommend_similar(plays, items, items, digits=DIGITS, **asked))


@registered(
    with_tables(
        """SELECT r.request_id, r.place, r.item_id, i.version, i.difficultyrating FROM (
  SELECT o_orderkey AS request_id, 0 AS place, o_custkey AS item_id FROM orders UNION ALL SELECT o_orderkey, 1, o_orderkey % 50 FROM orders UNION ALL SELECT o_orderkey, 2, o_custkey FROM orders) r
  LEFT JOIN items i ON r.item_id = i.item_id"""
    )
)
def lookup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of three ids for each order; the customer's id is asked for twice and mostly is no item."""
    ids = F.array("o_custkey", F.col("o_orderkey") % 50, "o_custkey")
    return serving.lookup_items(mapping.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), ids.alias("item_ids")), mapping.items(spark, sf_dir).drop("set_id"))


TOP50 = """SELECT user_id, place, item_id, version, difficultyrating, pp, variant_key, accuracy, score FROM (SELECT p.*, version, difficultyrating, row_number() OVER (PARTITION BY user_id
  ORDER BY pp DESC NULLS LAST, score DESC NULLS LAST, id, p.item_id, variant_key, accuracy) AS place FROM stg p JOIN items i ON p.item_id = i.item_id) WHERE place <= 50"""


@registered(with_tables(TOP50))
def user_top_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.user_top_plays(_staged(spark, sf_dir), mapping.items(spark, sf_dir))


@registered(
    with_tables(
        f"""SELECT u.user_id, username, pp_raw, coalesce(n, 0) AS total_plays, floor(m * 100 + 0.5) / 100 AS average_pp, CAST(NULL AS BIGINT) AS peak_rank FROM users u
  LEFT JOIN (SELECT user_id, count(*) AS n, CAST(sum(CAST(pp AS DECIMAL(18,2))) AS DOUBLE) / count(pp) AS m FROM ({TOP50}) GROUP BY user_id) t ON u.user_id = t.user_id"""
    )
)
def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.user_profile(mapping.users(spark, sf_dir), user_top_plays(spark, sf_dir), DIGITS)


def _placed_sql(of: str, where: str) -> str:
    return with_tables(f"SELECT *, row_number() OVER (PARTITION BY {of} ORDER BY pp DESC NULLS LAST, score DESC NULLS LAST, id, user_id, item_id, variant_key) AS place FROM best WHERE {where}")


@registered(_placed_sql("item_id", f"item_id = {SEED} AND pp >= {SEED_PP}"))
def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_item, _ = files.save_layouts(_best(spark, sf_dir), f"item_scores_{uuid.uuid4().hex[:8]}", 4)
    return serving.item_scores(by_item, SEED, SEED_PP)


@registered(_placed_sql("user_id", "user_id = 10"))
def user_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, by_user = files.save_layouts(_best(spark, sf_dir), f"user_scores_{uuid.uuid4().hex[:8]}", 4)
    return serving.user_scores(by_user, 10)


@registered("SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = mapping.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    return serving.known_ids(asked, mapping.table(spark, sf_dir, "events"), "user_id")


@registered("SELECT DISTINCT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = mapping.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    large = mapping.table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("item_id"))
    return serving.missing_ids(asked, large, "item_id")


@registered(with_tables("SELECT id, user_id, item_id, pp FROM plays WHERE user_id NOT IN (SELECT user_id FROM events)"))
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orphans(mapping.plays(spark, sf_dir), mapping.table(spark, sf_dir, "events"), "user_id").select("id", "user_id", "item_id", "pp")


@registered("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(mapping.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


CODES = "CASE l_linenumber % 4 WHEN 0 THEN 'HR' WHEN 1 THEN 'NC' WHEN 2 THEN 'HT' ELSE 'DT' END"


def _mod_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modifier JSON made of the columns of order lines, some of it malformed or without the list."""
    code = F.expr(CODES)
    data = F.when(F.col("l_returnflag") == "N", F.lit("not json")).when(F.col("l_linenumber") == 7, F.lit("{}")).otherwise(
        F.concat(F.lit('{"mods":[{"acronym":"'), code, F.lit('"},{"acronym":"'), F.col("l_returnflag"), F.lit('"}]}'))
    )
    return mapping.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", data.alias("data"))


NO_MODS = "l_returnflag = 'N' OR l_linenumber = 7"


@registered(f"SELECT l_orderkey, l_linenumber, CASE WHEN {NO_MODS} THEN '' WHEN {CODES} < l_returnflag THEN {CODES} || ',' || l_returnflag ELSE l_returnflag || ',' || {CODES} END AS variant_key FROM lineitem")
def variant_key_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mod_data(spark, sf_dir).select("l_orderkey", "l_linenumber", variant_key(modifiers(F.col("data"))).alias("variant_key"))


@registered(f"SELECT l_orderkey, l_linenumber, CASE WHEN {NO_MODS} THEN NULL WHEN {CODES} IN ('DT', 'NC') THEN 'DT' WHEN {CODES} = 'HT' THEN 'HT' END AS speed_mod FROM lineitem")
def speed_class_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mod_data(spark, sf_dir).select("l_orderkey", "l_linenumber", speed_class(modifiers(F.col("data"))).alias("speed_mod"))


@registered("SELECT p_partkey, p_name || '''s' AS name, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, CAST(NULL AS VARCHAR) AS nothing FROM part")
def parse_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns written as SQL literals and parsed again."""
    raw = mapping.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit(" '"), "p_name", F.lit("''s' ")).alias("name"),
        F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("size"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.lit("null").alias("nothing"),
    )
    return raw.select("p_partkey", literal(F.col("name")).alias("name"), literal(F.col("size"), "bigint").alias("size"), literal(F.col("price"), "double").alias("price"), literal(F.col("nothing")).alias("nothing"))


INFERRED = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "bigint", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "string"}


@registered(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN count(v) = 0 THEN 'string' WHEN count(TRY_CAST(v AS BIGINT)) FILTER (NOT contains(v, '.')) = count(v) THEN 'bigint' WHEN count(TRY_CAST(v AS DOUBLE)) = count(v) THEN 'double' ELSE 'string' END AS type FROM (SELECT CAST({c} AS VARCHAR) AS v FROM lineitem)"""
        for c in INFERRED
    )
)
def infer_types_(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mapping.table(spark, sf_dir, "lineitem")
    return infer_types(lines.select(*[F.col(c).cast("string").alias(c) for c in INFERRED]))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@registered(" UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS n_rows FROM {t}""" for t in TABLES) + """ UNION ALL SELECT 'absent' AS "table", 0 AS n_rows""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table_counts({**{t: mapping.table(spark, sf_dir, t) for t in TABLES}, "absent": None}, spark)


#: Violations planted in the tables, the same in both engines.
PLANTED_SQL = f"""
q_best AS (SELECT id, user_id, item_id, score, CASE WHEN id % 41 = 0 THEN NULL ELSE pp END AS pp, data,
    CASE WHEN id % 31 = 0 THEN 'R,A' WHEN id % 37 = 0 THEN 'DT,HR' ELSE variant_key END AS variant_key, speed_mod FROM plays WHERE id % 2 = 0),
q_sets AS (SELECT item_id % 90 AS item_id, variant_key, user_ids, CASE WHEN item_id % 5 = 0 THEN user_count + 1 ELSE user_count END AS user_count, min_pp, median_pp,
    CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 4 = 0 THEN min_pp - 1 ELSE p75_pp END AS p75_pp, p90_pp FROM stats),
q_rec AS (SELECT item_id, user_count AS total_players, user_count // 2 AS cohort_overlap,
    CASE WHEN item_id % 4 = 0 THEN NULL WHEN item_id % 4 = 1 THEN 1.5 ELSE 1 - CAST(user_count // 2 AS DOUBLE) / user_count END AS novelty_score FROM stats),
q_manifest AS (SELECT variant_key AS table_name, CASE WHEN variant_key = 'R' THEN count(*) + 1 ELSE count(*) END AS rows FROM stg GROUP BY variant_key),
q_top AS (SELECT user_id, speed_mod, count(*) AS n FROM best GROUP BY ALL HAVING count(*) > {K})"""

CHECKS = {
    ("playmode", "staged"): "SELECT count(*) FROM plays WHERE playmode <> 0",
    ("unique_play", "best"): "SELECT count(*) FROM (SELECT 1 FROM q_best GROUP BY user_id, item_id, variant_key HAVING count(*) > 1)",
    ("unique_set", "sets"): "SELECT count(*) FROM (SELECT 1 FROM q_sets GROUP BY item_id, variant_key HAVING count(*) > 1)",
    ("top_k", "top"): "SELECT count(*) FROM q_top",
    ("best_is_highest", "best"): """SELECT count(*) FROM q_best b JOIN (SELECT user_id, item_id, variant_key, max(pp) AS highest FROM plays GROUP BY ALL) h
  ON b.user_id = h.user_id AND b.item_id = h.item_id AND b.variant_key = h.variant_key WHERE b.pp IS NULL OR b.pp < highest""",
    ("user_count", "sets"): "SELECT count(*) FROM q_sets WHERE len(user_ids) <> user_count",
    ("percentile_order", "sets"): "SELECT count(*) FROM q_sets WHERE NOT coalesce(min_pp <= median_pp AND median_pp <= p75_pp AND p75_pp <= p90_pp, false)",
    ("orphan_item", "best"): "SELECT count(*) FROM q_best WHERE item_id NOT IN (SELECT item_id FROM items WHERE item_id % 7 <> 0)",
    ("orphan_user", "best"): "SELECT count(*) FROM q_best WHERE user_id NOT IN (SELECT user_id FROM plays WHERE user_id % 11 <> 0)",
    ("variant_order", "best"): "SELECT count(*) FROM q_best WHERE variant_key = 'R,A'",
    ("speed_class", "best"): "SELECT count(*) FROM q_best WHERE CASE WHEN variant_key = 'DT,HR' THEN 'DT' END IS DISTINCT FROM speed_mod",
    ("novelty", "recommended"): "SELECT count(*) FROM q_rec WHERE item_id % 4 < 2",
    ("manifest", "counts"): "SELECT count(*) FROM q_manifest WHERE table_name = 'R'",
    ("columns", "staged"): "SELECT 0",
    ("columns", "best"): "SELECT 1",
    ("columns", "top"): "SELECT 0",
}


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plays, best plays and user sets with violations of the checks of single rows."""
    plays = files.save_table(mapping.plays(spark, sf_dir), files.scratch_path(spark, "plays"))
    variant = F.when(F.col("id") % 31 == 0, "R,A").when(F.col("id") % 37 == 0, "DT,HR").otherwise(F.col("variant_key"))
    wrong = plays.where("id % 2 = 0").withColumn("variant_key", variant)
    sets = files.save_table(item_user_sets(best_plays(stage_scores(plays))), files.scratch_path(spark, "sets"))
    third = F.when(F.col("item_id") % 3 != 0, F.when(F.col("item_id") % 4 == 0, F.col("min_pp") - 1).otherwise(F.col("p75_pp")))
    return plays, wrong, sets.withColumns({"user_count": F.when(F.col("item_id") % 5 == 0, F.col("user_count") + 1).otherwise(F.col("user_count")), "p75_pp": third})


@registered(
    f"WITH {mapping.SQL.rstrip()},{PLANTED_SQL}\n" + " UNION ALL ".join(f"""SELECT '{c}' AS "check", '{t}' AS "table", CAST(({q}) AS BIGINT) AS violations""" for (c, t), q in CHECKS.items())
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check on tables with planted violations: other modes, repeated and lower plays, wrong counts, nulls, orphans."""
    plays, items = files.save_table(mapping.plays(spark, sf_dir), files.scratch_path(spark, "plays")), mapping.items(spark, sf_dir)
    good = files.save_table(best_plays(stage_scores(plays)), files.scratch_path(spark, "best"))
    variant = F.when(F.col("id") % 31 == 0, "R,A").when(F.col("id") % 37 == 0, "DT,HR").otherwise(F.col("variant_key"))
    wrong = plays.where("id % 2 = 0").withColumns({"pp": F.when(F.col("id") % 41 != 0, F.col("pp")), "variant_key": variant}).drop("playmode", "accuracy", "score")
    sets = files.save_table(item_user_sets(good), files.scratch_path(spark, "sets"))
    third = F.when(F.col("item_id") % 3 != 0, F.when(F.col("item_id") % 4 == 0, F.col("min_pp") - 1).otherwise(F.col("p75_pp")))
    wrong_sets = sets.withColumns({"user_count": F.when(F.col("item_id") % 5 == 0, F.col("user_count") + 1).otherwise(F.col("user_count")), "p75_pp": third, "item_id": F.col("item_id") % 90})
    overlap, share = F.expr("user_count DIV 2"), 1 - F.expr("user_count DIV 2") / F.col("user_count")
    novelty = F.when(F.col("item_id") % 4 == 1, 1.5).when(F.col("item_id") % 4 > 1, share)
    recommended = sets.select("item_id", F.col("user_count").alias("total_players"), overlap.alias("cohort_overlap"), novelty.alias("novelty_score"))
    counts = stage_scores(plays).groupBy(F.col("variant_key").alias("table")).agg(F.count("*").alias("n_rows"))
    manifest = counts.select(F.col("table").alias("table_name"), (F.col("n_rows") + F.when(F.col("table") == "R", 1).otherwise(0)).alias("rows"))
    kept_items, kept_plays = items.where("item_id % 7 <> 0"), plays.where("user_id % 11 <> 0")
    return quality.quality_report(plays, wrong, good, wrong_sets, kept_items, kept_plays, K, recommended, manifest, counts)


ROW_CHECKS = {(c, t): q for (c, t), q in CHECKS.items() if c in ("playmode", "user_count", "percentile_order", "variant_order", "speed_class")}


@registered(
    f"WITH {mapping.SQL.rstrip()},{PLANTED_SQL}\n" + " UNION ALL ".join(f"""SELECT '{c}' AS "check", '{t}' AS "table", CAST(({q}) AS BIGINT) AS violations""" for (c, t), q in ROW_CHECKS.items())
)
def quality_while_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of single rows, counted by the jobs that write the tables with planted violations."""
    plays, wrong, sets = _planted(spark, sf_dir)
    seen = {}
    for table, df in (("staged", plays), ("best", wrong), ("sets", sets)):
        _, seen[table] = files.save_observed(df, files.scratch_path(spark, table), **quality.WHILE_WRITING[table]())
    return quality.observed_report(spark, seen)


@registered(with_tables("SELECT * FROM best"))
def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch_path(spark, "shards")
    files.write_sharded(_best(spark, sf_dir), path, 5000, 1000)
    return files.load_raw(spark, f"{path}/*.parquet")


@registered(with_tables("SELECT 'best' AS table_name, '1.0' AS version, count(*) AS total_rows, true AS hashed, true AS small_files FROM best"))
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files' manifest adds up to; names, sizes and hashes depend on the writer."""
    path = files.scratch_path(spark, "manifest")
    files.write_sharded(_best(spark, sf_dir), path, 5000, 1000)
    m = files.parquet_manifest(spark, path, "best")
    return m.groupBy("table_name", "version").agg(F.sum("rows").alias("total_rows"), F.every(F.col("hash").rlike("^sha256:[0-9a-f]{64}$")).alias("hashed"), F.every(F.col("rows") <= 5000).alias("small_files"))


ODD = "CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 = 1 THEN p_name || ', \"x\"' WHEN p_size % 6 = 2 THEN p_name || ' a''b; (c) -- d' WHEN p_size % 6 = 3 THEN p_name || ' \\ e' WHEN p_size % 6 = 4 THEN p_name || ';' || chr(10) || 'two' ELSE p_name END"
ODD_ROWS = f"SELECT p_partkey, p_size, p_retailprice, {ODD} AS note FROM part"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, backslashes, commas, semicolons, parentheses and nulls."""
    note = ODD.replace("''", "\\'").replace("\\ e", "\\\\ e")
    return mapping.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.expr(note).alias("note"))


ODD_SCHEMA = "p_partkey long, p_size int, p_retailprice double, note string"


@registered(ODD_ROWS)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch_path(spark, "csv")
    files.write_csv_chunks(_odd(spark, sf_dir), path, 500)
    return files.read_csv_chunks(spark, path, ODD_SCHEMA)


@registered(ODD_ROWS)
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch_path(spark, "tsv")
    files.write_tsv(_odd(spark, sf_dir), path)
    return files.read_tsv(spark, path, ODD_SCHEMA)


def _dump(spark: SparkSession, sf_dir: str, raw_breaks: bool = False) -> str:
    path = files.scratch_path(spark, "dump")
    dump.write_insert_dump(_odd(spark, sf_dir), f"{path}/part.sql", "part", 300, raw_breaks)
    dump.write_insert_dump(mapping.table(spark, sf_dir, "supplier"), f"{path}/part_supplier.sql", "part_supplier")
    return f"{path}/*.sql"


@registered(ODD_ROWS)
def read_insert_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return dump.read_insert_dump(spark, _dump(spark, sf_dir), "part", StructType.fromDDL(ODD_SCHEMA))


@registered(ODD_ROWS)
def read_dump_of_raw_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with a semicolon at the end of a line, written as they are."""
    from pyspark.sql.types import StructType

    return dump.read_insert_dump(spark, _dump(spark, sf_dir, raw_breaks=True), "part", StructType.fromDDL(ODD_SCHEMA))


@registered("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def read_dump_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns named by the list of the INSERT statements, as strings."""
    return dump.read_insert_dump(spark, _dump(spark, sf_dir), "part_supplier").select("s_suppkey", "s_name", "s_nationkey")


@registered(ODD_ROWS)
def read_dump_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of statements that end anywhere, with comments that hold quotes and semicolons before, within and behind them."""
    from pyspark.sql.types import StructType

    odd, path = _odd(spark, sf_dir), files.scratch_path(spark, "anywhere")
    k = F.col("p_partkey")
    values = F.concat_ws(" /* , it's; */ ,", *[dump.shown(odd, c, raw_breaks=True) for c in odd.columns])
    before = F.when(k % 3 == 0, "/* don't; ( */").when(k % 3 == 1, "-- it's; (\n").otherwise("")
    after = F.when(k % 5 == 0, "; ").when(k % 5 == 1, "; -- who's; there\n").when(k % 5 == 2, " # 'x;\n;").when(k % 5 == 3, ";\r\n").otherwise(";/* ' */")
    text = F.concat(before, F.lit("INSERT INTO `part` (`p_partkey`, `p_size`, `p_retailprice`, `note`)/* ' */ VALUES("), values, F.lit(")"), after)
    odd.select(text.alias("value")).coalesce(1).write.option("lineSep", " ").text(path)
    return dump.read_insert_dump(spark, path, "part", StructType.fromDDL(ODD_SCHEMA))


@registered("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 > 1 THEN p_size END AS size FROM part")
def read_dump_of_short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with fewer values than names: what is missing is null."""
    from pyspark.sql.types import StructType

    path, k = files.scratch_path(spark, "short"), F.col("p_partkey")
    part = mapping.table(spark, sf_dir, "part")
    name = F.when(k % 3 > 0, F.concat(F.lit(", "), dump.shown(part, "p_name"))).otherwise("")
    size = F.when(k % 3 > 1, F.concat(F.lit(","), F.col("p_size"))).otherwise("")
    text = F.concat(F.lit("INSERT INTO part (k, name, size) VALUES ("), k, name, size, F.lit(")"))
    part.select(text.alias("value")).write.option("lineSep", ";").text(path)
    return dump.read_insert_dump(spark, path, "part", StructType.fromDDL("k long, name string, size int"))


@registered(
    """SELECT CASE WHEN p_partkey % 5 = 0 THEN 'rejected' ELSE 'read' END AS kind, count(*) AS n, sum(CASE WHEN p_partkey % 5 > 0 THEN p_partkey END) AS keys FROM part GROUP BY ALL"""
)
def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines with a value too few or too many, or of another type, beside those that fit."""
    path, k = files.scratch_path(spark, "rejects"), F.col("p_partkey").cast("string")
    wrong = F.when(F.col("p_partkey") % 15 == 0, k).when(F.col("p_partkey") % 15 == 5, F.concat(k, F.lit(",a,b,c"))).otherwise(F.concat(F.lit("x"), k, F.lit(",a,1")))
    line = F.when(F.col("p_partkey") % 5 == 0, wrong).otherwise(F.concat(k, F.lit(',"a, b",'), F.col("p_size")))
    mapping.table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    good, bad = files.csv_rows_and_rejects(spark, path, "k long, name string, size int", header=False)
    none = F.lit(None).cast("long").alias("keys")
    counted = good.agg(F.count("*").alias("n"), F.sum("k").alias("keys")).select(F.lit("read").alias("kind"), "n", "keys")
    return counted.unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("kind"), "n", none))


@registered(
    """SELECT 'part' AS "table", 'incomplete list' AS reason, 1 AS n_rows_kept, '(' || p_partkey || ', ''cut' AS text FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT 'part', 'no lists', 0, 'INSERT INTO part SELECT ' || p_partkey FROM part WHERE p_partkey % 7 = 1
  UNION ALL SELECT 'part', 'values without a name', 2, '(' || p_partkey || ',''b'',''c'')' FROM part WHERE p_partkey % 7 = 2"""
)
def dump_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not read of a dump with lists that are cut off (each in a file that ends there), statements without lists, and
    lists of more values than names."""
    path = files.scratch_path(spark, "rejects")
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 7
    names = F.lit("INSERT INTO part (a, b) VALUES ")
    text = (
        F.when(kind == 0, F.concat(names, F.lit("(1,'a'),("), k, F.lit(", 'cut")))
        .when(kind == 1, F.concat(F.lit("INSERT INTO part SELECT "), k))
        .when(kind == 2, F.concat(names, F.lit("(0,'a'),("), k, F.lit(",'b','c')")))
        .otherwise(F.concat(names, F.lit("("), k, F.lit(",'whole')")))
    )
    part = mapping.table(spark, sf_dir, "part")
    rows = part.select(text.alias("value"), (kind == 0).alias("cut"))
    rows.where("NOT cut").select("value").write.option("lineSep", dump.END).text(f"{path}/whole")
    files.write_each(rows.where("cut").select("value"), f"{path}/cut")
    return dump.dump_rejects(spark, f"{path}/*/*").select("table", "reason", "n_rows_kept", "text")


@registered("SELECT p_partkey, 'INSERT INTO ' || p_name || ' VALUES' AS head FROM part")
def without_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement heads with comments of both kinds, taken off again."""
    raw = F.concat(F.lit("/* note; */INSERT INTO"), F.lit(" "), F.col("p_name"), F.lit("/* of\nlines */ VALUES-- 'end'\n"))
    head = F.trim(F.regexp_replace(comments_off(raw), r"\s+", " "))
    return mapping.table(spark, sf_dir, "part").select("p_partkey", head.alias("head"))


@registered(with_tables("SELECT * FROM best"))
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is there already is kept when its dump is loaded again."""
    path = files.scratch_path(spark, "kept")
    files.write_sharded(_best(spark, sf_dir), path, 5000, 1000)
    files.write_sharded(_best(spark, sf_dir).where("item_id % 2 = 0"), path, 5000, 1000, mode="ignore")
    return files.load_raw(spark, path)


def _dump_of_brands(spark: SparkSession, sf_dir: str) -> str:
    """Every part in an INSERT statement of a table that has its brand's name, several on a line."""
    path = files.scratch_path(spark, "brands")
    name = F.concat(F.lit("INSERT INTO `"), F.regexp_replace("p_brand", r"\W", "_"), F.lit("` (`k`, `n`) VALUES ("))
    text = F.concat(name, F.col("p_partkey"), F.lit(",';'),("), F.col("p_size"), F.lit(",NULL); -- it's\n"))
    mapping.table(spark, sf_dir, "part").select(text.alias("value")).write.option("lineSep", " ").text(path)
    return path


BRAND = "regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g')"


@registered(f"""SELECT DISTINCT {BRAND} AS "table" FROM part""")
def dump_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.dump_tables(spark, _dump_of_brands(spark, sf_dir))


@registered(f"""SELECT {BRAND} AS "table", 2 * count(*) AS n_rows FROM part GROUP BY ALL""")
def dump_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.dump_row_counts(spark, _dump_of_brands(spark, sf_dir))


@registered(
    """SELECT 'of_' || c_custkey % 100 AS "table", row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey) - 1 AS position, 'c' || c_custkey AS "column",
  CASE c_nationkey % 3 WHEN 0 THEN 'bigint' WHEN 1 THEN 'double' ELSE 'varchar' END AS sql_type FROM customer"""
)
def dump_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE statements of a hundred tables whose columns and types are the customers'."""
    path, key = files.scratch_path(spark, "ddl"), F.col("c_custkey")
    kind = F.when(F.col("c_nationkey") % 3 == 0, "BIGINT(20) unsigned NOT NULL").when(F.col("c_nationkey") % 3 == 1, "double DEFAULT '1,5;'").otherwise("varchar(20) COMMENT 'it''s, b int'")
    made = F.struct(key.alias("key"), F.concat(F.lit("  `c"), key, F.lit("` "), kind).alias("line"))
    lines = mapping.table(spark, sf_dir, "customer").groupBy((key % 100).alias("of")).agg(F.transform(F.sort_array(F.collect_list(made)), lambda x: x["line"]).alias("lines"))
    text = F.concat(F.lit("CREATE TABLE IF NOT EXISTS `of_"), F.col("of"), F.lit("` (\n"), F.array_join("lines", ",\n"), F.lit(",\n  PRIMARY KEY (`c1`),\n  KEY `b` (`c2`)\n) ENGINE=InnoDB; /* it's */ "))
    lines.select(text.alias("value")).write.option("lineSep", "\n").text(path)
    return dump.dump_schemas(spark, path)


@registered(ODD_ROWS)
def read_dump_by_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of a dump's rows from the CREATE TABLE statement in it, which comes in a file of its own."""
    path = files.scratch_path(spark, "typed")
    odd = _odd(spark, sf_dir)
    dump.write_insert_dump(odd, f"{path}/part.sql", "part", 300)
    columns = ",\n".join(f"  `{n}` {k}" for n, k in odd.dtypes)
    made = odd.limit(1).select(F.lit(f"CREATE TABLE `part` (\n{columns},\n  PRIMARY KEY (`p_partkey`)\n)").alias("value"))
    made.write.option("lineSep", dump.END).text(f"{path}/schema.sql")
    return dump.read_insert_dump(spark, f"{path}/*.sql", "part").withColumn("p_size", F.col("p_size").cast("int"))


LAYOUT = "id, user_id, item_id, score, pp, variant_key"


@registered(with_tables(f"SELECT 'item' AS layout, {LAYOUT} FROM best UNION ALL SELECT 'user', {LAYOUT} FROM best"))
def layout_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of both bucketed layouts."""
    by_item, by_user = files.save_layouts(_best(spark, sf_dir), f"plays_layout_{uuid.uuid4().hex[:8]}", 4)
    columns = LAYOUT.split(", ")
    return by_item.select(F.lit("item").alias("layout"), *columns).unionByName(by_user.select(F.lit("user").alias("layout"), *columns))


@registered(
    with_tables(
        f"""SELECT 'raw_scores' AS "table", count(*) AS n_rows FROM plays UNION ALL SELECT 'raw_items', count(*) FROM items UNION ALL SELECT 'raw_item_sets', 0
  UNION ALL SELECT 'best_plays', count(*) FROM best UNION ALL SELECT 'user_topk', count(*) FROM ({TOPK}) UNION ALL SELECT 'item_user_sets', count(*) FROM stats"""
    )
)
def pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps of plays and items through all phases; the dump of item sets is missing and is skipped."""
    base = files.scratch_path(spark, "job")
    dump.write_insert_dump(mapping.plays(spark, sf_dir), f"{base}/dumps/scores.sql", "scores")
    dump.write_insert_dump(mapping.items(spark, sf_dir), f"{base}/dumps/items.sql", "items")
    names = Names(item_id="item_id", variant_key="variant_key")
    job = Job(f"{base}/dumps", f"{base}/parquet", f"{base}/warehouse", {"scores": "scores", "items": "items", "item_sets": "item_sets"}, names, K)
    return run_pipeline(spark, job)


@registered(
    with_tables(
        """SELECT item_id, place, t.user_id, username, pp, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pp DESC NULLS LAST, accuracy DESC NULLS LAST, user_id) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id, user_id ORDER BY pp DESC NULLS LAST, accuracy DESC NULLS LAST) AS n FROM stg) WHERE n = 1) t JOIN users u ON t.user_id = u.user_id WHERE place <= 10"""
    )
)
def cohort_top_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_top_players(_staged(spark, sf_dir), mapping.users(spark, sf_dir))


@registered(
    with_tables(
        """SELECT item_id, CAST(CASE WHEN hi = lo THEN 1 ELSE least(10, floor((pp - lo) / (hi - lo) * 10) + 1) END AS BIGINT) AS bin, count(*) AS n
  FROM stg JOIN (SELECT item_id, min(pp) AS lo, max(pp) AS hi FROM stg GROUP BY ALL) r USING (item_id) GROUP BY ALL"""
    )
)
def pp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.histogram(_staged(spark, sf_dir))


QUERIES = {k.rstrip("_"): v for k, v in QUERIES.items()}
ORACLES = {k.rstrip("_"): v for k, v in ORACLES.items()}
