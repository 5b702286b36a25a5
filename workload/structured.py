"""Filters, facets, charts, order and pages over the structured tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetspark.functions.scoring import weighted_grade_score, with_tables
from facetspark.operators import sorting
from facetspark.operators.charts import distribution, scatter, scatter_bins
from facetspark.operators.facets import facet_counts, facet_matches, label_facets
from facetspark.operators.predicates import (
    AnyElement, Everything, Exists, Scope, Term, all_of, any_of, between_range, facet_filter, ge, gt, le, lt, none_of,
    selected_facets, terms_all, terms_any,
)
from facetspark.operators.shape import post_process, project
from facetspark.operators.sorting import (
    page, page_per_query, result_summary, score_by_profiles, sort_documents, sort_key, with_places,
)
from facetspark.specs import Scorer
from workload.common import Query, facets_sql, table

PART_FILTER = all_of(between_range("p_size", 10, 40), none_of(Term("p_type", "PROMO")))


def where(df, predicate):
    return df.where(predicate.compile(Scope(schema=df.schema)))


def facets_filtered(spark, d):
    return facet_counts(where(table(spark, d, "part"), PART_FILTER), ["p_brand", "p_type"], 10)


def numeric_facets(spark, d):
    return facet_counts(where(table(spark, d, "part"), Everything()), ["p_size", "p_type"], 20)


SELECTED = {"o_orderpriority": ["5-LOW", "2-HIGH", "9-NEVER"], "o_orderstatus": ["F"]}


def facets_selected(spark, d):
    query = all_of(
        terms_any("o_orderpriority", SELECTED["o_orderpriority"]), Term("o_orderstatus", "F"),
        gt("o_totalprice", 50_000.0),
    )
    df = where(table(spark, d, "orders"), query)
    return facet_counts(df, ["o_orderpriority", "o_orderstatus", "o_custkey"], 1, selected_facets(query))


def selected_filter(spark, d):
    df = where(table(spark, d, "orders"), facet_filter(SELECTED))
    return project(df, ["o_orderkey", "o_orderpriority", "o_orderstatus"])


def facet_filter_batch(spark, d):
    part = table(spark, d, "part")
    types = part.select("p_type", "p_brand").distinct()
    selections = types.select(F.col("p_type").alias("query_id"), F.lit("p_type").alias("field"), F.col("p_type").alias("key"))
    brands = types.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select(
        F.col("p_type").alias("query_id"), F.lit("p_brand").alias("field"), F.col("p_brand").alias("key")
    )
    return facet_matches(part, "p_partkey", selections.unionByName(brands).distinct())


def geography_names(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    n_id = F.concat(F.lit("en:"), F.translate(F.lower("n_name"), "_", "-"))
    r_id = F.concat(F.lit("fr:"), F.translate(F.lower("r_name"), " ", "-"))
    nations = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return (
        nations.select(F.lit("nations").alias("taxonomy"), n_id.alias("id"), F.lit("en").alias("lang"), F.col("n_name").alias("name"))
        .unionByName(nations.where("r_name = 'EUROPE'").select(
            F.lit("nations").alias("taxonomy"), n_id.alias("id"), F.lit("fr").alias("lang"), F.concat(F.lit("Pays "), F.col("n_name")).alias("name")
        ))
        .unionByName(region.select(F.lit("regions").alias("taxonomy"), r_id.alias("id"), F.lit("fr").alias("lang"), F.initcap("r_name").alias("name")))
    )


def customer_places(spark, d):
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).join(
        F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        "c_custkey",
        F.concat(F.lit("en:"), F.translate(F.lower("n_name"), "_", "-")).alias("nation"),
        F.translate(F.lower("r_name"), " ", "-").alias("region"),
        F.col("c_mktsegment").alias("segment"),
    )


def facets_labelled(spark, d):
    items = facet_counts(customer_places(spark, d), ["nation", "region", "segment"], 10)
    return label_facets(items, geography_names(spark, d), "fr", {"nation": "nations", "region": "regions"})


PLACES_SQL = """
SELECT c_custkey, 'en:' || translate(lower(n_name), '_', '-') AS nation,
       translate(lower(r_name), ' ', '-') AS region, c_mktsegment AS segment, n_name, r_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

FACETS_LABELLED_SQL = f"""
SELECT f.field, f.key,
       CASE WHEN f.field = 'nation' AND r_name = 'EUROPE' THEN 'Pays ' || n_name
            WHEN f.field = 'nation' AND n_name IS NOT NULL THEN n_name
            WHEN f.field = 'region' AND f.key <> '--other--'
              THEN upper(f.key[1]) || replace(CASE WHEN f.key = 'middle-east' THEN 'iddle-East' ELSE f.key[2:] END, '-', ' ')
            ELSE f.name END AS name,
       f.count, f.selected, f.rank
FROM ({facets_sql(PLACES_SQL, {'nation': 'nation', 'region': 'region', 'segment': 'segment'}, 10)}) f
LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) n
  ON f.field = 'nation' AND f.key = 'en:' || translate(lower(n_name), '_', '-')"""


def boolean_filter(spark, d):
    query = all_of(
        ge("l_quantity", 10.0), lt("l_quantity", 45.0), le("l_discount", 0.06),
        any_of(Term("l_returnflag", "R"), all_of(Term("l_linestatus", "O"), gt("l_extendedprice", 40_000.0))),
        none_of(terms_any("l_linenumber", [1, 7]), terms_all("l_returnflag", ["N"])),
    )
    return where(table(spark, d, "lineitem"), query).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def nested_any(spark, d):
    lines = F.transform(
        F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("n"), line.alias("line"), F.length(line).alias("chars"))
    )
    df = table(spark, d, "documents").select("doc_id", "lang", lines.alias("lines"))
    long_line = AnyElement("lines", lambda e: (e["chars"] > 400) & e["line"].startswith("E"))
    return where(df, all_of(long_line, none_of(Term("lang", "en")))).select("doc_id", "lang")


def map_subfield(spark, d):
    df = table(spark, d, "events").withColumn("props", F.from_json("props", "map<string,int>"))
    query = all_of(Exists("props"), between_range("props.k", 20, 60, include_high=False), none_of(Exists("props.missing")))
    return where(df, query).select("event_id", "event_type", F.col("props")["k"].alias("k"))


def distribution_chart(spark, d):
    df = where(table(spark, d, "part"), PART_FILTER).withColumn(
        "p_type", F.when(F.col("p_type") == "ECONOMY", "unknown").otherwise(F.col("p_type"))
    )
    return with_places(distribution(df, ["p_type", "p_brand"], 10))


def sorted_page(spark, d):
    df = table(spark, d, "orders")
    return page(df, [sort_key(df, "-o_totalprice"), F.asc("o_orderkey")], 3, 25).select("o_orderkey", "o_totalprice", "o_orderstatus")


def scatter_page(spark, d):
    df = where(table(spark, d, "orders"), Term("o_orderstatus", "O"))
    hits = page(df, [sort_key(df, "o_orderdate"), F.asc("o_orderkey")], 2, 50)
    return scatter(hits, "o_custkey", "o_totalprice")


def scatter_all(spark, d):
    return scatter_bins(table(spark, d, "orders"), "o_custkey", "o_totalprice", 100.0, 50_000.0)


def summary(spark, d):
    df = where(table(spark, d, "orders"), Term("o_orderstatus", "O"))
    return result_summary(df, 24, keys=["o_orderpriority"], cap=1000)


def total(spark, d):
    return result_summary(table(spark, d, "lineitem"), 100)


def sorted_documents(spark, d):
    df = table(spark, d, "supplier").withColumn("balance", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    return with_places(sort_documents(df, "-balance", "s_suppkey").select("s_suppkey", "balance"))


def sorted_by_array(spark, d):
    """Orders by the greatest of several amounts, largest first."""
    amounts = F.array(F.col("o_totalprice"), F.col("o_custkey") * 100.0, F.lit(90_000.0))
    orders = table(spark, d, "orders").withColumn("amounts", amounts)
    return with_places(sort_documents(orders, "-amounts", "o_orderkey").select("o_orderkey"))


def pages_per_priority(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), "o_orderkey", "o_totalprice")
    return page_per_query(df, [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 15)


GRADES = with_tables(
    weighted_grade_score([
        ("o_orderpriority", "priority", "priority_table", "unknown"),
        ("o_orderstatus", "status", "status_table", "P"),
    ]),
    priority_table={"1-URGENT": 100, "2-HIGH": 75, "3-MEDIUM": 50, "unknown": 10},
    status_table={"F": 100, "O": 40},
)
PROFILES = {
    "speed": {"priority": 2.0, "status": 0.5},
    "done": {"priority": 0.5, "status": 3.0},
}


def score_by_grades(spark, d):
    df = table(spark, d, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    )
    scored = score_by_profiles(df, GRADES, PROFILES).withColumnRenamed("profile", "query_id")
    return page_per_query(scored, [F.desc("score"), F.desc("o_totalprice"), F.asc("o_orderkey")], 1, 40).select(
        "query_id", "o_orderkey", "score", "rank"
    )


def score_by_params_table(spark, d):
    """The best orders of each brand's own weights, which a table of parameters holds."""
    part, orders = table(spark, d, "part"), table(spark, d, "orders")
    weights = part.groupBy(F.col("p_brand").alias("query_id")).agg(
        F.min("p_size").cast("double").alias("speed"), F.max("p_size").cast("double").alias("done")
    )
    params = weights.select("query_id", F.inline(F.array(*[
        F.struct(F.lit(p).alias("param"), F.col(p).alias("value")) for p in ("speed", "done")
    ])))
    scorer = Scorer(
        lambda p: F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(p["speed"])).otherwise(0.0)
        + F.when(F.col("o_orderstatus") == "F", F.lit(p["done"])).otherwise(0.0) + F.lit(p["base"]) * F.col("o_custkey") % 7,
        params={"speed": 1.0, "done": 1.0}, static_params={"base": 2},
    )
    brand = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 60).cast("string"))  # some have no parameters
    scored = sorting.score_by_params_table(orders.withColumn("query_id", brand), scorer, params)
    return page_per_query(scored, [F.desc("score"), F.desc("o_totalprice"), F.asc("o_orderkey")], 1, 5).select(
        "query_id", "o_orderkey", "score", "rank"
    )


def user_transform(spark, d):
    cheap = Scorer(lambda p: F.lit(p["top"]) - F.col("p_retailprice"), params={"top": 2000.0})
    steps = [
        lambda df: df.withColumn("margin", F.round(cheap.column({"top": 2500.0}), 2)),
        lambda df: df.withColumn("label", F.concat_ws(" / ", "p_brand", "p_name")),
    ]
    return project(post_process(table(spark, d, "part"), steps), ["p_partkey", "margin", "label"])


QUERIES = {
    "facets_filtered": Query(facets_filtered, facets_sql(
        "SELECT * FROM part WHERE p_size BETWEEN 10 AND 40 AND p_type <> 'PROMO'", {"p_brand": "p_brand", "p_type": "p_type"}, 10
    )),
    "numeric_facets": Query(numeric_facets, facets_sql("SELECT * FROM part", {"p_size": "p_size", "p_type": "p_type"}, 20)),
    "facets_selected": Query(facets_selected, facets_sql(
        "SELECT * FROM orders WHERE o_orderpriority IN ('5-LOW', '2-HIGH', '9-NEVER') AND o_orderstatus = 'F' AND o_totalprice > 50000",
        {f: f for f in ("o_orderpriority", "o_orderstatus", "o_custkey")}, 1, SELECTED,
    )),
    "selected_filter": Query(selected_filter, """
        SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
        WHERE o_orderpriority IN ('5-LOW', '2-HIGH', '9-NEVER') AND o_orderstatus IN ('F')"""),
    "facet_filter_batch": Query(facet_filter_batch, """
        SELECT p_type AS query_id, p_partkey AS doc_id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
        UNION ALL
        SELECT p_type, p_partkey FROM part
        WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))"""),
    "facets_labelled": Query(facets_labelled, FACETS_LABELLED_SQL),
    "boolean_filter": Query(boolean_filter, """
        SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
        WHERE l_quantity >= 10 AND l_quantity < 45 AND l_discount <= 0.06
          AND (l_returnflag = 'R' OR (l_linestatus = 'O' AND l_extendedprice > 40000))
          AND NOT (l_linenumber IN (1, 7)) AND NOT (l_returnflag = 'N')"""),
    "nested_any": Query(nested_any, """
        SELECT doc_id, lang FROM documents
        WHERE lang <> 'en' AND len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 400 AND starts_with(x, 'E'))) > 0"""),
    "map_subfield": Query(map_subfield, """
        SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
        WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 20 AND CAST(json_extract(props, '$.k') AS INTEGER) < 60"""),
    "distribution": Query(distribution_chart, """
        WITH base AS (SELECT p_brand, CASE WHEN p_type = 'ECONOMY' THEN 'unknown' ELSE p_type END AS p_type
                      FROM part WHERE p_size BETWEEN 10 AND 40 AND p_type <> 'PROMO'),
        v AS (SELECT 'p_type' AS field, p_type AS category FROM base UNION ALL SELECT 'p_brand', p_brand FROM base),
        c AS (SELECT field, category, count(*) AS amount FROM v GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY amount DESC, category) AS pos_at FROM c)
        SELECT field, category, amount, row_number() OVER (ORDER BY field, category) AS place
        FROM r WHERE pos_at <= 10 AND category <> 'unknown'"""),
    "sorted_page": Query(sorted_page, """
        SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50"""),
    "scatter_page": Query(scatter_page, """
        SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders WHERE o_orderstatus = 'O'
        ORDER BY o_orderdate NULLS LAST, o_orderkey LIMIT 50 OFFSET 50"""),
    "scatter_all": Query(scatter_all, """
        SELECT floor(o_custkey / 100.0) * 100.0 AS x, floor(o_totalprice / 50000.0) * 50000.0 AS y, count(*) AS amount
        FROM orders GROUP BY ALL"""),
    "result_summary": Query(summary, """
        SELECT o_orderpriority, least(count(*), 1000) AS count, CAST(ceil(least(count(*), 1000) / 24.0) AS BIGINT) AS page_count,
               count(*) <= 1000 AS is_count_exact
        FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority"""),
    "match_all_count": Query(total, """
        SELECT count(*) AS count, CAST(ceil(count(*) / 100.0) AS BIGINT) AS page_count, true AS is_count_exact FROM lineitem"""),
    "sorted_documents": Query(sorted_documents, """
        SELECT *, row_number() OVER (ORDER BY balance DESC NULLS LAST, s_suppkey) AS place
        FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier)"""),
    "sorted_by_array": Query(sorted_by_array, """
        SELECT o_orderkey, row_number() OVER (ORDER BY greatest(o_totalprice, o_custkey * 100.0, 90000.0) DESC, o_orderkey) AS place
        FROM orders"""),
    "pages_per_query": Query(pages_per_priority, """
        SELECT * FROM (SELECT o_orderpriority AS query_id, o_orderkey, o_totalprice,
          CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders)
        WHERE rank BETWEEN 16 AND 30"""),
    "score_by_grades": Query(score_by_grades, """
        WITH g AS (SELECT o_orderkey, o_totalprice,
            CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 75 WHEN '3-MEDIUM' THEN 50
                 WHEN '4-NOT SPECIFIED' THEN 10 ELSE 0 END AS pg,
            CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 40 ELSE 0 END AS sg FROM orders),
        s AS (SELECT 'speed' AS query_id, *, CAST(pg * 2.0 + sg * 0.5 AS DOUBLE) AS score FROM g
              UNION ALL SELECT 'done', *, CAST(pg * 0.5 + sg * 3.0 AS DOUBLE) FROM g)
        SELECT * FROM (SELECT query_id, o_orderkey, score, CAST(row_number() OVER (
            PARTITION BY query_id ORDER BY score DESC, o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM s) WHERE rank <= 40"""),
    "score_by_params_table": Query(score_by_params_table, """
        WITH p AS (SELECT p_brand AS query_id, CAST(min(p_size) AS DOUBLE) AS speed, CAST(max(p_size) AS DOUBLE) AS done FROM part GROUP BY 1),
        s AS (SELECT query_id, o_orderkey, o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN speed ELSE 0.0 END
                + CASE WHEN o_orderstatus = 'F' THEN done ELSE 0.0 END + 2 * o_custkey % 7 AS score
              FROM orders JOIN p ON query_id = 'Brand#' || (o_custkey % 60))
        SELECT query_id, o_orderkey, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
          PARTITION BY query_id ORDER BY score DESC, o_totalprice DESC, o_orderkey) AS rank FROM s) WHERE rank <= 5"""),
    "user_transform": Query(user_transform, """
        SELECT p_partkey, round(2500.0 - p_retailprice, 2) AS margin, p_brand || ' / ' || p_name AS label FROM part"""),
}
