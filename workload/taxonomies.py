"""Taxonomy graph, synonyms, tagging and completion over tables seen as taxonomies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from facetspark.functions.text import FOLDED
from facetspark.operators import suggest as sg
from facetspark.operators import taxonomy as tx
from facetspark.operators.tagging import match_taxonomy, synonym_spans, tag_entities
from workload.common import CORPUS_SQL, ITEMS_SQL, Query, corpus, items, table

# --- a place taxonomy: customers and suppliers below nations, regions and segments ---

NODE_SQL = {
    "customer": "'en:customer-' || c_custkey", "supplier": "'en:supplier-' || s_suppkey",
    "nation": "'en:nation-' || n_nationkey", "region": "'en:region-' || r_regionkey",
    "segment": "'en:' || lower(c_mktsegment)",
}


def node(kind, key):
    return F.concat(F.lit(f"en:{kind}-"), F.col(key).cast("string"))


def segment():
    return F.concat(F.lit("en:"), F.lower("c_mktsegment"))


def place_edges(spark, d):
    def edges(df, child, parent):
        return df.select(F.lit("places").alias("taxonomy"), child.alias("child"), parent.alias("parent"))

    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return (
        edges(customer, node("customer", "c_custkey"), node("nation", "c_nationkey"))
        .unionByName(edges(customer, node("customer", "c_custkey"), segment()))
        .unionByName(edges(supplier, node("supplier", "s_suppkey"), node("nation", "s_nationkey")))
        .unionByName(edges(nation, node("nation", "n_nationkey"), node("region", "n_regionkey")))
        .unionByName(edges(region, node("region", "r_regionkey"), F.lit("en:world")))
    )


EDGES_SQL = f"""
edges AS (
  SELECT {NODE_SQL['customer']} AS child, 'en:nation-' || c_nationkey AS parent FROM customer
  UNION ALL SELECT {NODE_SQL['customer']}, {NODE_SQL['segment']} FROM customer
  UNION ALL SELECT {NODE_SQL['supplier']}, 'en:nation-' || s_nationkey FROM supplier
  UNION ALL SELECT {NODE_SQL['nation']}, 'en:region-' || n_regionkey FROM nation
  UNION ALL SELECT {NODE_SQL['region']}, 'en:world' FROM region
),
walk AS (
  SELECT child AS id, parent AS ancestor, 1 AS depth FROM edges
  UNION SELECT walk.id, edges.parent, depth + 1 FROM walk JOIN edges ON walk.ancestor = edges.child
),
closure AS MATERIALIZED (SELECT id, ancestor, min(depth) AS depth FROM walk GROUP BY ALL)"""


def taxonomy_ancestors(spark, d):
    return tx.ancestors(place_edges(spark, d)).drop("taxonomy")


def order_places(spark, d):
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(
        customer.join(nation, customer.c_nationkey == nation.n_nationkey), F.col("o_custkey") == F.col("c_custkey")
    )
    tags = F.array(
        node("nation", "c_nationkey"), node("region", "n_regionkey"), segment(), F.lit("en:world"),
        F.when(F.col("o_orderpriority") == "1-URGENT", node("customer", "c_custkey")),
    )
    return joined.select(F.col("o_orderkey").alias("doc_id"), F.explode(tags).alias("tag")).where("tag is not null")


ORDER_PLACES_SQL = f"""
tags AS MATERIALIZED (
  SELECT o_orderkey AS doc_id, unnest(['en:nation-' || c_nationkey, 'en:region-' || n_regionkey, {NODE_SQL['segment']}, 'en:world',
    CASE WHEN o_orderpriority = '1-URGENT' THEN {NODE_SQL['customer']} END]) AS tag
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def taxonomy_deepest(spark, d):
    """Places of orders in two taxonomies with the same ids; the second knows only what lies in the world."""
    edges, tags = place_edges(spark, d), order_places(spark, d)
    both = edges.unionByName(edges.where("parent = 'en:world'").withColumn("taxonomy", F.lit("rough")))
    tagged = tags.withColumn("taxonomy", F.explode(F.array(F.lit("places"), F.lit("rough"))))
    return tx.deepest_tags(tagged, tx.ancestors(both))


#: The places have four levels at most, so plain joins give all ancestors.
DEEPEST_SQL = f"""
WITH {EDGES_SQL.split("walk AS")[0].rstrip().rstrip(",")}, {ORDER_PLACES_SQL},
two AS (SELECT a.child AS id, b.parent AS ancestor FROM edges a JOIN edges b ON a.parent = b.child),
above AS MATERIALIZED (
  SELECT 'places' AS taxonomy, child AS id, parent AS ancestor FROM edges
  UNION SELECT 'places', id, ancestor FROM two
  UNION SELECT 'places', two.id, edges.parent FROM two JOIN edges ON two.ancestor = edges.child
  UNION SELECT 'places', a.id, b.ancestor FROM two a JOIN two b ON a.ancestor = b.id
  UNION SELECT 'rough', child, parent FROM edges WHERE parent = 'en:world'
),
own AS (SELECT taxonomy, doc_id, tag FROM tags, (VALUES ('places'), ('rough')) t(taxonomy) WHERE tag IS NOT NULL),
gone AS (SELECT DISTINCT own.taxonomy, doc_id, ancestor AS tag FROM own JOIN above ON above.taxonomy = own.taxonomy AND above.id = own.tag)
SELECT taxonomy, doc_id, tag FROM own ANTI JOIN gone USING (taxonomy, doc_id, tag)"""


def taxonomy_chain(spark, d):
    """A deep taxonomy: the orders of each customer, each below the one before it; how far up its ancestors go."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    chain = table(spark, d, "orders").select(
        F.lit("orders").alias("taxonomy"), F.col("o_orderkey").cast("string").alias("child"), before.cast("string").alias("parent")
    ).where("parent is not null")
    return tx.ancestors(chain).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("top")).select("id", "n", "top")


CHAIN_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, k - 1 AS n, CAST(k - 1 AS INTEGER) AS top
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k > 1"""


def trade_pairs(spark, d):
    """Pairs of a supplier and the region of a customer it delivered to."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    to = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return lines.join(to, lines.l_orderkey == to.o_orderkey).select(
        F.lit("places").alias("taxonomy"), node("supplier", "l_suppkey").alias("id"), node("region", "n_regionkey").alias("other")
    ).distinct()


TRADE_SQL = """
trade AS MATERIALIZED (
  SELECT DISTINCT 'en:supplier-' || l_suppkey AS id, 'en:region-' || n_regionkey AS other
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def taxonomy_descendants(spark, d):
    return tx.is_descendant(trade_pairs(spark, d), tx.ancestors(place_edges(spark, d))).drop("taxonomy")


def place_nodes(spark, d):
    edges = place_edges(spark, d)
    return edges.select("taxonomy", F.col("child").alias("id")).unionByName(edges.select("taxonomy", F.col("parent").alias("id"))).distinct()


def taxonomy_ancestor_of_any(spark, d):
    pairs = trade_pairs(spark, d)
    candidates = pairs.select("taxonomy", F.col("other").alias("id"), F.col("id").alias("candidate")).unionByName(
        pairs.select("taxonomy", F.concat("id", F.lit("-gone")).alias("id"), F.col("other").alias("candidate"))
    )
    return tx.is_ancestor_of_any(candidates, tx.ancestors(place_edges(spark, d)), place_nodes(spark, d)).drop("taxonomy")


def taxonomy_children(spark, d):
    return tx.children(place_edges(spark, d)).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))


# --- a taxonomy of parts -------------------------------------------------

def part_entries(spark, d):
    part = table(spark, d, "part")
    text = F.col("p_name")
    names = F.map_from_entries(F.filter(
        F.array(
            F.struct(F.lit("en").alias("k"), F.when(F.col("p_type") != "PROMO", text).alias("v")),
            F.struct(F.lit("xx").alias("k"), F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), F.concat(text, F.lit(" int"))).alias("v")),
            F.struct(F.lit("fr").alias("k"), F.when(F.col("p_type") == "SMALL", F.concat(F.lit("petit "), text)).alias("v")),
        ),
        lambda e: e["v"].isNotNull(),
    ))
    synonyms = F.map_from_arrays(
        F.array(F.lit("en"), F.lit("xx")),
        F.array(
            F.array(F.concat_ws("-", F.lower("p_type"), "p_name"), F.initcap("p_name")),
            F.when(F.col("p_size") > 25, F.array(
                F.concat(F.lit("L'objet "), F.lower("p_brand")), F.concat(F.lit("Chose "), F.lower("p_type"))
            )).otherwise(F.array().cast("array<string>")),
        ),
    )
    return part.select(
        F.lit("parts").alias("taxonomy"), node("part", "p_partkey").alias("id"), names.alias("name"), synonyms.alias("synonyms"),
        F.array(F.concat(F.lit("en:"), F.lower("p_type")), F.lit("en:part")).alias("parents"), "p_size",
    )


PARTS_SQL = """
names AS (
  SELECT 'en:part-' || p_partkey AS id, 'en' AS lang, p_name AS name FROM part WHERE p_type <> 'PROMO'
  UNION ALL SELECT 'en:part-' || p_partkey, 'xx', p_name || ' int' FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
  UNION ALL SELECT 'en:part-' || p_partkey, 'fr', 'petit ' || p_name FROM part WHERE p_type = 'SMALL'
),
synonyms AS (
  SELECT DISTINCT id, lang, synonym FROM (
    SELECT 'en:part-' || p_partkey AS id, 'en' AS lang, lower(p_type) || '-' || p_name AS synonym FROM part
    UNION ALL SELECT 'en:part-' || p_partkey, 'en',
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') FROM part
    UNION ALL SELECT 'en:part-' || p_partkey, 'xx', 'L''objet ' || lower(p_brand) FROM part WHERE p_size > 25
    UNION ALL SELECT 'en:part-' || p_partkey, 'xx', 'Chose ' || lower(p_type) FROM part WHERE p_size > 25)
)"""


def parts(spark, d):
    return tx.taxonomy_tables(part_entries(spark, d))


def synonym_rules(spark, d):
    t = parts(spark, d)
    return tx.synonym_rules(tx.synonym_table(t.nodes, t.synonyms, ["en", "fr"])).drop("taxonomy")


def fill_international(spark, d):
    t = parts(spark, d)
    names, synonyms = tx.fill_main_and_international(t.names, t.synonyms, ["en", "fr", "de"])
    return names.select("id", "lang", F.lit("name").alias("kind"), F.col("name").alias("text")).unionByName(
        synonyms.select("id", "lang", F.lit("synonym").alias("kind"), F.col("synonym").alias("text"))
    )


FILL_SQL = f"""
WITH {PARTS_SQL},
langs AS (SELECT unnest(['en', 'fr', 'de']) AS lang),
xx AS (
  SELECT id, name FROM names WHERE lang = 'xx'
  UNION ALL SELECT id, synonym FROM synonyms WHERE lang = 'xx' AND synonym LIKE 'L''objet %' AND id NOT IN (SELECT id FROM names WHERE lang = 'xx')
),
own AS (SELECT * FROM names UNION ALL SELECT id, 'main', name FROM names WHERE lang = split_part(id, ':', 1)),
filled AS (
  SELECT * FROM own
  UNION ALL SELECT xx.id, langs.lang, xx.name FROM xx, langs WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.id = xx.id AND own.lang = langs.lang)
),
more AS (
  SELECT * FROM synonyms
  UNION SELECT id, 'main', synonym FROM synonyms WHERE lang = split_part(id, ':', 1)
  UNION SELECT names.id, langs.lang, name FROM names, langs WHERE names.lang = 'xx'
  UNION SELECT synonyms.id, langs.lang, synonym FROM synonyms, langs WHERE synonyms.lang = 'xx'
)
SELECT id, lang, 'name' AS kind, name AS text FROM filled UNION ALL SELECT id, lang, 'synonym', synonym FROM more"""


def suggest_table(spark, d):
    t = parts(spark, d)
    return sg.suggest_table(t.names, t.synonyms, ["en", "fr"]).drop("taxonomy")


INPUTS_SQL = """
inputs AS (
  SELECT lang, id, input, max(is_name) AS is_name FROM (
    SELECT lang, id, name AS input, 1 AS is_name FROM names WHERE lang IN ('en', 'fr')
    UNION ALL SELECT lang, id, synonym, 0 FROM synonyms WHERE lang IN ('en', 'fr')) GROUP BY ALL
),
suggest AS MATERIALIZED (
  SELECT lang, id, input, CAST(greatest(100 - length(id), 0) AS INTEGER) AS weight,
    CAST(row_number() OVER (PARTITION BY lang, id ORDER BY is_name DESC, CASE WHEN is_name = 1 THEN 0 ELSE length(input) END, input) AS INTEGER) AS position
  FROM inputs
)"""


def localized_names(spark, d):
    return tx.localized_names(parts(spark, d).names, "fr").drop("taxonomy")


def taxonomy_export(spark, d):
    t = parts(spark, d)
    return tx.taxonomy_export(t.nodes, t.edges, t.names).drop("taxonomy")


def typed_texts(spark, d, cut):
    """What users may have typed on the way to a part name."""
    names = table(spark, d, "part").select("p_name").distinct()
    typed = F.expr("left(p_name, length(p_name) - 2)") if cut == "end" else F.expr("concat(left(p_name, 2), substring(p_name, 4))")
    return names.select(F.col("p_name").alias("query_id"), F.upper(typed).alias("q"))


def completions(spark, d, cut, fuzziness):
    t = parts(spark, d)
    table_ = sg.suggest_table(t.names, t.synonyms, ["en", "fr"])
    return sg.complete(typed_texts(spark, d, cut), table_, t.names, ["en", "fr"], 5, fuzziness).drop("taxonomy")


def complete_prefix(spark, d):
    return completions(spark, d, "end", 0)


def complete_fuzzy(spark, d):
    return completions(spark, d, "middle", 1)


def complete_sql(typed: str, fuzziness: int) -> str:
    key = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
    edits = "CASE WHEN starts_with(key, qk) THEN 0"
    if fuzziness:
        n = fuzziness
        options = ", ".join(f"levenshtein(left(key, greatest(length(qk) + {i}, 1)), qk)" for i in range(-n, n + 1))
        edits += f" WHEN length(qk) >= 3 AND left(key, 1) = left(qk, 1) AND least({options}) <= {n} THEN least({options})"
    return f"""
WITH {PARTS_SQL}, {INPUTS_SQL},
q AS (SELECT DISTINCT p_name AS query_id, upper({typed}) AS q FROM part),
qk AS (SELECT query_id, {key.format('q')} AS qk FROM q),
keyed AS (SELECT *, {key.format('input')} AS key FROM suggest),
found AS (SELECT query_id, lang, id, weight, position, input, {edits} END AS edits FROM qk, keyed),
best AS (SELECT DISTINCT ON (query_id, lang, id) * FROM found WHERE edits IS NOT NULL ORDER BY query_id, lang, id, edits, position, input),
by_text AS (SELECT DISTINCT ON (query_id, lang, input) * FROM best ORDER BY query_id, lang, input, edits, weight DESC, id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY edits, weight DESC, id, input) AS spot FROM by_text) WHERE spot <= 5),
merged AS (SELECT DISTINCT ON (query_id, id) * FROM kept ORDER BY query_id, id, lang, spot, input)
SELECT query_id, m.id, m.input AS text, coalesce(n.name, '') AS name, m.weight AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY edits, weight DESC, m.id) AS INTEGER) AS rank
FROM merged m LEFT JOIN names n ON n.id = m.id AND n.lang = 'en'"""


def complete_chosen(spark, d):
    """Completion within chosen taxonomies: a third of the texts names none, the others one or two."""
    t = parts(spark, d)
    half = F.when(F.col("id").rlike("[02468]$"), "even").otherwise("odd")
    shown = sg.suggest_table(t.names, t.synonyms, ["en", "fr"]).withColumn("taxonomy", half)
    chosen = F.when(F.length("query_id") % 3 == 1, F.array(F.lit("even"))).when(
        F.length("query_id") % 3 == 2, F.array(F.lit("odd"), F.lit("none"))
    )
    queries = typed_texts(spark, d, "end").withColumn("taxonomies", chosen)
    return sg.complete(queries, shown, t.names.withColumn("taxonomy", half), ["en", "fr"], 5).drop("taxonomy")


CHOSEN_SQL = complete_sql("left(p_name, length(p_name) - 2)", 0).replace("FROM qk, keyed)", """FROM qk, keyed
  WHERE length(query_id) % 3 = 0 OR (length(query_id) % 3 = 1) = regexp_matches(id, '[02468]$'))""")


def suggestion_labels(spark, d):
    t = parts(spark, d)
    s = sg.suggest_table(t.names, t.synonyms, ["en"])
    named = s.join(t.names.where("lang = 'en'").select("id", "name"), "id", "left")
    return named.select(
        sg.strip_lang_prefix(F.col("id")).alias("id"), sg.suggestion_label(F.col("input"), F.col("name")).alias("label")
    )


# --- texts to entries ------------------------------------------------------

def benchmark_synonyms(spark, d):
    """Every run of two and three words of the benchmark texts, as a synonym of an entry of its own."""
    words = items(spark, d).select("words", F.posexplode("words").alias("i", "w"))
    runs = words.select(F.explode(F.array(*[
        F.when(F.col("i") + n <= F.size("words"), F.array_join(F.slice("words", F.col("i") + 1, n), " ")) for n in (2, 3)
    ])).alias("synonym")).where("synonym is not null").distinct()
    langs = F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]))
    return runs.select(
        F.lit("runs").alias("taxonomy"), langs.alias("lang"), F.concat(F.lit("xx:"), F.translate("synonym", " ", "_")).alias("id"), "synonym"
    )


def tag_documents(spark, d):
    spans = synonym_spans(benchmark_synonyms(spark, d), FOLDED)
    return tag_entities(corpus(spark, d), spans).select("doc_id", "start", "n_words", "id")


TAG_SQL = f"""
WITH RECURSIVE {CORPUS_SQL}, {ITEMS_SQL},
runs AS (SELECT words, unnest(range(1, len(words) + 1)) AS i FROM items),
phrases AS (
  SELECT DISTINCT 2 AS n, array_to_string(words[i:i + 1], ' ') AS phrase FROM runs WHERE i + 1 <= len(words)
  UNION SELECT DISTINCT 3, array_to_string(words[i:i + 2], ' ') FROM runs WHERE i + 2 <= len(words)
),
grams AS (
  SELECT doc_id, unnest(range(len(tokens))) AS start, tokens FROM corpus
),
hits AS (
  SELECT doc_id, start, n, phrase FROM (
    SELECT doc_id, start, 2 AS n, array_to_string(tokens[start + 1:start + 2], ' ') AS phrase FROM grams WHERE start + 2 <= len(tokens)
    UNION ALL SELECT doc_id, start, 3, array_to_string(tokens[start + 1:start + 3], ' ') FROM grams WHERE start + 3 <= len(tokens))
  JOIN phrases USING (n, phrase)
),
longest AS MATERIALIZED (SELECT DISTINCT ON (doc_id, start) * FROM hits ORDER BY doc_id, start, n DESC),
chain AS MATERIALIZED (
  SELECT a.doc_id, a.start, a.n, a.phrase, b.start AS next
  FROM longest a ASOF LEFT JOIN longest b ON a.doc_id = b.doc_id AND a.start + a.n <= b.start
),
read AS (
  SELECT * FROM chain WHERE (doc_id, start) IN (SELECT (doc_id, min(start)) FROM chain GROUP BY doc_id)
  UNION ALL SELECT c.* FROM read JOIN chain c ON c.doc_id = read.doc_id AND c.start = read.next
)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n_words, 'xx:' || replace(phrase, ' ', '_') AS id FROM read"""


def taxonomy_match(spark, d):
    """Customers whose places include what a region name or a market segment says."""
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    docs = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey", F.array(node("region", "n_regionkey"), segment()).alias("places")
    )
    synonyms = region.select(node("region", "r_regionkey").alias("id"), F.col("r_name").alias("synonym")).unionByName(
        customer.select(segment().alias("id"), F.col("c_mktsegment").alias("synonym")).distinct()
    ).select(F.lit("places").alias("taxonomy"), F.lit("en").alias("lang"), "id", "synonym")
    queries = region.select(F.concat(F.lit("from "), F.col("r_name")).alias("text")).unionByName(
        customer.select(F.lower("c_mktsegment").alias("text")).distinct()
    ).unionByName(region.select(node("region", "r_regionkey").alias("text")))
    queries = queries.select(F.col("text").alias("query_id"), "text", F.lit("en").alias("lang"))
    return match_taxonomy(docs, "c_custkey", "places", queries, synonym_spans(synonyms), "places")


QUERIES = {
    "taxonomy_ancestors": Query(taxonomy_ancestors, f"WITH RECURSIVE {EDGES_SQL} SELECT id, ancestor, depth FROM closure"),
    "taxonomy_deepest": Query(taxonomy_deepest, DEEPEST_SQL),
    "taxonomy_chain": Query(taxonomy_chain, CHAIN_SQL),
    "complete_chosen": Query(complete_chosen, CHOSEN_SQL),
    "taxonomy_descendants": Query(taxonomy_descendants, f"""
WITH RECURSIVE {EDGES_SQL}, {TRADE_SQL}
SELECT t.id, t.other, c.id IS NOT NULL AS is_descendant FROM trade t LEFT JOIN closure c ON c.id = t.id AND c.ancestor = t.other"""),
    "taxonomy_ancestor_of_any": Query(taxonomy_ancestor_of_any, f"""
WITH RECURSIVE {EDGES_SQL}, {TRADE_SQL}
SELECT t.other AS id, true AS known, bool_or(c.id IS NOT NULL) AS is_ancestor
FROM trade t LEFT JOIN closure c ON c.id = t.id AND c.ancestor = t.other GROUP BY t.other
UNION ALL SELECT DISTINCT id || '-gone', false, false FROM trade"""),
    "taxonomy_children": Query(taxonomy_children, f"""
WITH RECURSIVE {EDGES_SQL} SELECT parent, count(DISTINCT child) AS n_children FROM edges GROUP BY parent"""),
    "synonym_rules": Query(synonym_rules, f"""
WITH {PARTS_SQL},
present AS (SELECT DISTINCT id, lang FROM synonyms WHERE lang IN ('en', 'fr')),
raw AS (
  SELECT id, lang, synonym FROM synonyms WHERE lang IN ('en', 'fr')
  UNION ALL SELECT p.id, p.lang, s.synonym FROM present p JOIN synonyms s ON s.id = p.id AND s.lang = 'xx'
  UNION ALL SELECT id, lang, split_part(id, ':', 2) FROM present
),
clean AS (SELECT DISTINCT id, lang, trim(regexp_replace(lower(synonym), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS s FROM raw)
SELECT id, lang, string_agg(s, ',' ORDER BY s) || ' => ' || id AS rule FROM clean WHERE s <> '' GROUP BY id, lang"""),
    "fill_international": Query(fill_international, FILL_SQL),
    "suggest_table": Query(suggest_table, f"WITH {PARTS_SQL}, {INPUTS_SQL} SELECT * FROM suggest"),
    "localized_names": Query(localized_names, f"""
WITH {PARTS_SQL} SELECT id, coalesce(max(CASE WHEN lang = 'fr' THEN name END), max(CASE WHEN lang = 'xx' THEN name END)) AS name
FROM names WHERE lang IN ('fr', 'xx') GROUP BY id"""),
    "taxonomy_export": Query(taxonomy_export, f"""
WITH {PARTS_SQL},
n AS (SELECT id, string_agg('"' || lang || '":"' || name || '"', ',' ORDER BY lang) AS names FROM names GROUP BY id)
SELECT 'en:part-' || p_partkey AS id,
  '{{"name":{{' || coalesce(names, '') || '}},"parents":["' || least('en:' || lower(p_type), 'en:part') || '","' || greatest('en:' || lower(p_type), 'en:part') || '"]}}' AS entry
FROM part LEFT JOIN n ON n.id = 'en:part-' || p_partkey"""),
    "complete_prefix": Query(complete_prefix, complete_sql("left(p_name, length(p_name) - 2)", 0)),
    "complete_fuzzy": Query(complete_fuzzy, complete_sql("left(p_name, 2) || substr(p_name, 4)", 1)),
    "suggestion_labels": Query(suggestion_labels, f"""
WITH {PARTS_SQL}, {INPUTS_SQL}
SELECT split_part(s.id, ':', 2) AS id, CASE WHEN n.name IS NOT NULL AND n.name <> input THEN input || ' (' || n.name || ')' ELSE input END AS label
FROM suggest s LEFT JOIN names n ON n.id = s.id AND n.lang = 'en' WHERE s.lang = 'en'"""),
    "tag_entities": Query(tag_documents, TAG_SQL),
    "match_taxonomy": Query(taxonomy_match, f"""
WITH q AS (
  SELECT 'from ' || r_name AS query_id, 'en:region-' || r_regionkey AS place FROM region
  UNION ALL SELECT DISTINCT lower(c_mktsegment), {NODE_SQL['segment']} FROM customer
  UNION ALL SELECT 'en:region-' || r_regionkey, 'en:region-' || r_regionkey FROM region
),
docs AS (SELECT c_custkey AS doc_id, unnest(['en:region-' || n_regionkey, {NODE_SQL['segment']}]) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT DISTINCT query_id, doc_id FROM q JOIN docs USING (place)"""),
}
