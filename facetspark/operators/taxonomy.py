"""Taxonomies as tables: entries, parent edges, names, synonyms, and their closure.

Tables: ``nodes(taxonomy, id, properties)``, ``edges(taxonomy, child, parent)``,
``names(taxonomy, id, lang, name)``, ``synonyms(taxonomy, id, lang, synonym[, position])``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.functions.text import normalize_term
from facetspark.scale import FREQUENT, broadcast_if_bounded, cut_lineage, is_bounded, partitions_for

ANY_LANG = "xx"


@dataclass(frozen=True)
class TaxonomyTables:
    nodes: DataFrame
    edges: DataFrame
    names: DataFrame
    synonyms: DataFrame


def taxonomy_tables(entries: DataFrame) -> TaxonomyTables:
    """Tables of ``entries(taxonomy, id, name map, synonyms map, parents array, properties)``.

    Null or empty names and synonyms are purged, repeated parents and synonyms kept once.
    """
    names = entries.select("taxonomy", "id", F.explode("name").alias("lang", "name")).where(
        F.col("name").isNotNull() & (F.col("name") != "")
    )
    synonyms = (
        entries.select("taxonomy", "id", F.explode("synonyms").alias("lang", "values"))
        .select("taxonomy", "id", "lang", F.posexplode(F.array_distinct("values")).alias("position", "synonym"))
        .where(F.col("synonym").isNotNull() & (F.col("synonym") != ""))
    )
    edges = entries.select(
        "taxonomy", F.col("id").alias("child"), F.explode(F.array_distinct("parents")).alias("parent")
    ).where(F.col("parent").isNotNull())
    properties = [c for c in entries.columns if c not in ("name", "synonyms", "parents", "taxonomy", "id")]
    return TaxonomyTables(entries.select("taxonomy", "id", *properties), edges, names, synonyms)


def children(edges: DataFrame) -> DataFrame:
    """``(taxonomy, parent, child)``: the edges seen from above."""
    return edges.select("taxonomy", "parent", "child").distinct()


def ancestors(edges: DataFrame) -> DataFrame:
    """``(taxonomy, id, ancestor, depth)``: every ancestor once, at its least depth.

    Round ``k`` knows all paths of up to ``2**k`` edges and the walks of exactly so many, at first the edges. Walks
    joined with paths give the paths twice as long, walks joined with walks the next ones. So a taxonomy of any depth
    takes a logarithmic number of rounds, and a round makes no more rows than it adds, but for ancestors reached on
    several ways. Cycles end like any other path, when nothing new is reached. Rounds are checkpointed, so neither the
    plan nor what a lost executor costs grows with the depth.
    """
    walks = cut_lineage(
        edges.select("taxonomy", F.col("child").alias("id"), F.col("parent").alias("ancestor")).where("id <> ancestor").distinct()
    )
    closure, length = walks.withColumn("depth", F.lit(1)), 1
    known = walks.count()
    single = walks.groupBy("taxonomy", "id").count().where("count > 1").isEmpty()
    if single and (rising := _walks_of_one_parent(walks, known)) is not None:
        return _paths_of_one_parent(rising)
    while True:
        onward = closure.select("taxonomy", F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), "depth")
        longer = walks.join(onward, ["taxonomy", "ancestor"]).where("id <> next").select(
            "taxonomy", "id", F.col("next").alias("ancestor"), (F.col("depth") + length).alias("depth")
        )
        closure = cut_lineage(
            closure.unionByName(longer).groupBy("taxonomy", "id", "ancestor").agg(F.min("depth").alias("depth"))
        )
        last, known = known, closure.count()
        if last == known:
            return closure
        steps = walks.select("taxonomy", F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
        walks = cut_lineage(
            walks.join(steps, ["taxonomy", "ancestor"]).where("id <> next")
            .select("taxonomy", "id", F.col("next").alias("ancestor")).distinct()
        )
        if walks.isEmpty():  # no path is longer than those known
            return closure
        length *= 2


def _walks_of_one_parent(walks: DataFrame, edges: int) -> list[DataFrame] | None:
    """Walks of 1, 2, 4, … edges where no entry has two parents; none if they never end, which takes a cycle."""
    rising = [walks]
    while 1 << len(rising) <= 2 * edges:
        steps = walks.select("taxonomy", F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
        walks = cut_lineage(
            walks.join(steps, ["taxonomy", "ancestor"]).where("id <> next").select("taxonomy", "id", F.col("next").alias("ancestor"))
        )
        if walks.isEmpty():
            return rising
        rising.append(walks)
    return None


def _paths_of_one_parent(rising: list[DataFrame]) -> DataFrame:
    """:func:`ancestors` where no entry has two parents: a round only makes the paths it adds, which are new but in cycles."""
    closure = rising[0].withColumn("depth", F.lit(1))
    for k, walks in enumerate(rising):
        onward = closure.select("taxonomy", F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), "depth")
        longer = walks.join(onward, ["taxonomy", "ancestor"]).where("id <> next").select(
            "taxonomy", "id", F.col("next").alias("ancestor"), (F.col("depth") + (1 << k)).alias("depth")
        )
        closure = closure.unionByName(cut_lineage(longer))
    return closure.groupBy("taxonomy", "id", "ancestor").agg(F.min("depth").alias("depth"))


def is_descendant(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """``pairs(taxonomy, id, other)`` with ``is_descendant``: whether ``other`` is an ancestor of ``id``."""
    known = closure.select("taxonomy", "id", F.col("ancestor").alias("other"), F.lit(True).alias("is_descendant"))
    return pairs.join(known, ["taxonomy", "id", "other"], "left").withColumn(
        "is_descendant", F.coalesce("is_descendant", F.lit(False))
    )


def is_ancestor_of_any(candidates: DataFrame, closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(taxonomy, id, known, is_ancestor)`` for ``candidates(taxonomy, id, candidate)``.

    Candidates that are no entries count for nothing; an unknown ``id`` is reported as such.
    """
    hits = closure.select("taxonomy", F.col("ancestor").alias("id"), F.col("id").alias("candidate"), F.lit(True).alias("hit"))
    known = nodes.select("taxonomy", "id", F.lit(True).alias("known")).distinct()
    return (
        candidates.join(hits, ["taxonomy", "id", "candidate"], "left")
        .groupBy("taxonomy", "id")
        .agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("is_ancestor"))
        .join(known, ["taxonomy", "id"], "left")
        .select("taxonomy", "id", F.coalesce("known", F.lit(False)).alias("known"), "is_ancestor")
    )


def deepest_tags(tags: DataFrame, closure: DataFrame) -> DataFrame:
    """``(taxonomy, doc_id, tag)`` without the tags that are ancestors of another tag of the same document.

    ``tags(taxonomy, doc_id, tag)``; only edges of a tag's own taxonomy count. A document's tags and their ancestors
    meet in one aggregation instead of in a self-join of the tags; its tasks are as many as the tags need.
    """
    keys = ["taxonomy", "tag"]
    rows = tags.count()
    parts = partitions_for(tags.sparkSession, rows)
    lineage = closure.select("taxonomy", F.col("id").alias("tag"), "ancestor").distinct()
    if is_bounded(lineage):
        found = tags.join(F.broadcast(lineage), keys)
    else:
        # frequent tags, of which there are few, meet their ancestors where they are; no task sorts all rows of one
        frequent = F.broadcast(cut_lineage(
            tags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * FREQUENT > rows).select(*keys)
        ))
        above_frequent = broadcast_if_bounded(lineage.join(frequent, keys, "left_semi"))
        rare = tags.join(frequent, keys, "left_anti").repartition(parts, *keys)
        found = tags.join(above_frequent, keys).unionByName(rare.join(lineage.repartition(parts, *keys), keys))
    above = found.select("taxonomy", "doc_id", F.col("ancestor").alias("tag"), F.lit(False).alias("own"), F.lit(True).alias("above"))
    own = tags.select("taxonomy", "doc_id", "tag", F.lit(True).alias("own"), F.lit(False).alias("above"))
    # rows of a document hardly repeat, so nothing is added up before they are dealt
    return (
        own.unionByName(above).repartition(parts, "taxonomy", "doc_id")
        .groupBy("taxonomy", "doc_id", "tag")
        .agg(F.max("own").alias("own"), F.max("above").alias("above"))
        .where(F.col("own") & ~F.col("above"))
        .select("taxonomy", "doc_id", "tag")
    )


def localized_name(names: Column, lang: str, fallback: bool = True) -> Column:
    """Name in a language out of a language map, or the international one."""
    return F.coalesce(names[lang], names[ANY_LANG]) if fallback else names[lang]


def localized_names(names: DataFrame, lang: str, fallback: bool = True) -> DataFrame:
    """``(taxonomy, id, name)`` from the names table."""
    own = F.max(F.when(F.col("lang") == lang, F.col("name")))
    international = F.max(F.when(F.col("lang") == ANY_LANG, F.col("name")))
    wanted = names.where(F.col("lang").isin(lang, ANY_LANG) if fallback else F.col("lang") == lang)
    return wanted.groupBy("taxonomy", "id").agg(
        (F.coalesce(own, international) if fallback else own).alias("name")
    ).where("name is not null")


def fill_main_and_international(
    names: DataFrame, synonyms: DataFrame, langs: Sequence[str], all_international: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Names and synonyms ready for matching, as ``(names, synonyms)``.

    The language of the id's prefix also becomes language ``main``. An international name stands in
    for missing languages and, with the international synonyms, is a synonym in every supported one.
    Taxonomies in ``all_international`` keep everything under ``xx`` and only get it as ``main``.
    """
    plain = ~F.col("taxonomy").isin(list(all_international)) if all_international else F.lit(True)
    prefix = F.substring_index("id", ":", 1)
    main_of = (plain & (F.col("lang") == prefix)) | (~plain & (F.col("lang") == ANY_LANG))
    fan_out = F.explode(F.array(*[F.lit(x) for x in langs]))

    xx_names = names.where(plain & (F.col("lang") == ANY_LANG))
    xx_synonyms = synonyms.where(plain & (F.col("lang") == ANY_LANG))
    # An entry with international synonyms only is named by the first of them (without positions, the least).
    unnamed = xx_synonyms.join(xx_names.select("taxonomy", "id"), ["taxonomy", "id"], "left_anti")
    first = F.min_by("synonym", "position") if "position" in synonyms.columns else F.min("synonym")
    stand_in = xx_names.select("taxonomy", "id", "name").unionByName(unnamed.groupBy("taxonomy", "id").agg(first.alias("name")))
    synonyms, xx_synonyms = (x.select("taxonomy", "id", "lang", "synonym") for x in (synonyms, xx_synonyms))
    own = names.unionByName(names.where(main_of).withColumn("lang", F.lit("main")))
    offered = stand_in.select("taxonomy", "id", fan_out.alias("lang"), "name")
    filled = (
        own.withColumn("own", F.lit(1)).unionByName(offered.withColumn("own", F.lit(0)))
        .groupBy("taxonomy", "id", "lang").agg(F.max_by("name", "own").alias("name"))
    )
    spread = xx_names.select("taxonomy", "id", fan_out.alias("lang"), F.col("name").alias("synonym")).unionByName(
        xx_synonyms.select("taxonomy", "id", fan_out.alias("lang"), "synonym")
    )
    more = synonyms.unionByName(synonyms.where(main_of).withColumn("lang", F.lit("main"))).unionByName(spread)
    return filled, more.distinct()


def synonym_table(
    nodes: DataFrame, synonyms: DataFrame, langs: Sequence[str]
) -> DataFrame:
    """``(taxonomy, lang, id, synonym)``: normalised synonyms per requested language.

    A language's own synonyms, the international ones and the id without its prefix; only languages
    in which the entry has synonyms of its own.
    """
    wanted = synonyms.where(F.col("lang").isin(list(langs)))
    present = wanted.select("taxonomy", "id", "lang").distinct()
    common = synonyms.where(F.col("lang") == ANY_LANG).select("taxonomy", "id", "synonym").unionByName(
        nodes.select("taxonomy", "id", F.regexp_replace("id", "^[^:]*:", "").alias("synonym"))
    )
    return (
        wanted.select("taxonomy", "lang", "id", "synonym")
        .unionByName(common.join(present, ["taxonomy", "id"]).select("taxonomy", "lang", "id", "synonym"))
        .withColumn("synonym", normalize_term(F.col("synonym")))
        .where(F.col("synonym") != "")
        .distinct()
    )


def synonym_rules(table: DataFrame) -> DataFrame:
    """``(taxonomy, lang, id, rule)`` with rule lines ``a,b => id``, one per entry and language."""
    return table.groupBy("taxonomy", "lang", "id").agg(
        F.concat(F.array_join(F.sort_array(F.collect_set("synonym")), ","), F.lit(" => "), F.col("id")).alias("rule")
    )


def write_synonym_rules(rules: DataFrame, path: str) -> None:
    """Rule files below ``taxonomy=…/lang=…``; a rerun replaces the partitions it covers."""
    (
        rules.select("taxonomy", "lang", F.col("rule").alias("value"))
        .hint("rebalance", "taxonomy", "lang")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("taxonomy", "lang").text(path)
    )


def taxonomy_export(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """``(taxonomy, id, entry)`` with each entry as JSON ``{"name": {...}, "parents": [...]}``."""
    by_entry = names.groupBy("taxonomy", "id").agg(
        F.map_from_entries(F.sort_array(F.collect_set(F.struct("lang", "name")))).alias("name")
    )
    parents = edges.groupBy("taxonomy", F.col("child").alias("id")).agg(F.sort_array(F.collect_set("parent")).alias("parents"))
    return (
        nodes.select("taxonomy", "id")
        .join(by_entry, ["taxonomy", "id"], "left")
        .join(parents, ["taxonomy", "id"], "left")
        .select("taxonomy", "id", F.to_json(F.struct(
            F.coalesce("name", F.create_map().cast("map<string,string>")).alias("name"),
            F.coalesce("parents", F.array().cast("array<string>")).alias("parents"),
        )).alias("entry"))
    )
