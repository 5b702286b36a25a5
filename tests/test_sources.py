"""Files, versions and change streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetspark.operators.taxonomy import synonym_rules, synonym_table, taxonomy_tables, write_synonym_rules
from facetspark.plans.ingest import import_taxonomy
from facetspark.sources import documents as src
from facetspark.sources import versions as vs
from facetspark.streaming import changes as ch
from conftest import rows

SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("n", T.IntegerType())])


@pytest.mark.parametrize("suffix", ["jsonl", "jsonl.gz"])
def test_json_lines(spark, tmp_path, suffix):
    path = tmp_path / f"docs.{suffix}"
    text = '{"code": "1", "n": 1}\n\n{"n": 2}\n{broken\n{"code": "4", "n": 4}\n'
    path.write_bytes(gzip.compress(text.encode()) if suffix.endswith("gz") else text.encode())
    df = src.read_documents(spark, str(path), SCHEMA, partitions=2)
    denied = spark.createDataFrame([("4",)], "id string")
    assert rows(src.ingest_report(df, "code", denied)) == [("accepted", 1), ("corrupt", 1), ("denied id", 1), ("missing id", 1)]
    parsed = src.split_corrupt(src.read_documents(spark, str(path), SCHEMA))
    assert parsed.documents.count() == 3 and parsed.corrupt.count() == 1
    assert src.read_documents(spark, str(path), SCHEMA, limit=1).count() == 1
    assert src.lookup_documents(parsed.documents, "code", "4").first()["n"] == 4
    assert src.lookup_documents(parsed.documents, "code", ["1", "4"]).count() == 2


def test_taxonomy_file_rules_and_publication(spark, tmp_path):
    entries = {
        "en:bio": {"name": {"en": "Organic", "fr": None}, "synonyms": {"en": ["Organic", "eco-friendly"], "fr": ["l'agriculture bio"]}, "parents": ["en:top", "en:top"]},
        "en:top": {"name": {"xx": "Top"}},
    }
    path = tmp_path / "tax.json"
    path.write_text(json.dumps(entries))
    t = taxonomy_tables(src.read_taxonomy(spark, str(path), "labels"))
    assert rows(t.edges) == [("labels", "en:bio", "en:top")] and t.names.count() == 2
    rules = synonym_rules(synonym_table(t.nodes, t.synonyms, ["en", "fr"]))
    assert rows(rules.select("lang", "rule")) == [
        ("en", "bio,eco friendly,organic => en:bio"), ("fr", "bio,l agriculture bio => en:bio"),
    ]
    write_synonym_rules(rules, str(tmp_path / "rules"))
    write_synonym_rules(rules, str(tmp_path / "rules"))
    assert spark.read.text(str(tmp_path / "rules")).count() == 2
    import_taxonomy(t, str(tmp_path / "base"), "labels")
    assert vs.read_current(spark, str(tmp_path / "base"), "labels-names").count() == 2
    lines = tmp_path / "tax.jsonl"
    lines.write_text("\n".join(json.dumps({"id": k, **v}) for k, v in entries.items()))
    assert rows(src.read_taxonomy_lines(spark, str(lines), "labels").select("id")) == [("en:bio",), ("en:top",)]


DOCS = "id long, name string, t long"


def test_versions(spark, tmp_path):
    base = str(tmp_path)
    first = spark.createDataFrame([(1, "a", 1)], DOCS)
    old = vs.publish_version(first, base, "docs")
    new = vs.publish_version(spark.createDataFrame([(i, "b", 1) for i in range(6)], DOCS), base, "docs", "id", 3)
    assert vs.current_version(spark, base, "docs") == new and vs.current_version(spark, base, "other") is None
    updates = spark.createDataFrame([(2, "c", 5), (9, "d", 5)], DOCS)
    vs.merge_into_current(spark, base, "docs", updates, "id", "t", deleted=spark.createDataFrame([(0,)], "id long"))
    vs.merge_into_current(spark, base, "docs", updates, "id", "t", deleted=spark.createDataFrame([(0,)], "id long"))
    assert rows(vs.read_current(spark, base, "docs").select("id", "name")) == [(1, "b"), (2, "c"), (3, "b"), (4, "b"), (5, "b"), (9, "d")]
    everything = vs.read_current(spark, base, "docs").select("id").collect()
    vs.merge_into_current(spark, base, "docs", updates.limit(0), "id", "t", deleted=spark.createDataFrame(everything, "id long"))
    assert vs.read_current(spark, base, "docs").count() == 0
    versions = spark.createDataFrame([(old,), (new,), ("elsewhere-1",), ("docsearch-1",)], "name string")
    assert (old,) in rows(vs.stale_versions(versions, vs.versions_in_use(spark, base), "docs"))


def test_merge_keeps_the_layout_and_old_readers(spark, tmp_path):
    base = str(tmp_path)
    first = vs.publish_version(spark.createDataFrame([(i, "a", 1) for i in range(20)], DOCS), base, "docs", "id", 4)
    before = vs.read_current(spark, base, "docs")
    change = spark.createDataFrame([(3, "b", 2), (40, "b", 2)], DOCS)
    vs.merge_into_current(spark, base, "docs", change, "id", "t")
    after = vs.read_current(spark, base, "docs")
    assert sorted(r["id"] for r in after.collect()) == [*range(20), 40]
    assert before.count() == 20 and rows(before.select("name").distinct()) == [("a",)]
    new = vs.current_version(spark, base, "docs")
    assert vs.layout(spark, base, new)["buckets"] == 4 and {first, new} <= {r["version"] for r in vs.versions_in_use(spark, base).collect()}

    vs.publish_version(spark.createDataFrame([(1, "a", 1), (2, "a", 1)], DOCS), base, "plain")
    vs.merge_into_current(spark, base, "plain", change, "id", "t", deleted=spark.createDataFrame([(1,)], "id long"))
    assert rows(vs.read_current(spark, base, "plain")) == [(2, "a", 1), (3, "b", 2), (40, "b", 2)]
    with pytest.raises(ValueError):
        vs.merge_into_current(spark, base, "docs", change.withColumnRenamed("id", "t2").withColumnRenamed("t", "id"), "t2", "id")


EVENTS = [
    ("1000-0", "1", None), ("1000-1", "1", "deleted"), ("2000-0", "2", None), ("1500-0", "2", "deleted"), ("2500-0", "3", "deleted"),
    ("2600-0", "4", None), ("2700-0", "77", None), ("2800-0", "5", None),
]


def live(spark, base):
    return rows(vs.read_current(spark, base, "docs").select("id", "name"))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    now = spark.createDataFrame([(1, "now1", 9), (2, "now2", 9), (3, "now3", 9), (4, "now4", 9), (5, "now5", 9)], DOCS)
    start = spark.createDataFrame([(i, "old", 1) for i in (1, 2, 3, 6)], DOCS)
    expected = [(2, "now2"), (4, "now4"), (6, "old")]

    batch = str(tmp_path / "batch")
    vs.publish_version(start, batch, "docs", "id", 2)
    apply = ch.ApplyChanges(batch, "docs", "id", "t", lambda: now, denied=frozenset({"5"}))
    log = spark.createDataFrame(EVENTS, ch.EVENT_SCHEMA)
    apply(log, 0)
    apply(log, 0)
    assert live(spark, batch) == expected
    assert rows(ch.replay_changes(log, 2600).select("id")) == [("4",), ("5",), ("77",)]
    assert ch.resume_point(now, "t") == 9000

    base, files = str(tmp_path / "stream"), tmp_path / "events"
    files.mkdir()
    vs.publish_version(start, base, "docs", "id", 2)
    apply = ch.ApplyChanges(
        base, "docs", "id", "t", lambda: now, denied=frozenset({"5"}), retry_path=str(tmp_path / "retry"),
        prepare=lambda df: df.withColumn("status", F.when(F.col("id") == 4, "FOUND").otherwise("FOUND")),
    )
    for part, chunk in enumerate((EVENTS[:3], EVENTS[3:])):
        (files / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "id", "action"), e))) for e in chunk))
        stream = ch.newest_per_id(ch.read_change_files(spark, str(files)))
        ch.run_changes(stream, apply, str(tmp_path / "checkpoint"), output_mode="update").awaitTermination()
    assert live(spark, base) == expected


def test_retry_and_removed_statuses(spark, tmp_path):
    base = str(tmp_path / "base")
    now = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (3, "c", 9)], DOCS)
    vs.publish_version(spark.createDataFrame([(1, "old", 1), (2, "old", 1), (3, "old", 1)], DOCS), base, "docs", "id", 2)
    status = F.expr("case id when 1 then 'REMOVED' when 2 then 'RETRY' else 'SKIP' end")
    apply = ch.ApplyChanges(base, "docs", "id", "t", lambda: now, prepare=lambda df: df.withColumn("status", status), retry_path=str(tmp_path / "retry"))
    apply(spark.createDataFrame([("1-0", "1", None), ("2-0", "2", None), ("3-0", "3", None)], ch.EVENT_SCHEMA), 4)
    assert live(spark, base) == [(2, "old"), (3, "old")]
    assert rows(spark.read.json(str(tmp_path / "retry")).select("id", "batch_id")) == [(2, 4)]
