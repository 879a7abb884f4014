from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.sources import sinks, vault

T = datetime(2025, 1, 1)


def test_notes_and_claims(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "pages" / "a.md").write_text("---\ntitle: A\ntags: [KB, Two Words]\ncreated: 2024-05-01\n---\nbody #Inline_tag and text")
    (tmp_path / "b.md").write_text("---\n: broken: [\n---\nplain")
    (tmp_path / "_hidden" / "c.md").write_text("hidden")
    claim = {"claim_id": "c1", "claim": "It holds.", "status": "active", "confidence": 0.7, "S": 1.0, "evidence": [{"insight": "i"}], "body": "text\n"}
    (tmp_path / "pages" / "claim.md").write_text(vault.render_claim(claim))
    notes = {r.title: r for r in vault.read_notes(spark, str(tmp_path)).collect()}
    assert set(notes) == {"A", "b", "claim"}
    assert notes["A"].tags == ["inline-tag", "kb", "two-words"] and notes["A"].section == "pages" and notes["A"].date == datetime(2024, 5, 1)
    assert notes["b"].tags == [] and notes["b"].body == "plain" and notes["b"].date is not None
    got = vault.read_claims(spark, str(tmp_path)).collect()
    assert [(r.claim_id, r.status, r.evidence) for r in got] == [("c1", "active", 1)]
    assert vault.parse_claim(vault.render_claim(claim)) == claim and vault.parse_claim("no page") is None


def test_feeds_and_targets(spark):
    rss = "<rss><channel><item><title>t</title><link>u</link><guid>g</guid></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>x</title><link href="v"/><id>k</id></entry></feed>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, "not xml"), (4, None)], "id int, x string")
    assert sorted((r.title, r.url, r.key) for r in vault.feed_items(df, "id", "x").collect()) == [("t", "u", "g"), ("x", "v", "k")]
    assert vault.targets("| a |\n|---|\n| 1 |\n\ntext\n\n| name | url |\n|---|---|\n| n | http://x |\n| m | |\n") == [{"name": "n", "url": "http://x"}]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", T), (2, "b", T)], "k int, v string, ts timestamp")
    new = spark.createDataFrame([(2, "c", T), (3, "d", T + timedelta(days=2))], old.schema)
    path = str(tmp_path / "t")
    sinks.replace(spark, path, old)
    sinks.replace(spark, path, sinks.upserted(spark.read.parquet(path), new, "k"))
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert sinks.without(new, old, "k").count() == 1
    assert sinks.prune({"t": (new, "ts")}, F.lit(T + timedelta(days=1)))["t"].count() == 1
    assert sinks.newest(old.unionByName(new), "k", "ts").count() == 3
    steps = [("one", lambda df: df.withColumn("w", F.lit(1))), ("two", lambda df: df.drop("v"))]
    df, done = sinks.migrate(old, steps, ["two"])
    assert df.columns == ["k", "v", "ts", "w"] and done == ["two", "one"]
    keys = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    cache = spark.createDataFrame([("a", [1.0]), ("a", [1.0])], "cache_key string, embedding array<double>")
    every, fresh = sinks.cached_embeddings(keys, cache, lambda m: m.withColumn("embedding", F.array(F.lit(2.0))))
    assert {r.cache_key: r.embedding for r in every.collect()} == {"a": [1.0], "b": [2.0]} and fresh.count() == 1
