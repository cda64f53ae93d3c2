from datetime import datetime

from pyspark.sql import functions as F

from tessella.operators import lifecycle, publishing

T = datetime(2025, 1, 1)
NOW = lambda: F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
ASK = "owner_key string, document_id string, title string, profiles array<string>, media_type string"


def test_publishing(spark):
    none = spark.createDataFrame([], publishing.DOCUMENT_SCHEMA)
    ask = spark.createDataFrame(
        [("o", "a", "  A \n title", ["p", " p ", "", "q"], "text/markdown"), ("o", "b", "B", None, "text/markdown"), ("o", "c", "C", ["p"], "text/markdown"), ("o", "d", " ", ["p"], "text/markdown"), ("o", "e", "E", ["p"], "image/png"), ("x", "f", "F", ["p"], "application/pdf")], ASK
    )
    docs, said = publishing.create(none, ask, NOW(), 2)
    assert {r.document_id: r.outcome for r in said.collect()} == {"a": "created", "b": "created", "c": "limit_reached", "d": "blank_title", "e": "bad_media_type", "f": "created"}
    assert {(r.document_id, r.title, tuple(r.profiles)) for r in docs.collect()} == {("a", "A title", ("p", "q")), ("b", "B", ()), ("f", "F", ("p",))}
    docs = publishing.set_profiles(docs, spark.createDataFrame([("o", "b", ["p"]), ("o", "zz", ["p"])], "owner_key string, document_id string, profiles array<string>"))
    reqs = spark.createDataFrame([("o", "a", "h1", "m", 1), ("o", "b", "h", "m", 1), ("x", "f", "h", "m", 1)], "owner_key string, document_id string, sha256 string, embed_model string, size_bytes bigint")
    lib = lifecycle.begin(lifecycle.Library.empty(spark), reqs, NOW())
    lib, _ = lifecycle.commit(lib, spark.createDataFrame([("a", 1), ("f", 1)], "document_id string, version int"), NOW())
    assert [r.document_id for r in publishing.readable(docs, lib, "o", "p").collect()] == ["a"]
    assert publishing.readable(docs, lib, "o", "r").collect() == [] and publishing.readable(docs, lib, "x/y", "p").collect() == []
    chunks = spark.createDataFrame([("a", 1, k, ["A title", h], f"c{k}") for k, h in enumerate(["x", "y", "x"])] + [("f", 1, 0, ["F"], "no")], "document_id string, version int, ordinal int, heading_path array<string>, content string")
    got = publishing.read_served(chunks, docs, lib, "o", "p", after=-1, limit=2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.content, r.has_more) for r in got] == [(0, "c0", True), (1, "c1", True)]
    assert [(r.document_id, r.sections) for r in publishing.outline(chunks, docs, lib, "o", "p").collect()] == [("a", ["x", "y"])]
