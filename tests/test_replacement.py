"""Rows that used to be lost or changed: vanished figures, quiet buckets, replaced documents, large ids."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import streaming
from ledgerloom.operators import access, compare, models, stages


def test_a_vanished_figure_and_each_segment_keep_their_rows(spark):
    rows = [
        ("d1", "2024Q1", "revenue", None, 100), ("d2", "2024Q2", "revenue", None, 150),
        ("d1", "2024Q1", "tax", None, 9),
        ("d1", "2024Q1", "segment_revenue", "a", 60), ("d1", "2024Q1", "segment_revenue", "b", 40),
        ("d2", "2024Q2", "segment_revenue", "b", 70), ("d2", "2024Q2", "segment_revenue", "c", 80),
    ]
    figures = spark.createDataFrame(rows, "document_id string, fiscal_period string, metric string, segment string, value int").withColumn("value", F.col("value").cast("decimal(28,4)"))
    figures = figures.withColumns({"company": F.lit("x"), "unit": F.lit("units"), "currency": F.lit("USD")})

    def told(df):
        return {
            (r["metric"], r["segment"], r["document_id"]): (r["flag"], None if r["delta"] is None else int(r["delta"])) for r in df.collect()
        }

    later = {
        ("revenue", None, "d2"): (None, 50), ("tax", None, "d2"): ("missing_other", None),
        ("segment_revenue", "a", "d2"): ("missing_other", None), ("segment_revenue", "b", "d2"): (None, 30),
        ("segment_revenue", "c", "d2"): ("missing_base", None),
    }
    assert told(compare.metric_deltas(figures, "d1", ["d2"])) == later
    by_period = told(compare.period_deltas(figures, compare.quarter_ordinal(F.col("fiscal_period"))))
    first = {k: v for k, v in by_period.items() if k[2] == "d1"}
    assert len(first) == 4 and {v for v in first.values()} == {("missing_base", None)}
    assert {k: v for k, v in by_period.items() if k[2] == "d2"} == later
    grown = compare.growth_series(figures).filter("segment = 'b' and fiscal_period = '2024Q2'").collect()
    assert [int(r["delta"]) for r in grown] == [30]


def test_a_stuck_queue_shows_in_quiet_buckets(spark, at):
    rows = [("enqueue", 0), ("enqueue", 10), ("finish", 3 * 3600), ("finish", 3 * 3600 + 5), ("enqueue", 5 * 3600), (None, 5 * 3600)]
    jobs = spark.createDataFrame([(o, at(t)) for o, t in rows] + [("enqueue", None)], "op string, ts timestamp")
    got = [(r["bucket_start"], r["max_depth"], r["end_depth"]) for r in stages.queue_depth(jobs).orderBy("bucket_start").collect()]
    assert got == [(at(3600 * h), m, e) for h, m, e in [(0, 2, 2), (1, 2, 2), (2, 2, 2), (3, 2, 0), (4, 0, 0), (5, 1, 1)]]
    # Buckets far apart lie in different runs of the second level.
    far = spark.createDataFrame([("enqueue", at(0)), ("finish", at(3600 * 2500))], "op string, ts timestamp")
    depths = [(r["max_depth"], r["end_depth"]) for r in stages.queue_depth(far).orderBy("bucket_start").collect()]
    assert depths == [(1, 1)] * 2500 + [(1, 0)]
    assert stages.queue_depth(jobs.limit(0)).count() == 0


def test_required_fields_inside_arrays(spark):
    item = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("note", T.StringType())])
    schema = T.StructType([T.StructField("items", T.ArrayType(item, True)), T.StructField("tags", T.ArrayType(T.StringType(), False))])
    texts = {
        1: '{"items":[{"name":"a"}],"tags":["x"]}', 2: '{"items":[{"name":null,"note":"b"}]}', 3: '{"items":[null]}',
        4: '{"tags":["x",null]}', 5: "{}", 6: '{"items":[],"tags":[]}',
    }
    df = spark.createDataFrame(list(texts.items()), "n int, raw string")
    got = {r["n"]: r["outcome"] for r in access.parse_structured(df, "raw", schema).collect()}
    assert {n for n, outcome in got.items() if outcome == "ok"} == {1, 3, 5, 6}


def test_generation_passes_columns_through(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "ask", [1, None]), (None, None, None)], "id bigint, prompt string, extra array<int>")
    out = models.batch_generate(df, ["prompt"], lambda p: f"<{p}>").collect()
    assert {(r["id"], r["response"], tuple(r["extra"] or ())) for r in out} == {(big, "<ask>", (1, None)), (None, "<>", ())}
    assert {(r["outcome"], r["calls"], r["tokens_in"], r["tokens_out"]) for r in out} == {("ok", 1, 1, 1), ("ok", 1, 0, 1)}
    assert models.batch_generate(df.limit(0), ["prompt"], str).count() == 0


def test_a_document_that_comes_again_replaces_all_its_chunks(spark, tmp_path):
    schema = "id string, user_id string, company string, fiscal_period string, report_type string, text string, version int"
    src, index = str(tmp_path / "src"), str(tmp_path / "index")

    def arrive(*docs):
        rows = [(i, "u1", "Acme", "FY2025", "10-K", text, v) for i, text, v in docs]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streaming.stream_ingest(spark, src, index, schema, order_by=["version"]).awaitTermination()
        found = streaming.read_stream_index(spark, index).groupBy("document_id").agg(F.count("*"), F.max("text")).collect()
        return {r[0]: (r[1], r[2]) for r in found}

    long = "word " * 2000
    got = arrive(("d1", long, 1), ("d2", "other", 1), ("d3", "gone", 1), ("d4", "newest", 2), ("d4", long, 1), ("d4", "newest", 2))
    assert got["d1"][0] > 1 and got["d2"] == (1, "other") and got["d4"] == (1, "newest")
    got = arrive(("d1", "short", 2), ("d3", "", 2))
    assert got == {"d1": (1, "short"), "d2": (1, "other"), "d4": (1, "newest")}
