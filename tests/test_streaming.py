"""The ingestion job resumes with new files, and a repeated batch has the effect of one."""

from pyspark.sql import functions as F

from wardline import queries as registry
from wardline.operators.quality import ReportColumns, quality_gate
from wardline.streaming import jobs as j

registry.load()
GOOD = "The worker slipped on the wet deck near the main pump today"


def prepare(batch):
    return quality_gate(batch, ReportColumns("t"), with_dates=False)


def test_resume_and_dedupe(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def add(rows):
        spark.createDataFrame(rows, "incident_id long, t string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = j.file_stream(spark, source, spark.read.parquet(source).schema)
        j.ingest_stream(stream, prepare, lambda ok: ok.select("incident_id", F.lit("rule").alias("rule")), target).awaitTermination()

    add([(1, GOOD), (2, "test"), (1, GOOD)])
    run()
    add([(1, GOOD), (3, GOOD)])
    run()
    run()
    read = lambda name: spark.read.parquet(f"{target}/{name}")
    assert sorted(r["incident_id"] for r in read("accepted").collect()) == [1, 3]
    assert [r["incident_id"] for r in read("rejected").collect()] == [2]
    assert read("tags").count() == 2


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(3).withColumnRenamed("id", "k")
    for _ in range(2):
        j.write_batch(j.unseen(rows, path, "k", 0), path, 0)
    j.write_batch(j.unseen(spark.range(5).withColumnRenamed("id", "k"), path, "k", 1), path, 1)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_a_table_streams_as_one_file_or_as_a_folder(spark, tmp_path):
    """Whole tables by either layout through the registered ingestion queries."""
    rows = [(i, f"{GOOD} {i}" if i % 3 else "test", "en", "web") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    for layout in ("folder", "file"):
        run = lambda name: registry.QUERIES[name](spark, str(tmp_path / layout)).collect()  # noqa: E731, B023
        once = run("s2_exactly_once")
        assert {r["n"] for r in once} == {1} and len(once) + len(run("s5_rejected")) == 12
        assert 0 < len(run("s1_ingest_tags")) <= 12
        assert len(run("s1_ingest_accepted")) == len(once)
