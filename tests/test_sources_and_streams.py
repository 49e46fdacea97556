"""Sources, hooks and tenants; streams of several triggers against the batch rules."""

import pytest
from pyspark.sql import functions as F

from quarrymind.catalog import common as cm
from quarrymind.catalog.learning import scored_of
from quarrymind.operators import feedback, graph, learners, sessions
from quarrymind.session import scratch_path, shared_dir
from quarrymind.sources import corpus, ingest
from quarrymind.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_text_files_fall_back_to_latin_1(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("año".encode())
    (tmp_path / "b.txt").write_bytes("año".encode("latin-1"))
    assert {r.content for r in corpus.read_text_corpus(spark, str(tmp_path)).collect()} == {"año"}


def test_shared_dir_is_the_one_named(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_spaces(spark):
    corpus.create_space(spark, "space_a")
    assert "space_a" in corpus.list_spaces(spark)
    corpus.drop_space(spark, "space_a")
    assert "space_a" not in corpus.list_spaces(spark)
    with pytest.raises(ValueError):
        corpus.create_space(spark, "1; drop")
    with pytest.raises(ValueError):
        corpus.drop_space(spark, spark.catalog.currentDatabase())


def test_tenant_filter_reads_one_folder(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant string, x int")
    corpus.append(df, str(tmp_path / "t"), ["tenant"])
    one = corpus.for_tenant(spark.read.parquet(str(tmp_path / "t")), "a")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(tenant" in one._jdf.queryExecution().executedPlan().toString()


def lengths(texts):
    assert all(t.strip() for t in texts) and len(texts) <= 2
    return [[float(len(t)), 1.0] for t in texts]


def test_embedder_hook(spark):
    df = spark.createDataFrame([(1, "abc"), (2, " "), (3, None), (4, "x"), (5, "yy")], "chunk_id long, content string")
    got = {r.chunk_id: r.embedding for r in ingest.embed_table(df, lambda ts: [[float(len(t)), 1.0] for t in ts], 2, "chunk_id", batch_size=2).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [1.0, 1.0], 5: [2.0, 1.0]}


def test_ingest_splits_good_from_bad(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# Title\n" + "word " * 30), (2, "too short"), (3, "")], "source_id long, content string")
    out = ingest.ingest(docs, as_of="2024-01-01")
    assert [r.source_id for r in out.sources.collect()] == [1]
    assert {r.source_id: r.error for r in out.rejects.collect()} == {2: "Contenido muy corto: 2 palabras", 3: "Contenido normalizado vacío"}
    ingest.write_ingested(out, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store" / "edges")).where("edge_type = 'belongs_to'").count() == out.chunks.count()


def test_sessions_survive_export_and_import(spark):
    t = cm.turns(spark, SF)
    turns, totals = sessions.import_sessions(sessions.export_sessions(t), t.schema)
    assert rows(turns.select("session_id", "turn_no", "content", "token_count")) == rows(
        sessions.retained_turns(t).select("session_id", "turn_no", "content", "token_count")
    )
    assert totals.count() == t.select("session_id").distinct().count()


def test_reingesting_replaces_a_source(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# One\n" + "word " * 30), (2, "# Two\n" + "word " * 40), (3, "")], "source_id long, content string")
    base = str(tmp_path / "store")
    ingest.write_ingested(ingest.ingest(docs, as_of="2024-01-01"), base)
    once = {name: df.count() for name, df in ingest.read_ingested(spark, base)._asdict().items()}
    ingest.write_ingested(ingest.ingest(docs, as_of="2024-01-02"), base)
    again = ingest.read_ingested(spark, base)
    assert {name: df.count() for name, df in again._asdict().items()} == once
    longer = spark.createDataFrame([(2, "# Two\n" + "word " * 50)], docs.schema)
    ingest.write_ingested(ingest.ingest(longer, as_of="2024-01-03"), base)
    assert {r.source_id: r.word_count for r in ingest.read_ingested(spark, base).sources.collect()} == {1: 32, 2: 52}


class Landing:
    """Events that land in a folder in three files of rising time."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.events = spark.read.parquet(f"{SF}/events.parquet")
        ids = [r.event_id for r in self.events.orderBy("ts", "event_id").select("event_id").collect()]
        n = len(ids) // 3
        self.pieces = [ids[:n], ids[n : 2 * n], ids[2 * n :]]

    def land(self, *pieces):
        for k in pieces:
            wanted = self.spark.createDataFrame([(i,) for i in self.pieces[k]], "event_id long")
            self.events.join(wanted, "event_id", "left_semi").coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.events.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


@pytest.fixture()
def landing(spark, tmp_path):
    return Landing(spark, str(tmp_path / "events"))


def scored(spark, df):
    n_parts, n_docs = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("part", "documents"))
    return scored_of(df, n_parts, n_docs)


def rounded_rows(df, columns):
    return rows(df.select(*[F.round(c, 9).alias(c) if df.schema[c].dataType.simpleString() == "double" else c for c in columns]))


JOBS = {
    "chunks": (lambda s, df, f: jobs.chunk_metrics_stream(scored(s, df), f), lambda s, df: feedback.chunk_metrics(scored(s, df), tie="feedback_id"), ["chunk_id", "total_feedback", "positive_feedback", "average_score", "quality"]),
    "concepts": (lambda s, df, f: jobs.concept_metrics_stream(cm.signals_of(df), f), lambda s, df: feedback.concept_metrics(feedback.parse_signals(cm.signals_of(df))), ["concept_id", "total_queries", "unique_students", "average_satisfaction", "confusion_score"]),
    "mastery": (lambda s, df, f: jobs.mastery_stream(cm.interactions_of(df), f), lambda s, df: learners.mastery(cm.interactions_of(df)), ["student_id", "concept_id", "mastery_score", "interactions", "is_weakness"]),
    "profiles": (lambda s, df, f: jobs.profile_stream(cm.interactions_of(df), f), lambda s, df: learners.update_profiles(cm.interactions_of(df)), ["student_id", "total_questions", "correct_answers", "average_response_quality"]),
    "edges": (lambda s, df, f: jobs.edge_update_stream(scored(s, df), cm.edges(s, SF), f), lambda s, df: graph.apply_feedback(scored(s, df), cm.edges(s, SF))["edges"], ["edge_type", "src", "dst", "weight", "negative_signals"]),
    "signals": (lambda s, df, f: jobs.append_all(jobs.signals_stream(cm.signals_of(df)), f), lambda s, df: feedback.parse_signals(cm.signals_of(df)), ["signal_id", "value", "polarity"]),
}


@pytest.mark.parametrize("name", JOBS)
def test_a_job_that_is_started_again_equals_the_batch(spark, landing, tmp_path, name):
    """Two files, a first run, one more file, a second run with the same folder, and a third without news."""
    run, batch, columns = JOBS[name]
    folder = str(tmp_path / "job")
    landing.land(0, 1)
    run(spark, landing.stream(), folder)
    landing.land(2)
    run(spark, landing.stream(), folder)
    last = run(spark, landing.stream(), folder)
    assert rounded_rows(last, columns) == rounded_rows(batch(spark, landing.events), columns)


def test_a_job_without_rows_gives_an_empty_table(spark, landing, tmp_path):
    empty = spark.readStream.schema(landing.events.schema).parquet(str(tmp_path))
    assert jobs.mastery_stream(cm.interactions_of(empty), str(tmp_path / "job")).count() == 0


def test_sessions_go_on_where_they_stopped(spark, tmp_path):
    turns = spark.createDataFrame([(1, t, 100, [t, t + 1]) for t in range(9)], "session_id long, turn_no long, token_count long, concepts array<long>")
    folder, job = str(tmp_path / "turns"), str(tmp_path / "job")
    run = lambda: jobs.latest_per_key(jobs.session_stream(spark.readStream.schema(turns.schema).parquet(folder), max_turns=4, max_tokens=300, active=3), ["session_id"], job)
    turns.where("turn_no < 5").coalesce(1).write.mode("append").parquet(folder)
    assert rows(run()) == [(1, [2, 3, 4], 300, [3, 4, 5])]
    turns.where("turn_no >= 5").coalesce(1).write.mode("append").parquet(folder)
    assert rows(run()) == [(1, [6, 7, 8], 300, [7, 8, 9])]


def test_ingesting_goes_on_and_replaces(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# One\n" + "word " * 30), (2, "# Two\n" + "word " * 40)], "source_id long, content string")
    folder, base = str(tmp_path / "docs"), str(tmp_path / "store")
    run = lambda: jobs.ingest_stream(spark.readStream.schema(docs.schema).parquet(folder), base, as_of="2024-01-01")
    docs.coalesce(1).write.mode("append").parquet(folder)
    run()
    spark.createDataFrame([(2, "# Two\n" + "word " * 50)], docs.schema).write.mode("append").parquet(folder)
    run()
    assert {r.source_id: r.word_count for r in ingest.read_ingested(spark, base).sources.collect()} == {1: 32, 2: 52}


def test_period_stream_counts_every_event_once_per_period(spark, landing, tmp_path):
    landing.land(0, 1, 2)
    periods = jobs.latest_per_key(jobs.period_metrics_stream(scored_of(landing.stream(), 10, 10), "1 day", "1 day"), ["period_start", "period_end"], str(tmp_path / "job"))
    assert periods.agg(F.sum("total_feedback")).first()[0] == landing.events.count()
