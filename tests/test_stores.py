"""Retrieval, chat, stores and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from codeloom.functions.vectors import hashed_embedding
from codeloom.operators import chat, retrieval
from codeloom.sources import repositories, sinks
from codeloom.streaming import limits, progress, streams


def test_retrieval_modes(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<double>")
    hits = retrieval.scored(chunks, q)
    assert [r.id for r in retrieval.top_k(hits, 5).orderBy("rank").collect()] == [1, 2]
    assert retrieval.top_k(hits, 5, threshold=0.0, inclusive=True).count() == 4
    assert rows(retrieval.scored(chunks, q, query_rows=0 + 1), "id", "score") == rows(hits, "id", "score")
    many = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query_id int, query_vector array<double>")
    assert rows(retrieval.scored(chunks, many, query_rows=2), "query_id", "id", "score") == rows(retrieval.scored(chunks, many), "query_id", "id", "score")
    assert retrieval.ivf_shape(400) == (1, 1) and retrieval.ivf_shape(10_000) == (400, 50)


def test_rerank_and_cache(spark):
    hits = spark.createDataFrame([(0, 1, 0.5, "where is auth.js loaded", "load auth here", "src/auth.js"), (0, 2, 0.6, "where is auth.js loaded", "nothing", "x.js")], "query_id int, id int, score double, question string, content string, file_path string")
    assert retrieval.rerank(hits).orderBy(F.desc("final_score")).first().id == 1
    got = retrieval.embed_once(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string"), "t", lambda c: hashed_embedding(c, 4))
    assert got.count() == 4 and got.select(F.to_json("vector")).distinct().count() == 3


def test_prompt_budget(spark):
    q = spark.createDataFrame([(1, "what?"), (2, "none")], "query_id int, question string")
    hits = spark.createDataFrame([(1, k, f"f{k}.js", "JavaScript", "x" * 5000, 0.9) for k in range(1, 30)], "query_id int, rank int, file_path string, language string, content string, score double")
    history = spark.createDataFrame([(1, 1, "User: hi")], "query_id int, line_no int, line string")
    got = {r.query_id: r for r in chat.rag_prompts(q, hits, history).collect()}
    assert got[1].chunk_tokens <= 3500 and "## Previous\nUser: hi" in got[1].prompt and "### f1.js (90%)" in got[1].prompt and "f20.js" not in got[1].prompt
    assert got[2].chunk_tokens == 0 and got[2].prompt.endswith("## Question\nnone")


def test_history_modes(spark):
    m = spark.createDataFrame([("s", k, "user", "x" * 1500) for k in range(6)], "session string, turn int, role string, text string")
    assert chat.history_budget(m, "session", "turn").count() == 4
    assert chat.history_budget(m, "session", "turn", cumulative=True).count() == 1


def test_vector_store(spark, tmp_path):
    at = str(tmp_path / "store")
    c = spark.createDataFrame([("p", "h1", "a", 0, 3, "f", "class", "body"), ("q", "h2", "b", 0, 3, None, None, "text")], "project_id string, chunk_hash string, file_path string, start_line int, end_line int, function_name string, symbol_type string, content string")
    v = spark.createDataFrame([("h1", [1.0]), ("h2", [2.0])], "chunk_hash string, vector array<double>")
    full = sinks.checked_index(c, v)
    sinks.overwrite_projects(full, at)
    sinks.overwrite_projects(full.where("project_id = 'p'").withColumn("content", F.lit("new")), at)
    assert rows(sinks.read_projects(spark, at), "project_id", "content") == {("p", "new"), ("q", "text")}
    sinks.drop_project(spark, at, "p")
    assert rows(spark.read.parquet(at), "project_id") == {"q"}
    with pytest.raises(ValueError):
        sinks.checked_index(c, v.limit(1))
    with pytest.raises(ValueError):
        sinks.checked_index(c.limit(0), v.limit(0))
    assert rows(sinks.collection_rows(c), "id", "document") == {("p_chunk_0", "[Class: f]\nbody"), ("q_chunk_0", "text")}
    assert rows(sinks.cascade_delete({"c": c}, spark.createDataFrame([("p",)], "project_id string"))["c"], "project_id") == {"q"}


def test_versions_and_caches(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "v1"))
    got = sinks.upsert_table(spark, str(tmp_path / "v1"), spark.createDataFrame([(2, "c")], "k int, v string"), ["k"], str(tmp_path / "v2"))
    assert rows(got, "k", "v") == {(1, "a"), (2, "c")}
    b = spark.createDataFrame([("k", [1.0], 1), ("k", [4.0], 4), ("m", [2.0], 2), ("n", [3.0], 3)], "cache_key string, vector array<double>, batch_ts int")
    assert rows(sinks.compact_cache(b), "cache_key", "batch_ts") == {("k", 4), ("m", 2), ("n", 3)}
    (tmp_path / "cache.json").write_text('{"key": "a", "vector": [1.0], "ts": 1}\n{"vectors": {"a": [2.0], "b": [3.0]}, "ts": 2}\n')
    assert {r.cache_key: list(r.vector) for r in repositories.embedding_cache(spark, str(tmp_path / "cache.json")).collect()} == {"a": [2.0], "b": [3.0]}
    now = spark.createDataFrame([(dt.datetime(2000, 1, 1),), (dt.datetime.now() + dt.timedelta(days=1),)], "modified_at timestamp")
    assert sinks.aged_out(now).count() == 1


def test_repo_urls(spark):
    urls = {"https://github.com/a/b.git": ("github", "a", "b"), "git@gitlab.com:x/y.git": ("gitlab", "x", "y"), "https://bitbucket.org/o/r/src/main": ("bitbucket", "o", "r"), "https://example.org/q/z/": ("other", "q", "z"), "nonsense": ("other", None, None)}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", repositories.parse_repo_url("u").alias("p"))
    assert {r.u: (r.p.provider, r.p.owner, r.p.repo) for r in df.collect()} == urls
    page = spark.createDataFrame([('[{"id": 1, "name": "r", "private": false, "stargazers_count": 3}]',)], "body string")
    assert repositories.repository_listing(page).first().stars == 3
    assert spark.createDataFrame([(bytearray(b"a\0b"),), (bytearray(b"ab"),)], "d binary").select(repositories.is_binary_content("d").alias("b")).collect() == [(True,), (False,)]


def stream_of(spark, df, tmp_path):
    at = str(tmp_path / "in")
    df.write.parquet(at)
    return spark.readStream.schema(df.schema).parquet(at)


def drained(df, mode):
    name = f"t{abs(hash((id(df), mode)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows_ = [(i, t0 + dt.timedelta(minutes=m), u, k) for i, (m, u, k) in enumerate([(0, 1, "a"), (1, 1, "error"), (2, 1, "b"), (50, 1, "c"), (3, 2, "a"), (300, 2, "z")])]
    return spark.createDataFrame(rows_, "event_id int, ts timestamp, user_id int, event_type string")


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    s = stream_of(spark, e, tmp_path)
    want = {(r.user_id, r.n) for r in e.groupBy(F.window("ts", "15 minutes"), "user_id").agg(F.count("*").alias("n")).collect()}
    assert rows(drained(streams.windowed_counts(s, "user_id", "ts"), "complete"), "user_id", "n") == want
    assert rows(drained(streams.latest_phase(s, "user_id", "event_type", "ts"), "complete"), "user_id", "phase") == rows(progress.latest(e, "user_id", "event_type", "ts", "event_id"), "user_id", "phase")
    segs = limits.segments(e, "user_id", "ts", "event_id", "30 minutes")
    assert rows(drained(streams.sessions(s, "user_id", "ts"), "complete"), "user_id", "n_events") == rows(segs, "user_id", "n_events")


def test_breaker_stream_equals_batch(spark, tmp_path):
    from codeloom.streaming.breaker import replay

    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(i, t0 + dt.timedelta(seconds=s), 1, f) for i, (s, f) in enumerate([(0, True), (1, True), (2, True), (3, True), (4, True), (5, False), (33, True), (34, False), (35, True)])], "event_id int, ts timestamp, user_id int, failed boolean")
    got = rows(replay(e, "user_id", "ts", "event_id"), "event_id", "state")
    assert (4, "opened") in got and (5, "open") in got and (33, "open") not in got and (7, "closed") in got
    assert rows(drained(streams.breaker_states(stream_of(spark, e, tmp_path), "user_id", "ts", "event_id"), "append"), "event_id", "state") == got


def test_limits(spark):
    e = events(spark)
    assert rows(limits.excess(e, "user_id", "ts", "event_id", "15 minutes", 2), "event_id") == {2}
    assert rows(progress.throttled(e, "user_id", ["ts"], 2), "event_id", "n") == {(1, 2), (3, 4), (5, 2)}


def test_lines_of_chunks_cut_anywhere(spark, tmp_path):
    """The same lines however a text is cut, as a table and as a stream that waits for the rest of a line."""
    import random

    rng = random.Random(4)
    said = {k: "".join(f"data: {{\"phase\": \"p{i}é\"}}\n\n" for i in range(12)) + "no end" for k in ("a", "b")}
    chunks = []
    for k, text in said.items():
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(30))})
        chunks += [(k, n, text[i:j]) for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))] + [(k, 1_000, None), (k, 1_001, "")]
    df = spark.createDataFrame(chunks, "k string, seq long, chunk string")
    want = {(k, i, x) for k, text in said.items() for i, x in enumerate(text.split("\n")[:-1])}
    assert rows(progress.lines(df, "k", "seq", "chunk"), "k", "line", "text") == want
    for b in range(3):  # chunks of a key in order over three files
        own = [c for c in chunks if min(c[1] // 11, 2) == b]
        spark.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/chunks")
    assert rows(drained(streams.lines(s, "k", "seq", "chunk"), "append"), "k", "line", "text") == want
    assert progress.lines(df.limit(0), "k", "seq", "chunk").collect() == []


def test_cache_stream_equals_batch(spark, tmp_path):
    """Entries that the stream ends are those that are not live at the watermark, over shuffled and late puts."""
    import datetime as dt
    import random

    rng, start = random.Random(6), dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    puts = [(f"k{rng.randrange(40)}", f"v{i}", start + dt.timedelta(seconds=rng.randrange(7_000))) for i in range(200)]
    puts = sorted(puts, key=lambda p: p[2].timestamp() + rng.randrange(500))  # late by less than the watermark allows
    schema = "key string, value string, ts timestamp"
    for n in range(0, 200, 50):
        spark.createDataFrame(puts[n:n + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/puts")
    spark.createDataFrame([("end", "x", start + dt.timedelta(seconds=8_000))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/puts")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/puts")
    got = {(r.key, r.value) for r in drained(streams.expiries(s, "key", "value", "ts", 1_800), "append").collect()}
    df = spark.createDataFrame(puts, schema)
    now = F.lit(start + dt.timedelta(seconds=8_000 - 600))
    live = rows(limits.live(df, "ts", "1800 seconds", now), "key")
    last = {}
    for k, v, t in puts:
        last[k] = max(last.get(k, (t, v)), (t, v))
    assert {(k, v) for k, (t, v) in last.items() if k not in live} <= got
    assert {k for k, _ in got} - {k for k in last if k not in live} <= live  # ended once before a later put
