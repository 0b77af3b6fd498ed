import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.functions import vectors as V
from codeloom.operators import chunking, metrics, ml, relational


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


LOC = "// c\n\nx=1\n/* a\nb */\ny=2\n# z"


def test_code_lines_and_comments(spark):
    assert one(spark, X.code_lines("s"), s=LOC) == 2
    assert one(spark, F.size(X.lines("s")), s=LOC) == 7
    assert one(spark, metrics.comment_percent(F.lit(7), F.lit(2))) == 71.4
    assert one(spark, X.code_lines("s"), s='"""\ndoc\n"""\nx = 1\n/* one line */\n<!-- c\ny') == 3  # a lone mark opens and closes
    assert one(spark, X.code_lines("s", X.PARSER_PREFIXES), s="% x\n<!-- y\nz") == 3
    assert one(spark, X.code_lines(F.lit(None).cast("string"))) == 0


def test_numbers(spark):
    assert one(spark, X.estimate_tokens("s"), s="a" * 13) == 4
    assert one(spark, X.estimate_tokens("s"), s="") == 0
    assert one(spark, X.round_half_up(F.lit(-2.5))) == -2.0
    assert one(spark, X.round_half_up(F.lit(2.345), 2)) == 2.35
    assert one(spark, X.round_half_even(F.lit(2.5))) == 2.0
    assert one(spark, X.min_max(F.lit(70), 0.0, 50.0)) == 1.0
    assert one(spark, X.min_max(F.lit(70), 5.0, 5.0)) == 0.0


def test_paths(spark):
    assert one(spark, X.basename("p"), p="a/b.c") == "b.c"
    assert [one(spark, X.dirname("p"), p=p) for p in ("a/b/c.js", "c.js")] == ["a/b", "."]
    assert [one(spark, X.extname("p"), p=p) for p in (".env", "a/x.test.js", "Makefile")] == ["", ".js", ""]
    assert one(spark, X.normalise("p"), p="a/./b/../c//d") == "a/c/d"
    assert one(spark, X.normalise("p"), p="../x") == "../x"
    assert [one(spark, X.package_key("s"), s=s) for s in ("@scope/pkg/x", "lodash/fp", "./a", "node:fs")] == ["@scope/pkg", "lodash", None, None]
    assert [one(spark, X.dependency_class("s"), s=s) for s in ("fs", "node:fs", "./a", "React")] == ["builtin", "external", "local", "local"]
    assert one(spark, X.dependency_class("s", F.lit("Python")), s="os.path") == "builtin"
    assert one(spark, X.dependency_class("s", F.lit("Java")), s="javax.inject") == "builtin"


def test_classifiers(spark):
    assert one(spark, X.phase(F.lit("UserSchema models/user.js"), F.lit("class"))) == "validation"
    assert one(spark, X.phase(F.lit("x"), F.lit("route"))) == "request"
    assert [one(spark, X.layer("p"), p=p) for p in ("index.js", "src/index.js", "src/services/a.js", "x/y.spec.ts")] == ["entry", "other", "service", "test"]
    assert one(spark, X.summary_layer("p"), p="a/b.jsx") == "component"
    assert [one(spark, X.confidence_class(F.lit(s))) for s in (0.9, 0.7, 0.5, 0.3, 0.29)] == ["definite", "high", "medium", "low", "speculative"]


def test_follow_ups(spark):
    cases = [("why?", 1, True), ("Explain the login controller in detail please", 0, False), ("Android setup for release builds in the client", 1, True), ("How is it built?", 1, True), ("Where?", 2, True), ("Where?", 1, False)]
    assert [one(spark, X.is_follow_up("t", "n"), t=t, n=n) for t, n, _ in cases] == [x for _, _, x in cases]


def test_strings(spark):
    assert one(spark, F.length(X.trim_space("s")), s="  a \t ") == 1
    assert one(spark, X.file_references("s"), s="see file:a/b.js and `x.py` or src/z/q.ts then `x.py`") == ["a/b.js", "x.py", "src/z/q.ts"]
    assert one(spark, X.line_number("s", F.lit(4)), s="a\nb\nc") == 3
    assert one(spark, X.diagram_id("s"), s="a-b.c") == "a_b_c"
    assert one(spark, X.is_retryable("s"), s="429 Too Many Requests") and not one(spark, X.is_retryable("s"), s="401 unauthorized")
    assert one(spark, X.retry_delay_ms(F.lit(3))) == 4000.0
    assert one(spark, X.mask_value("s"), s="secret") == "***masked***"


def test_vectors(spark):
    cos = lambda a, b: one(spark, V.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert cos([1.0, 2.0], [2.0, 1.0]) == pytest.approx(0.8)
    assert cos([1.0], [1.0, 2.0]) == 0.0 and cos([0.0, 0.0], [1.0, 1.0]) == 0.0
    assert one(spark, V.fit_length(F.array(F.lit(1.0)), 3)) == [1.0, 0.0, 0.0]
    assert one(spark, V.fit_length(F.array(F.lit(1.0), F.lit(2.0)), 1)) == [1.0]
    e = one(spark, V.hashed_embedding("s", 8), s="alpha beta alpha")
    assert len(e) == 8 and sum(x * x for x in e) == pytest.approx(1.0)
    assert one(spark, V.hashed_embedding("s", 8), s="  ") == [0.0] * 8


def test_vector_quality(spark):
    df = spark.createDataFrame([([0.0, 0.0],)] * 3 + [([1.0, 0.0],)] * 7, "embedding array<double>")
    r = metrics.vector_quality(df).first()
    assert (r.n_zero, r.zero_percent, r.status) == (3, 30.0, "warning")
    assert metrics.vector_quality(df.limit(0)).first().status == "ok"


def test_maintainability_and_dimensions(spark):
    assert one(spark, metrics.maintainability(F.lit(6.0), F.lit(2000), F.lit(40), F.lit(10.0))) == 84.0
    assert one(spark, metrics.maintainability(F.lit(6.0), F.lit(0), F.lit(40), F.lit(10.0))) == 100.0
    m = spark.createDataFrame([(2000, 40, 6.0, 20, 4, 10, 1, 20, 40, 10, 70.0, 10.0, 1, 0.8)], "total_loc int, file_count int, avg_cc double, max_cc int, folder_depth int, dep_chain_length int, circular_dep_count int, route_count int, async_count int, class_count int, maintainability double, comment_percent double, level_no int, confidence double")
    r = metrics.dimension_scores(m).first()
    assert (r.size_score, r.complexity_score, r.architecture_score, r.surface_score, r.quality_score) == (3.0, 5.0, 6.6, 3.0, 3.4)
    d = ml.difficulty(m).first()
    assert (d.score, d.learning_hours, d.level) == (6.2, 18.0, "Intermediate")


def test_features_default(spark):
    r = ml.features(spark.createDataFrame([(None, 0.0)], "total_loc long, maintainability double")).first()
    assert (r.total_loc, r.maintainability, r.route_count) == (0.0, 100.0, 0.0)
    assert ml.features(spark.createDataFrame([(0.0,)], "maintainability double"), mi_zero_is_100=False).first().maintainability == 0.0


def test_difficulty_model(spark):
    model, found = ml.train(ml.training_set(spark), trees=20)
    assert found["test_accuracy"] > 0.95
    assert abs(sum(v for k, v in found.items() if k.startswith("importance_")) - 1) < 1e-6
    got = ml.predict(spark.createDataFrame([(100, 5), (45_000, 450)], "total_loc int, file_count int"), model).collect()
    assert all(1 <= r.score <= 10 and abs(sum(r.probabilities) - 1) < 1e-6 for r in got)
    plain = [{n: (ends[k][0] + ends[k][1]) / 2 for n, (*ends, _) in ml.CLASS_RANGES.items()} for k in range(4)]
    seen = ml.predict(spark.createDataFrame(plain).withColumn("at", F.monotonically_increasing_id()), model).orderBy("at").collect()
    assert [r.level for r in seen] == ["Beginner", "Intermediate", "Advanced", "Expert"] and all(r.confidence > 0.6 for r in seen)


def test_training_rows_stay_in_their_ranges(spark):
    rows = ml.training_set(spark).collect()
    assert [sum(r.label == k for r in rows) for k in range(4)] == list(ml.ROWS)
    for name, (*ends, places) in ml.CLASS_RANGES.items():
        for k, (low, high) in enumerate(ends):
            own = [r[name] for r in rows if r.label == k]
            assert low <= min(own) and max(own) <= high and all(x == round(x, places) for x in own)
            if not places and high - low < 20:
                assert {low, high} <= set(own)


def test_password_and_checks(spark):
    s = one(spark, relational.password_score(F.lit("Abcdefgh1!")))
    assert s == 5 and one(spark, relational.password_label(F.lit(s))) == "Strong"
    assert one(spark, relational.registration_errors(F.lit("A"), F.lit("x"), F.lit("Abcdefg1"))) == ["name", "email"]
    assert one(spark, relational.acceptable_upload(F.lit("a.ZIP"), F.lit("text/plain"), F.lit(10)))
    assert not one(spark, relational.acceptable_upload(F.lit("a.zip"), F.lit("application/zip"), F.lit(51 * 1024 * 1024)))


def test_maps_and_islands(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"b": "3"}), ({"a": "1"}, None)], "x map<string,string>, y map<string,string>")
    assert [r.m for r in df.select(relational.merged_maps("x", "y").alias("m")).collect()] == [{"a": "1", "b": "3"}, {"b": "3"}, {"a": "1"}]
    got = relational.islands(spark.createDataFrame([("k", x) for x in (1, 2, 3, 7, 9, 10)], "k string, p int"), "k", "p").orderBy("first_pos").collect()
    assert [(r.first_pos, r.last_pos, r.n) for r in got] == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]


def test_brackets():
    assert chunking.split_depth0("a: Map<x, y>, b = [1, 2], c = 'p,q'") == ["a: Map<x, y>", "b = [1, 2]", "c = 'p,q'"]
    s = "f() { // }\n '}' /* } */ { } }x"
    assert s[chunking.closing_brace(s, s.index("{"))+1:] == "x"
    assert chunking.closing_brace("{ {", 0) == -1
