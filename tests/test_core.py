import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.functions import vector as V
from tesserine.functions.catalogue import PATTERNS, REPEATS, portable
from tesserine.operators import graph as G
from tesserine.operators import learning as L
from tesserine.operators import patterns as R
from tesserine.operators import relational as A
from tesserine.operators import search as S
from tesserine.operators import upsert as K
from tesserine.operators import windows as W
from tesserine.operators.components import connected_components
from tesserine.plans.scratch import discard, materialise
from tesserine.sources import files as S1
from tesserine.sources import sinks
from tesserine.streaming import changes as C


def one(df):
    return df.collect()[0][0]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (7, 7), (200, 200), (None, 3), (5, None)]
    found = {r.node: r.component for r in connected_components(edges(spark, pairs), "src", "dst").collect()}
    assert found == {i: 1 for i in range(1, 31)} | {100: 100, 101: 100, 200: 200}
    assert connected_components(edges(spark, []), "src", "dst").count() == 0


def test_scratch_is_removed(spark):
    table = materialise(spark.range(3))
    assert table.count() == 3
    discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(table._scratch_path).count()


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 0.0]), (None, [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None]
    assert [r[0] for r in df.select(V.has_dimension(F.col("a"), 2)).collect()] == [True, True, False, False]
    assert one(df.limit(1).select(V.euclidean(F.col("a"), F.lit([0.0, 0.0]).cast("array<float>")))) == 5.0
    assert one(df.limit(1).select(V.adjusted_confidence(F.lit(0.95), F.lit(True), F.lit(0), F.lit(5)))) == 1.0
    assert one(df.limit(1).select(V.adjusted_confidence(F.lit(None).cast("double"), F.lit(True), F.lit(1), F.lit(2)))) is None
    assert one(df.limit(1).select(V.enriched_text(F.lit("t"), F.lit("p"), F.lit("go"), F.array(F.lit("x"))))) == "Dependencies: x\nLanguage: go\nFile: p\nt"


def test_text_functions(spark):
    cases = {
        "lines": (T.lines(F.lit("a\r\nb\rc\n")), ["a", "b", "c"]), "no_lines": (T.lines(F.lit("")), []), "words": (T.word_count(F.lit("  a b\n c ")), 3), "no_words": (T.word_count(F.lit(" ")), 0),
        "ext": (T.extension(F.lit("a\\b.d\\c.PY")), "py"), "no_ext": (T.extension(F.lit("a.b/c")), ""), "lang": (T.language_of(F.lit("x.rs")), "rust"), "kind": (T.kind_of(F.lit("x.yml")), "config"),
        "ignored": (T.is_ignored(F.lit("a/node_modules/b")), True), "kept": (T.is_ignored(F.lit("a/node_modules2/b")), False), "norm": (T.normalised_language(F.lit("Objective-C x")), "objective_c_x"),
        "camel": (T.naming_convention(F.lit("fooBar")), "camelCase"), "snake": (T.naming_convention(F.lit("foo_bar")), "snake_case"), "pascal": (T.naming_convention(F.lit("FooBar")), "PascalCase"), "mixed": (T.naming_convention(F.lit("Foo_bar")), None),
        "url": (T.repo_name_of(F.lit("https://h/x/y.git/")), "y"), "jaccard": (T.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))), 0.5), "retry": (T.is_retryable(F.lit("timeout: permission denied")), False),
        "backoff": (T.backoff(F.lit(3), 1.0, 5.0), 5.0), "cplx": (T.pattern_complexity(F.lit("(a) @b | c*")), 11), "error": (T.error_class(F.lit("Syntax problem")), "syntax_error"),
    }
    row = spark.range(1).select(*[c.alias(n) for n, (c, _) in cases.items()]).collect()[0].asDict()
    assert row == {n: v for n, (_, v) in cases.items()}
    assert one(spark.range(1).select(T.line_counts(F.lit("# a\n\nx\n// b")))).asDict() == {"total": 4, "blank": 1, "comment": 2, "code": 1}
    assert one(spark.range(1).select(T.share_spec(F.lit("1, 2:7")))).asDict() == {"ids": [1, 2], "target": 7}


def test_catalogues_compile_for_spark(spark):
    columns = [F.regexp_count(F.lit("x = 1\n"), F.lit(portable(p))).alias(f"{f}_{n}") for f, own in PATTERNS.items() for n, p in own.items()]
    assert len(spark.range(1).select(*columns).collect()[0]) == len(columns)


def test_pattern_matches_and_counts(spark):
    df = spark.createDataFrame([(1, "# TODO: a\nx\n// FIXME b\n"), (2, None), (3, "")], "id long, t string")
    found = R.pattern_matches(df, "id", "t", {k: PATTERNS["common"][k] for k in ("todo_comment", "fixme_comment")} | {"broken": "("})
    assert [(r.pattern, r.line, r.groups) for r in found.orderBy("first").collect()] == [("todo_comment", 1, [" a"]), ("fixme_comment", 3, [" b"])]
    counts = R.pattern_counts(df, ["id"], "t", {k: PATTERNS["common"][k] for k in ("todo_comment", "fixme_comment")})
    assert sorted((r.pattern, r.n) for r in counts.collect()) == [("fixme_comment", 1), ("todo_comment", 1)]


def test_blocks_headings_sections_and_trees(spark):
    df = spark.createDataFrame([(1, "# A\n```py\n# not\nx\n```\n## B\n[s]\nk = v\n")], "id long, t string")
    assert [(r.language, r.code) for r in R.code_blocks(df, ["id"], "t").collect()] == [("py", "# not\nx")]
    assert [(r.level, r.title) for r in R.headings(df, ["id"], "t").orderBy("line").collect()] == [(1, "A"), (1, "not"), (2, "B")]
    assert [r.line for r in R.fenced_lines(df, ["id"], "t").where("inside").orderBy("line").collect()] == [3, 4]
    assert [(r.section, r.option, r.value) for r in R.sections(df, ["id"], "t").collect()] == [("s", "k", "v")]
    trees = spark.createDataFrame([(1, '{"type": "m", "children": [{"type": "if_statement", "start_point": [2, 0], "text": "q"}]}'), (2, "{"), (3, None)], "id long, a string")
    nodes = R.tree_nodes(trees, "id", "a")
    assert [(r.id, r.node, r.parent, r.type, r.depth) for r in nodes.orderBy("node").collect()] == [(1, 0, None, "m", 1), (1, 1, 0, "if_statement", 2)]
    assert R.tree_statistics(nodes, "id").collect()[0].cyclomatic == 2
    code = spark.createDataFrame([(1, "@x\ndef f():\n  try:\n    pass\n")], "id long, t string")
    assert [(r.kind, r.name) for r in R.decorated_functions(code, ["id"], "t").orderBy("line").collect()] == [("decorator", "f"), ("function", "f"), ("try", "")]


def test_change_ratio(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "wxyz"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(R.change_ratio(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]


def test_relational_operators(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 5, "z")], "k string, v int, s string")
    assert {(r.k, r.n) for r in A.count_by(df, "k").collect()} == {("a", 2), ("b", 1), (None, 1)}
    assert [(r.k, r.v) for r in A.top_per_key(df.where("k = 'a'"), ["k"], [F.desc("v")], 1).collect()] == [("a", 2)]
    assert A.groups_with_samples(df, "k", "s", 1).collect()[0].samples == "x|y"
    assert one(A.distinct_over_union([df, df], "v")) == 3
    assert {r.k for r in A.missing(df, df.where("v = 2"), ["k"]).collect()} == {"b", None}
    first = A.first_tier([df.where("v = 2").select("k"), df.select("k").distinct()], ["k"])
    assert {(r.k, r.tier) for r in first.where("k is not null").collect()} == {("a", 1), ("b", 2)}
    ranks = A.nearest_rank(spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v")), ["g"], "v", 0.95).collect()[0]
    assert (ranks.n, ranks.p, ranks.avg) == (100, 96.0, 50.5)
    fit = A.line_fit(spark.createDataFrame([("g", 0, 0.1), ("g", 10, 0.2)], "g string, x int, y double"), ["g"], "x", "y", 60.0).collect()[0]
    assert math.isclose(fit.slope, 0.01) and math.isclose(fit.forecast, 0.7)
    flat = A.line_fit(spark.createDataFrame([("g", 3, 0.1), ("g", 3, None)], "g string, x int, y double"), ["g"], "x", "y", 60.0).collect()[0]
    assert flat.slope is None and flat.forecast is None
    assert one(spark.range(1).select(T.share_of_comments(T.line_counts(F.lit(""))))) is None
    same = A.members_in_common(spark.createDataFrame([("p", 1), ("p", 2), ("q", 2), ("q", 2), ("r", None)], "k string, m int"), "k", "m").collect()
    assert [(r.key_a, r.key_b, r.shared, r.similarity) for r in same] == [("p", "q", 1, 0.5)]


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, True, 1.0), ("a", 2, False, 3.0), ("a", 3, True, 5.0)], "k string, t int, hit boolean, v double")
    assert [r.rolling_mean for r in W.rolling_mean(df, ["k"], ["t"], "v", 2).orderBy("t").collect()] == [1.0, 2.0, 4.0]
    assert W.running_rate(df, ["k"], ["t"], "hit").orderBy("t").collect()[1].running_rate == 0.5
    assert math.isclose(W.exponential_rate(df, ["k"], ["t"], "hit").collect()[0].rate, ((1.0 * 0.9 + 0.1) * 0.9) * 0.9 + 0.1)
    long = spark.createDataFrame([(1, "x" * 1050), (2, ""), (3, None)], "id long, t string")
    chunks = W.text_windows(long, "id", "t", 500, 100).orderBy("part").collect()
    assert [len(c.chunk) for c in chunks] == [500, 500, 250]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    assert {(r.k, r.v) for r in K.upsert(old, new, ["k"], [F.desc("t")]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    again = K.upsert(K.upsert(old, new, ["k"], [F.desc("t")]), new, ["k"], [F.desc("t")])
    assert {(r.k, r.v) for r in again.collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {r.k for r in K.insert_missing(old, new, ["k"]).collect()} == {3}
    kept = K.upsert_columns(old, spark.createDataFrame([(1, None), (2, "z")], "k int, v string"), ["k"], ["v"])
    assert {(r.k, r.v) for r in kept.collect()} == {(1, "a"), (2, "z")}
    a = spark.createDataFrame([(1, {"x": "1", "y": "2"})], "id long, props map<string,string>")
    b = spark.createDataFrame([(1, {"y": None, "z": "3"}), (2, {"q": "1"})], "id long, props map<string,string>")
    assert {r.id: r.props for r in K.merge_properties(a, b, "id").collect()} == {1: {"x": "1", "z": "3"}, 2: {"q": "1"}}
    merged = K.merge_edges(spark.range(3), spark.createDataFrame([(0, 1, "a"), (0, 1, "a"), (0, 9, "a")], "src long, dst long, type string"))
    assert merged.count() == 1


def test_repeat_counts_equal_the_expressions():
    rng = np.random.default_rng(4)
    signs = {"property": "a b = = \n \n", "key": "a b : : \n \n #", "conflict": "a b == == 1 2 . \n \n", "name": "a b == > \n \n !", "attribute": ": : a ! \n \n"}
    for pattern, kind in REPEATS.items():
        hits = 0
        for _ in range(4000):
            text = "".join(rng.choice([*signs[kind].split(" "), " "], rng.integers(0, 25)))
            expected = sum(1 for _ in re.finditer(pattern, text, re.MULTILINE))
            assert R.repeat_count(kind, text) == expected, (kind, text)
            hits += expected > 0
        assert hits > 5
        assert R.repeat_count(kind, "\n".join(f"k{i}" for i in range(100_000))) == 0


def test_graph_operators(spark):
    diamond = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (5, 5)])
    assert {r.node: (r.out_degree, r.in_degree, r.degree) for r in G.degrees(diamond).collect()}[5] == (1, 1, 2)
    start = spark.createDataFrame([(1,)], "node long")
    assert sorted(r.path for r in G.paths(diamond, start, 2).collect()) == ["1>2", "1>2>4", "1>3", "1>3>4"]
    assert {(r.node, r.steps) for r in G.nodes_on_cycles(diamond, 3).collect()} == {(1, 3), (2, 3), (3, 3), (4, 3), (5, 1)}
    ranks = {r.node: r["rank"] for r in G.pagerank(edges(spark, [(1, 2), (2, 1)]), rounds=6).collect()}
    assert math.isclose(ranks[1], 1.0) and math.isclose(sum(ranks.values()), 2.0)
    line = {r.node: r.score for r in G.betweenness(edges(spark, [(1, 2), (2, 3), (3, 4)])).collect()}
    assert line == {2: 2.0, 3: 2.0}
    two = edges(spark, [(1, 2), (2, 3), (1, 3), (11, 12), (12, 13), (11, 13)])
    assert len({r.community for r in G.label_propagation(two).collect()}) == 2
    assert G.pagerank(edges(spark, [])).count() == 0 and G.betweenness(edges(spark, [])).count() == 0


def test_density_clusters_match_brute_force(spark):
    rng = np.random.default_rng(0)
    points = rng.random((120, 4)) * 2
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")
    far = np.linalg.norm(points[:, None] - points[None], axis=2)
    expected = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(far <= 0.3, 1)))}
    for block_rows in (4096, 7):
        assert {(r.a, r.b) for r in G.grid_neighbours(df, "id", "v", 0.3, block_rows=block_rows).collect()} == expected
    assert G.grid_neighbours(df.limit(0), "id", "v", 0.3).count() == 0
    assert G.density_clusters(df, "id", "v", 0.3).count() == len({x for p in expected for x in p})


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((60, 5))
    vectors[7] = vectors[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(99, None), (98, [1.0])], "id long, v array<double>")
    asked = df.where("id < 10").select(F.col("id").alias("query"), F.col("v").alias("vec"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    expected = {q: [int(i) for i in np.lexsort((np.arange(60), -scores[q])) if i != q][:4] for q in range(10)}
    found = {}
    for r in S.nearest(df, "id", "v", asked, k=4, block_rows=3).orderBy("query", "place").collect():
        found.setdefault(r.query, []).append(r.id)
    assert found == expected
    assert S.nearest(df, "id", "v", asked.limit(0)).count() == 0


def test_learning(spark):
    assert L.regex_of_examples(["test_12", "test_7"]) == r"test_\d+"
    assert L.regex_of_examples([]) == ""
    df = spark.createDataFrame([("a", "x1.py"), ("a", "x22.py"), (None, "q"), ("b", None)], "k string, e string")
    assert [(r.k, r.pattern) for r in L.learned_patterns(df, "k", "e").collect()] == [("a", r"x\d+\.py")]
    assert one(spark.range(1).select(L.improvement(F.lit(0), F.lit(3)))) == 1.0
    assert one(spark.range(1).select(L.variation_score(F.lit("(a|b)")))) == 7


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_bytes("é = 1".encode())
    (tmp_path / "src" / "b.py").write_bytes(b"\xe9 = 1")
    (tmp_path / "src" / "node_modules" / "c.py").write_text("x")
    (tmp_path / "src" / "d.bin").write_text("x")
    files = S1.classified(S1.decoded(S1.list_files(spark, str(tmp_path / "src"))))
    assert {(r.path, r.text, r.language) for r in files.collect()} == {("a.py", "é = 1", "python"), ("b.py", "é = 1", "python")}
    assert S1.decoded(S1.list_files(spark, str(tmp_path / "src")), max_bytes=5).where("text is null").count() == 1
    assert S1.of_language(files, "python", 1).count() == 1
    path = sinks.replace_table(spark.range(3), str(tmp_path / "t"), 2)
    assert spark.read.parquet(path).count() == 3
    sinks.append_daily_json(spark.createDataFrame([("2024-01-02 03:04:05", 1)], "ts string, n int"), str(tmp_path / "j"), "ts")
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert one(sinks.exported(spark.createDataFrame([(1, None)], "a int, b string"))) == '{"a":1}'


def test_streams(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:00.0", "modified", 1), ("r", "2024-01-01 00:00:00.5", "modified", 2), ("r", "2024-01-01 00:00:09", "modified", 3), ("r", "2024-01-01 00:00:09", "deleted", 4), ("s", "2024-01-01 02:00:00", "modified", 5)]
    changes = spark.createDataFrame(rows, "repo string, t string, kind string, v int").withColumn("ts", F.to_timestamp("t"))
    changes.write.parquet(str(tmp_path / "in"))
    stream = C.read_changes(spark, str(tmp_path / "in"), changes.schema)
    kept = C.relevant(stream, "kind", ["modified"])
    C.run_to_end(C.debounced(kept, "repo", "ts"), str(tmp_path / "debounced"))
    assert sorted((r.repo, r.changes) for r in spark.read.parquet(str(tmp_path / "debounced" / "out")).collect())[:2] == [("r", 1), ("r", 2)]
    state = {"rows": spark.createDataFrame([], "repo string, ts timestamp, v int")}

    def write(df, _):
        state["rows"] = spark.createDataFrame(df.collect(), df.schema)

    sink = C.upsert_sink(lambda: state["rows"], write, ["repo"], "ts")
    batch = changes.where("kind = 'modified'").select("repo", "ts", "v")
    sink(batch, 0)
    sink(batch, 0)
    assert sorted((r.repo, r.v) for r in state["rows"].collect()) == [("r", 3), ("s", 5)]


def test_more_text_functions(spark):
    cases = {
        "same": (T.similar_content(F.lit("a b c d"), F.lit("a b c e")), True), "other": (T.similar_content(F.lit("abc"), F.lit("x y z w v u t")), False), "empty": (T.similar_content(F.lit(""), F.lit("")), False),
        "mean": (T.capped_mean((F.lit(20), 10.0), (F.lit(None).cast("int"), 5.0), (F.lit(1), 2.0)), 0.75), "tongue": (T.embedded_language(F.lit("a\n[source,javascript]\nx java")), "javascript"), "names": (T.capture_names(F.lit("(a) @b.c @a @a")), ["a", "b.c"]),
        "tests": (T.predicates(F.lit('(a) (#eq? @a "b")')), ['(#eq? @a "b")']), "prefixes": (T.path_prefixes(F.lit("a\\b/c.py")), ["a", "a/b"]), "none": (T.path_prefixes(F.lit("c.py")), []), "option": (T.option_class(F.lit("LogDir")), "logging"),
    }
    row = spark.range(1).select(*[c.alias(n) for n, (c, _) in cases.items()]).collect()[0].asDict()
    assert row == {n: v for n, (_, v) in cases.items()}


def test_edit_scripts_line_windows_and_derived_nodes(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "z"), (3, "q", "q")], "id long, o string, n string")
    assert [(r.id, r.op) for r in R.edit_script(df, "id", "o", "n").orderBy("id", "place").collect()] == [(1, "replace"), (1, "insert"), (2, "insert")]
    assert [r.window for r in R.line_windows(df.where("id = 1"), ["id"], "n", 2).orderBy("first").collect()] == ["a\nx", "x\nc", "c\nd"]
    own = spark.createDataFrame([(1, {"a": "x"}), (2, None)], "id long, m map<string,string>")
    assert [tuple(r) for r in G.property_nodes(own, "id", "m").collect()] == [("1_a", 1, "a", "x")]
    sets = spark.createDataFrame([("p", 2), ("p", 1), ("q", 1), ("q", 2), ("q", 2), ("r", 1)], "k string, m int")
    ids = {r.k: r.group_id for r in G.group_node(sets, ["k"], "m").collect()}
    assert ids["p"] == ids["q"] != ids["r"]
    star = {r.node: r.vec for r in G.node_embeddings(edges(spark, [(1, 3), (2, 3), (3, 4)]), dim=8).collect()}
    assert len(star) == 4 and all(len(v) == 8 for v in star.values())


def test_learned_patterns_match_every_example(spark):
    rng = np.random.default_rng(5)
    examples = {"digits": ["k1", "k2b3", "k9"], "letters": ["xa", "xbéc", "xz"], "lines": ["p:a\nb", "p:c", "p:zz"], "squares": ["n²", "n1"], "empty": ["a", "aa"], "one": ["q.x", "q.x"], "gap": ["aa", "aaa", "aba"]}
    examples |= {f"r{i}": ["".join(rng.choice(list("ab1é_-\n"), rng.integers(1, 7))) for _ in range(30)] for i in range(20)}
    df = spark.createDataFrame([(k, e) for k, own in examples.items() for e in own] + [("none", ""), (None, "x")], "k string, e string").repartition(3)
    found = {r.k: r.pattern for r in L.learned_patterns(df, "k", "e").collect()}
    assert found == {k: L.regex_of_examples(own) for k, own in examples.items()}
    assert all(re.fullmatch(found[k], e) for k, own in examples.items() for e in own)
    assert found["digits"] == r"k\w+" and found["letters"] == r"x\w+" and found["one"] == r"q\.x"
