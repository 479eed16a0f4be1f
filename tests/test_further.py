import json
import subprocess
import time

import numpy as np
import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.functions.catalogue import PATTERNS, Catalogue
from tesserine.operators import extensions as E
from tesserine.operators import graph as G
from tesserine.operators import learning as L
from tesserine.operators import patterns as R
from tesserine.operators import relational as A
from tesserine.operators import shortest
from tesserine.operators import upsert as K
from tesserine.operators.shortest import Searches, packed, searched
from tesserine.operators.tree_queries import tree_captures
from tesserine.sources import settings, sinks
from tesserine.sources.files import classified_content, relative_path
from tesserine.streaming import changes as C


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_betweenness_by_joins_equals_the_searches(spark):
    rng = np.random.default_rng(3)
    links = edges(spark, [(int(a), int(b)) for a, b in rng.integers(0, 25, (70, 2))] + [(None, 1), (3, 3)])
    plain = {r.node: r.score for r in G.betweenness(links).collect()}
    joined = {r.node: r.score for r in G.betweenness(links, max_edges=0, block_sources=10).collect()}
    assert plain and joined == pytest.approx(plain)
    assert G.betweenness(edges(spark, []), max_edges=-1).count() == 0


def brandes(links, n):
    """Betweenness by one search after the other."""
    after, score = [sorted({b for a, b in links if a == v and b != v}) for v in range(n)], np.zeros(n)
    for s in range(n):
        far, count, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in after[v]:
                if w not in far:
                    far[w], count[w] = far[v] + 1, 0
                    order.append(w)
                if far[w] == far[v] + 1:
                    count[w] += count[v]
        depends = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            depends[v] += sum(count[v] / count[w] * (1 + depends[w]) for w in after[v] if far[w] == far[v] + 1)
            score[v] += depends[v] if v != s else 0.0
    return score


@pytest.mark.parametrize("width", [1, 5, 16])
def test_searches_equal_brandes(width):
    rng = np.random.default_rng(width)
    hub = [(0, i) for i in range(1, 300)] + [(i, 0) for i in range(5, 250)] + [(300, i) for i in range(50, 290)]
    chain = [(301 + i, 302 + i) for i in range(60)]
    dense = [(int(a) + 370, int(b) + 370) for a, b in rng.integers(0, 60, (300, 2)) if a != b]
    for links, n in ((hub + chain + dense, 440), (chain + dense, 440), ([(i - 370, j - 370) for i, j in dense], 60), (hub, 301)):
        src, dst = np.array(sorted(set(links))).T
        graph = Searches(src, dst, n)
        graph.width = width
        graph.add(np.arange(n))
        assert graph.score == pytest.approx(brandes(links, n))


def scores(spark, links, n, step=1):
    """What `searched` gives over `links`, from every first source."""
    src, dst = np.array(links, np.int64).reshape(-1, 2).T
    rows = spark.createDataFrame([(bytearray(packed(src, dst, n)), first, step) for first in range(step)], "graph binary, first int, step int")
    return sum(np.frombuffer(r[0], "<f8") for r in rows.select(searched(spark, "graph", "first", "step")).collect())


@pytest.mark.parametrize("compiled", [True, False])
def test_compiled_searches_equal_brandes(spark, monkeypatch, compiled):
    if not compiled:

        def refused(session):
            raise Py4JError("no compiler")

        monkeypatch.setattr(shortest, "_compiled", refused)
    rng = np.random.default_rng(6)
    hub = [(0, i) for i in range(1, 300)] + [(i, 0) for i in range(5, 250)] + [(300, i) for i in range(50, 290)]
    chain = [(301 + i, 302 + i) for i in range(60)]
    dense = [(int(a) + 370, int(b) + 370) for a, b in rng.integers(0, 60, (300, 2)) if a != b]
    wide = [(int(a), int(b)) for a, b in rng.integers(0, 400, (2400, 2)) if a != b]
    fan = [(0, i) for i in range(1, 200)] + [(i, 200 + i % 7) for i in range(1, 200)] + [(200 + i, 210) for i in range(7)] + [(210, 0)]
    for links, n in ((hub + chain + dense, 440), (wide, 400), (wide + chain[:1], 420), (fan, 211), ([(b, a) for a, b in fan], 211), ([(0, 1)], 3)):
        links = sorted(set(links))
        for step in (1, 3):
            assert scores(spark, links, n, step) == pytest.approx(brandes(links, n))


def test_compiled_searches_outrun_those_in_numpy(spark):
    """400 searches of a random graph as large as that of the parts of sf0.1."""
    rng = np.random.default_rng(7)
    src, dst = rng.integers(0, 20_000, (2, 290_000))
    graph = spark.createDataFrame([(bytearray(packed(src, dst, 20_000)), 0, 50)], "graph binary, first int, step int").select(searched(spark, "graph", "first", "step"))
    graph.collect()
    began = time.time()
    found = np.frombuffer(graph.first()[0], "<f8")
    took, plain = time.time() - began, Searches(src, dst, 20_000)
    began = time.time()
    plain.add(np.arange(0, 20_000, 50))
    assert found == pytest.approx(plain.score) and 2 * took < time.time() - began


def test_betweenness_sends_small_components_to_tasks_however_many_edges_there_are(spark, monkeypatch):
    rng = np.random.default_rng(4)
    links = [(int(a) + 30 * c, int(b) + 30 * c) for c in range(8) for a, b in rng.integers(0, 30, (70, 2))]
    expected = {i: s for i, s in enumerate(brandes(links, 240)) if s}
    seen = []
    monkeypatch.setattr(G, "_betweenness_joined", lambda links, block: seen.append(links) or links.select(F.col("src").alias("node"), F.lit(0.0).alias("score")).limit(0))
    monkeypatch.setattr(G, "SLICE", 2)
    for unit in (10, 2000):
        monkeypatch.setattr(G, "UNIT", unit)
        for most in (1000, 100):
            assert {r.node: r.score for r in G.betweenness(edges(spark, [*links, (None, 1)]), max_edges=most).collect()} == pytest.approx(expected)
    assert not seen
    larger = links + [(int(a) + 500, int(b) + 500) for a, b in rng.integers(0, 30, (200, 2))]
    assert {r.node: r.score for r in G.betweenness(edges(spark, larger), max_edges=100).collect()} == pytest.approx(expected)
    assert len(seen) == 1 and seen[0].where("src < 500").count() == 0


def test_betweenness_searches_a_component_without_the_others(spark):
    """20,000 searches in rings of 20 nodes; over all edges at once they took minutes."""
    rings = spark.range(20_000).selectExpr("id as src", "id - id % 20 + (id + 1) % 20 as dst")
    began = time.time()
    found = [r.score for r in G.betweenness(rings).collect()]
    assert len(found) == 20_000 and set(found) == {171.0} and time.time() - began < 20


def test_modularity_finds_cliques(spark):
    cliques = [(10 * c + i, 10 * c + j) for c in range(4) for i in range(5) for j in range(i)]
    bridges = [(0, 10), (10, 20), (20, 30)]
    links = edges(spark, cliques + bridges + [(7, 7), (None, 1)])
    found = {r.node: r.community for r in G.modularity_communities(links).collect()}
    assert found == {10 * c + i: 10 * c for c in range(4) for i in range(5)}
    labels = spark.createDataFrame(list(found.items()), "node long, community long")
    assert 0.6 < G.modularity(links, labels).collect()[0][0] < 0.75
    assert G.modularity_communities(edges(spark, [])).count() == 0


def test_waiting_cycles_of_any_length(spark):
    waits = edges(spark, [(i, i % 9 + 1) for i in range(1, 10)] + [(20, 1), (21, 20)])
    started = spark.createDataFrame([(1, 5), (20, 900), (30, 999)], "txn long, age long")
    found = {(r.txn, r.reason, r.cycle) for r in G.waiting_cycles(waits, started, F.col("age") > 500).collect()}
    assert found == {(i, "deadlock", 9) for i in range(1, 10)} | {(20, "timeout", 20), (30, "timeout", 30)}


def test_hierarchy_marks_circles(spark):
    found = G.hierarchy(edges(spark, [(1, 2), (2, 3), (3, 1), (1, 4)]), spark.createDataFrame([(1,)], "node long"))
    assert sorted((r.path, r.circular) for r in found.collect()) == [("1", False), ("1>2", False), ("1>2>3", False), ("1>2>3>1", True), ("1>4", False)]


def test_walks_are_the_same_each_time_and_near_nodes_get_near_vectors(spark):
    cliques = [(10 * c + i, 10 * c + j) for c in range(2) for i in range(6) for j in range(6) if i != j] + [(0, 10), (10, 0)]
    links = edges(spark, cliques)
    steps = [sorted(map(tuple, G.random_walks(links, walks=2, length=5).collect())) for _ in range(2)]
    assert steps[0] == steps[1] and len(steps[0]) == 12 * 2 * 5
    vec = {r.node: np.array(r.vec) for r in G.walk_embeddings(links, dim=64, walks=6, length=12, window=3).collect()}
    cos = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    assert np.mean([cos(1, j) for j in range(2, 6)]) > np.mean([cos(1, 10 + j) for j in range(1, 6)]) + 0.3


def test_projection_cache(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3), edges(spark, [(0, 1)])

    cache = G.ProjectionCache()
    assert not cache.exists("a") and cache.get("a", 1, make)[1].count() == 1
    cache.get("a", 1, make)
    assert len(made) == 1 and cache.valid("a", 1) and not cache.valid("a", 2)
    cache.invalidate("a")
    assert cache.exists("a") and not cache.valid("a", 1)
    cache.get("a", 2, make)
    cache.drop("a")
    assert len(made) == 2 and not cache.exists("a")
    cache.get("empty", 1, lambda: (spark.range(0), edges(spark, [])))
    assert not cache.exists("empty")


def test_members_in_common_in_blocks(spark):
    df = spark.createDataFrame([(k, m) for k in range(40) for m in range(k % 7 + 1)] + [(None, 1), (1, None), (1, 0)], "k long, m long")
    whole, split = (sorted(map(tuple, A.members_in_common(df, "k", "m", 0.4, n).collect())) for n in (1000, 6))
    sets = {k: set(range(k % 7 + 1)) for k in range(40)}
    expected = [(a, b, len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(40) for b in range(a + 1, 40)]
    assert whole == split == sorted(e for e in expected if e[3] >= 0.4)


def test_tree_features(spark):
    leaf = lambda kind, text="": {"type": kind, "text": text}
    method = {"type": "method_definition", "start_point": [4, 2], "end_point": [7, 3], "children": [leaf("identifier", "run"), {"type": "parameter_list", "children": [leaf("identifier", "a"), leaf("parameter", "b"), leaf(",")]}, {"type": "block", "children": [{"type": "if_statement", "children": [leaf("&&"), leaf("for_statement")]}]}]}
    tree = {"type": "module", "children": [leaf("import_statement"), {"type": "class_definition", "start_point": [1, 0], "end_point": [9, 0], "children": [leaf("identifier", "C"), {"type": "superclass", "children": [leaf("type_identifier", "B")]}, {"type": "body", "children": [method]}]}, {"type": "arrow_function", "start_point": [12, 5], "children": None}]}
    deep = '{"type": "block", "children": [' * 3000 + "]}" * 3000
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, "{"), (3, None), (4, '"x"'), (5, deep)], "id long, a string")
    found = {(r.kind, r.name): r for r in R.tree_features(df, "id", "a").collect()}
    assert set(found) == {("import", None), ("class", "C"), ("function", "run"), ("function", "arrow_function_12_5")}
    run = found["function", "run"]
    assert (run.parts, run.first_line, run.last_line, run.decisions, run.nesting) == (["a", "b"], 5, 8, 3, 3)
    assert (found["class", "C"].parts, found["class", "C"].nesting) == (["B"], 4)
    own = R.node_relations(R.tree_nodes(df.where("id = 1"), "id", "a"), "id").where("type = 'if_statement'").collect()[0]
    assert (own.parent_type, own.siblings, own.children) == ("block", 0, 2)


def test_blocks_and_their_errors(spark):
    df = spark.createDataFrame([(1, "x <<a>> y <<b>>")], "id long, t string")
    found = R.block_spans(df, "id", "t", {"mark": r"<<\w>>"}).orderBy("first").collect()
    assert [(r.first, r.last, r.content, r.errors) for r in found] == [(2, 7, "<<a>>", []), (10, 15, "<<b>>", [])]
    bad = spark.createDataFrame([("k", 3, 3, "abc"), (None, 0, 2, None)], "k string, a int, b int, c string").select(R.block_errors(F.col("k"), F.col("a"), F.col("b"), F.col("c"), ["other"]).alias("e"))
    assert [r.e for r in bad.collect()] == [["Unsupported block type: k", "Invalid block boundaries", "Content length does not match boundaries"], ["Missing required field: type", "Missing required field: content"]]


def test_windows_widen_until_one_matches(spark):
    text = "\n".join("hit" if i in (3, 12) else "x" for i in range(15))
    df = spark.createDataFrame([(1, text), (2, "x\n" * 30), (3, "hit"), (4, None), (5, "a\n" * 5 + "b\n" * 5)], "id long, t string")
    assert sorted((r.id, r["size"], r["first"], r.n) for r in R.widening_windows(df, ["id"], "t", "hit").collect()) == [(1, 5, 0, 1), (1, 5, 2, 1), (1, 5, 8, 1), (1, 5, 10, 1)]
    assert {(r.id, r["size"]) for r in R.widening_windows(df, ["id"], "t", "a\na\nb\nb").collect()} == {(5, 5)}
    ways = {r.id: r.strategy for r in R.recovered_matches(df, ["id"], "t", ["nothing", "^a$"], "hit").collect()}
    assert ways == {1: "regex_fallback", 3: "regex_fallback", 5: "fallback_patterns:1"}
    across = spark.createDataFrame([(9, "\n".join(["q"] * 4 + ["a", "b"]))], "id long, t string")
    assert R.recovered_matches(across, ["id"], "t", [], "a\\nb").collect()[0].strategy == "regex_fallback"


def test_matches_in_cuts_count_in_the_whole_text(spark):
    df = spark.createDataFrame([("k", "x" * 25 + "HIT" + "y" * 10 + "HIT")], "id string, t string")
    assert sorted((r.id, r.first, r.last) for r in R.chunked_matches(df, "id", "t", {"p": "HIT"}, size=10).collect()) == [("k", 25, 28)]


GOOD_AND_BAD = {
    "common": {"function_definition": ("def f(a)", "f(a)"), "todo_comment": ("# TODO: x", "TODO x"), "exposed_credential": ("token = 'abcdefgh1'", "token = 'abc'"), "hardcoded_path": ("'/usr/lib/x'", "/usr/lib"), "empty_block": ("if (a) { }", "if (a) { b }"), "magic_number": ("x = 4711", "x = 47")},
    "plaintext": {"header": ("== A ==", "A =="), "metadata": ("@key: v", "key: v"), "reference": ("[a][b]", "[a](b)")},
    "ini": {"section": ("[a]", "a]"), "malformed_section": ("[a", "[a]"), "reference": ("${x}", "$x"), "duplicate_property": ("a=1\nb=2\na=3", "a=1\nb=2")},
    "editorconfig": {"root": ("root = true", "root = yes"), "indent": ("indent_style = tab", "indent = tab"), "end_of_line": ("end_of_line = lf", "end_of_line = xx"), "file_type_pattern": ("[*.py]", "[py]"), "configuration_patterns": ("[*]\nindent_style = tab\nindent_size = 4", "[*]\nindent_style = tab")},
    "asciidoc": {"header": ("= T", "== T"), "anchor": ("[[a]]", "[a]"), "callout": ("<12>", "<x>"), "admonition": ("NOTE: x", "Note: x"), "source_block": ("[source,go]\n----\nx\n----", "[source,go]\nx"), "conditional_directive": ("ifdef::x[a endif::x[]", "ifdef::x[a"), "inconsistent_attributes": (":a: 1\n:b: 2\n:a: 3", ":a: 1\n:b: 2"), "macro": ("image::x[y]", "image:x"), "custom_macro": ("kbd:x[y]", "kbd")},
    "markdown": {"header": ("## T", "##T"), "invalid_header": ("#T", "# T"), "link": ("[a](b)", "[a] b"), "unclosed_code_block": ("```py\nx", "x"), "malformed_table": ("|a|b|\nx", "|a|b|\n|-|")},
    "html": {"doctype": ("<!DOCTYPE html>", "<html>"), "unclosed_tag": ("<p>x", "<p>x</p>"), "invalid_nesting": ("<p>a<b>c</p>", "<p>a</p>"), "broken_reference": ("href='#a'", "href='a'"), "meta": ("<meta a>", "<met a>"), "invalid_attribute": ("<a b >", "<a>")},
    "sql": {"unsafe_delete": ("DELETE FROM t;", "DELETE t"), "cartesian_product": ("FROM a, b;", "FROM a;"), "unconstrained_query": ("SELECT a FROM t;", "SELECT a")},
    "python": {"bare_except": ("except:", "except E:"), "circular_import": ("from a import b", "import b"), "resource_leak": ("open(a)", "open()")},
    "json": {"trailing_comma": ("[1,]", "[1]"), "missing_quotes": ("{a: 1", '{"a": 1'), "invalid_value": (": NaN", ": 1"), "type": ('"type": "x"', '"kind": "x"'), "schema": ('{"type": "x", "properties": {"a": 1}}', '{"type": "x"}'), "duplicate_key": ('"a": 1, "a": 2', '"a": 1')},
    "yaml": {"unresolved_alias": ("*a", "* a"), "invalid_mapping": ("a:b", "a: b"), "duplicate_key": ("a: 1\nb: 2\na: 3", "a: 1\nb: 2"), "invalid_anchor": ("& a", "&a")},
    "requirements": {"insecure_version": ("a==1.0", "a>=1.0"), "invalid_version": ("a", "a==1"), "version_conflict": ("a==1\na==2", "a==1\nb==2"), "duplicate_requirement": ("a>1\na>2", "a>1\nb>2"), "invalid_constraint": ("a >= 1", "a")},
    "xml": {"invalid_reference": ("&amp;", "& amp"), "malformed_xml": ("<a>x", "<a/>"), "invalid_attribute": ("<a b>", "<a>"), "dtd_error": ("<!DOCTYPE a [", "<!DOCTYPE a>"), "namespace_error": ("<a:b>x", "<ab>x")},
    "rust": {"unsafe_block": ("unsafe { x }", "safe { x }"), "unwrap_usage": ("a.unwrap()", "a.get()"), "mutex_deadlock": ("a.lock(); a.lock()", "a.lock()"), "lifetime_mismatch": ("&'a x", "&a x"), "unhandled_error": ("Result<A, B> = f();", "A = f();")},
    "java": {"unchecked_exception": ("throw new RuntimeException", "throw new Exception"), "resource_leak": ("new File(a);", "new Object(a);"), "null_pointer": ("a.b();", "b();"), "concurrent_modification": ("for (A a : b) { b.add(", "for (A a : b) { c.add("), "unclosed_resource": ("extends Reader {", "extends Base {")},
    "javascript": {"strict_mode": ("'use strict';", "use strict;"), "null_reference": ("null.a", "x.a"), "promise_error": ("new Promise(a)", "new Other(a)"), "js_function_expression": ("function f(a) {", "f(a) {"), "jsx_in_js": ("<A b={c}/>", "<a/>"), "memory_leak": ("setInterval(function () { x },", "setTimeout(x)"), "undefined_variable": ("a = 1", "a"), "type_error": ("a.b", "a")},
    "cobalt": {"function": ("fn f(a) -> B {", "f(a) {"), "class": ("class A : B {", "class {"), "namespace": ("namespace a {", "namespace {"), "type_definition": ("type A = B;", "type;"), "enum": ("enum A { b }", "enum A"), "doc_comment": ("/// x", "// x"), "module_doc": ("//! x", "// x"), "error_handling": ("try { a } catch (e) {", "try { a }"), "pattern_matching": ("match a { b }", "match a")},
    "graphql": {"scalar": ("scalar A", "scalar"), "union": ("union A = B", "union A"), "implements": ("type A implements B", "type A"), "query": ("query a { b }", "query a"), "fragment": ("fragment a on B { c }", "fragment a"), "directive": ("@a", "a"), "fragment_spread": ("...a", "..a"), "circular_fragment": ("fragment a on B { ...a", "fragment a on B { ...b"), "custom_directive": ("directive @a on B", "directive a"), "naming_convention": ("type Abc", "type abc"), "invalid_field": ("{ a { b }", "{ a }"), "comment": ("# x", "x"), "field": ("a: B", "a"), "argument": ("a: B = c", "a")},
    "env": {"variable": ("A=1", "A 1"), "export": ("export A=1", "A=1"), "unset": ("unset A", "unset"), "group": ("# [a]", "# a"), "quoted_value": ("A = 'b'", "A = b"), "multiline": ("A = `b`", "A = b"), "section_comment": ("# === a ===", "# a"), "url": ("A_URL = x", "A = x"), "path": ("A_PATH = x", "A = x"), "comments": ("# a", "a"), "reference": ("${a}", "$a")},
}


@pytest.mark.parametrize("fmt", sorted(PATTERNS))
def test_patterns_match_what_they_should_and_nothing_else(spark, fmt):
    cases = GOOD_AND_BAD[fmt]
    rows = [(f"{n}+", good) for n, (good, _) in cases.items()] + [(f"{n}-", bad) for n, (_, bad) in cases.items()]
    df = spark.createDataFrame(rows, "id string, t string")
    found = {(r.id, r.pattern) for r in R.pattern_counts(df, ["id"], "t", {n: PATTERNS[fmt][n] for n in cases}).collect()}
    assert {n for n in cases if (f"{n}+", n) not in found} == set()
    assert {n for n in cases if (f"{n}-", n) in found} == set()


def test_dots_match_line_ends_where_asked(spark):
    df = spark.createDataFrame([(1, "@a: 1\n@b: 2\n")], "id long, t string")
    own = {"metadata": PATTERNS["plaintext"]["metadata"]}
    for dotall, n in ((False, 2), (True, 1)):
        assert R.pattern_counts(df, ["id"], "t", own, dotall).collect()[0].n == n == R.pattern_matches(df, "id", "t", own, dotall).count()


def test_catalogue_at_run_time(spark):
    known = Catalogue()
    assert len(known.find("common", "documentation")) == 5 and len(known.find()) == sum(map(len, PATTERNS.values()))
    known.register("mine", "hit", "h.t", "syntax", block_type="code")
    known.register("mine", "hit", "hit", "syntax", block_type="code")
    assert known.find("mine") == {"mine.hit": "hit"} == known.for_block("code") and known.find("mine", "other") == {}
    assert known.table(spark).where("format = 'mine'").count() == 1
    assert known.invalidate("mine") == 1 and known.invalidate("mine") == 0 and known.version == 4
    with pytest.raises(Exception):
        known.register("mine", "bad", "(")


def test_rewrites_of_patterns():
    assert L.with_commonest_node("(_) @a (.)", 0.93, "call") == ("(call) @a (call)", 0.95)
    assert L.with_commonest_node("(a)", 0.5, "call") == ("(a)", 0.5)
    pattern, sure = L.without_rare_captures("(f) @rare (g)", 0.5, {"rare": 2}, {"g:g": 7, "h:h": 9})
    assert pattern == "(f)  (g) @g" and sure == pytest.approx(0.55)
    assert L.without_rare_captures("(f) @f", 0.5, {"f": 3}, {"g:f": 9}) == ("(f) @f", 0.5)
    pattern, sure = L.without_poor_predicates('(a) (#match? @a "^x$") (#eq? @b "y")', 0.31, {'(#match? @a "^x$")': (1, 9), '(#eq? @b "y")': (0, 6), "(#eq? @c 1)": (0, 5)})
    assert pattern == '(a) (#match? @a "x") ' and sure == 0.3
    pattern, sure = L.generalised_pattern('(class (method) "literal" "abc" "li*eral")', 0.5, 5)
    assert pattern == '(class (method)? ".*" "abc" "li*eral")' and sure == pytest.approx(0.47)
    assert L.generalised_pattern('"literal"', 0.5, 4) == ('"literal"', 0.5)


def test_rewrites_in_order_with_a_plug_in(spark):
    schema = "k long, pattern string, confidence double, nodes map<string,int>, captures map<string,int>, structures map<string,int>, predicates map<string,struct<success:int,failure:int>>, matches int"
    rows = [(1, '(_) @a "literal"', 0.5, {"call": 3, "x": 3}, {"a": 9}, {}, {}, 9), (2, None, 0.4, None, None, None, None, None), (3, "(q)", 0.2, None, None, None, {"p": (0, 9)}, 1)]
    df = spark.createDataFrame(rows, schema)
    found = {r.k: (r.pattern, r.confidence, r.applied) for r in L.improved_patterns(df, "k").collect()}
    assert found[1] == ('(call) @a ".*"', 0.55, ["node_pattern_improvement", "pattern_generalization"]) and found[2] == (None, 0.4, []) and found[3] == ("(q)", 0.2, [])
    L.register_strategy("louder", lambda p, c, seen: (p.upper(), 0.9))
    L.register_strategy("broken", lambda p, c, seen: 1 / 0)
    try:
        assert L.improved_patterns(df, "k", ["louder", "broken"]).where("k = 3").collect()[0][1:] == ("(Q)", 0.9, ["louder"])
    finally:
        del L.STRATEGIES["louder"], L.STRATEGIES["broken"]


def test_insights_variations_and_recommendations(spark):
    seen = spark.createDataFrame([("p", 1, "a", "call"), ("p", 1, "b", "call"), ("p", 2, "a", "name")], "k string, match long, capture string, type string")
    row = L.insight_counts(seen, "k").collect()[0]
    assert (row.nodes, row.captures, row.structures, row.matches) == ({"call": 2, "name": 1}, {"a": 2, "b": 1}, {"a:call": 1, "a:name": 1, "b:call": 1}, 2)
    texts = spark.createDataFrame([("x", "item 12 a"), ("x", "item 13 a"), ("x", "a wholly other and longer text"), ("x", ""), (None, "q")], "k string, t string")
    groups = sorted((r.group_no, r.n) for r in L.variations(texts, "k", "t").collect())
    assert groups == [(0, 1), (1, 2)]
    patterns = spark.createDataFrame([("go", "naming", "n1"), ("go", "other", "n2"), ("rb", "architecture", "n3")], "language string, kind string, pattern string")
    targets = spark.createDataFrame([(7, "go"), (8, "py")], "repo long, language string")
    assert [(r.repo, r.pattern, r.confidence) for r in L.recommendations(patterns, targets, ["language"]).collect()] == [(7, "n1", 0.75)]
    rated = patterns.withColumn("compatibility", F.lit(0.5))
    assert {(r.kind, r.moved, r.skipped) for r in L.transferred(rated, targets, ["language"], "kind").collect()} == {("naming", 1, 0), ("other", 1, 0), ("architecture", 0, 1)}


def test_validation_against_cases(spark):
    cases = [("a+", "baa", "true", True), ("a+", "b", "false", True), ("a+", "b", "true", False), ("a", "aba", "2", True), ("a", "aba", "[1]", False), ("(?P<x>\\d)", "a1 2", '{"x": "2"}', True), ("(", "a", "true", False), (None, "a", "true", False), ("a", None, "false", False), ("a", "a", None, True)]
    df = spark.createDataFrame(cases, "pattern string, input string, expected string, wanted boolean")
    assert all(r.passed == r.wanted for r in L.validated(df).collect())


def test_callbacks_strategies_and_embeddings(spark):
    df = spark.createDataFrame([(1, "a=1\nb=2", "ini"), (2, None, "ini"), (3, "", None)], "id long, t string, lang string")
    calls = {"pair": lambda m: {"key": m["named"]["k"], "line": m["line"]} if m["groups"][1] != "2" else None, "bad": lambda m: 1 / 0}
    found = E.extracted(df, "id", "t", {"pair": r"(?P<k>\w)=(\d)", "bad": "b", "broken": "("}, calls)
    assert sorted((r.pattern, r.line, r.features) for r in found.collect()) == [("bad", 2, None), ("pair", 1, '{"key": "a", "line": 1}'), ("pair", 2, None)]

    class Lines(E.MatchStrategy):
        def __init__(self, sign="="):
            self.sign = sign

        def adapt_to_context(self, context):
            return Lines(":") if context["lang"] == "yaml" else self

        def specific_matches(self, text):
            return [{"line": i} for i, x in enumerate(text.split("\n")) if self.sign in x]

    more = df.unionByName(spark.createDataFrame([(4, "a: b\nc", "yaml")], df.schema))
    assert sorted(map(tuple, E.strategy_matches(more, "id", "t", "lang", Lines()).collect())) == [(1, 0, '{"line": 0}'), (1, 1, '{"line": 1}'), (4, 0, '{"line": 0}')]
    rows = {r.id: r.embedding for r in E.embedded(df, "t", E.HashedWords(16)).collect()}
    assert rows[2] is None and len(rows[1]) == 16 and rows[3] == [0.0] * 16


def test_table_function(spark):
    E.register_table_functions(spark)
    df = spark.createDataFrame([(1, "aXb\ncX"), (2, None)], "id long, t string")
    df.createOrReplaceTempView("texts_of_test")
    found = spark.sql("SELECT id, m.* FROM texts_of_test, LATERAL text_matches(t, 'X') m ORDER BY first").collect()
    spark.catalog.dropTempView("texts_of_test")
    assert [tuple(r) for r in found] == [(1, 0, 1, 2, 1, "X"), (1, 1, 5, 6, 2, "X")]


def test_warm_up(spark):
    warm = E.WarmUp()
    warm.register("rows", lambda s: s.range(4).count())
    warm.register("bad", lambda s: 1 / 0)
    found = warm.run(spark)
    assert found["rows"] == 4 and isinstance(found["bad"], ZeroDivisionError)


def test_settings_insights_checkouts(spark, tmp_path):
    base = {"a": {"x": 1, "y": {"z": 1}}, "b": [1]}
    assert settings.merged_settings(base, {"a": {"y": {"w": 2}}, "b": [2]}, {"a": {"x": None}}) == {"a": {"x": None, "y": {"z": 1, "w": 2}}, "b": [2]}
    assert base == {"a": {"x": 1, "y": {"z": 1}}, "b": [1]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"name": "p",\n "uses": 3}')
    (tmp_path / "in" / "b.json").write_text('{"name": ')
    assert [(r.name, r.uses) for r in settings.read_insights(spark, str(tmp_path / "in")).collect()] == [("p", 3)]
    repo = tmp_path / "origin"
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    (repo / "a.py").write_text("x = 1\n")
    subprocess.run(["git", "-C", str(repo), "add", "."], check=True)
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "a"], check=True)
    settings.checkout(f"file://{repo}", str(tmp_path / "copy"))
    assert (tmp_path / "copy" / "a.py").read_text() == "x = 1\n"
    found = settings.run_queries(spark, [("SELECT {n} AS n", {"n": i}) for i in range(3)])
    assert [d.collect()[0].n for d in found] == [0, 1, 2]


def test_versions_migrations_and_rollback(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    assert sinks.current_version(spark, folder) is None
    sinks.replace_table(spark.range(3), folder, 1)
    steps = [(2, "add", lambda df: df.withColumn("n", F.lit(1))), (3, "more", lambda df: df.withColumn("n", F.col("n") + 1))]
    assert sinks.migrate(spark, folder, steps) == 3 and sinks.migrate(spark, folder, steps) == 3
    assert sinks.read_current(spark, folder).where("n = 2").count() == 3
    with pytest.raises(ValueError):
        sinks.migrate(spark, folder, [(2, "other", lambda df: df)])
    with pytest.raises(Exception):
        sinks.migrate(spark, folder, [*steps, (4, "bad", lambda df: df.withColumn("m", F.raise_error(F.lit("no"))))])
    assert sinks.current_version(spark, folder) == 3
    assert sinks.roll_back(spark, folder, 2) == 2 and sinks.migrate(spark, folder, steps) == 3
    assert sinks.drop_versions(spark, folder) == 2 and sinks.read_current(spark, folder).count() == 3


def test_commits_over_several_tables(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    commit = sinks.commit_together(spark, [(spark.range(2), a), (spark.range(5), b)])
    assert sinks.committed(spark, a) == [commit] and spark.read.parquet(f"{b}/{commit}").count() == 5
    with pytest.raises(Exception):
        sinks.commit_together(spark, [(spark.range(2), a), (spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), b)])
    assert sinks.committed(spark, a) == [commit] and [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith("_")] == [commit]


def test_exports():
    own = {"f": {"a": "x\n", "b": "y"}, "g": {"c": "z"}}
    assert sinks.exported_patterns(own, "dict", "tree_sitter", {"g.c": "tree_sitter"}) == {"g": {"c": "z"}}
    assert json.loads(sinks.exported_patterns(own, "json")) == own
    assert sinks.exported_patterns(own, "yaml") == '"f":\n  "a": "x\\n"\n  "b": "y"\n"g":\n  "c": "z"'
    assert sinks.as_yaml({"l": [1, {"k": None}], "e": []}) == '"l":\n  - 1\n  -\n    "k": null\n"e": []'


def test_keys_and_ids(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3), ("a", 9)], "k string, v int")
    found = K.insert_with_ids(df, ["k", "v"], "id", after=10).orderBy("id").collect()
    assert [(r.id, r.k, r.v) for r in found] == [(11, "a", 1), (12, "a", 9), (13, "b", 2), (14, "c", 3)]
    assert K.insert_with_ids(df.limit(0), ["k"], "id").count() == 0
    assert [(r.k, r.n) for r in K.violations(df, ["k"]).collect()] == [("a", 2)]
    assert K.created(df, df).count() == 8
    nested = K.with_nested(df.select("k").distinct(), "k", df.withColumnRenamed("k", "f"), "f", "rows", ["v"])
    assert {r.k: [x.v for x in r.rows] for r in nested.collect()} == {"a": [1, 9], "b": [2], "c": [3]}


def test_bucketed_upserts_touch_only_their_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    sink = C.bucketed_upsert_sink(folder, ["k"], "t", buckets=8)
    batch = lambda rows: spark.createDataFrame(rows, "k long, t long, v string")
    sink(batch([(i, 1, "old") for i in range(40)]), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    for _ in range(2):
        sink(batch([(3, 2, "new"), (3, 1, "older"), (99, 1, "added")]), 1)
    sink(batch([(3, 0, "late")]), 2)
    sink(batch([]), 3)
    rows = {r.k: r.v for r in C.read_bucketed(spark, folder).collect()}
    assert len(rows) == 41 and rows[3] == "new" and rows[99] == "added" and rows[5] == "old"
    kept = [p for p in before if p.exists()]
    assert len(kept) >= len(before) * 5 // 8


def test_views_are_made_anew_for_changed_keys(spark, tmp_path):
    folder, source = f"file://{tmp_path}/view", {"rows": [(1, "a"), (1, "b"), (2, "c")]}
    read = lambda: spark.createDataFrame(source["rows"], "k long, v string")
    apply = C.rebuilding(lambda df: df.groupBy("k").agg(F.count("*").alias("n")), read, "k", folder)
    apply(read(), 0)
    source["rows"] = [(1, "a"), (2, "c"), (2, "d"), (2, "e")]
    apply(spark.createDataFrame([(2, "d"), (2, "e"), (None, "f")], "k long, v string"), 1)
    assert {r.k: r.n for r in spark.read.parquet(folder).collect()} == {1: 2, 2: 3}


def test_progress_of_a_stream(spark, tmp_path):
    seen, ended = [], []
    listener = E.ProgressListener(lambda q, batch, rows: seen.append(rows), ended.append)
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(f"{tmp_path}/in")
        C.run_to_end(C.read_changes(spark, f"{tmp_path}/in", "id long"), f"{tmp_path}/s")
        for _ in range(100):
            if ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(seen) == 7 and len(ended) == 1
    assert spark.read.parquet(f"{tmp_path}/s/out").count() == 7


def test_expiry_and_time_ranges(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-09 00:00:00"), (3, None)], "id long, s string").select("id", F.col("s").cast("timestamp").alias("t"))
    now = F.lit("2024-01-09 00:00:10").cast("timestamp")
    assert {r.id for r in C.unexpired(df, "t", 60, now).collect()} == {2, 3}
    assert {r.id for r in A.since(df, "t", 7).collect()} == {2} == {r.id for r in A.since(df, "t", 1, now).collect()}


def test_scores(spark):
    row = lambda c: spark.range(1).select(c.alias("c")).collect()[0].c
    assert row(T.weighted_confidence([(F.lit(1.0), 0.3), (F.lit(None).cast("double"), 0.4), (F.lit(0.5), 0.2)])) == pytest.approx(0.4)
    assert row(T.is_retryable(F.lit("odd"), F.lit(True))) is True and row(T.is_retryable(F.lit("schema timeout"))) is False
    assert row(T.transaction_error(F.lit("x"), F.lit("commit_failed"))) == "commit" and row(T.transaction_error(F.lit(None).cast("string"), F.lit("commit_failed"))) is None
    assert row(T.backoff(F.lit(1), 1.0, 30.0, F.lit(True))) == 4.0
    assert row(T.node_category(F.lit("javadoc"))) == "documentation" and row(T.node_category(F.lit("zzz"))) == "code_patterns"
    assert row(T.kind_of(F.lit("a/Makefile"))) == "build" and row(T.extension(F.lit("a/.env"))) == ""
    assert row(T.is_skipped(F.lit(0.1))) is True and row(T.is_skipped(F.lit(None).cast("double"))) is False


def node(kind, *children, text=None):
    return {"type": kind, "text": text or kind, "children": list(children)}


TREE = node("module", node("call", node("identifier", text="print"), node("arguments", node("string", text="a"), node("number", text="1"), node("string", text="b"))), node("def", node("identifier", text="f"), node("body", node("call", node("identifier", text="g")))))


@pytest.mark.parametrize("query, expected", [
    ("(call (identifier) @name) @call", [("call", "call"), ("name", "print"), ("call", "call"), ("name", "g")]),
    ('(call (identifier) @name (#eq? @name "g"))', [("name", "g")]),
    ('(call (identifier) @name (#not-eq? @name "g"))', [("name", "print")]),
    ('((identifier) @x (#match? @x "^p"))', [("x", "print")]),
    ('(identifier) @x (#any-of? @x "f" "g")', [("x", "f"), ("x", "g")]),
    ("(arguments (string) @a (string) @b)", [("a", "a"), ("b", "b")]),
    ("(arguments (string)* @s)", [("s", "a"), ("s", "b")]),
    ("(call (identifier) @n (missing)? @m)", [("n", "print"), ("n", "g")]),
    ("(arguments [(number) (string)] @v (number) @n)", [("v", "a"), ("n", "1")]),
    ("(def name: (identifier) @n body: (_) @b)", [("n", "f"), ("b", "body")]),
    ("(module (_) @first)", [("first", "call"), ("first", "def")]),
    ("(nothing) @x", []),
    ("(call (identifier", []),
])
def test_captures_of_queries(spark, query, expected):
    df = spark.createDataFrame([(1, json.dumps(TREE)), (2, "{"), (3, None)], "id long, a string")
    found = tree_captures(df, "id", "a", {"q": query}).collect()
    assert [(r.capture, r.text) for r in sorted(found, key=lambda r: r.match)] == expected


def test_deep_trees_have_captures(spark):
    deep = '{"type": "a", "children": [' * 2000 + '{"type": "b"}' + "]}" * 2000
    df = spark.createDataFrame([(1, deep)], "id long, a string")
    assert [r.node for r in tree_captures(df, "id", "a", {"q": "(a (b) @x)"}).collect()] == [2000]


def test_asciidoc_machine_contents_and_encodings(spark):
    text = "= Title\n\n* item\n----\n= no\n----\n== Part\nlink:a[b]\nsome *bold* text\nplain"
    rows = R.asciidoc_lines(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), ["id"], "t").orderBy("line").collect()
    assert [r.kind for r in rows] == ["header", "blank", "list", "fence", "code", "fence", "header", "link", "emphasis", "paragraph"]
    assert [r.section for r in rows][::3] == ["Title", "Title", "Part", "Part"] and [r.level for r in rows if r.level] == [1, 2]
    files = spark.createDataFrame([("a", "#!/usr/bin/env python3\n# coding: latin-1\n"), ("b.rs", "x\0"), ("c", None), ("d", "<!DOCTYPE html>")], "path string, text string")
    found = {r.path: (r.language, r.kind, r.encoding, r.is_binary) for r in classified_content(files).collect()}
    assert found == {"a": ("python", "other", "latin-1", False), "b.rs": ("rust", "source", "utf-8", True), "c": ("unknown", "other", None, False), "d": ("html", "other", "utf-8", False)}
    deep = spark.sql("SELECT 'a' AS s, array('b', NULL) AS l, map('k', 'v') AS m, named_struct('x', 'y', 'n', 1) AS t")
    row = T.encoded(deep).collect()[0]
    assert (bytes(row.s), [x and bytes(x) for x in row.l], {k: bytes(v) for k, v in row.m.items()}, bytes(row.t.x), row.t.n) == (b"a", [b"b", None], {"k": b"v"}, b"y", 1)
    assert spark.range(1).select(relative_path(F.lit("./a\\b//c"), "a").alias("p")).collect()[0].p == "b/c"
