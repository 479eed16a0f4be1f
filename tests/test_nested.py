import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserine.operators import nested as N
from tesserine.operators.components import on_cycles
from tesserine.operators.nested import child_table, flatten_records, parse_record, record_rows, table_elements

KEYS = ["sections", "anchors", "params"]


def rows_of(spark, records, **options):
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "id long, j string, record_id string")
    rows, schema = flatten_records(df, "id", {"j": "t.j"}, KEYS, **options)
    return rows, schema


def cases(spark, *records):
    rows, _ = rows_of(spark, records)
    return sorted((r.record_id, r.child_path, r.parent_path) for r in rows.where("repeated").collect())


def test_lists_lone_objects_strings_and_nulls(spark):
    record = {"sections": [None, {"anchors": {"id": "a"}}, {"anchors": '[{"id": 1}, 2]'}], "o": {"params": {"n": 1}}}
    assert cases(spark, json.dumps(record)) == [
        (0, "o.params[0]", ""),
        (0, "sections[1]", ""),
        (0, "sections[1].anchors[0]", "sections[1]"),
        (0, "sections[2]", ""),
        (0, "sections[2].anchors[0]", "sections[2]"),
    ]


def test_a_record_held_by_a_string_and_broken_records(spark):
    whole = json.dumps(json.dumps({"params": [{"a": 1}]}))
    assert cases(spark, whole, "", None, "{", "[]", "null", "3", '{"a": NaN, "params": [{}]}') == [(0, "params[0]", "")]


def test_root_lists_and_lists_of_lists(spark):
    assert cases(spark, '[{"a": [[{"b": 1}]]}, 5]') == [(0, "[0]", ""), (0, "[0].a[0][0]", "[0]")]


def test_tables_and_inlining(spark):
    record = {"meta": {"owner": {"name": "x", "age": 3}}, "sections": [{"title": "t", "style": {"font": "f"}}], "other": {"owner": {"name": "y"}}}
    rows, schema = rows_of(spark, [json.dumps(record)])
    reasons = {r.element: r.table_reason for r in schema.collect()}
    assert reasons == {"meta": "inlined", "other": "inlined", "owner": "shared", "sections": "repeated", "style": "inlined"}
    sections = child_table(rows, "t.j", "sections", ["title", "style.font", "position"]).collect()
    assert [(r.row_path, r.parent_path, r.title, r["style.font"], r.position_) for r in sections] == [("sections[0]", "", "t", "f", None)]
    assert sorted(r.row_path for r in child_table(rows, "t.j", "owner", ["name"]).collect()) == ["meta.owner", "other.owner"]


def test_recursive_elements_get_a_table():
    assert table_elements([("", "node", False), ("node", "node", False)]) == {"node": "recursive"}


def test_latest_delivery_wins_and_ids_count_once(spark):
    df = spark.createDataFrame([(1, '{"params": [{}]}', "2024-01-01"), (1, '{"params": [{}, {}]}', "2024-01-02"), (1, '{"params": [{}, {}]}', "2024-01-02"), (None, '{"params": [{}]}', "2024-01-01")], "id long, j string, t string")
    rows, _ = flatten_records(df, "id", {"j": "t.j"}, KEYS, "t")
    assert rows.where("repeated").count() == 2


def test_empty_table(spark):
    rows, schema = rows_of(spark, [])
    assert rows.count() == 0 and schema.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(alphabet="ab{[", max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "params"]), c, max_size=3), max_leaves=12))
def test_every_listed_object_has_a_row(value):
    parsed = parse_record(json.dumps(value))
    if not isinstance(parsed, (dict, list)):
        return

    def count(node, key=None, inside=False):
        if isinstance(node, list):
            return sum(count(x, key, True) for x in node)
        if isinstance(node, dict):
            own = inside or key == "params"
            return int(own) + sum(count(v, k) for k, v in node.items())
        return 0

    found = [r for r in record_rows(parsed, frozenset(), frozenset(["params"])) if r[5]]
    assert len(found) == count(parsed) and len({r[1] for r in found}) == len(found)


def test_deep_records(spark):
    deep = '{"a": ' * 3000 + '{"parts": [{"x": 1}, null, {"y": "z"}]}' + "}" * 3000
    broken = deep[:-1]
    lists = "[" * 5000 + "]" * 5000
    df = spark.createDataFrame([(1, deep), (2, broken), (3, lists)], "id long, j string")
    rows, schema = N.flatten_records(df, "id", {"j": "t.j"})
    found = rows.where("repeated").select("record_id", "element", "fields").collect()
    assert sorted((r.record_id, r.element, r.fields) for r in found) == [(1, "parts", '{"x": 1}'), (1, "parts", '{"y": "z"}')]
    assert {r.element: r.table_reason for r in schema.collect()} == {"a": "recursive", "parts": "repeated"}


@pytest.mark.parametrize("raw", ['{"a": [1, -2.5e3, true, false, null, "x\\u00e9", {}], "b": {"c": []}}', " [ ] ", '{"a":1', '{"a" 1}', "[1,]", "[1 2]", "nul", "{} {}", '{"a":NaN}', "01"])
def test_the_deep_decoder_reads_what_the_plain_one_reads(raw):
    def value(f):
        try:
            return f(raw)
        except ValueError:
            return ValueError

    assert value(N._deep_decode) == value(N._plain_decode)


def test_large_schema_graphs_give_the_same_tables(spark):
    records = [{f"k{i}": {"shared": {"n": i}, "tree": {"l": {"tree": {"v": i}}}}, "list": [{"only": {"p": 1}}]} for i in range(12)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, j string")
    plain, joined = N.flatten_records(df, "id", {"j": "t.j"}), N.flatten_records(df, "id", {"j": "t.j"}, max_edges=3)
    for a, b in zip(plain, joined):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {r.element: r.table_reason for r in joined[1].where("table_reason <> 'inlined'").collect()} == {"shared": "shared", "tree": "recursive", "l": "recursive", "list": "repeated"}


def test_nodes_on_cycles_of_any_length(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("f", "g"), ("x", "x"), ("y", "a"), (None, "a")] + [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)]
    found = {r.node: r.cycle for r in on_cycles(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert found == {"a": "c", "b": "c", "c": "c", "e": "f", "f": "f", "x": "x"} | {f"r{i}": "r9" for i in range(30)}


def test_child_tables_take_their_fields_from_the_rows(spark):
    df = spark.createDataFrame([(1, '{"list": [{"b": 1, "a": {"x": 2}}, {"position": "p"}]}')], "id long, j string")
    rows, _ = N.flatten_records(df, "id", {"j": "t.j"})
    table = N.child_table(rows, "t.j", "list")
    assert table.columns == ["record_id", "row_path", "parent_path", "position", "a.x", "b", "position_"]
    assert N.child_table(rows, "t.j", "list", max_columns=2).columns[-1] == "fields"
