"""Nested records as related flat tables: shared inlining.

The schema graph of the records is analysed first: which element names hold objects, under which
elements, once or repeatedly. Elements that repeat, that several elements share or that contain
themselves become tables; every other nested object is inlined into the row around it, its fields
named by their path. Rows carry the record and the row they belong to as foreign keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.operators.components import on_cycles
from tesserine.plans.scratch import materialise

ROOT = ""


def _no_constant(name: str) -> None:
    raise ValueError(name)


_plain_decode = json.JSONDecoder(parse_constant=_no_constant).decode
_BLANKS = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _decode(raw: str) -> object:
    """The value of a JSON text, however deep; ValueError where it is not valid."""
    try:
        return _plain_decode(raw)
    except RecursionError:
        return _deep_decode(raw)


def _deep_decode(raw: str) -> object:
    """As `_decode`, with a stack of its own instead of recursion."""
    holder: list[tuple[object, str | None]] = []  # containers that are open, with the key at hand
    at = _BLANKS.match(raw).end()
    while True:
        head = raw[at : at + 1]
        value, opened = None, False
        if head in ("{", "["):
            value, opened = ({} if head == "{" else []), True
            at = _BLANKS.match(raw, at + 1).end()
            if raw[at : at + 1] == ("}" if head == "{" else "]"):
                at, opened = at + 1, False
        elif head == '"':
            value, at = json.decoder.scanstring(raw, at + 1, True)
        elif head and head in _WORDS:
            word, value = _WORDS[head]
            if not raw.startswith(word, at):
                raise ValueError("no JSON value")
            at += len(word)
        else:
            m = _NUMBER.match(raw, at)
            if not m:
                raise ValueError("no JSON value")
            value, at = _plain_decode(m[0]), m.end()
        if holder:
            above, key = holder[-1]
            if isinstance(above, dict):
                above[key] = value
            else:
                above.append(value)
        if opened:
            holder.append((value, None))
        elif not holder:
            if _BLANKS.match(raw, at).end() != len(raw):
                raise ValueError("more than one JSON value")
            return value
        # Close what ends here, then stand at the next value.
        while not opened:
            at = _BLANKS.match(raw, at).end()
            above, _ = holder[-1]
            sign = raw[at : at + 1]
            if sign == ("}" if isinstance(above, dict) else "]"):
                holder.pop()
                at += 1
                if not holder:
                    if _BLANKS.match(raw, at).end() != len(raw):
                        raise ValueError("more than one JSON value")
                    return above
            elif sign == ",":
                at = _BLANKS.match(raw, at + 1).end()
                break
            else:
                raise ValueError("no comma or end")
        above, _ = holder[-1]
        if isinstance(above, dict):
            if raw[at : at + 1] != '"':
                raise ValueError("no key")
            key, at = json.decoder.scanstring(raw, at + 1, True)
            at = _BLANKS.match(raw, at).end()
            if raw[at : at + 1] != ":":
                raise ValueError("no colon")
            at = _BLANKS.match(raw, at + 1).end()
            holder[-1] = (above, key)


def _open(value: object) -> object:
    """A string that holds a JSON object or list stands for that value; others stay as they are."""
    while isinstance(value, str) and (head := value.lstrip()[:1]) and head in "{[\"":
        try:
            inner = _decode(value)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        if isinstance(inner, str) and not inner.lstrip()[:1] in tuple('{["'):
            return value
        value = inner
    return value


def parse_record(raw: str | None) -> object:
    """The value of a record; None where it is not valid JSON."""
    if not raw:
        return None
    try:
        return _open(_decode(raw))
    except ValueError:
        return None


def schema_edges(value: object, list_keys: frozenset[str]) -> set[tuple[str, str, bool]]:
    """(containing element, element, repeated) of every object of a record."""
    edges: set[tuple[str, str, bool]] = set()
    stack = [(value, ROOT, ROOT, False)]
    while stack:
        node, holder, name, repeated = stack.pop()
        node = _open(node)
        if isinstance(node, dict):
            if name != ROOT or repeated:
                edges.add((holder, name, repeated))
            for key, child in node.items():
                if isinstance(child, (dict, list, str)):
                    stack.append((child, name, key, key in list_keys))
        elif isinstance(node, list):
            stack.extend((x, holder, name, True) for x in node if isinstance(x, (dict, list, str)))
    return edges


def table_elements(edges: Sequence[tuple[str, str, bool]]) -> dict[str, str]:
    """Why an element gets a table: 'repeated', 'recursive' or 'shared'; others are inlined."""
    holders: dict[str, set[str]] = {}
    reasons: dict[str, str] = {}
    for holder, name, repeated in edges:
        holders.setdefault(name, set()).add(holder)
        if repeated:
            reasons[name] = "repeated"
    for name in holders:
        seen, stack = set(), list(holders[name])
        while stack:
            above = stack.pop()
            if above == name:
                reasons.setdefault(name, "recursive")
                break
            if above not in seen:
                seen.add(above)
                stack.extend(holders.get(above, ()))
        if len(holders[name]) > 1:
            reasons.setdefault(name, "shared")
    return reasons


def record_rows(value: object, tables: frozenset[str], list_keys: frozenset[str]) -> list[tuple]:
    """(element, path, parent, list parent, position, repeated, fields) of a record's rows, root first.

    `parent` is the path of the enclosing row and `list parent` that of the nearest enclosing
    element of a list, both '' at the root. Null elements of a list keep their place.
    """
    base: dict = {}
    rows: list[tuple] = [(ROOT, "", "", "", 0, False, base)]
    # What is still to be visited, the next on top: node, path, name, row, case, fields, prefix, inside a list, position.
    stack: list[tuple] = [(value, "", ROOT, "", "", base, "", False, -1)]
    while stack:
        node, path, name, row, case, fields, prefix, inside, position = stack.pop()
        node = _open(node)
        below: list[tuple] = []
        if isinstance(node, list):
            for i, x in enumerate(node):
                if isinstance(x, (dict, list, str)):
                    below.append((x, f"{path}[{i}]", name, row, case, fields, f"{prefix}[{i}]", True, i))
                elif x is not None:
                    fields[f"{prefix}[{i}]"] = x
        elif isinstance(node, dict):
            if name in list_keys and not inside:
                path, inside, position = f"{path}[0]", True, 0
            if inside or name in tables:
                own: dict = {}
                rows.append((name, path, row, case, position, inside, own))
                row, case, start = path, (path if inside else case), ""
            else:
                own, start = fields, f"{prefix}." if prefix else ""
            for key, child in node.items():
                if isinstance(child, (dict, list, str)):
                    below.append((child, f"{path}.{key}" if path else key, key, row, case, own, start + key, False, -1))
                elif child is not None:
                    own[start + key] = child
        else:
            fields[prefix] = node
        stack.extend(reversed(below))
    return rows


_ROWS = "src_field string, record_id long, element string, child_path string, parent_row string, parent_path string, position int, repeated boolean, fields string"


def _latest(df: DataFrame, id_col: str, columns: Sequence[str], order_col: str | None) -> DataFrame:
    newest = F.col(order_col).cast("timestamp_ntz") if order_col else F.lit(None).cast("timestamp_ntz")
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.struct(newest.alias("t"), *[F.col(c).cast("string").alias(f"j{i}") for i, c in enumerate(columns)]).alias("s"))
    return picked.where("id is not null").groupBy("id").agg(F.max("s").alias("s")).select("id", *[f"s.j{i}" for i in range(len(columns))])


def flatten_records(df: DataFrame, id_col: str, columns: dict[str, str], list_keys: Sequence[str] = (), order_col: str | None = None, max_edges: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(rows, schema) of the JSON records in `columns` (column -> name of the source field).

    rows: one per record root and per object that is an element of a list or of a table element,
    with the flat fields of inlined objects as a JSON object. schema: src_field, element,
    table_reason ('repeated', 'shared', 'recursive' or 'inlined') and the elements that hold it.

    `list_keys` always hold lists, so a lone object there is a list of one. A string that holds an
    object or a list stands for it. An id counts once: its latest row by `order_col` wins (ties: the
    greatest text). Null ids have no rows; records that are null or not valid JSON have no rows;
    an empty table gives empty results. Records may be of any depth. A schema graph of at most
    `max_edges` edges is analysed on the driver and sent along; a larger one (keys that are data) is
    analysed as a table and joined to the records, with the same result.
    """
    names, keys = list(columns.values()), frozenset(list_keys)
    latest = materialise(_latest(df, id_col, list(columns), order_col))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple] = set()
        for batch in batches:
            for i, name in enumerate(names):
                for raw in batch.column(i + 1).to_pylist():
                    for edge in schema_edges(parse_record(raw), keys):
                        found.add((name, *edge))
            if len(found) > 100_000:
                yield _batch(found, ["src_field", "holder", "element", "repeated"])
                found = set()
        if found:
            yield _batch(found, ["src_field", "holder", "element", "repeated"])

    graph = materialise(latest.mapInArrow(edges, "src_field string, holder string, element string, repeated boolean").distinct())
    collected = graph.limit(max_edges + 1).collect()  # bounded by max_edges
    small = len(collected) <= max_edges
    if small:
        listed = [(name, e, why) for name in names for e, why in table_elements([tuple(r)[1:] for r in collected if r[0] == name]).items()]
        reasons = df.sparkSession.createDataFrame(listed, "src_field string, element string, table_reason string")
    else:
        reasons = materialise(_table_reasons(graph))
    fixed = {name: frozenset(e for n, e, _ in listed if n == name) for name in names} if small else {}

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part, out = batch.slice(start, 2000), []
                ids = part.column(0).to_pylist()
                own = [None] * len(ids) if small else part.column("tabled").to_pylist()
                for i, name in enumerate(names):
                    for key, raw, listed in zip(ids, part.column(i + 1).to_pylist(), own):
                        value = parse_record(raw)
                        if isinstance(value, (dict, list)):
                            tables = fixed[name] if small else frozenset(x["element"] for x in listed or () if x["src_field"] == name)
                            for element, path, row, case, position, repeated, fields in record_rows(value, tables, keys):
                                out.append((name, key, element, path, row, case, position, repeated, json.dumps(fields, ensure_ascii=False)))
                if out:
                    yield _batch(out, ["src_field", "record_id", "element", "child_path", "parent_row", "parent_path", "position", "repeated", "fields"])

    if not small:
        latest = latest.join(_tabled(latest, names, keys, reasons), "id", "left")
    rows = latest.mapInArrow(flatten, _ROWS)
    held = graph.groupBy("src_field", "element").agg(F.array_join(F.array_sort(F.collect_set("holder")), ",").alias("held_by"))
    schema = held.join(reasons, ["src_field", "element"], "left").select("src_field", "element", F.coalesce("table_reason", F.lit("inlined")).alias("table_reason"), "held_by")
    return rows, schema


def _tabled(latest: DataFrame, names: Sequence[str], keys: frozenset[str], reasons: DataFrame) -> DataFrame:
    """(id, tabled): of each record those of its own elements that get tables."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            ids = batch.column(0).to_pylist()
            for i, name in enumerate(names):
                for key, raw in zip(ids, batch.column(i + 1).to_pylist()):
                    found |= {(name, element, key) for _, element, _ in schema_edges(parse_record(raw), keys)}
            if found:
                rows = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2], pa.int64())], ["src_field", "element", "id"])

    own = latest.mapInArrow(elements, "src_field string, element string, id long").join(reasons.select("src_field", "element"), ["src_field", "element"])
    return own.groupBy("id").agg(F.collect_list(F.struct("src_field", "element")).alias("tabled"))


def _table_reasons(graph: DataFrame) -> DataFrame:
    """(src_field, element, table_reason) of the elements that get tables, as aggregations of the graph."""
    degree = graph.groupBy("src_field", "element").agg(F.max("repeated").alias("repeated"), F.count_distinct("holder").alias("holders"))
    node = lambda c: F.concat_ws("\u0000", "src_field", c)
    cyclic = on_cycles(graph.select(node("holder").alias("src"), node("element").alias("dst"))).select("node")
    marked = degree.withColumn("node", node("element")).join(cyclic.withColumn("cyclic", F.lit(True)), "node", "left")
    reason = F.when(F.col("repeated"), "repeated").when(F.col("cyclic"), "recursive").when(F.col("holders") > 1, "shared")
    return marked.select("src_field", "element", reason.alias("table_reason")).where("table_reason is not null")


_KINDS = {"record_id": pa.int64(), "position": pa.int32(), "repeated": pa.bool_()}


def _batch(rows: Sequence[tuple] | set[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)


def child_table(rows: DataFrame, src_field: str, element: str, fields: Sequence[str] | None = None, max_columns: int = 1000) -> DataFrame:
    """The flat table of one element: record, row and parent keys, and one string column a field.

    Without `fields` all that occur are taken, in order of their names; should there be more than
    `max_columns` (names that are data), they stay together in a map column `fields`. A missing field
    is null. Names of fields that clash with a key column get a trailing underscore.
    """
    taken = {"record_id", "row_path", "parent_path", "position"}
    held = F.from_json("fields", "map<string,string>")
    own = rows.where((F.col("src_field") == src_field) & (F.col("element") == element))
    keys = ["record_id", F.col("child_path").alias("row_path"), F.col("parent_row").alias("parent_path"), "position"]
    if fields is None:
        names = own.select(F.explode(F.map_keys(held)).alias("name")).distinct().limit(max_columns + 1).collect()  # bounded by max_columns
        if len(names) > max_columns:
            return own.select(*keys, held.alias("fields"))
        fields = sorted(r["name"] for r in names)
    return own.select(*keys, *[held[f].alias(f + "_" if f in taken else f) for f in fields])
