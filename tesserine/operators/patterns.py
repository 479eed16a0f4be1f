"""Pattern matching over texts: counts inside the JVM, spans and groups through Arrow batches."""

from __future__ import annotations

import bisect
import difflib
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.catalogue import REPEATS, portable
from tesserine.functions.text import lines

_SPANS = "pattern string, first int, last int, line int, text string, groups array<string>"


def pattern_counts(df: DataFrame, key: Sequence[str], text: str, patterns: Mapping[str, str], dotall: bool = False) -> DataFrame:
    """(key, pattern, n) of the patterns that match at all; null and empty texts match none.

    Patterns of a key that comes again (`REPEATS`) are counted over the lines, without backtracking. With
    `dotall` the dots of all others match line ends, as in `pattern_matches`.
    """
    repeats = {name: REPEATS[p] for name, p in patterns.items() if p in REPEATS}
    plain = {name: p for name, p in patterns.items() if p not in REPEATS}
    counted = [F.struct(F.lit(name).alias("pattern"), F.regexp_count(F.col(text), F.lit(portable(p, dotall))).cast("long").alias("n")) for name, p in plain.items()]
    if repeats:

        @F.pandas_udf("array<bigint>")
        def lines_count(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [repeat_count(kind, t) if t else 0 for kind in repeats.values()])

        df = df.withColumn("_repeats", lines_count(F.col(text)))
        counted += [F.struct(F.lit(name).alias("pattern"), F.col("_repeats")[i].alias("n")) for i, name in enumerate(repeats)]
    return df.select(*key, F.explode(F.array(*counted)).alias("c")).where("c.n > 0").select(*key, "c.pattern", "c.n")


_NAME_VERSION = re.compile(r"([a-zA-Z0-9_-]+)==(.*)")
_VERSION = re.compile(r"[0-9.]+")
_NAME_END = re.compile(r"([a-zA-Z0-9_-]+)(?:[<>=!~]|$)")
_YAML_KEY = re.compile(r"([^:#]+):")


def repeat_count(kind: str, text: str) -> int:
    """How often the pattern of `kind` in `REPEATS` matches a text, counted as finditer does.

    A match begins at a line with a key and ends in the line where the key comes again; the next
    one begins below that line. Time grows with the text, whatever its lines hold.
    """
    own = text.split("\n")
    ends = {"property": _property_ends, "key": _key_ends, "conflict": _conflict_ends, "name": _name_ends, "attribute": _attribute_ends}[kind](own)
    n, i = 0, 0
    while i < len(own):
        end = ends(i)
        n, i = (n, i + 1) if end is None else (n + 1, end + 1)
    return n


def _name_ends(own: list[str]) -> Callable[[int], int | None]:
    """Names of requirements: up to the next line with the same name."""
    after: list[int | None] = [None] * len(own)
    last: dict[str, int] = {}
    for i in range(len(own) - 1, -1, -1):
        if m := _NAME_END.match(own[i]):
            after[i], last[m[1]] = last.get(m[1]), i
    return after.__getitem__


def _attribute_ends(own: list[str]) -> Callable[[int], int | None]:
    """Attributes of a document: what stands between two colons, up to where it is set again with its value."""
    n = len(own)
    solid = [n] * (n + 1)  # the next line that does not consist of blanks
    for i in range(n - 1, -1, -1):
        solid[i] = i if own[i].strip() else solid[i + 1]
    heads: list[tuple[str, int, str] | None] = [None] * n  # name, line of its second colon, what follows there
    places: dict[str, list[int]] = {}
    for i, line in enumerate(own):
        if not line.startswith(":"):
            continue
        name, stop = line[1:], i
        while ":" not in name and stop + 1 < n:
            stop += 1
            name += "\n" + own[stop]
        name, colon, rest = name.partition(":")
        if name and colon:
            heads[i] = name, stop, rest
            for known in {name, name[:-1] if name.endswith("!") else name} - {""}:
                places.setdefault(known, []).append(i)

    def end(i: int) -> int | None:
        if not heads[i]:
            return None
        name, stop, rest = heads[i]
        last = stop if rest.strip() else min(solid[stop + 1], n - 1)  # the value may stand below
        for known in (name, name[:-1]) if name.endswith("!") and len(name) > 1 else (name,):
            same = places.get(known, [])
            at = bisect.bisect_right(same, last)
            again = same[at] if at < len(same) else last if last > stop and last in same[at - 1 : at] else None
            if again is not None:
                _, under, value = heads[again]
                return under if value.strip() else min(solid[under + 1], n - 1)
        return None

    return end


def _conflict_ends(own: list[str]) -> Callable[[int], int | None]:
    """Pinned names: up to the next line that pins the same name and does not begin with the same version."""
    found = [_NAME_VERSION.match(line) for line in own]
    after: list[int | None] = [None] * len(own)
    same: dict[str, tuple[int, str]] = {}  # the next line of a name, and what all its later lines begin with
    hopeless = [True] * len(own)
    for i in range(len(own) - 1, -1, -1):
        if m := found[i]:
            v = _VERSION.match(m[2])
            if m[1] in same:
                after[i], shared = same[m[1]]
                hopeless[i] = v is None or shared.startswith(v[0])
                shared = os.path.commonprefix([shared, m[2]])
            else:
                shared = m[2]
            same[m[1]] = i, shared

    def end(i: int) -> int | None:
        if hopeless[i]:
            return None
        version, j = _VERSION.match(found[i][2])[0], after[i]
        while found[j][2].startswith(version):
            j = after[j]
        return j

    return end


def _property_ends(own: list[str]) -> Callable[[int], int | None]:
    """Properties: what stands before the next equals sign, over line ends too, up to where it comes again."""
    keys: dict[tuple[str, int], int] = {}
    key, stop = [-1] * len(own), [0] * len(own)  # the key's number, and the line of its equals sign
    for i in range(len(own) - 1, -1, -1):
        head, sign, _ = own[i].partition("=")
        if sign:
            key[i], stop[i] = keys.setdefault((head, -1), len(keys)), i
        elif i + 1 < len(own) and key[i + 1] >= 0:
            key[i], stop[i] = keys.setdefault((head, key[i + 1]), len(keys)), stop[i + 1]
    nothing = keys.get(("", -1))  # a line that begins with the sign has no key
    places: dict[int, list[int]] = {}
    for i, k in enumerate(key):
        places.setdefault(k, []).append(i)

    def end(i: int) -> int | None:
        if key[i] < 0 or key[i] == nothing:
            return None
        same = places[key[i]]
        at = bisect.bisect_right(same, stop[i])
        return stop[same[at]] if at < len(same) else None

    return end


def _key_ends(own: list[str]) -> Callable[[int], int | None]:
    """Keys of YAML: up to the last line with the same key before an empty line."""
    found = [_YAML_KEY.match(line) for line in own]
    last = len(own) - 1  # no line end follows it
    places: dict[str, list[int]] = {}
    for i, m in enumerate(found):
        if m:
            places.setdefault(m[1], []).append(i)
    block = [0] * len(own)  # the last line that is reached from here over lines that are not empty
    for i in range(last, -1, -1):
        block[i] = block[i + 1] if own[i] and i < last else i
    solid = [0] * (len(own) + 1)  # the next line that does not consist of blanks
    solid[-1] = len(own)
    for i in range(last, -1, -1):
        solid[i] = i if own[i].strip() else solid[i + 1]

    def end(i: int) -> int | None:
        if not found[i] or len(places[found[i][1]]) < 2:
            return None
        rest = own[i][found[i].end() :]
        final = i if rest.strip() else solid[i + 1]
        # The value may end on any line of blanks before the first text; the farthest is tried first.
        for j in range(min(final, last - 1), i - 1, -1):
            if not (rest if j == i else own[j]):
                continue
            same = places[found[i][1]]
            at = bisect.bisect_right(same, block[j + 1]) - 1
            if at >= 0 and same[at] > j:
                return same[at]
        return None

    return end


def pattern_matches(df: DataFrame, key: str, text: str, patterns: Mapping[str, str], dotall: bool = False) -> DataFrame:
    """(key, pattern, first, last, line, text, groups) of every match, whole texts searched.

    `first` and `last` count characters from 0, lines from 1. A pattern that does not compile
    matches nothing; groups that took no part are null.
    """
    key_type = df.schema[key].dataType.simpleString()
    compiled = {}
    for name, p in patterns.items():
        try:
            compiled[name] = re.compile(p, re.MULTILINE | (re.DOTALL if dotall else 0))
        except re.error:
            continue

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                breaks = [i for i, c in enumerate(t) if c == "\n"] if t else []
                for name, pattern in compiled.items() if t else ():
                    for m in pattern.finditer(t):
                        keys.append(k)
                        rows.append((name, m.start(), m.end(), bisect.bisect_left(breaks, m.start()) + 1, m[0], list(m.groups())))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds))], [key, "pattern", "first", "last", "line", "text", "groups"])

    return df.select(key, text).mapInArrow(search, f"`{key}` {key_type}, {_SPANS}")


def code_blocks(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, place, language, code) of fenced blocks; the language is 'text' where none is given."""
    fence = F.lit("(?s)```(\\w+)?\\n(.*?)\\n```")
    both = F.arrays_zip(F.regexp_extract_all(text, fence, F.lit(1)).alias("l"), F.regexp_extract_all(text, fence, F.lit(2)).alias("c"))
    blocks = df.where(F.col(text).isNotNull()).select(*key, F.posexplode(both).alias("place", "b"))
    return blocks.select(*key, F.col("place").cast("long").alias("place"), F.coalesce(F.nullif(F.col("b.l"), F.lit("")), F.lit("text")).alias("language"), F.col("b.c").alias("code"))


def headings(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, line, level, title) of heading lines: hashes, a blank and a title."""
    numbered = df.where(F.col(text).isNotNull()).select(*key, F.posexplode(F.transform(lines(F.col(text)), lambda x: F.trim(x))).alias("line", "l"))
    heads = numbered.where(F.col("l").rlike("^#+ "))
    return heads.select(*key, (F.col("line") + 1).cast("long").alias("line"), F.length(F.regexp_extract("l", "^(#+)", 1)).cast("long").alias("level"), F.trim(F.regexp_extract("l", "^#+ (.*)$", 1)).alias("title"))


def fenced_lines(df: DataFrame, key: Sequence[str], text: str, fence: str = "^(```|----)") -> DataFrame:
    """(key, line, text, inside) of all lines, with whether a line lies inside a fenced block."""
    numbered = df.where(F.col(text).isNotNull()).select(*key, F.posexplode(lines(F.col(text))).alias("line", "l"))
    marked = numbered.withColumn("mark", F.col("l").rlike(fence).cast("int"))
    before = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("mark").over(before), F.lit(0)) % 2 == 1) & (F.col("mark") == 0)
    return marked.select(*key, (F.col("line") + 1).cast("long").alias("line"), F.col("l").alias("text"), inside.alias("inside"))


def sections(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, section, option, value) of INI-like texts; options before any section have ''."""
    numbered = df.where(F.col(text).isNotNull()).select(*key, F.posexplode(lines(F.col(text))).alias("line", "l"))
    named = numbered.withColumn("s", F.when(F.col("l").rlike("^\\[[^\\]]+\\]\\s*$"), F.regexp_extract("l", "^\\[([^\\]]+)\\]", 1)))
    order = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    filled = named.withColumn("section", F.coalesce(F.last("s", ignorenulls=True).over(order), F.lit("")))
    options = filled.where(F.col("s").isNull() & F.col("l").rlike("^[^=#;\\[]+=") & (F.trim(F.regexp_extract("l", "^([^=]+)=", 1)) != ""))
    return options.select(*key, "section", F.trim(F.regexp_extract("l", "^([^=]+)=", 1)).alias("option"), F.trim(F.regexp_extract("l", "^[^=]+=(.*)$", 1)).alias("value"))


def asciidoc_lines(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, line, kind, level, section, content) of AsciiDoc lines by a state machine: fences switch it, headers open sections.

    kind is 'fence', 'code' (between fences), 'header', 'list', 'link', 'emphasis', 'paragraph' or
    'blank'; section is the title of the last header above, '' before any; a null text has no lines.
    """
    fenced = fenced_lines(df, key, text, "^----\\s*$")
    line = F.col("text")
    kind = F.when(line.rlike("^----\\s*$"), "fence").when(F.col("inside"), "code").when(F.trim(line) == "", "blank").when(line.rlike("^=+\\s+\\S"), "header")
    kind = kind.when(line.rlike("^\\s*(?:\\*+|-|\\.+|\\d+\\.)\\s+\\S"), "list").when(line.rlike("link:[^\\[]+\\["), "link").when(line.rlike("\\*[^*]+\\*|_[^_]+_"), "emphasis").otherwise("paragraph")
    marked = fenced.withColumn("kind", kind)
    header = F.when(F.col("kind") == "header", F.trim(F.regexp_replace("text", "^=+\\s+", "")))
    before = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("kind") == "header", F.length(F.regexp_extract("text", "^(=+)", 1)).cast("long"))
    return marked.select(*key, "line", "kind", level.alias("level"), F.coalesce(F.last(header, ignorenulls=True).over(before), F.lit("")).alias("section"), F.col("text").alias("content"))


def decorated_functions(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, line, kind, name): try lines, decorators with the name on the next line, and def lines."""
    numbered = df.where(F.col(text).isNotNull()).select(*key, F.posexplode(F.transform(lines(F.col(text)), lambda x: F.trim(x))).alias("line", "l"))
    after = F.lead("l").over(Window.partitionBy(*key).orderBy("line"))
    marked = numbered.withColumn("after", after)
    name = lambda c: F.regexp_extract(c, "^(?:async )?def (\\w+)", 1)
    kind = F.when(F.col("l") == "try:", "try").when(F.col("l").startswith("@"), "decorator").when(F.col("l").startswith("def "), "function")
    found = marked.withColumn("kind", kind).where("kind is not null")
    return found.select(*key, (F.col("line") + 1).cast("long").alias("line"), "kind", F.when(F.col("kind") == "decorator", name(F.coalesce("after", F.lit("")))).when(F.col("kind") == "function", name(F.col("l"))).otherwise("").alias("name"))


def tree_nodes(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, node, parent, type, depth, first_row, text, children, place) of JSON syntax trees in pre-order.

    Trees that are null or not valid JSON have no nodes; depth counts from 1, the place among the
    children of the parent from 0.
    """
    import json

    key_type = df.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    root = json.loads(raw) if raw else None
                except ValueError:
                    root = None
                stack, number = [(root, None, 1, 0)], 0
                while stack:
                    node, parent, depth, place = stack.pop()
                    if not isinstance(node, dict):
                        continue
                    start = node.get("start_point")
                    row = start[0] if isinstance(start, list) and start and isinstance(start[0], int) else None
                    text = node.get("text")
                    keys.append(k)
                    below = [c for c in node["children"] if isinstance(c, dict)] if isinstance(node.get("children"), list) else []
                    rows.append((number, parent, str(node.get("type", "")), depth, row, text if isinstance(text, str) else None, len(below), place))
                    stack.extend((c, number, depth + 1, i) for i, c in reversed(list(enumerate(below))))
                    number += 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds))], [key, "node", "parent", "type", "depth", "first_row", "text", "children", "place"])

    return df.select(key, tree).mapInArrow(walk, f"`{key}` {key_type}, node long, parent long, type string, depth long, first_row long, text string, children long, place long")


DECISIONS = ["if_statement", "for_statement", "while_statement", "case_statement", "catch_clause", "conditional_expression"]


def tree_statistics(nodes: DataFrame, key: str) -> DataFrame:
    """Per tree: nodes, depth, statements, expressions, decisions, cyclomatic and cognitive complexity."""
    ends = lambda s: F.count_if(F.col("type").endswith(s))
    stats = nodes.groupBy(key).agg(
        F.count("*").alias("nodes"), F.max("depth").alias("max_depth"), ends("_statement").alias("statements"), ends("_expression").alias("expressions"),
        F.count_if(F.col("type").isin(DECISIONS)).alias("decisions"),
    )
    return stats.withColumn("cyclomatic", F.col("decisions") + 1).withColumn("cognitive", F.col("cyclomatic") * F.col("max_depth") / 3.0)


FUNCTIONS = ["function_definition", "method_definition", "arrow_function"]
CLASSES = ["class_definition", "class_declaration"]
IMPORTS = ["import_statement", "import_declaration", "using_directive", "include_statement"]
# Node types that count as a decision, and that nest when they have children.
DECISION_POINTS = ["if_statement", "while_statement", "for_statement", "switch_statement", "case_statement", "conditional_expression", "ternary_expression", "&&", "||"]
NESTING = ["if_statement", "for_statement", "while_statement", "function_definition", "method_definition", "class_definition", "try_statement", "catch_clause", "block"]
_FEATURES = "node long, kind string, type string, name string, parts array<string>, first_line long, last_line long, decisions long, nesting long"


def tree_features(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, node, kind, type, name, parts, first_line, last_line, decisions, nesting) of syntax trees.

    kind is 'function', 'class' or 'import'. A name is the text of the first child that is an
    identifier; without one a function is named by type, row and column, other nodes have null.
    parts are the parameters of a function and the superclasses of a class. decisions counts the
    decision points at and below the node, nesting the deepest chain of nesting nodes that have
    children. Lines count from 1 and are null where the tree does not tell them. Trees that are
    null or not valid JSON give no row. Deep trees are walked with a stack.
    """
    import json

    key_type = df.schema[key].dataType.simpleString()
    kinds = {t: k for k, types in (("function", FUNCTIONS), ("class", CLASSES), ("import", IMPORTS)) for t in types}
    lists = {"function": ("parameter_list", "formal_parameters"), "class": ("extends_clause", "superclass", "argument_list")}
    members = {"function": ("identifier", "parameter"), "class": ("identifier", "type_identifier")}
    decides, nests = frozenset(DECISION_POINTS), frozenset(NESTING)

    def point(node: dict, name: str) -> tuple[int | None, int | None]:
        value = node.get(name)
        good = isinstance(value, list) and len(value) == 2 and all(isinstance(x, int) for x in value)
        return (value[0], value[1]) if good else (None, None)

    def features(root: object) -> Iterator[tuple]:
        nodes, parents, stack = [], [], [(root, -1)]
        while stack:
            node, parent = stack.pop()
            if not isinstance(node, dict):
                continue
            below = node.get("children")
            below = [c for c in below if isinstance(c, dict)] if isinstance(below, list) else []
            nodes.append((node, str(node.get("type", "")), below))
            parents.append(parent)
            stack.extend((c, len(nodes) - 1) for c in reversed(below))
        decisions, nesting = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
            _, kind, below = nodes[i]
            decisions[i] += kind in decides
            nesting[i] = nesting[i] + (kind in nests) if below else 0
            if parents[i] >= 0:
                decisions[parents[i]] += decisions[i]
                nesting[parents[i]] = max(nesting[parents[i]], nesting[i])
        for i, (node, own, below) in enumerate(nodes):
            kind = kinds.get(own)
            if not kind:
                continue
            (row, column), (end, _) = point(node, "start_point"), point(node, "end_point")
            name = next((c.get("text") for c in below if c.get("type") == "identifier"), None)
            if kind == "function" and not name:
                name = f"{own}_{'' if row is None else row}_{'' if column is None else column}"
            inner = [x for c in below if c.get("type") in lists.get(kind, ()) for x in (c.get("children") if isinstance(c.get("children"), list) else [])]
            parts = [str(x.get("text", "")) for x in inner if isinstance(x, dict) and x.get("type") in members[kind]]
            yield i, kind, own, name, parts, None if row is None else row + 1, None if end is None else end + 1, decisions[i], nesting[i]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    root = json.loads(raw) if raw else None
                except (ValueError, RecursionError):
                    continue
                own = list(features(root))
                keys += [k] * len(own)
                rows += own
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, types))], [key, *(f.split()[0] for f in _FEATURES.split(", "))])

    return df.select(key, tree).mapInArrow(extract, f"`{key}` {key_type}, {_FEATURES}")


def node_relations(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node, type, parent_type, siblings, children) of the nodes of `tree_nodes`; a root has no parent type and no siblings."""
    above = nodes.select(key, F.col("node").alias("parent"), F.col("type").alias("parent_type"), (F.col("children") - 1).alias("siblings"))
    return nodes.join(above, [key, "parent"], "left").select(key, "node", "type", "parent_type", F.coalesce("siblings", F.lit(0)).alias("siblings"), "children")


def block_spans(df: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, block_type, first, last, content, errors): the text of every match, with what is wrong about it."""
    found = pattern_matches(df, key, text, patterns).select(key, F.col("pattern").alias("block_type"), "first", "last", F.col("text").alias("content"))
    return found.withColumn("errors", block_errors(F.col("block_type"), F.col("first"), F.col("last"), F.col("content")))


def block_errors(kind: Column, first: Column, last: Column, content: Column, kinds: Sequence[str] | None = None) -> Column:
    """What is wrong about a block: missing fields, an unknown type, bounds that do not run forwards or do not fit the content."""
    checks = [F.when(c.isNull(), F.lit(f"Missing required field: {n}")) for n, c in (("type", kind), ("start", first), ("end", last), ("content", content))]
    if kinds is not None:
        checks.append(F.when(~kind.isin(list(kinds)), F.concat(F.lit("Unsupported block type: "), kind)))
    checks.append(F.when(last <= first, F.lit("Invalid block boundaries")))
    checks.append(F.when(F.length(content) != last - first, F.lit("Content length does not match boundaries")))
    return F.array_compact(F.array(*checks))


def chunked_matches(df: DataFrame, key: str, text: str, patterns: Mapping[str, str], size: int = 102_400) -> DataFrame:
    """As `pattern_matches` on cuts of `size` characters, with places counted in the whole text; lines count inside the cut.

    Matches across a cut are not found, which is the price of the cuts: texts that fit into memory
    are better searched whole.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")))
    cuts = df.where(F.length(text) > 0).select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.explode(starts).alias("_n"))
    cuts = cuts.select(F.struct("_k", "_n").alias("cut"), F.substring(F.col("_t"), F.col("_n") * size + 1, F.lit(size)).alias("t"))
    named = cuts.select(F.to_json("cut").alias("cut"), "t")
    found = pattern_matches(named, "cut", "t", patterns)
    cut = F.from_json("cut", f"_k {df.schema[key].dataType.simpleString()}, _n int")
    moved = found.withColumn("cut", cut)
    return moved.select(F.col("cut._k").alias(key), "pattern", *[(F.col(c) + F.col("cut._n") * size).alias(c) for c in ("first", "last")], "line", "text", "groups")


def widening_windows(df: DataFrame, key: Sequence[str], text: str, pattern: str, sizes: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """(key, size, first, n): windows of lines that match `pattern`, of the first of `sizes` at which any window does.

    Windows step by half their size; sizes beyond the number of lines are not tried. n counts the matches.
    """
    own = F.split(F.col(text), "\n")

    def windows(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("_l") - size, F.lit(size // 2))
        return F.transform(starts, lambda s: F.struct(s.cast("long").alias("first"), F.array_join(F.slice("_l", s + 1, F.lit(size)), "\n").alias("window")))

    found = None
    for size in sizes:
        cut = windows(size)
        part = df.where(F.length(text) > 0).select(*key, own.alias("_l")).where(F.size("_l") >= size).select(*key, F.explode(cut).alias("w"))
        part = part.select(*key, F.lit(size).cast("long").alias("size"), "w.first", F.regexp_count("w.window", F.lit(portable(pattern))).cast("long").alias("n")).where("n > 0")
        found = part if found is None else found.unionByName(part)
    least = found.groupBy(*key).agg(F.min("size").alias("size"))
    return found.join(least, [*key, "size"]).select(*key, "size", "first", "n")


def recovered_matches(df: DataFrame, key: Sequence[str], text: str, fallbacks: Sequence[str], regex: str) -> DataFrame:
    """(key, strategy, n): matches by the first way that finds any: the fallback patterns in order, a plain pattern, then windows of lines.

    strategy is 'fallback_patterns:<place>', 'regex_fallback' or 'partial_match:<size>'; texts that no way
    matches have no row.
    """
    ways = [(f"fallback_patterns:{i}", p) for i, p in enumerate(fallbacks)] + [("regex_fallback", regex)]
    tried = [F.struct(F.lit(name).alias("strategy"), F.regexp_count(F.col(text), F.lit(portable(p))).cast("long").alias("n")) for name, p in ways]
    first = F.get(F.filter(F.array(*tried), lambda w: w["n"] > 0), 0)  # null where none matches
    counted = df.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("_t"), first.alias("w"))
    whole = counted.where("w is not null").select(*key, "w.strategy", "w.n")
    windows = widening_windows(counted.where("w is null"), key, "_t", regex).groupBy(*key, "size").agg(F.sum("n").alias("n"))
    return whole.unionByName(windows.select(*key, F.concat(F.lit("partial_match:"), F.col("size").cast("string")).alias("strategy"), "n"))


def change_ratio(old: Column, new: Column) -> Column:
    """Similarity of two texts as matched characters over all characters; null for a null text."""

    @F.pandas_udf("double")
    def ratio(a, b):  # noqa: ANN001, ANN202
        return a.combine(b, lambda x, y: None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio())

    return ratio(old, new)


def edit_script(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, place, op, old_first, old_last, new_first, new_last): the line edits from one text to another."""
    key_type = df.schema[key].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                steps = difflib.SequenceMatcher(None, (a or "").splitlines(), (b or "").splitlines(), autojunk=False).get_opcodes()
                for i, (op, *spans) in enumerate(s for s in steps if s[0] != "equal"):
                    keys.append(k)
                    rows.append((i, op, *spans))
            kinds = [pa.int64(), pa.string()] + [pa.int64()] * 4
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds))], [key, "place", "op", "old_first", "old_last", "new_first", "new_last"])

    return df.select(key, old, new).mapInArrow(compare, f"`{key}` {key_type}, place long, op string, old_first long, old_last long, new_first long, new_last long")


def line_windows(df: DataFrame, key: Sequence[str], text: str, size: int) -> DataFrame:
    """(key, first, window): windows of `size` lines at steps of half a size; short texts have one."""
    own = lines(F.col(text))
    n = F.least(F.lit(size), F.size(own))
    starts = F.sequence(F.lit(0), F.size(own) - n, F.greatest(F.lit(1), F.floor(n / 2).cast("int")))
    cut = F.transform(starts, lambda s: F.struct(s.cast("long").alias("first"), F.array_join(F.slice(own, s + 1, n), "\n").alias("window")))
    return df.where(F.length(text) > 0).select(*key, F.explode(cut).alias("w")).select(*key, "w.first", "w.window")
