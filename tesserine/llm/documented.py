"""Functions and methods of source texts paired with their documentation comments.

Signatures are found by regular expressions on lines outside comments and strings, bodies are
delimited by a stack of indentations (Python), of braces or of end keywords (Ruby), and a comment
belongs to the function whose first line (annotations included) follows it at a distance of one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# File endings of the languages read here.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "java": "java", "go": "go", "rb": "ruby", "rs": "rust",
}

_JS = re.compile(
    r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s+([\w$]+)\s*[(<]"
    r"|^\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={]+)?=>|[\w$]+\s*=>)"
    r"|^\s*(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*[*#]?([\w$]+)\s*(?:<[^>()]*>)?\([^{};]*\)\s*(?::[^;{}]+)?\{\s*(?:\}|$|//)"
)
_SIGNATURES = {
    "python": re.compile(r"^\s*(?:async\s+)?def\s+(\w+)\s*[(\[]"),
    "javascript": _JS,
    "typescript": _JS,
    "java": re.compile(
        r"^\s*(?:@\w+(?:\([^()]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
        r"(?:<[^()]*>\s+)?(?:[\w$.]+(?:<[^()]*>)?(?:\[\])*\s+)?([\w$]+)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{\s*(?:\}|$|//|[^;]*;\s*\}$)"
    ),
    "go": re.compile(r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]"),
    "ruby": re.compile(r"^\s*(?:(?:private|public|protected|module_function)\s+)?def\s+(?:self\.)?(\w+[?!=]?)"),
    "rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)\s*[(<]"),
}
# Headers of methods without a body, on one line.
_BODILESS = {
    "java": re.compile(r"^\s*(?:@\w+(?:\([^()]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|strictfp)\s+)*(?:<[^()]*>\s+)?(?!(?:assert|yield)\b)[\w$.]+(?:<[^()]*>)?(?:\[\])*\s+([\w$]+)\s*\([^;{}=]*\)\s*(?:throws\s+[\w.,\s]+)?;"),
    "typescript": re.compile(r"^\s*(?:(?:public|private|protected|static|readonly|override|abstract)\s+)*([\w$]+)\??\s*(?:<[^>()]*>)?\([^;]*\)\s*:[^;=?]+;\s*$"),
}
_NOT_NAMES = frozenset("if for while switch catch return function do else try with new throw await typeof elseif synchronized super this case".split())
_ANNOTATION = {
    "python": re.compile(r"^\s*@\w"), "javascript": re.compile(r"^\s*@\w"), "typescript": re.compile(r"^\s*@\w"),
    "java": re.compile(r"^\s*@\w"), "go": re.compile(r"^\s*//go:\w"), "ruby": re.compile(r"^\s*(?:private|public|protected|module_function)\s*$|^\s*@\w"), "rust": re.compile(r"^\s*#!?\["),
}
_BREAKS = re.compile(r"\r\n|\r|\n")
_TRIPLE = re.compile(r"\"\"\"|'''")
_PY_STRING = re.compile(r"^\s*[rRuUbB]{0,2}(\"\"\"|'''|\"|')")
_LETTERS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]")
_MARKS = re.compile(r"^\s*(?:/\*+|\*+/|\*+(?!/)|//+!?|#+!?|=begin\b|=end\b)?\s?")
_TODO = re.compile(r"^\W*(?:todo|fixme|xxx|tbd)\b", re.IGNORECASE)
_RUBY_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|case|while|until|for|begin)\b|\bdo\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
_RUBY_END = re.compile(r"^\s*end\b")


# What every signature of a language holds on its first line.
_HINTS = {"python": "def", "javascript": "", "typescript": "", "java": "(", "go": "func", "ruby": "def", "rust": "fn"}


class Function(NamedTuple):
    """One function with its documentation; lines count from 1 and include both ends."""

    name: str
    first_line: int
    last_line: int
    code: str
    description: str


def language_of(path: str | None) -> str | None:
    """The language of a path by its ending, or None."""
    return LANGUAGES.get((path or "").strip().rpartition(".")[2].lower())


def _kinds(lines: list[str], language: str) -> list[str]:
    """Of each line: 'comment', 'block' (part of a block comment), 'string' (inside one), 'blank' or 'code'."""
    kinds, inside = [], ""
    hashes = language in ("python", "ruby")
    for line in lines:
        bare = line.strip()
        if inside:
            kinds.append("block" if inside in ("*/", "=end") else "string")
            if inside == "=end":
                inside = "" if bare.startswith("=end") else inside
            elif inside == "`":
                inside = "" if line.count("`") % 2 else inside
            elif inside in line:
                inside = ""
            continue
        if not bare:
            kinds.append("blank")
        elif (bare.startswith("#") if hashes else bare.startswith("//")) :
            kinds.append("comment")
        elif language == "ruby" and bare.startswith("=begin"):
            kinds.append("block")
            inside = "=end"
        elif not hashes and bare.startswith("/*"):
            kinds.append("block" if bare.endswith("*/") or "*/" not in bare else "code")
            inside = "" if "*/" in bare[2:] else "*/"
        else:
            kinds.append("code")
            if language == "python":
                marks = _TRIPLE.findall(line.split("#")[0] if "#" in line and not _TRIPLE.search(line) else line)
                open_mark = ""
                for mark in marks:
                    open_mark = "" if mark == open_mark else (open_mark or mark)
                inside = open_mark
            elif language in ("javascript", "typescript", "go"):
                if line.count("`") % 2:
                    inside = "`"
            if not hashes and not inside and "/*" in line and line.rfind("/*") > line.rfind("*/") and "//" not in line.split("/*")[0] and '"' not in line and "'" not in line:
                inside = "*/"
    return kinds


_TEXTS = {
    "python": re.compile(r"[rRbBuUfF]{0,2}(?:\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|#.*"),
    "ruby": re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|(?<![\w$])#(?!\{).*"),
    "rust": re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\[^']+|[^'\\])'|//.*|/\*.*?\*/"),
    "javascript": re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|//.*|/\*.*?\*/"),
}
for _name in ("typescript", "java", "go"):
    _TEXTS[_name] = _TEXTS["javascript"]


_LONG = {"python": "", "ruby": "", "rust": "", "java": "", "javascript": "`", "typescript": "`", "go": "`"}
_CLOSED_TRIPLE = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''")


def _bare(lines: list[str], kinds: list[str], language: str) -> list[str]:
    """The code of each line without strings and comments, '' for lines of other kinds."""
    texts, mark = _TEXTS[language], _LONG[language]
    found = []
    for line, kind in zip(lines, kinds):
        if kind != "code":
            line = ""
        elif language == "python" and _TRIPLE.search(line):
            line = texts.sub("''", _TRIPLE.split(_CLOSED_TRIPLE.sub("''", line))[0])
        else:
            line = texts.sub("''", line)
            if mark and mark in line:  # what is left of a text over several lines
                line = line.partition(mark)[0]
        found.append(line)
    return found


def _header_end(bare: list[str], start: int) -> int:
    """Index of the last line of a header that begins at `start`: where its brackets are closed."""
    depth = 0
    for i in range(start, len(bare)):
        depth += sum(map(bare[i].count, "([")) - sum(map(bare[i].count, ")]"))
        if depth <= 0:
            return i
    return start


def _body_ends(lines: list[str], kinds: list[str], bare: list[str], headers: dict[int, int], language: str) -> dict[int, int]:
    """Of each header (first line -> last line) the index of the last line of its body, in one pass with a stack."""
    ends: dict[int, int] = {}
    stack: list[list[int]] = []  # first line and what closes it: an indentation or a depth
    depth, last, opened = 0, 0, set()
    for i, line in enumerate(lines):
        if language == "python":
            if kinds[i] == "code":
                indent = len(line) - len(line.lstrip())
                while stack and depth == 0 and indent <= stack[-1][1]:
                    ends[stack.pop()[0]] = last
                if i in headers:
                    stack.append([i, indent])
                depth = max(0, depth + sum(map(bare[i].count, "([{")) - sum(map(bare[i].count, ")]}")))
            if kinds[i] in ("code", "string"):
                last = i
            continue
        if kinds[i] != "code":
            continue
        last = i
        if i in headers:
            stack.append([i, depth])
        if language == "ruby":
            if _RUBY_END.match(bare[i]):
                depth -= 1
                if stack and depth <= stack[-1][1]:
                    ends[stack.pop()[0]] = i
            elif _RUBY_OPEN.search(bare[i]):
                depth += 1
                if re.search(r"[;\s]end\s*$", bare[i]):  # opened and closed on one line
                    depth -= 1
                    if stack and stack[-1][0] == i:
                        ends[stack.pop()[0]] = i
            elif stack and stack[-1][0] == i and "=" in bare[i]:
                ends[stack.pop()[0]] = i  # def of one expression
            continue
        if "{" in bare[i]:
            opened.update(start for start, _ in stack)
        depth += bare[i].count("{") - bare[i].count("}")
        while stack:
            start, level = stack[-1]
            if depth <= level if start in opened else i >= headers[start] and bare[i].rstrip().endswith(";"):
                ends[stack.pop()[0]] = i
            else:
                break
    for start, _ in stack:
        ends[start] = last
    return ends


def _comment_above(lines: list[str], kinds: list[str], start: int, language: str) -> str:
    note = _ANNOTATION[language]
    i = start - 1
    while i >= 0 and kinds[i] in ("code", "comment") and note.match(lines[i]):
        i -= 1
    if i < 0 or kinds[i] not in ("comment", "block"):
        return ""
    kind, end = kinds[i], i
    while i >= 0 and kinds[i] == kind:
        i -= 1
        if kind == "block" and ("/*" in lines[i + 1] or lines[i + 1].lstrip().startswith("=begin")):
            break
    return "\n".join(lines[i + 1 : end + 1])


def _string_below(lines: list[str], head: int) -> str:
    i = head + 1
    while i < len(lines) and not lines[i].strip():
        i += 1
    if i == len(lines) or not (m := _PY_STRING.match(lines[i])):
        return ""
    mark, rest = m[1], lines[i][m.end() :]
    found = []
    while True:
        before, closed, _ = rest.partition(mark)
        found.append(before)
        i += 1
        if closed or i == len(lines) or len(mark) == 1:
            return "\n".join(found)
        rest = lines[i]


def plain_comment(raw: str) -> str:
    """A comment without its marks."""
    lines = [_MARKS.sub("", line, count=1) for line in raw.split("\n")]
    return "\n".join(re.sub(r"\s*\*+/\s*$", "", line).rstrip() for line in lines).strip()


def is_trivial(description: str, name: str) -> bool:
    """Whether a description says nothing: a reminder, or fewer than four words of its own."""
    if _TODO.match(description):
        return True
    kept = [line for line in description.split("\n") if not line.lstrip().startswith(("@", ":"))]
    own = {part.lower() for part in _PARTS.findall(name)} | {part.lower() for part in _LETTERS.findall(name)}
    return sum(word.lower() not in own for line in kept for word in _LETTERS.findall(line)) < 4


def documented_functions(source: str | None, language: str) -> list[Function]:
    """The functions of a source text whose documentation is neither empty nor trivial."""
    if not source:
        return []
    lines = _BREAKS.split(source)
    kinds = _kinds(lines, language)
    signature, found, headers = _SIGNATURES[language], [], {}
    bare: list[str] = []
    for i, line in enumerate(lines):
        if kinds[i] != "code" or not (_HINTS[language] in line):
            continue
        bare = bare or _bare(lines, kinds, language)
        m = signature.match(line)
        if not m and "(" in line and bare[i].count("(") > bare[i].count(")") and language not in ("python", "go", "ruby", "rust"):
            m = signature.match(" ".join(x.strip() for x in lines[i : _header_end(bare, i) + 1]))
        bodiless = None
        if not m and language in ("java", "typescript") and "(" in line:
            end = _header_end(bare, i)
            header = " ".join(x.strip() for x in lines[i : end + 1])
            below = end + 1
            while below < len(lines) and kinds[below] == "blank":
                below += 1
            if language in _BODILESS and header.endswith(";"):
                m = bodiless = _BODILESS[language].match(header)
            elif "{" not in header and below < len(lines) and lines[below].lstrip().startswith("{"):
                m = signature.match(header + " {")
        name = next((g for g in m.groups() if g), None) if m else None
        if not name or name in _NOT_NAMES or line.split(None, 1)[0] in ("return", "new", "else", "throw", "await", "}"):
            continue
        head = _header_end(bare, i)
        if not bodiless:
            headers[i] = head  # every function belongs on the stack, documented or not
        texts = [plain_comment(_comment_above(lines, kinds, i, language))]
        if language == "python":
            texts.append(_string_below(lines, head).strip())
        described = [t for t in texts if t and not is_trivial(t, name)]
        if described:
            found.append((name, i, head, "\n".join(described)))
    if not found:
        return []
    ends = _body_ends(lines, kinds, bare, headers, language)
    spans = [(name, i, ends.get(i, head), described) for name, i, head, described in found]
    return [Function(name, i + 1, last + 1, "\n".join(lines[i : last + 1]), described) for name, i, last, described in spans]


def function_pairs(df: DataFrame, id_col: str, content_col: str, path_col: str) -> DataFrame:
    """(id, func_name, first_line, last_line, code, description) of every documented function.

    The language follows from the ending of `path_col`. Null ids, null or empty contents and paths
    of other endings give no row; a text delivered twice gives its functions once.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for key, text, path in zip(*(c.to_pylist() for c in batch.columns)):
                if language := language_of(path):
                    own = documented_functions(text, language)
                    ids += [key] * len(own)
                    found += own
            fields = list(zip(*found)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(f, k) for f, k in zip(fields, kinds))], ["id", "func_name", "first_line", "last_line", "code", "description"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("t"), F.col(path_col).alias("p")).where("id is not null and t is not null and p is not null")
    return picked.mapInArrow(extract, "id long, func_name string, first_line int, last_line int, code string, description string").distinct()
