"""Trees as a table of nodes, and tree queries as joins over it.

nodes(tree_id, node_id, parent_id, last, depth, sib_pos, n_sib, field, node_type, text, subtree_text,
start_line, end_line, source_file): node_id counts from 0 in pre-order and last is the greatest of a
node's subtree, so a descendant has the tree's id and a node_id in (node_id, last]. Children are an
equality on (tree_id, parent_id). Descendants and ancestors are an equality on (tree_id, block): node
ids are cut to blocks of BLOCK, an interval is sent to the blocks it touches, and a large tree is as
many keys as it has blocks.

A query that walks axes, selects by conditions on nodes and projects is compiled to one plan. Any
other is evaluated tree by tree in Arrow batches with the same parser; results are equal.
"""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.plans import tree_query as tq
from tessella.session import materialised

NODES = (
    "tree_id string, node_id bigint, parent_id bigint, last bigint, depth int, sib_pos int, n_sib int, field string, node_type string, "
    "text string, subtree_text string, start_line int, end_line int, source_file string"
)
DEEP = 8  # levels of a tree that one plan holds
BLOCK = 4096  # node ids that share a key where intervals are joined
NAMES = [x.split()[0] for x in NODES.split(", ")]
BATCH = 1024  # nodes that leave Python together
WHOLE = 100_000  # links of a tree that are numbered in one place
_ARROW = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split() for x in NODES.split(", "))])


# Building: any parser of texts that gives Nodes


def flatten(root: tq.Node, tree_id: str) -> list[tuple]:
    """Rows of a tree, in pre-order."""
    rows: list[list] = []

    def add(n: tq.Node, parent: int | None, depth: int, pos: int, sibs: int) -> int:
        i = len(rows)
        rows.append([tree_id, i, parent, i, depth, pos, sibs, n.field, n.type, n.text, n.subtree, n.line, n.end, n.file])
        for k, c in enumerate(n.children):
            rows[i][3] = add(c, i, depth + 1, k, len(n.children))
        return rows[i][3]

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    add(root, None, 0, 0, 1)
    return [tuple(r) for r in rows]


def rebuild(rows: list[dict]) -> tq.Node:
    """The tree of its rows."""
    return _rebuild(sorted(rows, key=lambda r: r["node_id"]))


def _rebuild(rows: Iterable[dict]) -> tq.Node:
    made: dict[int, tq.Node] = {}
    root = None
    for r in rows:
        n = tq.Node(r["node_type"], r["text"], r["start_line"], r["end_line"], r["field"], r["subtree_text"], r["source_file"], id=r["node_id"])
        n.hidden = dict(r["hidden"]) if r.get("hidden") else None
        made[r["node_id"]] = n
        p = made.get(r["parent_id"]) if r["parent_id"] is not None else None
        if p is None:
            root = n
        else:
            n.parent = p
            p.children.append(n)
    return root


def json_tree(text: str, file: str | None = None) -> tq.Node:
    """object > pair(key) > value, array, string, number, boolean, null."""

    def node(v, field=None) -> tq.Node:
        if isinstance(v, dict):
            return tq.Node("object", None, 1, 1, field, json.dumps(v), file, [tq.Node("pair", None, 1, 1, None, None, file, [tq.Node("string", k, field="key", file=file), node(x, "value")]) for k, x in v.items()])
        if isinstance(v, list):
            return tq.Node("array", None, 1, 1, field, json.dumps(v), file, [node(x) for x in v])
        kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
        return tq.Node(kind, v if kind == "string" else json.dumps(v), field=field, file=file)

    return tq.Node("document", None, 1, text.count("\n") + 1, None, text, file, [node(json.loads(text))])


class _Markup(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, file: str | None):
        super().__init__(convert_charrefs=True)
        self.root = tq.Node("document", file=file)
        self.stack, self.file = [self.root], file

    def _put(self, n: tq.Node) -> tq.Node:
        n.parent = self.stack[-1]
        self.stack[-1].children.append(n)
        return n

    def handle_starttag(self, tag, attrs):
        line = self.getpos()[0]
        n = self._put(tq.Node(tag, None, line, line, file=self.file))
        for k, v in attrs:
            a = tq.Node("attribute", v or "", line, line, k, file=self.file)
            a.parent = n
            n.children.append(a)
        if tag not in self.VOID:
            self.stack.append(n)

    def handle_endtag(self, tag):
        line = self.getpos()[0]
        if any(n.type == tag for n in self.stack[1:]):
            while (n := self.stack.pop()).type != tag:
                n.end = line
            n.end = line

    def handle_data(self, data):
        if data.strip():
            line = self.getpos()[0]
            self._put(tq.Node("text", data.strip(), line, line + data.count("\n"), file=self.file))


def html_tree(text: str, file: str | None = None) -> tq.Node:
    p = _Markup(file)
    p.feed(text)
    p.close()
    for n in p.stack:
        n.end = text.count("\n") + 1
    return p.root


def python_tree(text: str, file: str | None = None) -> tq.Node:
    """Python source by the standard library's grammar; names as snake case, fields as the grammar's."""
    import re

    lines = text.splitlines()

    def snake(s: str) -> str:
        return re.sub(r"(?<!^)(?=[A-Z])", "_", s).lower()

    def node(x: ast.AST, field: str | None, line: int) -> tq.Node:
        line = getattr(x, "lineno", line)
        n = tq.Node(snake(type(x).__name__), None, line, getattr(x, "end_lineno", None) or line, field, None, file)
        if hasattr(x, "lineno"):
            n.subtree = ast.get_source_segment(text, x) if n.end - n.line < 200 else "\n".join(lines[n.line - 1 : n.end])
        for f, v in ast.iter_fields(x):
            for y in v if isinstance(v, list) else [v]:
                if isinstance(y, ast.AST) and not isinstance(y, (ast.Load, ast.Store, ast.Del)):
                    c = node(y, f, line)
                elif y is not None and not isinstance(y, ast.AST) and f in ("name", "id", "arg", "attr", "value", "module"):
                    c = tq.Node("identifier" if isinstance(y, str) and f != "value" else "literal", str(y), line, line, f, file=file)
                else:
                    continue
                c.parent = n
                n.children.append(c)
        if not n.children:
            n.text = n.subtree if n.subtree is not None else ""
        return n

    root = node(ast.parse(text), None, 1)
    root.type, root.end, root.subtree = "source_file", max(1, len(lines)), text
    return root


def outline_tree(text: str, file: str | None = None) -> tq.Node:
    """A grammar-free stand-in for languages without a parser here: lines nested by indentation and
    braces. Declarations are told by their keywords, and get a name and a body."""
    import re

    decl = re.compile(r"^\s*(?:(?:pub(?:\([a-z]+\))?|export|default|public|private|protected|static|final|abstract|async|unsafe|open|override)\s+)*(fn|func|function|def|class|struct|enum|trait|interface|impl|module|mod|type)\s+([A-Za-z_]\w*)")
    root = tq.Node("source_file", None, 1, max(1, text.count("\n") + 1), None, text, file)
    stack: list[tuple[int, tq.Node]] = [(-1, root)]
    for i, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while stack[-1][0] >= indent and len(stack) > 1:
            stack.pop()
        if line.strip() in ("}", "};", "end", ")", "});"):
            last = stack[-1][1].children[-1] if stack[-1][1].children else stack[-1][1]
            last.end = i
            continue
        m = decl.match(line)
        kind = f"{ {'fn': 'function', 'func': 'function', 'def': 'function'}.get(m[1], m[1]) }_item" if m else "import" if re.match(r"\s*(?:import|use|from|#include|require)\b", line) else "line"
        n = tq.Node(kind, None if m else line.strip(), i, i, None, line.strip(), file)
        n.parent = stack[-1][1]
        n.parent.children.append(n)
        for p in n.up():
            p.end = max(p.end, i)
        if m:
            name = tq.Node("identifier", m[2], i, i, "name", file=file)
            body = tq.Node("block", None, i, i, "body", None, file)
            for c in (name, body):
                c.parent = n
                n.children.append(c)
            stack.append((indent, body))
    return root


LANGUAGES = {
    "py": "python", "rs": "rust", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "dart": "dart", "swift": "swift", "kt": "kotlin", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "html": "html", "htm": "html",
    "md": "prose", "txt": "prose", "rst": "prose", "adoc": "prose",
}
BUILDERS: dict[str, Callable] = {"json": json_tree, "html": html_tree, "python": python_tree}


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _built(batches: Iterable[pa.RecordBatch], language: str | None = None, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Nodes of texts (path, content), `size` rows at a time; one text's tree is held at once."""
    rows: list[tuple] = []
    for b in batches:
        for path, content in (x for k in range(0, b.num_rows, 16) for x in zip(*(b.slice(k, 16).column(c).to_pylist() for c in ("path", "content")))):
            if content is None:
                continue
            maker = BUILDERS.get(language or language_of(path) or "", outline_tree)
            try:
                root = maker(content, path)
            except (ValueError, SyntaxError, RecursionError) as e:
                root = tq.Node("document", None, 1, content.count("\n") + 1, None, content, path, [tq.Node("error", str(e), file=path)])
            rows += flatten(root, path)
            whole = len(rows) - len(rows) % size
            for k in range(0, whole, size):
                yield _batch(rows[k : k + size])
            del rows[:whole]
    if rows:
        yield _batch(rows)


def build(docs: DataFrame, language: str | None = None) -> DataFrame:
    """The node table of texts (path, content). A text that its parser refuses is one error node."""
    return docs.select("path", "content").mapInArrow(lambda batches: _built(batches, language), NODES)


def parse_metrics(nodes: DataFrame) -> DataFrame:
    """(tree_id, named, errors, missing, confidence) with confidence 1 - (errors + missing) / nodes."""
    err, gone = F.count(F.when(F.lower("node_type") == "error", 1)), F.count(F.when(F.lower("node_type") == "missing", 1))
    return nodes.groupBy("tree_id").agg(F.count("*").alias("named"), err.alias("errors"), gone.alias("missing"), F.round(1 - (err + gone) / F.count("*"), 3).alias("confidence"))


_NUMBERED = "tree_id string, node_id bigint, parent_id bigint, last bigint, depth int, sib_pos int, n_sib int, field string, node_type string, text string"


def _numbered(batches: Iterable[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Nodes of links sorted by (tree_id, sort), one tree held at a time. Of a tree of over WHOLE links, with several
    roots or with an id twice there is one row without a node_id."""
    schema = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split() for x in _NUMBERED.split(", "))])
    rows = (r for b in batches for k in range(0, b.num_rows, 4096) for r in zip(*(b.slice(k, 4096).column(c).to_pylist() for c in ("tree_id", "id", "parent", "field", "node_type", "text"))))
    out: list[tuple] = []
    for tree_id, own in groupby(rows, key=lambda r: r[0]):
        links = list(islice(own, WHOLE + 1))
        kids: dict[str | None, list[tuple]] = {}
        for r in links:
            kids.setdefault(r[2], []).append(r)
        roots = kids.get(None, [])
        if len(links) > WHOLE or len(roots) > 1 or len({r[1] for r in links}) < len(links):
            out.append((tree_id, *[None] * 9))
        elif roots:
            start = len(out)
            stack = [(roots[0], None, 0, 0, 1)]
            while stack:
                r, parent, depth, pos, n = stack.pop()
                at = len(out) - start
                out.append([tree_id, at, parent, at, depth, pos, n, r[3], r[4], r[5]])
                below = kids.get(r[1], ())
                stack += [(x, at, depth + 1, k, len(below)) for k, x in zip(range(len(below) - 1, -1, -1), reversed(below))]
            for r in reversed(out[start + 1 :]):
                above = out[start + r[2]]
                above[3] = max(above[3], r[3])
        for k in range(0, len(out) - len(out) % size, size):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + size]), schema.types)], schema=schema)
        del out[: len(out) - len(out) % size]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def number_trees(links: DataFrame) -> DataFrame:
    """number_nodes() of many trees that are mostly small: links meet once, by tree, and are numbered there. Trees
    of over WHOLE links, and any that only joins tell the meaning of, are numbered level by level."""
    # by a hash: a shuffle by tree_id itself would be left out where the parts of the union have had one
    placed = links.repartition(F.xxhash64("tree_id")).sortWithinPartitions("tree_id", "sort").select("tree_id", "id", "parent", "field", "node_type", "text")
    made = materialised(placed.mapInArrow(_numbered, _NUMBERED), "tree-numbers")
    none, rest = F.lit(None).cast("string"), made.where("node_id is null").select("tree_id")
    out = made.where("node_id is not null").select(
        *[c.split()[0] for c in _NUMBERED.split(", ")], none.alias("subtree_text"), (F.col("node_id") + 1).cast("int").alias("start_line"), (F.col("last") + 1).cast("int").alias("end_line"), none.alias("source_file"),
    ).select(*NAMES)
    return out if rest.isEmpty() else out.unionByName(number_nodes(links.join(rest, "tree_id", "left_semi")))


def number_nodes(links: DataFrame, roots: str = "parent is null") -> DataFrame:
    """The node table of (tree_id, id, parent, field, node_type, text, sort): relations as trees.

    Level by level from the roots; subtree sizes come back up, a sum a level; then a child's number is its
    parent's, plus one, plus the sizes of the siblings before it. Every step is a join on (tree_id, parent),
    so a large tree is spread over all tasks. There are as many rounds as the deepest tree has levels,
    without a bound; each is written, so plans stay small. A cycle that hangs on a root is an error; nodes that no root
    reaches are left out."""
    w = Window.partitionBy("tree_id", "parent").orderBy("sort")
    placed = links.withColumn("sib_pos", (F.row_number().over(w) - 1).cast("int")).withColumn("n_sib", F.count("*").over(Window.partitionBy("tree_id", "parent")).cast("int"))
    placed = materialised(placed, "tree-links")
    levels, most = [placed.where(roots)], None
    while not levels[-1].isEmpty():
        if len(levels) == 64:
            most = placed.count()
        if most is not None and len(levels) > most:
            raise ValueError("a node is its own ancestor")
        up = levels[-1].select("tree_id", F.col("id").alias("parent"))
        level = placed.join(up, ["tree_id", "parent"]).select(placed.columns)
        levels.append(materialised(level, "tree-level"))
    levels.pop()
    sized, below = [], None
    for level in reversed(levels):
        if below is None:
            level = level.withColumn("size", F.lit(1).cast("bigint"))
        else:
            sums = below.groupBy("tree_id", F.col("parent").alias("id")).agg(F.sum("size").alias("__below"))
            level = level.join(sums, ["tree_id", "id"], "left").withColumn("size", F.coalesce("__below", F.lit(0)) + 1).drop("__below")
        below = materialised(level, "tree-sizes") if len(levels) > DEEP else level
        sized.insert(0, below)
    if 1 < len(sized) <= DEEP:  # few levels are written together
        together = sized[0].withColumn("__depth", F.lit(0))
        for depth, level in enumerate(sized[1:], 1):
            together = together.unionByName(level.withColumn("__depth", F.lit(depth)))
        together = materialised(together, "tree-sizes")
        sized = [together.where(F.col("__depth") == depth).drop("__depth") for depth in range(len(sized))]
    earlier = Window.partitionBy("tree_id", "parent").orderBy("sib_pos").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None).cast("string")
    out, above = None, None
    for depth, level in enumerate(sized):
        if above is None:
            level = level.withColumn("parent_id", F.lit(None).cast("bigint")).withColumn("node_id", F.lit(0).cast("bigint"))
        else:
            ids = above.select("tree_id", F.col("id").alias("parent"), F.col("node_id").alias("parent_id"))
            level = level.withColumn("__before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(ids, ["tree_id", "parent"])
            level = level.withColumn("node_id", F.col("parent_id") + 1 + F.col("__before"))
        above = materialised(level.drop("__before"), "tree-numbers") if len(levels) > DEEP else level.drop("__before")
        rows = above.select(
            "tree_id", "node_id", "parent_id", (F.col("node_id") + F.col("size") - 1).alias("last"), F.lit(depth).alias("depth"), "sib_pos", "n_sib", "field", "node_type", "text", none.alias("subtree_text"),
            (F.col("node_id") + 1).cast("int").alias("start_line"), (F.col("node_id") + F.col("size")).cast("int").alias("end_line"), none.alias("source_file"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else links.sparkSession.createDataFrame([], NODES)


# Axes: from a set of nodes (with any extra columns in front, prefixed __) to another


def _step(start: DataFrame, nodes: DataFrame, on: Callable[[Column, Column], Column], types=None) -> DataFrame:
    """Nodes that stand to those of `start` as `on` says; __from keeps where a walk began."""
    if types is not None:
        nodes = nodes.where(F.col("node_type").isin(list(types)))
    extra = [c for c in start.columns if c.startswith("__")]
    a, b = start.alias("a"), nodes.alias("b")
    c = lambda side: lambda x: F.col(f"{side}.{x}")
    return a.join(b, (F.col("a.tree_id") == F.col("b.tree_id")) & on(c("a"), c("b"))).select(*[F.col(f"a.{x}") for x in extra], *[F.col(f"b.{x}") for x in nodes.columns])


def _interval(low: Column, high: Column) -> Column:
    """The blocks that an interval of node ids touches; none if it is empty."""
    return F.when(low <= high, F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))).otherwise(F.array().cast("array<bigint>"))


def _inside(start: DataFrame, nodes: DataFrame, types=None, own: bool = False, near: Callable | None = None) -> DataFrame:
    """Nodes in the subtrees of `start`, joined block by block."""
    low = F.col("node_id") if own else F.col("node_id") + 1
    a = start.withColumn("block", F.explode(_interval(low, F.col("last"))))
    b = nodes.withColumn("block", F.floor(F.col("node_id") / BLOCK))
    on = lambda a, b: (a("block") == b("block")) & ((b("node_id") >= a("node_id")) if own else (b("node_id") > a("node_id"))) & (b("node_id") <= a("last")) & (near(a, b) if near else F.lit(True))
    return _step(a, b, on, types).drop("block")


def children(start: DataFrame, nodes: DataFrame, types=None, n: int | None = None) -> DataFrame:
    nth = lambda b: F.lit(True) if n is None else b("sib_pos") == n if n >= 0 else b("sib_pos") == b("n_sib") + n
    return _step(start, nodes, lambda a, b: (b("parent_id") == a("node_id")) & nth(b), types)


def descendants(start: DataFrame, nodes: DataFrame, types=None, depth: int | None = None) -> DataFrame:
    """A depth below 1 reads as 1."""
    if depth is not None and depth <= 1:
        return children(start, nodes, types)
    return _inside(start, nodes, types, near=None if depth is None else lambda a, b: b("depth") <= a("depth") + depth)


def parent(start: DataFrame, nodes: DataFrame) -> DataFrame:
    return _step(start, nodes, lambda a, b: b("node_id") == a("parent_id"))


def ancestors(start: DataFrame, nodes: DataFrame) -> DataFrame:
    above = nodes.where(F.col("last") > F.col("node_id")).withColumn("block", F.explode(_interval(F.col("node_id") + 1, F.col("last"))))
    at = start.withColumn("block", F.floor(F.col("node_id") / BLOCK))
    return _step(at, above, lambda a, b: (a("block") == b("block")) & (b("node_id") < a("node_id")) & (b("last") >= a("node_id"))).drop("block")


def siblings(start: DataFrame, nodes: DataFrame, by: int | None = None) -> DataFrame:
    gap = lambda a, b: b("sib_pos") != a("sib_pos") if by is None else b("sib_pos") == a("sib_pos") + by
    return _step(start, nodes, lambda a, b: (b("parent_id") == a("parent_id")) & gap(a, b))


def field(start: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The first child of that field; none where there is none."""
    own = nodes.where(F.col("field") == name)
    first = Window.partitionBy("tree_id", "parent_id").orderBy("sib_pos")
    own = own.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return _step(start, own, lambda a, b: b("parent_id") == a("node_id"))


_META = {
    "type": lambda: F.col("node_type"), "text": lambda: F.coalesce("text", "subtree_text"), "start": lambda: F.col("start_line"), "line": lambda: F.col("start_line"), "end": lambda: F.col("end_line"),
    "file": lambda: F.col("source_file"), "subtree_text": lambda: F.col("subtree_text"), "depth": lambda: F.col("depth"),
}
_NUMERIC = ("start", "line", "end", "depth")


class NotCompiled(Exception):
    """The expression has no plan of joins; it is evaluated tree by tree."""


def _value(e: tuple) -> tuple[Column, str]:
    """A scalar over one node as (column, kind)."""
    if e[0] == "meta" and e[1] in _META:
        return _META[e[1]](), "number" if e[1] in _NUMERIC else "string"
    if e[0] == "lit" and e[1] is not None:
        return F.lit(e[1]), "boolean" if isinstance(e[1], bool) else "number" if isinstance(e[1], float) else "string"
    if e[0] == "arith":
        (a, ka), (b, kb) = _value(e[2]), _value(e[3])
        if ka == kb == "number":
            a, b = a.cast("double"), b.cast("double")
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[e[1]], "number"
    if e[0] == "pipe" and e[2][0] == "call":
        a, kind = _value(e[1])
        name, args = e[2][1], e[2][2]
        if kind == "string":
            if name in ("startswith", "endswith", "contains", "test") and len(args) == 1 and args[0][0] == "lit" and isinstance(args[0][1], str):
                x = args[0][1]
                test = {"startswith": a.startswith, "endswith": a.endswith, "contains": a.contains, "test": a.rlike}[name](x)
                return F.coalesce(test, F.lit(False)), "boolean"
            if name == "length":
                return F.coalesce(F.octet_length(a), F.lit(0)), "number"
            if name in ("ascii_downcase", "ascii_upcase"):
                return (F.lower if name == "ascii_downcase" else F.upper)(a), "string"
    if e[0] in ("cmp", "and", "or", "not"):
        return _condition(e), "boolean"
    raise NotCompiled(e[0])


def _condition(e: tuple) -> Column:
    if e[0] == "cmp":
        (a, ka), (b, kb) = _value(e[2]), _value(e[3])
        if e[1] in ("==", "!="):
            same = a.eqNullSafe(b) if ka == kb else F.lit(False)
            return same if e[1] == "==" else ~same
        if e[1] == "=~" and e[3][0] == "lit" and ka == kb == "string":
            tq._regex(e[3][1])
            return F.coalesce(a.rlike(e[3][1]), F.lit(False))
        if e[1] != "=~" and ka == kb == "number":
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e[1]]
        raise NotCompiled("comparison of kinds")
    if e[0] == "and":
        return _condition(e[1]) & _condition(e[2])
    if e[0] == "or":
        return _condition(e[1]) | _condition(e[2])
    if e[0] == "not":
        return ~_condition(e[1])
    if e[0] == "lit":
        return F.lit(tq.truthy(e[1]))
    c, kind = _value(e)
    return F.coalesce(c, F.lit(False)) if kind == "boolean" else c.isNotNull()


def _walk(e: tuple, at: DataFrame, nodes: DataFrame) -> DataFrame:
    if e[0] == "id":
        return at
    if e[0] == "pipe":
        return _walk(e[2], _walk(e[1], at, nodes), nodes)
    if e[0] == "select":
        return at.where(_condition(e[1]))
    if e[0] == "field":
        return field(at, nodes, e[1])
    if e[0] == "child":
        return children(at, nodes, None, e[1])
    if e[0] == "iterate":
        return children(at, nodes)
    if e[0] == "axis":
        _, axis, depth, types = e
        if axis == "self":
            return at.where(F.col("node_type").isin(list(types)))
        if axis == "children":
            return children(at, nodes, types)
        if axis == "desc":
            return descendants(at, nodes, types, depth)
        if axis == "parent":
            return parent(at, nodes)
        if axis == "ancestors":
            return ancestors(at, nodes)
        return siblings(at, nodes, {"siblings": None, "prev_sibling": -1, "next_sibling": 1}[axis])
    if e[0] == "match":
        return _match(e[1], at, nodes)
    raise NotCompiled(e[0])


def _matching(step: tuple, nodes: DataFrame) -> DataFrame:
    _, node_type, constraint, predicates = step
    out = nodes.where(F.col("node_type") == node_type)
    for name, op, value in predicates:
        if name not in _META:
            raise tq.QueryError(f"no such field in a predicate: @{name}")
        if name in _NUMERIC and isinstance(value, str):
            try:
                value = float(value)
            except ValueError:
                raise NotCompiled("number") from None
        elif name not in _NUMERIC and not isinstance(value, str):
            raise NotCompiled("text")
        out = out.where(_condition(("cmp", op, ("meta", name), ("lit", value))))
    if constraint:
        first = field(out, nodes, constraint[0]).where(F.col("node_type") == constraint[1])
        out = out.join(first.select("tree_id", F.col("parent_id").alias("node_id")), ["tree_id", "node_id"], "left_semi").select(nodes.columns)
    return out


def _match(steps: tuple, at: DataFrame, nodes: DataFrame) -> DataFrame:
    out = _inside(at, _matching(steps[0], nodes), own=True)
    for s in steps[1:]:
        found = _matching(s, nodes)
        out = _step(out, found, lambda a, b: b("parent_id") == a("node_id")) if s[0] == "child" else _inside(out, found)
    return out


def compile(query: str | tuple, nodes: DataFrame) -> DataFrame:
    """The plan of a query from every tree's root: a table of nodes, or (tree_id, node_id, value) for a
    scalar at the end, or a column a key for an object of scalars and fields' texts. Raises NotCompiled."""
    e = tq.parse(query) if isinstance(query, str) else query
    roots = nodes.where("parent_id is null")
    steps = []
    while e[0] == "pipe":
        steps.append(e[2])
        e = e[1]
    steps.append(e)
    steps.reverse()
    at = roots
    for i, s in enumerate(steps):
        if i == 0 and s[0] == "axis" and s[1] in ("children", "desc"):  # every other node is below its tree's root
            at = nodes.where(F.col("parent_id").isNotNull())
            if s[1] == "children" or s[2] is not None:
                at = at.where(F.col("depth") <= (1 if s[1] == "children" else max(1, s[2])))
            at = at if s[3] is None else at.where(F.col("node_type").isin(list(s[3])))
            continue
        try:
            at = _walk(s, at, nodes)
        except NotCompiled:
            if s[0] == "object" and i == len(steps) - 1:
                return _project(s[1], at, nodes)
            rest = s
            for t in steps[i + 1 :]:
                rest = ("pipe", rest, t)
            value, _ = _value(rest)
            return at.select("tree_id", "node_id", value.alias("value"))
    return at


def _project(pairs: tuple, at: DataFrame, nodes: DataFrame) -> DataFrame:
    """An object's keys as columns; a key whose expression walks from the node gives the first result."""
    at = at.withColumn("__row", F.struct("tree_id", "node_id")) if any(p[1][0] == "pipe" and p[1][1][0] in ("field", "axis", "child") for p in pairs) else at
    columns: dict[str, Column] = {}
    for k, e in pairs:
        if e[0] == "pipe" and e[1][0] in ("field", "axis", "child"):
            value, _ = _value(e[2])
            found = _walk(e[1], at.select("__row", *nodes.columns), nodes)
            # nearest first on the way up, else in the order of the tree
            near = -F.col("node_id") if e[1][0] == "axis" and e[1][1] == "ancestors" else F.col("node_id")
            first = found.groupBy("__row").agg(F.min_by(F.struct(value.alias("v")), near).alias(f"__{k}"))
            at = at.join(first, "__row", "left")
            columns[k] = F.col(f"__{k}.v")
        else:
            columns[k] = _value(e)[0]
    return at.select("tree_id", "node_id", *[c.alias(k) for k, c in columns.items()])


def _reach(e: tuple, d: float, counted: set[str]) -> tuple[float, float]:
    """(depth of the deepest node in the outputs, depth of the deepest node looked at) for an input with nodes down
    to depth d, -1 being none. Types that count_desc() names are gathered instead of looked at."""
    kind = e[0]
    if kind in ("lit", "meta"):
        return -1, d
    if kind in ("id", "index"):
        return d, d
    if d < 0 and kind in ("axis", "match", "field", "child", "iterate"):
        return -1, -1
    if kind == "match":
        return math.inf, math.inf
    if kind in ("field", "child", "iterate"):
        return d + 1, d + 1
    if kind == "axis":
        deeper = {"children": 1, "desc": math.inf if e[2] is None else max(1, e[2])}.get(e[1], 0)
        return d + deeper, d + deeper
    if kind == "pipe":
        mid, seen = _reach(e[1], d, counted)
        out, more = _reach(e[2], mid, counted)
        return out, max(seen, more)
    if kind == "select":
        return d, max(d, _reach(e[1], d, counted)[1])
    if kind == "call":
        _, name, args = e
        if name == "count_desc":
            if len(args) == 1 and args[0][0] == "lit" and isinstance(args[0][1], str):
                counted.add(args[0][1])
                return -1, d
            return -1, math.inf
        own = d + 1 if d >= 0 and name in ("length", "has", "first", "last") else d
        each = [_reach(x, d, counted) for x in args]
        return max([d, own if name in ("first", "last") else d, *(x for x, _ in each)]), max([own, *(x for _, x in each)])
    parts = {"object": lambda: [x for _, x in e[1]], "array": lambda: e[1], "interp": lambda: [x for x in e[1] if not isinstance(x, str)], "cmp": lambda: e[2:], "arith": lambda: e[2:]}.get(kind, lambda: e[1:])()
    each = [_reach(x, d, counted) for x in parts]
    return max([-1, *(x for x, _ in each)]), max([d, *(x for _, x in each)])


def _within(nodes: DataFrame, depth: int, counted: set[str]) -> DataFrame:
    """Nodes down to a depth; those at it with a map `hidden`: how many nodes of each counted type lie below."""
    kept = nodes.where(F.col("depth") <= depth)
    if not counted:
        return kept.withColumn("hidden", F.lit(None).cast("map<string,bigint>"))
    deep = nodes.where((F.col("depth") > depth) & F.col("node_type").isin(*counted))
    if depth == 0:
        found = deep.select("tree_id", F.lit(0).cast("bigint").alias("node_id"), "node_type")
    else:
        above = nodes.where((F.col("depth") == depth) & (F.col("last") > F.col("node_id"))).withColumn("__at", F.col("node_id"))
        found = _inside(above, deep).select("tree_id", F.col("__at").alias("node_id"), "node_type")
    counts = found.groupBy("tree_id", "node_id", "node_type").agg(F.count("*").alias("n"))
    return kept.join(counts.groupBy("tree_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("node_type", "n"))).alias("hidden")), ["tree_id", "node_id"], "left")


def evaluate(query: str | tuple, nodes: DataFrame) -> DataFrame:
    """(tree_id, ord, value): the results of any query as JSON, tree by tree. Of a tree only the nodes come together
    that the query can look at: those down to a depth, if it has no step to all descendants; count_desc() of a named
    type is no such step, as what lies deeper is counted before."""
    e = tq.parse(query) if isinstance(query, str) else query
    counted: set[str] = set()
    depth = _reach(e, 0, counted)[1]
    nodes = nodes.withColumn("hidden", F.lit(None).cast("map<string,bigint>")) if depth == math.inf else _within(nodes, int(depth), counted)

    def run(group: pa.Table) -> pa.Table:
        rows = (r for b in group.sort_by("node_id").to_batches(max_chunksize=4096) for r in b.to_pylist())
        out = tq.run(e, _rebuild(rows))
        return pa.table({"tree_id": pa.array([group.column("tree_id")[0].as_py()] * len(out), pa.string()), "ord": pa.array(range(len(out)), pa.int64()), "value": pa.array([tq.dumps(v) for v in out], pa.string())})

    used = ("tree_id", "node_id", "parent_id", "field", "node_type", "text", "subtree_text", "start_line", "end_line", "source_file", "hidden")
    return nodes.select(*used).groupBy("tree_id").applyInArrow(run, "tree_id string, ord bigint, value string")


def query(text: str, nodes: DataFrame) -> DataFrame:
    """A query by the plan of joins where there is one, else tree by tree."""
    e = tq.parse(text)
    try:
        return compile(e, nodes)
    except NotCompiled:
        return evaluate(e, nodes)


# Summaries of source trees

_NOISE = "comment|attribute|decorator|expression_statement|^expr$|^line$"
_IMPORT = "^(?:import|use_declaration|import_from|import_statement|import_from_statement|include|preproc_include|use)"
_CALLABLE = "function|method|^fn_|_fn$"


def skeleton(nodes: DataFrame) -> DataFrame:
    """(tree_id, imports, declarations): the root's children without comments and decorators."""
    roots = nodes.where("parent_id is null")
    top = children(roots, nodes).where(~F.col("node_type").rlike(_NOISE))
    name = field(top, nodes, "name").select("tree_id", F.col("parent_id").alias("node_id"), F.coalesce("text", "subtree_text").alias("name"))
    members = children(field(top.withColumn("__of", F.col("node_id")), nodes, "body"), nodes).groupBy("tree_id", F.col("__of").alias("node_id")).agg(F.count("*").alias("members"))
    is_import = F.col("node_type").rlike(_IMPORT)
    shown = top.join(name, ["tree_id", "node_id"], "left").join(members, ["tree_id", "node_id"], "left")
    d = F.struct("node_id", F.col("node_type").alias("type"), "name", F.col("start_line").alias("line"), "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), "members")
    each = shown.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.when(is_import, F.struct("node_id", F.trim(F.coalesce("subtree_text", "text", F.lit(""))).alias("t"))))).alias("i"), F.array_sort(F.collect_list(F.when(~is_import, d))).alias("declarations"))
    return roots.select("tree_id").join(each, "tree_id", "left").select("tree_id", F.coalesce(F.transform("i", lambda x: x["t"]), F.array().cast("array<string>")).alias("imports"), "declarations")


def signatures(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, type, name, params, return_type, line, lines) of functions and methods at any depth."""
    own = nodes.where(F.col("node_type").rlike(_CALLABLE) & ~F.col("node_type").rlike("call|type$"))

    def part(names: tuple[str, ...], alias: str) -> DataFrame:
        kids = nodes.where(F.col("field").isin(*names)).select("tree_id", F.col("parent_id").alias("node_id"), F.struct("sib_pos", F.coalesce("text", "subtree_text").alias("t")).alias("x"))
        return kids.groupBy("tree_id", "node_id").agg(F.min("x")["t"].alias(alias))

    out = own
    for names, alias in ((("name", "declarator"), "name"), (("parameters", "args", "formal_parameters"), "params"), (("return_type", "returns", "result"), "return_type")):
        out = out.join(part(names, alias), ["tree_id", "node_id"], "left")
    return out.select("tree_id", "node_id", F.col("node_type").alias("type"), "name", "params", "return_type", F.col("start_line").alias("line"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
