"""Extraction of symbols, imports, calls and API operations from source text.

Python goes through its own syntax tree.  Other languages are read by a scanner that blanks
strings and comments and then looks for declarations, with braces, indentation or end
keywords closing them; the mode of each file is reported.
"""

from __future__ import annotations

import ast
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .declarations import declarations

FACTS = (
    "repo_id string, file_path string, fact string, name string, qualified_name string, kind string, start_line int, end_line int, exported boolean, "
    "signature string, owner string, callee string, qualifier string, occurrences int, specifier string, local string, imported string, "
    "method string, path string, confidence double, cyclomatic int, cognitive int, mode string, body string"
)
_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]

# Words before "(" that are no calls.
KEYWORDS = frozenset((
    "assert", "await", "catch", "class", "def", "delete", "do", "else", "except", "finally", "for", "foreach", "function", "if",
    "import", "in", "isinstance", "lambda", "match", "new", "print", "raise", "return", "sizeof", "super", "switch", "typeof",
    "unless", "using", "while", "with", "yield",
))
#: Words that no definition has as its name, besides.
NO_NAMES = KEYWORDS | frozenset("try throw void instanceof export extends case elif and or not is fn func let var const mut pub impl struct enum trait interface select go defer namespace template of async".split())

_CALL = re.compile(r"(?:\b(?P<q>[A-Za-z_$][\w$]*)\s*(?:\.|::|->)\s*)?(?P<n>[A-Za-z_$][\w$]*)\s*\(")
_ROUTE = re.compile(r"\b(?:app|router|server|fastify|api)\s*\.\s*(get|post|put|patch|delete|all|use)\s*\(\s*(['\"`])([^'\"`]*)\2(?:\s*,\s*([A-Za-z_$][\w$]*))?")
_FETCH = re.compile(r"\bfetch\s*\(\s*(['\"`])([^'\"`]+)\1(?:\s*,\s*\{[^}]*?method\s*:\s*['\"](\w+)['\"])?", re.S)
_CLIENT = re.compile(r"\b(?:axios|http|client|request)\s*\.\s*(get|post|put|patch|delete)\s*\(\s*(['\"`])([^'\"`]+)\2")
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|elif|except|when)\b|&&|\|\||\?\?|\?(?![.:])")


def blank(text: str, hash_comments: bool = False) -> str:
    """The text with strings and comments blanked; lengths and line breaks stay."""
    line = r"#[^\n]*" if hash_comments else r"//[^\n]*|/\*.*?\*/"
    pattern = re.compile(line + r"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _complexity(body: str) -> tuple[int, int]:
    """Cyclomatic and nesting-weighted complexity of blanked code."""
    n, cognitive, depth = 1, 0, 0
    for token in re.finditer(r"[{}]|" + _BRANCH.pattern, body):
        t = token[0]
        if t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
        else:
            n += 1
            cognitive += 1 + (max(0, depth - 1) if t[0].isalpha() else 0)
    return n, cognitive


def scan_code(text: str, language: str) -> list[dict]:
    code = blank(text, language in ("ruby",))
    at_line = lambda k: code.count("\n", 0, k) + 1
    found: dict[int, dict] = {}
    for d in declarations(code, language, NO_NAMES):
        kind = "Constructor" if d["kind"] == "Method" and d["name"] in ("constructor", "__init__") else d["kind"]
        found[d["name_at"]] = {"fact": "symbol", "name": d["name"], "kind": kind, "at": d["at"], "end": d["end"], "exported": d["exported"]}
    rows = sorted(found.values(), key=lambda r: (r["at"], -r["end"]))
    for r in rows:
        owner = [o for o in rows if o is not r and o["at"] <= r["at"] and o["end"] >= r["end"] and o["kind"] in ("Class", "Interface", "Struct", "Trait", "Module", "Record", "Enum")]
        r["qualified_name"] = ".".join([*(o["name"] for o in owner), r["name"]])
        r["start_line"], r["end_line"] = at_line(r["at"]), at_line(max(r["at"], r["end"] - 1))
        r["signature"] = " ".join(text[r["at"] : r["end"]].split("{")[0].split())[:500]
        r["cyclomatic"], r["cognitive"] = _complexity(code[r["at"] : r["end"]])
        r["body"] = text[r["at"] : r["end"]]
    names = {r["at"] for r in rows}
    spots = {s for s in found}
    calls: Counter = Counter()
    for m in _CALL.finditer(code):
        if m["n"] in KEYWORDS or m.start("n") in spots or m.start("n") in names:
            continue
        inner = [r for r in rows if r["at"] <= m.start() < r["end"] and r["kind"] not in ("Class", "Interface", "Struct", "Trait", "Enum", "Constant")]
        owner = max(inner, key=lambda r: r["at"], default=None)
        calls[(owner["qualified_name"] if owner else "<module>", m["n"], m["q"])] += 1
    out = rows + [{"fact": "call", "owner": o, "callee": c, "qualifier": q, "occurrences": n} for (o, c, q), n in calls.items()]
    out += _imports(text, language)
    for m in _ROUTE.finditer(text):
        out.append({"fact": "api", "kind": "mount" if m[1] == "use" else "route", "method": "ANY" if m[1] in ("all", "use") else m[1].upper(), "path": m[3], "name": m[4], "confidence": 0.95, "start_line": text.count("\n", 0, m.start()) + 1})
    for m in _FETCH.finditer(text):
        out.append({"fact": "api", "kind": "client", "method": (m[3] or "GET").upper(), "path": m[2], "confidence": 0.99, "start_line": text.count("\n", 0, m.start()) + 1})
    for m in _CLIENT.finditer(text):
        out.append({"fact": "api", "kind": "client", "method": m[1].upper(), "path": m[3], "confidence": 0.95, "start_line": text.count("\n", 0, m.start()) + 1})
    if language in ("javascript", "typescript"):
        out += _exports(text) + _relations(code, rows, language == "typescript") + _selectors(text, rows) + _endpoints(text)
    covered = {k for r in rows for k in range(r["start_line"], r["end_line"] + 1)}
    lines = text.split("\n")
    if any(x.strip() and k not in covered for k, x in enumerate(lines, 1)) or any(c.get("owner") == "<module>" for c in out):
        out.append({"fact": "symbol", "name": "<module>", "qualified_name": "<module>", "kind": "Module", "start_line": 1, "end_line": len(lines), "exported": True, "signature": "", "cyclomatic": 1, "cognitive": 0, "body": ""})
    return out


_IMPORTS = [
    re.compile(r"^\s*(?P<re>export|import)\s+(?:type\s+)?(?P<what>[^'\";]+?)\s+from\s+['\"](?P<s>[^'\"]+)['\"]", re.M),
    re.compile(r"^\s*import\s+['\"](?P<s>[^'\"]+)['\"]", re.M),
    re.compile(r"(?:const|let|var)\s+(?P<what>\{[^}]*\}|[A-Za-z_$][\w$]*)\s*=\s*require\(\s*['\"](?P<s>[^'\"]+)['\"]\s*\)"),
]
_OTHER_IMPORTS = re.compile(r"^\s*(?:use|using|import|#include|require|require_relative|include)\s+[\"'<(]*(?P<s>[\w./:*\\-]+)", re.M)


def _imports(text: str, language: str) -> list[dict]:
    out = []
    add = lambda s, kind, local=None, imported=None: out.append({"fact": "import", "specifier": s, "kind": kind, "local": local, "imported": imported})
    if language not in ("javascript", "typescript"):
        for m in _OTHER_IMPORTS.finditer(text):
            add(m["s"], "side-effect")
        return out
    for k, rule in enumerate(_IMPORTS):
        for m in rule.finditer(text):
            what = (m.groupdict().get("what") or "").strip()
            if not what:
                add(m["s"], "side-effect")
                continue
            again = m.groupdict().get("re") == "export"
            braces = re.search(r"\{([^}]*)\}", what)
            for part in (braces[1].split(",") if braces else ()):
                names = re.split(r"\s+as\s+|\s*:\s*", part.replace("type ", "").strip())
                if names[0]:
                    add(m["s"], "re-export" if again else "commonjs" if k == 2 else "named", names[-1], names[0])
            rest = re.sub(r"\{[^}]*\}", "", what).strip(" ,")
            if star := re.match(r"\*(?:\s+as\s+(\w+))?", rest):
                add(m["s"], "re-export-all" if again and not star[1] else "namespace", star[1] or "*", "*")
            elif rest:
                add(m["s"], "commonjs" if k == 2 else "default", rest.split(",")[0].strip(), "default")
    return out


_EXPORTS = [
    ("re-export-all", re.compile(r"^\s*export\s+\*\s+from\s+['\"](?P<s>[^'\"]+)['\"]", re.M)),
    ("re-export-namespace", re.compile(r"^\s*export\s+\*\s+as\s+(?P<n>\w+)\s+from\s+['\"](?P<s>[^'\"]+)['\"]", re.M)),
    ("local", re.compile(r"^\s*export\s+(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+(?P<n>[A-Za-z_$][\w$]*)", re.M)),
    ("default", re.compile(r"^\s*export\s+default\s+(?:async\s+)?(?:(?:function\s*\*?|class)\s+)?(?P<l>[A-Za-z_$][\w$]*)?", re.M)),
    ("commonjs-default", re.compile(r"^\s*module\.exports\s*=\s*(?P<l>[A-Za-z_$][\w$]*)", re.M)),
    ("commonjs-named", re.compile(r"^\s*(?:module\.)?exports\.(?P<n>[A-Za-z_$][\w$]*)\s*=\s*(?P<l>[A-Za-z_$][\w$]*)?", re.M)),
]
_EXPORT_LIST = re.compile(r"^\s*export\s+(?:type\s+)?\{([^}]*)\}(?:\s*from\s+['\"]([^'\"]+)['\"])?", re.M)


def _exports(text: str) -> list[dict]:
    """Exported names with their local names and, for re-exports, where they come from."""
    out = []
    for kind, rule in _EXPORTS:
        for m in rule.finditer(text):
            g = m.groupdict()
            name = g.get("n") or ("*" if kind == "re-export-all" else "default")
            out.append({"fact": "export", "kind": kind, "name": name, "local": g.get("l") or g.get("n"), "specifier": g.get("s")})
    for m in _EXPORT_LIST.finditer(text):
        for part in filter(None, (p.strip() for p in m[1].split(","))):
            names = re.split(r"\s+as\s+", part.removeprefix("type "))
            out.append({"fact": "export", "kind": "re-export" if m[2] else "alias" if len(names) > 1 else "local", "name": names[-1], "local": names[0], "specifier": m[2]})
    return out


_HERITAGE = re.compile(r"\b(class|interface)\s+([A-Za-z_$][\w$]*)[^{;]*?\{")
_TYPE_REFERENCE = re.compile(r"[:<|&,]\s*([A-Z][\w$]*(?:\.[A-Z][\w$]*)*)")


def _relations(code: str, rows: list[dict], types: bool) -> list[dict]:
    """extends, implements and interface-extends; type references in TypeScript."""
    out = []
    for m in _HERITAGE.finditer(code):
        head = re.sub(r"<[^<>]*>", "", m[0])
        for word, kind in (("extends", "interface-extends" if m[1] == "interface" else "extends"), ("implements", "implements")):
            found = re.search(rf"\b{word}\s+([\w$.,\s]+?)(?=\bimplements\b|\{{)", head)
            out += [{"fact": "relationship", "kind": kind, "owner": m[2], "name": n.strip(), "confidence": 0.99} for n in (found[1].split(",") if found else ()) if n.strip()]
    if types:
        pairs = set()
        for m in _TYPE_REFERENCE.finditer(code):
            inner = [r for r in rows if r["at"] <= m.start() < r["end"]]
            if inner:
                pairs.add((max(inner, key=lambda r: r["at"])["qualified_name"], m[1]))
        out += [{"fact": "relationship", "kind": "type-reference", "owner": o, "name": n, "confidence": 0.9} for o, n in sorted(pairs)]
    return out


_DATA_ATTRIBUTE = re.compile(r"\b(data-[\w-]+)\s*=\s*[{]?\s*['\"`]([^'\"`{}]*)['\"`]")
_SELECTOR_CALL = re.compile(r"\b(?:querySelector(?:All)?|closest|matches|locator)\s*\(\s*(['\"`])(.*?)\1\s*\)")


def _selectors(text: str, rows: list[dict]) -> list[dict]:
    """Elements with data attributes produce selectors; selector calls consume them."""

    def owner(at: int) -> str:
        inner = [r for r in rows if r["at"] <= at < r["end"]]
        return max(inner, key=lambda r: r["at"])["qualified_name"] if inner else "<module>"

    taken = [(m.start(), m.end()) for m in _SELECTOR_CALL.finditer(text)]
    out = [{"fact": "selector", "kind": "producer", "name": f"[{m[1]}={m[2]}]", "owner": owner(m.start()), "confidence": 0.95} for m in _DATA_ATTRIBUTE.finditer(text) if not any(a <= m.start() < z for a, z in taken)]
    for m in _SELECTOR_CALL.finditer(text):
        out += [{"fact": "selector", "kind": "consumer", "name": f"[{a}={v}]", "owner": owner(m.start()), "confidence": 0.95} for a, v in re.findall(r"\[(data-[\w-]+)=['\"]?([^'\"\]]+)['\"]?\]", m[2])]
    return out


_REGISTRY = re.compile(r"(?:^|[{,;])\s*(?:(?:const|let|var|export\s+const)\s+)?([A-Za-z_$][\w$]*)\s*[:=]\s*(['\"`])((?:https?://[^'\"`\s]+)|(?:/[\w:{}$./-]+))\2", re.M)


def _endpoints(text: str) -> list[dict]:
    """Literals that look like endpoints, kept in a registry or a variable: clients with any method."""
    return [{"fact": "api", "kind": "client", "method": "ANY", "path": m[3], "name": m[1], "confidence": 0.75, "start_line": text.count("\n", 0, m.start(1)) + 1} for m in _REGISTRY.finditer(text)]


_NEXT = re.compile(r"(?:^|/)(?:app/(?P<app>.*?)/?route\.[jt]sx?|pages/(?P<pages>api/.*?)(?:/index)?\.[jt]sx?)$")


def framework_path(file_path: str) -> str | None:
    """The route that a file's place means: app/**/route.* and pages/api/**; groups and slots don't count."""
    m = _NEXT.search(file_path)
    if not m:
        return None
    parts = [p for p in (m["app"] if m["app"] is not None else m["pages"]).split("/") if p and not (p.startswith("(") and p.endswith(")")) and not p.startswith("@")]
    return "/" + "/".join(parts)


class _Python(ast.NodeVisitor):
    def __init__(self, text: str):
        self.lines, self.rows, self.calls, self.stack = text.split("\n"), [], Counter(), []
        self.public: set[str] | None = None

    def _define(self, node, kind: str) -> None:
        path = [*(n for n, _ in self.stack), node.name]
        if kind == "Function" and self.stack and self.stack[-1][1] == "Class":
            kind = "Constructor" if node.name == "__init__" else "Method"
        exported = not self.stack and (node.name in self.public if self.public is not None else not node.name.startswith("_"))
        cyc, cog = python_complexity(node)
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        self.rows.append({"fact": "symbol", "name": node.name, "qualified_name": ".".join(path), "kind": kind, "start_line": first, "end_line": node.end_lineno, "exported": exported, "signature": " ".join(self.lines[node.lineno - 1].split())[:500], "cyclomatic": cyc, "cognitive": cog, "body": "\n".join(self.lines[first - 1 : node.end_lineno])})
        self.stack.append((node.name, "Class" if kind == "Class" else "Function"))
        self.generic_visit(node)
        self.stack.pop()

    def visit_FunctionDef(self, node):
        self._define(node, "Function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        owner = ".".join([*(n for n, _ in self.stack), node.name])
        self.rows += [{"fact": "relationship", "kind": "extends", "owner": owner, "name": ast.unparse(b), "confidence": 0.99} for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        self._define(node, "Class")

    def visit_Call(self, node):
        f = node.func
        name, qualifier = (f.id, None) if isinstance(f, ast.Name) else (f.attr, f.value.id if isinstance(f.value, ast.Name) else None) if isinstance(f, ast.Attribute) else (None, None)
        if name:
            self.calls[(".".join(n for n, _ in self.stack) or "<module>", name, qualifier)] += 1
        self.generic_visit(node)

    def visit_Import(self, node):
        for a in node.names:
            self.rows.append({"fact": "import", "specifier": a.name, "kind": "namespace", "local": a.asname or a.name.split(".")[0], "imported": "*"})

    def visit_ImportFrom(self, node):
        for a in node.names:
            self.rows.append({"fact": "import", "specifier": "." * node.level + (node.module or ""), "kind": "named" if a.name != "*" else "namespace", "local": a.asname or a.name, "imported": a.name})


def python_complexity(node: ast.AST) -> tuple[int, int]:
    """Cyclomatic and cognitive complexity of a definition, without the definitions inside it."""
    cyclomatic, cognitive = 1, 0

    def walk(n: ast.AST, depth: int) -> None:
        nonlocal cyclomatic, cognitive
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue
            d = depth
            if isinstance(c, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)):
                cyclomatic += 1
                cognitive += 1 + depth
                d = depth + 1
            elif isinstance(c, ast.BoolOp):
                cyclomatic += len(c.values) - 1
                cognitive += 1
            elif isinstance(c, (ast.Break, ast.Continue)):
                cognitive += 1
            elif isinstance(c, ast.comprehension):
                cyclomatic += 1 + len(c.ifs)
            walk(c, d)

    walk(node, 0)
    return cyclomatic, cognitive


def parse_python(text: str) -> list[dict]:
    tree = ast.parse(text)
    v = _Python(text)
    for n in tree.body:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
            v.public = {e.value for e in n.value.elts if isinstance(e, ast.Constant)}
    v.visit(tree)
    out = v.rows + [{"fact": "call", "owner": o, "callee": c, "qualifier": q, "occurrences": n} for (o, c, q), n in v.calls.items()]
    inside = {k for r in v.rows if r["fact"] == "symbol" for k in range(r["start_line"], r["end_line"] + 1)}
    if any(x.strip() and k not in inside for k, x in enumerate(v.lines, 1)):
        out.append({"fact": "symbol", "name": "<module>", "qualified_name": "<module>", "kind": "Module", "start_line": 1, "end_line": len(v.lines), "exported": True, "signature": "", "cyclomatic": 1, "cognitive": 0, "body": ""})
    return out


def facts_of(text: str | None, language: str) -> list[dict]:
    """All facts of one file, each with the parser's mode."""
    text = text or ""
    mode = "heuristic"
    if language == "python":
        try:
            rows, mode = parse_python(text), "python-ast"
        except (SyntaxError, ValueError, RecursionError):
            rows, mode = [{"fact": "diagnostic", "name": "syntax_error"}], "heuristic-fallback"
            for m in re.finditer(r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)", text, re.M):
                line = text.count("\n", 0, m.start()) + 1
                rows.append({"fact": "symbol", "name": m[3], "qualified_name": m[3], "kind": "Class" if m[2] == "class" else "Function", "start_line": line, "end_line": line, "exported": not m[1] and not m[3].startswith("_"), "signature": m[0].strip(), "cyclomatic": 1, "cognitive": 0, "body": ""})
    else:
        rows = scan_code(text, language)
    seen: Counter = Counter()
    for r in rows:
        if r["fact"] == "symbol":
            key = (r["qualified_name"], r["kind"])
            seen[key] += 1
            if seen[key] > 1:
                r["qualified_name"] += f"#{seen[key]}"
    return [r | {"mode": mode} for r in rows]


def extract(files: DataFrame) -> DataFrame:
    """Facts of (repo_id, file_path, language, content): one pass over the files, spread by size-bounded batches."""

    schema = to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = facts_of(text, lang)
                if route := framework_path(b):
                    verbs = [m for m in ("GET", "POST", "PUT", "PATCH", "DELETE") if any(r["fact"] == "symbol" and r["name"] == m for r in own)]
                    own += [{"fact": "api", "kind": "route", "method": m, "path": route, "name": m, "confidence": 0.95, "start_line": 1, "mode": "path"} for m in verbs or ["ANY"]]
                rows += [{"repo_id": a, "file_path": b} | r for r in own]
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in _COLUMNS} for r in rows], schema=schema)

    return files.select("repo_id", "file_path", "language", "content").mapInArrow(run, FACTS)


def stable_key() -> F.Column:
    return F.concat_ws(":", "file_path", "qualified_name", "kind")
