"""Declarations of brace and `end` languages, read from a stream of tokens by a small grammar for each language.

A statement is a run of modifiers, then an introducing keyword with a name, a binding to a
function, or a name with parameters and a body.  Brackets are matched once for the whole
text, so a declaration's end is a look-up.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(r"[A-Za-z_$#][\w$]*[?!]?|\d[\w.]*|=>|->|::|[^\s\w]")
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Tokens after which, or before which, a declaration's head goes on in the next line.
_GOES_ON = frozenset("= => -> , : :: ( [ | & + < . extends implements where throws".split())
_JOINS = frozenset("{ . => -> = | & ) ] extends implements where throws :".split())


@dataclass(frozen=True)
class Grammar:
    """What introduces a declaration, what may stand before it, and which forms have no keyword."""

    introducers: dict[str, str]
    modifiers: frozenset = frozenset()
    exports: frozenset = frozenset()
    bindings: frozenset = frozenset()  # `const f = () => ...`
    methods: str = ""  # "bare": name(...) {, "typed": type name(...) {
    ends: bool = False  # blocks end with `end`, not with a brace
    upper_is_public: bool = False
    shapes: dict[str, str] = field(default_factory=dict)  # `type Name <word>`: the word decides


_CURLY = Grammar(
    {
        "class": "Class", "interface": "Interface", "protocol": "Interface", "enum": "Enum", "record": "Record",
        "struct": "Struct", "trait": "Trait", "fun": "Function", "func": "Function", "function": "Function",
    },
    frozenset(
        "public private protected internal static final abstract sealed open data partial override suspend virtual async inline "
        "const unsigned synchronized readonly extern fileprivate mutating".split()
    ),
    frozenset(("public", "open")), methods="typed",
)
_SCRIPT = Grammar(
    {"function": "Function", "class": "Class", "interface": "Interface", "enum": "Enum", "type": "TypeAlias"},
    frozenset("export default async abstract declare public private protected static get set readonly override".split()),
    frozenset(("export",)), frozenset(("const", "let", "var")), methods="bare",
)
GRAMMARS = {
    "javascript": _SCRIPT, "typescript": _SCRIPT,
    "go": Grammar({"func": "Function", "type": ""}, upper_is_public=True, shapes={"struct": "Struct", "interface": "Interface"}),
    "rust": Grammar({"fn": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait"}, frozenset("pub async unsafe const extern".split()), frozenset(("pub",))),
    "ruby": Grammar({"def": "Method", "class": "Class", "module": "Module"}, ends=True),
} | dict.fromkeys(("java", "csharp", "kotlin", "swift", "c", "cpp", "php"), _CURLY)


class Stream:
    """The tokens of a text, which of them begin a line or a statement, and each bracket's partner."""

    def __init__(self, code: str):
        self.code = code
        found = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(code)]
        self.text = [t for t, _, _ in found]
        self.start = [a for _, a, _ in found]
        self.end = [z for _, _, z in found]
        self.fresh = [k == 0 or "\n" in code[self.end[k - 1] : self.start[k]] for k in range(len(found))]
        self.partner: dict[int, int] = {}
        waiting: list[int] = []
        for k, t in enumerate(self.text):
            if t in _OPENS:
                waiting.append(k)
            elif t in _CLOSES:
                while waiting and _OPENS[self.text[waiting[-1]]] != t:
                    waiting.pop()
                if waiting:
                    self.partner[waiting.pop()] = k

    def __len__(self) -> int:
        return len(self.text)

    def at(self, k: int) -> str:
        return self.text[k] if 0 <= k < len(self.text) else ""

    def begins(self, k: int) -> bool:
        return self.fresh[k] or self.at(k - 1) in ("{", "}", ";")

    def past(self, k: int) -> int:
        """The token after the bracket group at k; k + 1 where the bracket stays open."""
        return self.partner.get(k, k) + 1

    def is_name(self, k: int) -> bool:
        t = self.at(k)
        return bool(t) and (t[0].isalpha() or t[0] in "_$#")

    def block(self, k: int) -> tuple[int, bool]:
        """(offset behind the declaration whose head goes on at k, whether it has a block)."""
        while k < len(self):
            t = self.at(k)
            if t == "{":
                return (self.end[self.partner[k]] if k in self.partner else len(self.code)), True
            if t == ";" or t in _CLOSES:
                return (self.end[k] if t == ";" else self.end[k - 1]), False
            if self.fresh[k] and t not in _JOINS and self.at(k - 1) not in _GOES_ON:
                return self.end[k - 1], False
            k = self.past(k) if t in ("(", "[") else k + 1
        return len(self.code), False


def declarations(code: str, language: str, no_names: frozenset) -> list[dict]:
    """(name, kind, at, name_at, end, exported) of the declarations in code whose strings and comments are blank."""
    grammar = GRAMMARS.get(language)
    if grammar is None:
        return []
    s, out = Stream(code), {}
    for k in range(len(s)):
        if not s.begins(k):
            continue
        got = _declaration(s, k, grammar)
        if got is None:
            continue
        kind, name, end, exported = got
        if s.at(name) in no_names or name in out:
            continue
        exported = exported or grammar.upper_is_public and s.at(name)[:1].isupper()
        out[name] = {"name": s.at(name), "kind": kind, "at": s.start[k], "name_at": s.start[name], "end": end, "exported": exported}
    return list(out.values())


def _declaration(s: Stream, first: int, g: Grammar) -> tuple[str, int, int, bool] | None:
    """(kind, place of the name, end, exported) of the statement at token `first`, if it declares something."""
    k, exported = first, False
    while s.at(k) in g.modifiers and (s.is_name(k + 1) or s.at(k + 1) in ("(", "*")) and not (s.at(k + 1) == "(" and s.at(k) != "pub"):
        exported |= s.at(k) in g.exports
        k = s.past(k + 1) if s.at(k + 1) == "(" else k + 1
    word = s.at(k)
    if word in g.bindings and s.at(k + 1) in g.introducers:  # `const enum`
        k, word = k + 1, s.at(k + 1)
    if word in g.introducers:
        return _introduced(s, k, g, exported)
    if word in g.bindings:
        return _bound(s, k, exported)
    if g.methods == "bare" and s.is_name(k) and s.at(k + 1) == "(":
        end, block = s.block(s.past(k + 1))
        return ("Method", k, end, exported) if block and k + 1 in s.partner else None
    return _typed(s, k, k > first, exported) if g.methods == "typed" else None


def _introduced(s: Stream, k: int, g: Grammar, exported: bool):
    kind, name = g.introducers[s.at(k)], k + 1
    while s.at(name) in ("*", "class"):  # a generator, `enum class`
        name += 1
    if kind == "Function" and s.at(name) == "(" and g.upper_is_public:  # a receiver
        kind, name = "Method", s.past(name)
    if g.ends:
        if s.at(name) == "self" and s.at(name + 1) == ".":
            name += 2
        return (kind, name, _ruby_end(s, k), exported) if s.is_name(name) and (kind == "Method" or s.at(name)[:1].isupper()) else None
    if not s.is_name(name):
        return None
    if g.shapes:
        kind = kind or g.shapes.get(s.at(name + 1), "")
    if kind == "TypeAlias" and not _reaches(s, name + 1, "="):
        return None
    if kind == "Function" and g.bindings and s.at(name + 1) not in ("(", "<"):
        return None
    return (kind, name, s.block(name + 1)[0], exported) if kind else None


def _reaches(s: Stream, k: int, mark: str) -> bool:
    """Whether the head at k comes to a mark before its statement ends."""
    while k < len(s) and s.at(k) not in (";", "}") and not (s.fresh[k] and s.at(k) not in _JOINS and s.at(k - 1) not in _GOES_ON):
        if s.at(k) == mark:
            return True
        k = s.past(k) if s.at(k) in _OPENS else k + 1
    return False


def _bound(s: Stream, k: int, exported: bool):
    """A name bound to a function, or an exported constant in upper case."""
    name, v = k + 1, k + 2
    if not s.is_name(name):
        return None
    while v < len(s) and s.at(v) not in ("=", ";", "{", "}"):
        v = s.past(v) if s.at(v) in _OPENS else v + 1
    if s.at(v) != "=":
        return None
    v += 2 if s.at(v + 1) == "async" and s.at(v + 2) != "=>" else 1
    arrow = s.past(v) if s.at(v) == "(" else v + 1
    if s.at(v) == "(" and s.at(arrow) == ":":
        while arrow < len(s) and s.at(arrow) not in ("=>", ";", "{"):
            arrow += 1
    if s.at(v) == "function" or (s.at(v) == "(" or s.is_name(v)) and s.at(arrow) == "=>":
        return "Function", name, s.block(v)[0], exported
    if exported and s.at(k) == "const" and re.fullmatch(r"[A-Z][A-Z0-9_]+", s.at(name)):
        return "Constant", name, s.block(v)[0], exported
    return None


def _typed(s: Stream, k: int, modified: bool, exported: bool):
    """A type, a name, parameters and a block; a constructor has modifiers and no type."""
    if modified and s.is_name(k) and s.at(k + 1) == "(":
        end, block = s.block(s.past(k + 1))
        return ("Constructor", k, end, exported) if block and k + 1 in s.partner else None
    name, depth = k, 0
    while name < len(s) and (s.is_name(name) or s.at(name) in ("<", ">", ",", "::", "*", "&", "?", "[", "]", ":")):
        depth += {"<": 1, ">": -1}.get(s.at(name), 0)
        if s.at(name + 1) == "(" and depth <= 0:
            break
        name += 1
    if name <= k or not s.is_name(name) or s.at(name + 1) != "(" or name + 1 not in s.partner or s.at(k) in ("return", "new", "else", "throw"):
        return None
    end, block = s.block(s.past(name + 1))
    return ("Method", name, end, exported) if block else None


def _ruby_end(s: Stream, k: int) -> int:
    """Behind the `end` that stands as far in as the keyword at k, else behind the line."""
    code, at = s.code, s.start[k]
    column = at - code.rfind("\n", 0, at) - 1
    for j in range(bisect_right(s.start, at), len(s)):
        if s.at(j) == "end" and s.fresh[j] and s.start[j] - code.rfind("\n", 0, s.start[j]) - 1 == column:
            return s.end[j]
    stop = code.find("\n", at)
    return stop if stop >= 0 else len(code)
