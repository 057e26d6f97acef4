"""Review rules from a small local file: JSON, or the plain part of YAML."""

from __future__ import annotations

import json
import os
import re

MOST_BYTES = 256 << 10
_KEYS = ("id", "contains", "severity", "message", "file", "case_sensitive")


def safe_path(root: str, path: str) -> str:
    """The path below root, refused where it is absolute, leads outside, is a link or has control characters."""
    if os.path.isabs(path) or ".." in path.replace("\\", "/").split("/") or re.search(r"[\x00-\x1f]", path):
        raise ValueError(f"unsafe path {path!r}")
    full = os.path.join(root, path)
    if os.path.islink(full):
        raise ValueError(f"{path} is a link")
    return full


def load(root: str, path: str) -> list[dict]:
    full = safe_path(root, path)
    if os.path.getsize(full) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    with open(full, encoding="utf-8") as f:
        return parse(f.read())


def parse(text: str) -> list[dict]:
    """Checked rules; each needs an id and the literal that it looks for."""
    if text.lstrip()[:1] in "[{":
        data = json.loads(text)
        rules = data["rules"] if isinstance(data, dict) else data
    else:
        rules = _yaml(text)
    for r in rules:
        if unknown := set(r) - set(_KEYS):
            raise ValueError(f"unknown keys {sorted(unknown)}")
        if not r.get("id") or not r.get("contains"):
            raise ValueError("a rule needs id and contains")
    if len({r["id"] for r in rules}) < len(rules):
        raise ValueError("rule ids repeat")
    return rules


def _yaml(text: str) -> list[dict]:
    """A list of flat mappings, under `rules:` or alone."""
    out: list[dict] = []
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line or line.strip() == "rules:":
            continue
        m = re.match(r"^\s*(-\s+)?(\w+):\s*(.*)$", line)
        if not m:
            raise ValueError(f"can't read {line!r}")
        if m[1]:
            out.append({})
        elif not out:
            raise ValueError(f"no rule begins before {line!r}")
        value = m[3].strip()
        out[-1][m[2]] = {"true": True, "false": False}.get(value, value[1:-1] if value[:1] in "'\"" and value[:1] == value[-1:] else value)
    return out
