"""Symbols of brace languages (C, C++, Java, Kotlin, Rust) by their heads and braces, without a compiler.

Comments and strings are blanked, then the text is read once: what stands before a brace, a semicolon or, in Kotlin, the
end of a line is a head; its words tell types, functions and fields. Heads inside functions are part of the function.
Macros that hide braces and old C definitions are not understood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.sources.symbols import SCHEMA

LANGUAGES = ("c", "cpp", "java", "kotlin", "rust")
_HIDDEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_TYPE = re.compile(r"\b(enum\s+class|data\s+class|companion\s+object|class|interface|enum|struct|union|trait|object|record|namespace|impl)\b\s*(?:<[^>]*>\s*)?([A-Za-z_]\w*)?")
_CALL = re.compile(r"([A-Za-z_~]\w*)\s*\(")
_FUNCTION = re.compile(r"([A-Za-z_~][\w:~]*)\s*\(((?:[^()]|\([^()]*\))*)\)")
_KOTLIN = re.compile(r"\b(fun|val|var|constructor)\b\s*(?:<[^>]*>\s*)?(?:[\w?]+\.)?([A-Za-z_]\w*)?")
_RUST = re.compile(r"\bfn\s+([A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*\(([^()]*)\)(?:\s*->\s*([^{;]+))?")
_FIELD = re.compile(r"^(?:@\w+(?:\([^)]*\))?\s*)*((?:[\w<>,.?*&:\[\]]+\s+)+[*&]*)([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*(?:=.*)?$", re.S)
_WORDS = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "synchronized", "when", "sizeof", "new", "throw", "match", "loop", "super", "this", "init", "get", "set", "defined"}
_NO_FIELD = {"return", "import", "package", "using", "typedef", "goto", "break", "continue", "throw", "use", "mod", "extern", "template", "friend", "case", "else"}
_KINDS = {"enum class": "enum", "data class": "class", "record": "class", "trait": "interface", "impl": "impl", "companion object": "object"}


def blanked(text: str) -> str:
    """The text with comments and literals as blanks, of the same length and lines."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _split(params: str) -> list[str]:
    out, depth, last = [], 0, ""
    for c in params:
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            out.append(last)
            last = ""
        else:
            last += c
    return [" ".join(x.split()) for x in [*out, last] if x.strip() and x.strip() != "void"]


def _doc(text: str, at: int) -> str:
    """The comment that ends right before a place, without its marks."""
    before = text[:at].rstrip()
    if before.endswith("*/"):
        body = before[before.rfind("/*") :]
        lines = [re.sub(r"^/?\*+/?|\*/$", "", x.strip()).strip() for x in body.splitlines()]
    else:
        lines = []
        for x in reversed(before.splitlines()):
            if not x.strip().startswith("//"):
                break
            lines.insert(0, x.strip().lstrip("/").strip())
    return "\n".join(x for x in lines if x and x != "/")


def _read(head: str, language: str, scope: list[tuple[str, str]]) -> tuple | None:
    """(kind, name, params, return type) that a head declares; None if it declares nothing."""
    owner = scope[-1][0] if scope else ""
    types = [m for m in _TYPE.finditer(head) if "(" not in head[: m.start()]]
    if types and types[0].group(1) not in ("namespace", "impl") or types and head.rstrip().endswith(types[0].group(2) or ""):
        kind = " ".join(types[0].group(1).split())
        name = types[0].group(2) or ("Companion" if kind == "companion object" else "")
        if name and not _FUNCTION.search(head[: types[0].start()]):
            return _KINDS.get(kind, kind), name, [], ""
    if language == "rust":
        m = _RUST.search(head)
        return ("method" if owner else "function", m.group(1), _split(m.group(2)), (m.group(3) or "").strip()) if m else None
    if language == "kotlin":
        m = _KOTLIN.search(head)
        if not m or not (m.group(2) or m.group(1) == "constructor"):
            return None
        if m.group(1) in ("val", "var"):
            return "field" if owner else "variable", m.group(2), [], (re.findall(r":\s*([\w<>?., ]+)", head) or [""])[0].strip()
        params = re.search(r"\(((?:[^()]|\([^()]*\))*)\)", head[m.start() :])
        returns = re.search(r"\)\s*:\s*([\w<>?., ]+)", head[m.start() :])
        kind = "constructor" if m.group(1) == "constructor" else "method" if owner else "function"
        name = m.group(2) or (scope[-1][1] if scope else "constructor")
        return kind, name, _split(params.group(1)) if params else [], returns.group(1).strip() if returns and kind != "constructor" else ""
    m = next((x for x in _FUNCTION.finditer(head) if x.group(1).split("::")[-1] not in _WORDS), None)
    if m and "=" not in head[: m.start()]:
        name = m.group(1).split("::")[-1]
        returns = re.sub(r"@\w+(?:\([^)]*\))?\s*|\b(public|private|protected|static|final|inline|virtual|abstract|extern|override)\b\s*", "", head[: m.start()]).strip()
        if not returns and not (owner and name.strip("~") == scope[-1][1]) and "::" not in m.group(1):
            return None
        kind = ("destructor" if name.startswith("~") else "constructor") if owner and name.strip("~") == scope[-1][1] else "method" if owner or "::" in m.group(1) else "function"
        return kind, name, _split(m.group(2)), "" if kind.endswith("structor") else returns
    return None


def _field(head: str, scope: list[tuple[str, str]]) -> tuple | None:
    m = _FIELD.match(head.strip())
    if not m or m.group(1).split()[0] in _NO_FIELD or "(" in head.split("=")[0]:
        return None
    return "field" if scope else "variable", m.group(2), [], " ".join(m.group(1).split())


def brace_rows(rel_path: str, language: str, content: str | None) -> list[dict]:
    """Symbols of one file in the order in which they begin."""
    text = content or ""
    bare = blanked(text)
    if language in ("c", "cpp"):
        bare = re.sub(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m.group()), bare, flags=re.M)
    module = (rel_path.rpartition(".")[0] or rel_path).replace("/", ".")
    rows: list[dict] = []
    #: Open braces: (kind of symbol or "" for other blocks, name, its row, place).
    stack: list[tuple[str, str, dict | None, int]] = []
    head_at, parens = 0, 0

    def scope() -> list[tuple[str, str]]:
        return [(k, n) for k, n, _, _ in stack if k]

    def in_body() -> bool:
        return any(k in ("function", "method", "constructor", "destructor", "") for k, *_ in stack)

    def add(found: tuple, start: int, end: int) -> dict:
        kind, name, params, returns = found
        outer = "".join(f"{n}." for k, n in scope())
        head = " ".join(text[start:end].split())
        row = {
            "rel_path": rel_path, "ordinal": len(rows), "scope": outer, "name": name, "kind": kind, "line_start": bare.count("\n", 0, start) + 1,
            "line_end": bare.count("\n", 0, end) + 1, "fqdn": f"{module}.{outer}{name}", "signature": head, "doc": _doc(text, start), "return_type": returns, "callees": [], "params": params,
        }
        rows.append(row)
        return row

    def declared(found: tuple, head: str, start: int, end: int) -> None:
        row = add(found, start, end)
        if language == "kotlin" and "=" in head:
            row["callees"] = sorted({x for x in _CALL.findall(head.split("=", 1)[1]) if x not in _WORDS})

    for at, c in enumerate(bare):
        if c in "()":
            parens += 1 if c == "(" else -1
            continue
        newline = c == "\n" and language == "kotlin"
        if parens > 0 and c != "{" or c not in "{};" and not newline:
            continue
        head = bare[head_at:at]
        start = head_at + len(head) - len(head.lstrip())
        if newline and (not head.strip() or re.search(r"[=,(:.]\s*$", head) or re.match(r"\s*@\w+\s*$", head)):
            continue
        if c == "{":
            found = None if in_body() or parens > 0 else _read(head, language, scope())
            row = add(found, start, at) if found else None
            transparent = not found and re.search(r"\b(namespace|extern|impl)\b", head) and not in_body()
            stack.append(("namespace" if transparent else found[0] if found else "", found[1] if found else (re.findall(r"\w+", head) or [""])[-1], row, at))
        elif c == "}":
            if language == "kotlin" and head.strip() and not in_body() and (found := _read(head, language, scope())):
                declared(found, head, start, at)
            if stack:
                _, _, row, opened = stack.pop()
                if row:
                    row["line_end"] = bare.count("\n", 0, at) + 1
                    if row["kind"] in ("function", "method", "constructor", "destructor"):
                        row["callees"] = sorted({x for x in _CALL.findall(bare[opened + 1 : at]) if x not in _WORDS})
            parens = 0
        elif not in_body() and head.strip():
            found = _read(head, language, scope()) if language == "kotlin" or stack and language in ("java", "rust") else None
            found = found or (_field(head, scope()) if language != "kotlin" else None)
            if found:
                declared(found, head, start, at)
        head_at = at + 1
    return rows


def brace_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files(rel_path, language, content) in these languages, file by file on the executors."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, lang, text in zip(batch.rel_path, batch.language, batch.content, strict=True) for r in brace_rows(p, lang, text)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("rel_path", "language", "content").mapInPandas(parse, SCHEMA)
