"""Documents of symbols and files: rendered from rows, parsed back, and given a section on the symbol's role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import first_filled

#: The English labels of symbol and file documents.
LABELS = {
    "doc_title_template": "{kind} Documentation: `{name}`",
    "basic_info_title": "## 1. Basic Information",
    "label_fqdn": "FQDN",
    "label_symbol_kind": "Symbol Kind",
    "label_location": "Location",
    "location_template": "Line {start} to Line {end}",
    "label_signature": "Signature / Type",
    "parameters_title": "## 2. Parameters",
    "label_none": "None",
    "input_return_title": "## 3. Input / Return Specifications",
    "label_input_constraints": "Input Constraints",
    "label_return_type": "Return Type",
    "label_return_value_side_effects": "Return Value & Side Effects",
    "label_void_none": "void / None",
    "called_functions_title": "## 4. Called Functions",
    "referencing_functions_title": "## 4. Referencing Functions",
    "source_code_snippet_title": "## Source Code Snippet",
    "file_doc_title_template": "File Documentation: `{path}`",
    "label_file_hash": "File SHA-256",
    "label_detected_symbols": "Detected Symbols",
    "symbol_list_title": "## Symbol List",
    "symbol_list_item_template": "- `{name}` ({kind}) [Lines: {line_range}]",
    "prose_referenced_by_template": "In the system architecture, it is referenced by {callers}.",
    "prose_root_entry_point": "It serves as the root entry point (system bootstrap and dispatcher).",
    "prose_implementation_overview_template": "Implementation overview: {overview}",
    "ui_role_title": "## UI & Interaction Role",
    "label_ui_type": "UI Type",
    "label_ui_interaction": "Interaction Specification",
}
KIND_LABELS = ("function", "class", "method", "variable", "struct", "enum", "interface", "constant", "type", "module")
#: Fixed values: (parts of a kind, purpose, sentence on its data), the last for all others.
PROSE = (
    (("var",), "Holds state data for `{name}`.", "It is read and written by referencing functions to share state."),
    (("enum", "const"), "Defines constant identifier `{name}`.", "It is referenced in conditional logic and status checks."),
    (("struct", "class", "type"), "Defines data model for `{name}`.", "It is passed via function arguments, returns, or member access."),
    ((), "Executes `{name}` operations.", "It accepts parameters and returns computed results."),
)
ROOTS = ("main", "app", "cli", "run")
#: What a symbol without a describer is said to be: (parts of a kind, purpose, inputs, outputs, overview).
STATIC = (
    (("enum", "const"), "Defines status code, constant, or enumeration `{name}`{in_parent}.", "None (constant definition).", "Constant `{signature}`.",
     "Enumeration and constant definition `{name}` referenced in conditional logic and status management."),
    (("field", "member"), "Defines field `{name}` ({signature}) {model} for data storage and transfer.", "Value supplied during initialization or assignment.",
     "Retained value `{signature}`.", "Property utilized {model} to manage state and pass structured data across functions."),
    (("typedef", "type"), "Defines data type or alias `{name}`.", "None (type definition).", "Type `{signature}`.",
     "Specification of data structure or type alias `{name}` used across modules."),
    (("struct", "class"), "Defines data model or structure `{name}`.", "Member field initialization parameters.", "Data structure `{signature}`.",
     "Encapsulates structured data fields for inter-module passing as `{name}`."),
    (("var",), "Holds state data for variable `{name}` ({signature}).", "Assigned state value.", "Retained value `{signature}`.",
     "Shared state data storage accessed and updated by processing functions as `{name}`."),
    (("fn", "func", "method"), "Executes `{name}` operations.", "According to parameter definitions.", "Result `{signature}`.",
     "Basic specification and role for `{name}`."),
    ((), "Defines `{name}` ({kind}).", "According to parameter definitions.", "Result `{signature}`.", "Basic specification and role for `{name}`."),
)


def _fill(template: str, **values: Column) -> Column:
    """The template with its {fields} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(values[field], F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _by_kind(kind: Column, table: tuple, value) -> Column:
    """value(row) of the first row of the table one of whose parts the kind contains; of the last row otherwise."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    out = value(table[-1])
    for row in reversed(table[:-1]):
        out = F.when(F.greatest(F.lit(False), F.lit(False), *[F.contains(k, F.lit(p)) for p in row[0]]), value(row)).otherwise(out)
    return out


def static_description(name: Column, kind: Column, signature: Column, fqdn: Column) -> dict[str, Column]:
    """purpose, inputs, outputs, overview from the kind and the names alone."""
    parts = F.split(fqdn, r"\.")
    parent = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))
    has = F.coalesce(parent, F.lit("")) != ""
    values = {
        "name": name, "kind": kind, "signature": first_filled(signature, name), "in_parent": F.when(has, F.concat(F.lit(" in `"), parent, F.lit("`"))).otherwise(""),
        "model": F.when(has, F.concat(F.lit("in data model `"), parent, F.lit("`"))).otherwise("in data structure"),
    }
    return {n: _by_kind(kind, STATIC, lambda row, i=i: _fill(row[i], **values)) for i, n in enumerate(("purpose", "inputs", "outputs", "overview"), 1)}


def kind_label(kind: Column) -> Column:
    """The kind with a capital; of several words the first alone has one."""
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1_000)))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _sentence(text: Column) -> Column:
    return F.concat(F.regexp_replace(text, "[。.]+$", ""), F.lit("."))


def symbol_section(s: dict[str, Column], level: int = 2, language: Column | str = "", labels: dict[str, str] | None = None) -> Column:
    """The document of a symbol. ``s`` has name, kind, fqdn, signature, line_start, line_end, purpose, context, overview,
    inputs, outputs, return_type, params and callees and callers (arrays), snippet."""
    lb = LABELS | (labels or {})
    shown = kind_label(s["kind"])
    role = first_filled(s["context"], s["purpose"], _by_kind(s["kind"], PROSE, lambda r: _fill(r[1], name=s["name"])))
    callers = F.coalesce(F.size(s["callers"]), F.lit(0)) > 0
    callees = F.coalesce(F.size(s["callees"]), F.lit(0)) > 0
    root = F.when(s["name"].isin(*ROOTS), lb["prose_root_entry_point"])
    used = F.when(callers, _fill(lb["prose_referenced_by_template"], callers=F.array_join(s["callers"], ", "))).otherwise(root)
    more = _filled(s["overview"]) & (s["overview"] != F.coalesce(s["purpose"], F.lit(""))) & (s["overview"] != role)
    prose = F.concat_ws(
        " ", _sentence(role), used, _by_kind(s["kind"], PROSE, lambda r: F.lit(r[2])), F.when(more, _fill(lb["prose_implementation_overview_template"], overview=s["overview"]))
    )
    item = lambda key, value: F.concat(F.lit(f"- **{lb[key]}**: "), value)
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    full = F.when(_filled(s["fqdn"]), F.concat(shown, F.lit(" (FQDN: `"), s["fqdn"], F.lit("`)"))).otherwise(shown)
    params = F.transform(s["params"], lambda p: F.concat(F.lit("- `"), F.regexp_extract(p, r"^[^:]*", 0), F.lit("`"), F.when(F.contains(p, F.lit(": ")), F.concat(F.lit(": `"), F.regexp_extract(p, r"(?s)^[^:]*: (.*)$", 1), F.lit("`"))).otherwise("")))
    none = F.lit(f"- {lb['label_none']}")
    io = F.concat_ws(
        "\n", F.lit("\n" + lb["input_return_title"]), F.when(_filled(s["inputs"]), F.concat(F.lit(f"- {lb['label_input_constraints']}: "), s["inputs"])),
        F.concat(F.lit(f"- {lb['label_return_type']}: `"), first_filled(s["return_type"], F.lit(lb["label_void_none"])), F.lit("`")),
        F.when(_filled(s["outputs"]), F.concat(F.lit(f"- {lb['label_return_value_side_effects']}: "), s["outputs"])),
    )
    links = F.when(callees, F.concat(F.lit("\n" + lb["called_functions_title"] + "\n"), F.array_join(F.transform(s["callees"], lambda c: F.concat(F.lit("- `"), c, F.lit("`"))), "\n")))
    links = links.when(callers, F.concat(F.lit("\n" + lb["referencing_functions_title"] + "\n"), F.array_join(F.transform(s["callers"], lambda c: F.concat(F.lit("- "), c)), "\n")))
    lang = F.lit(language) if isinstance(language, str) else F.coalesce(language, F.lit(""))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("#" * level + " "), _fill(lb["doc_title_template"], kind=shown, name=s["name"])), F.concat(F.lit("\n"), prose, F.lit("\n")), F.lit(lb["basic_info_title"]),
        item("label_fqdn", code(first_filled(s["fqdn"], s["name"]))), item("label_symbol_kind", code(full)),
        item("label_location", _fill(lb["location_template"], start=s["line_start"].cast("string"), end=s["line_end"].cast("string"))),
        F.when(_filled(s["signature"]), item("label_signature", code(s["signature"]))), F.lit("\n" + lb["parameters_title"]),
        F.when(F.coalesce(F.size(s["params"]), F.lit(0)) > 0, F.array_join(params, "\n")).otherwise(none),
        F.when(_filled(s["return_type"]) | _filled(s["inputs"]) | _filled(s["outputs"]), io), links,
        F.when(_filled(s["snippet"]), F.concat(F.lit("\n" + lb["source_code_snippet_title"] + "\n```"), lang, F.lit("\n"), s["snippet"], F.lit("\n```"))),
    )


def file_documents(symbols: DataFrame, hashes: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(rel_path, text): a file's hash, its list of symbols, then their sections, in order of ``ordinal``.

    symbols(rel_path, ordinal, depth, name, kind, line_start, line_end, section), hashes(rel_path, file_hash). The list and
    the count are of the outer symbols; a file's symbols are one document, so one row.
    """
    lb = LABELS | (labels or {})
    span = F.format_string("%d-%d", "line_start", "line_end")
    line = _fill(lb["symbol_list_item_template"], name=F.col("name"), kind=F.when(F.lower("kind").isin(*KIND_LABELS), kind_label(F.col("kind"))).otherwise(F.col("kind")), line_range=span)
    rows = symbols.select("rel_path", F.struct("ordinal", (F.col("depth") == 0).alias("outer"), line.alias("line"), "section").alias("s"))
    per_file = rows.groupBy("rel_path").agg(F.sort_array(F.collect_list("s")).alias("s"))
    every = hashes.join(per_file, "rel_path", "left")
    outer = F.filter("s", lambda x: x["outer"])
    n = F.when(F.col("s").isNull(), 0).otherwise(F.size(outer))
    listed = F.array_join(F.transform(outer, lambda x: x["line"]), "\n")
    sections = F.array_join(F.transform("s", lambda x: F.concat(x["section"], F.lit("\n"))), "\n")
    text = F.concat_ws(
        "\n", F.concat(F.lit("# "), _fill(lb["file_doc_title_template"], path=F.col("rel_path")), F.lit("\n")),
        F.concat(F.lit(f"- **{lb['label_file_hash']}**: `"), "file_hash", F.lit("`")), F.concat(F.lit(f"- **{lb['label_detected_symbols']}**: "), n.cast("string")),
        F.lit("\n" + lb["symbol_list_title"]), F.when(listed != "", listed), F.when(sections != "", F.concat(F.lit("\n"), sections)),
    )
    return every.select("rel_path", F.concat(F.btrim(text, F.lit("\n ")), F.lit("\n")).alias("text"))


def _either(*labels: str) -> str:
    """Alternation of distinct labels as literals."""
    return "|".join("\\Q" + x + "\\E" for x in dict.fromkeys(x for x in labels if x))


def _heading(label: str) -> str:
    return label.lstrip("#").strip().split(". ", 1)[-1] if label.lstrip("#").strip()[:1].isdigit() else label.lstrip("#").strip()


def parse_document(text: Column, labels: dict[str, str] | None = None) -> dict[str, Column]:
    """title, purpose, kind, signature, callees, callers, ui_role of a document, by the English and the given labels."""
    lb = LABELS | (labels or {})
    find = lambda pattern: F.btrim(F.regexp_extract(text, pattern, 1), F.lit(" \t\n\r"))
    bold = lambda *names: find(rf"(?i)- \*\*(?:{_either(*names)})[^*]*\*\*:\s*`?([^`\n]+)`?")
    body = lambda head: F.regexp_extract(text, rf"(?i){head}[^\n]*\n([\s\S]*?)(?=\n## |\z)", 1)
    numbered = lambda *names: body(rf"## \d+\.[^\n]*(?:{_either(*names)})")
    none = ["None", "none", LABELS["label_none"], lb["label_none"]]
    names = lambda c: F.filter(F.regexp_extract_all(c, F.lit("- `([^`]+)`"), F.lit(1)), lambda x: ~x.isin(*none))
    prose, legacy = find(r"\A(?:[\s\S]*?\n)?# [^\n]+\n+([^#\s][\s\S]*?)(?=\n## |\z)"), find(r"## 1\.[^\n]*\n([\s\S]*?)(?=\n## 2\.|\z)")
    return {
        "title": find(r"(?m)^# (.+)$"),
        "purpose": F.when(prose != "", prose).otherwise(legacy),
        "kind": bold("Symbol Kind", "Kind", lb["label_symbol_kind"]),
        "signature": bold("Signature", "Type", lb["label_signature"]),
        "callees": names(numbered(_heading(LABELS["called_functions_title"]), _heading(lb["called_functions_title"]))),
        "callers": names(numbered("Referencing Functions", "References", _heading(lb["referencing_functions_title"]))),
        "ui_role": F.btrim(body(rf"## [^\n]*(?:{_either(_heading(LABELS['ui_role_title']), 'UI・ユーザー操作における役割', _heading(lb['ui_role_title']))})"), F.lit(" \t\n\r")),
    }


def with_role(text: Column, ui_type: Column, framework: Column, role: Column, force: bool = False, labels: dict[str, str] | None = None) -> Column:
    """The document with a section on the symbol's role before its code, or at its end. A document that has one stays as it
    is; with ``force`` the section is made anew, so that doing it twice changes nothing."""
    lb = LABELS | (labels or {})
    heads = list(dict.fromkeys([lb["ui_role_title"], LABELS["ui_role_title"]]))
    bare = text
    for h in heads:
        bare = F.regexp_replace(bare, rf"\n*\Q{h}\E[\s\S]*?(?=\n## |\z)", "")
    has = F.greatest(F.lit(False), F.lit(False), *[F.contains(text, F.lit(h)) for h in heads])
    block = F.concat(
        F.lit(f"\n{lb['ui_role_title']}\n- **{lb['label_ui_type']}**: `"), ui_type, F.lit("` ("), framework, F.lit(f")\n- **{lb['label_ui_interaction']}**: "), role, F.lit("\n")
    )
    code = F.lit(lb["source_code_snippet_title"])
    code = F.when(F.contains(bare, code), code).otherwise(LABELS["source_code_snippet_title"])
    at = F.instr(bare, code)
    trim = lambda c: F.regexp_replace(c, r"(?U)\s+\z", "")
    new = F.when(at > 0, F.concat(trim(F.substring(bare, F.lit(1), at - 1)), F.lit("\n"), block, F.lit("\n"), F.substring(bare, at, F.length(bare)))).otherwise(F.concat(trim(bare), F.lit("\n"), block, F.lit("\n")))
    new = F.concat(F.regexp_replace(new, r"(?U)\A\s+|\s+\z", ""), F.lit("\n"))
    return new if force else F.when(has, text).otherwise(new)
