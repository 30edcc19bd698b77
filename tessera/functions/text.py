"""Column -> Column text functions: kinds, locations, tokens, similarity, normal forms and hashes."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kinds by prefix.
KINDS = {
    "fn": ("function", "async_function", "method", "constructor", "destructor"),
    "var": ("variable", "var"),
    "type": ("struct", "class", "enum", "interface", "annotation", "object", "typedef", "type_alias", "type", "field", "member", "property"),
    "const": ("enum_constant", "constant", "macro", "const"),
}
#: Fixed value: the punctuation that separates tokens, white space included.
PUNCTUATION = r"(?U)[.,。、:：;；!?！？\-_()（）「」『』`\"'\[\]{}*#>|/\\\s]+"
#: Fixed value: what a normal specification text leaves out.
SPEC_PUNCTUATION = r"(?U)[\s.,。、:：\-_()（）「」『』`\"']"
#: Tokens that count as a branch.
BRANCHES = (
    "if", "elif", "else", "for", "while", "switch", "case", "catch", "except", "try", "match", "when",
    "guard", "yield", "async", "await", "return", "break", "continue",
)
BRANCH_SIGNS = ("&&", "||", "?", "=>")
#: Likeness from which two texts say the same, and two contracts.
SAME, SAME_CONTRACT = 0.85, 0.5
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def kind_prefix(kind: Column) -> Column:
    """fn, var, type, const or sym; null kinds are sym."""
    out = F.lit("sym")
    for prefix, names in KINDS.items():
        out = F.when(F.lower(kind).isin(*names), prefix).otherwise(out)
    return out


def location(name: Column, path: Column, start: Column, end: Column) -> Column:
    """``name (file:from:to)``; a missing end repeats the start, without lines only the file, without file the name."""
    lines = F.concat(F.lit(":"), start.cast("string"), F.lit(":"), F.coalesce(end, start).cast("string"))
    return F.when(path.isNull() | (path == ""), name).otherwise(F.concat(name, F.lit(" ("), path, F.coalesce(lines, F.lit("")), F.lit(")")))


def tokens(text: Column) -> Column:
    """Set of words and of 2-grams over the text without spaces; a one-character text has only its word."""
    clean = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " "))
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    letters = F.split(F.replace(clean, F.lit(" "), F.lit("")), "")
    n = F.size(letters) - 1
    grams = F.zip_with(F.slice(letters, F.lit(1), F.greatest(n, F.lit(0))), F.slice(letters, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.concat(words, grams))


def similarity(a: Column, b: Column) -> Column:
    """Of two token sets: the larger of Jaccard and overlap * (0.5 + 0.5 * size ratio); both empty 1, one empty 0."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    overlap = F.try_divide(inter, low) * (0.5 + 0.5 * F.try_divide(low, high))
    jaccard = F.try_divide(inter, F.size(F.array_union(a, b)))
    return F.when(high == 0, 1.0).when(low == 0, 0.0).otherwise(F.greatest(jaccard, overlap))


def alike(a: Column, b: Column) -> Column:
    """Likeness of two texts; null counts as empty."""
    return similarity(tokens(a), tokens(b))


def says_the_same(a: Column, b: Column, least: float = SAME) -> Column:
    return alike(a, b) >= least


def normal_spec(text: Column) -> Column:
    """Lower-cased without spaces and punctuation, for comparing specifications; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPEC_PUNCTUATION, "")


_LITERALS = r"'(?:\\[^\n]|[^\\'])*'|\"(?:\\[^\n]|[^\\\"])*\""


def strip_c_comments(code: Column) -> Column:
    """Code with a space for each // or /* */ comment, string literals kept; lines trimmed, blank ones dropped."""
    parts = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(rf"(?s)//[^\n]*|/\*.*?\*/|{_LITERALS}|[^'\"/]+|."), F.lit(0))
    bare = F.transform(parts, lambda p: F.when(p.rlike(r"^/[/*]"), F.lit(" ")).otherwise(p))
    return _lines(F.array_join(bare, ""))


def strip_hash_comments(code: Column) -> Column:
    """Code with a space for each # comment; string literals kept, triple-quoted ones too; lines trimmed, blank ones dropped."""
    triple = r"\"\"\".*?\"\"\"|'''.*?'''"
    parts = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(rf"(?s)#[^\n]*|{triple}|{_LITERALS}|[^'\"#]+|."), F.lit(0))
    return _lines(F.array_join(F.transform(parts, lambda p: F.when(p.startswith("#"), F.lit(" ")).otherwise(p)), ""))


def _lines(code: Column) -> Column:
    lines = F.transform(F.split(code, LINE_ENDS), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


@F.pandas_udf(StringType())
def _python_logic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Source of the syntax tree, which has no comments; null where the text is not valid Python."""

    def one(code):
        try:
            return ast.unparse(ast.parse(code or "")).strip()
        except (SyntaxError, ValueError, RecursionError):
            return None

    for codes in parts:
        yield codes.map(one)


def dedent(code: Column) -> Column:
    """The code without the indent of its first line, so that a method stands for itself."""
    indent = F.regexp_extract(code, r"^[ \t]*", 0)
    return F.when(indent == "", code).otherwise(F.regexp_replace(code, F.concat(F.lit("(?m)^"), indent), F.lit("")))


def strip_python_comments(code: Column) -> Column:
    """By the syntax tree; text that is not valid Python loses its # comments."""
    return F.coalesce(_python_logic(code), strip_hash_comments(code))


def symbol_hash(signature: Column, doc: Column, code: Column) -> Column:
    """SHA-256 of signature, doc and code."""
    return _sha(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (signature, doc, code)]))


def logic_hash(signature: Column, stripped: Column) -> Column:
    """SHA-256 of the signature and the code without comments."""
    return _sha(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (signature, stripped)]))


def _sha(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), 256)


def count_lines(text: Column) -> Column:
    """Lines of a text; an end of line at the very end begins no further one."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS)))


def complexity(code: Column, callees: Column, params: Column) -> Column:
    """max(1, 1 + .5 branches + .3 callees + .2 parameters + .05 lines); without code 1."""
    signs = "|".join("".join("\\" + c for c in s) for s in BRANCH_SIGNS)
    branches = F.regexp_count(code, F.lit(rf"\b(?:{'|'.join(BRANCHES)})\b|{signs}"))
    value = F.greatest(F.lit(1.0), 1 + 0.5 * branches + 0.3 * callees + 0.2 * params + 0.05 * count_lines(code))
    return F.when(F.coalesce(code, F.lit("")) == "", 1.0).otherwise(value)


def list_to_json(items: Column) -> Column:
    return F.coalesce(F.to_json(items), F.lit("[]"))


def list_from_json(text: Column) -> Column:
    """A JSON list of strings; bad or missing input gives the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def first_filled(*cols: Column) -> Column:
    """The first of the texts that is neither null nor empty; else empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))
