"""Line slices and JSON objects in noisy text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snippet(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (1-based, inclusive), clamped to the text; empty if none is left, null for a null text."""
    lines = F.split(text, "\n")
    lo, hi = F.greatest(first, F.lit(1)), F.least(last, F.size(lines))
    return F.when(text.isNotNull(), F.when(hi >= lo, F.array_join(F.slice(lines, lo, F.greatest(hi - lo + 1, F.lit(0))), "\n")).otherwise(""))


#: What a text cut off in transfer may lack.
ENDINGS = ("}", '"}', '"}}', '"\n}')
#: The names that stand for each key, in order.
KEY_NAMES = {
    "purpose": ("purpose", "目的", "設計意図", "意図", "description", "target", "機能"),
    "inputs": ("inputs", "入力", "引数", "パラメータ", "input", "arguments", "parameters"),
    "outputs": ("outputs", "出力", "戻り値", "返り値", "output", "returns", "result"),
    "overview": ("overview", "概要", "要約", "説明", "summary", "details"),
    "role": ("role", "役割", "significance", "重要性", "意義"),
    "significance": ("role", "役割", "significance", "重要性", "意義"),
    "usage_scenario": ("usage_scenario", "利用シナリオ", "使用シナリオ", "データフロー", "データ受け渡し", "scenario"),
    "top_down_summary": ("top_down_summary", "要約", "概要", "全体設計要約", "summary"),
}


def standard_keys(text: Column) -> Column:
    """Map of the standard keys of a JSON object, each the first of its names that has a value, trimmed; others are left out."""
    values = F.from_json(text, "map<string,string>")
    pairs = []
    for key, names in KEY_NAMES.items():
        found = F.coalesce(*[F.when(F.try_element_at(values, F.lit(n)) != "", F.btrim(F.try_element_at(values, F.lit(n)))) for n in names])
        pairs.append(F.struct(F.lit(key).alias("key"), found.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def json_object(text: Column) -> Column:
    """The first of these that is a valid JSON object, as text; null if none is: the body of a fenced block, the span of
    the outermost braces, or what follows the first brace closed in one of four ways (texts cut off in transfer)."""
    fenced = F.btrim(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    cut = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"(?s)\{.*", 0), r"\s+$", ""), r"\s*```*$", "")
    tries = [fenced, braces, *[F.concat(cut, F.lit(end)) for end in ENDINGS]]
    return F.coalesce(*[F.when(c.startswith("{") & F.try_parse_json(c).isNotNull(), c) for c in tries])

