"""Registered queries over markup files made from the tables, each beside the rows that they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import markup
from lodestone.plans.catalog import query
from lodestone.sources.views import table

XAML = '<Window x:Class="App.W#" xmlns:x="x">\n<!-- <Button x:Name="no"/> -->\n<Window.Resources><Style x:Key="s#"/></Window.Resources>\n<Button x:Name="b#" Click="On#" Style="{StaticResource s#}"/>\n<TextBlock Text="{Binding Path=Name#, Mode=OneWay}"/>\n<ResourceDictionary Source="d#.xaml"/>\n</Window>'
RESX = '<root>\n<data name="k#" type="T#"><value>x</value></data>\n<data name="f#" type="System.Resources.ResXFileRef"><value>img\\\\p#.png;T</value></data>\n<metadata name="m#"/>\n</root>'
TEMPLATE = "{* {include file='no.tpl'} *}{extends file='base#.tpl'}\n{block name=b#}\n{include './part#.tpl'}\n{call name=f#}{call g#}\n{/block}\n{function name=f#}x{/function}\n<script src='../js/s#.js'></script>"
#: What these texts say: (entity, kind, name, qualified name or origin, parent, first line, last line, target, confidence); @ stands for the path.
ROWS = {
    "xaml": (
        ("symbol", "xaml_document", "@", "@", None, 1, 7, None, 0.9), ("symbol", "xaml_resource", "s#", "@::s#", "@", 3, 3, None, 0.85), ("symbol", "xaml_named", "b#", "@::b#", "@", 4, 4, None, 0.85), ("symbol", "xaml_element", "TextBlock", "@::TextBlock", "@", 5, 5, None, 0.85),
        ("relation", "references", None, "@", None, None, None, "App.W#", 0.9), ("relation", "contains", None, "@", None, None, None, "@::s#", 0.9), ("relation", "contains", None, "@", None, None, None, "@::b#", 0.9), ("relation", "contains", None, "@", None, None, None, "@::TextBlock", 0.9),
        ("relation", "references", None, "@::b#", None, None, None, "On#", 0.8), ("relation", "references", None, "@::b#", None, None, None, "@::s#", 0.7), ("relation", "references", None, "@::TextBlock", None, None, None, "Name#", 0.65), ("relation", "imports", None, "@", None, None, None, "d#.xaml", 0.8),
    ),
    "dotnet-resource": (
        ("symbol", "resx_document", "@", "@", None, 1, 5, None, 0.9), ("symbol", "resx_data", "k#", "@::data::k#", "@", 2, 2, None, 0.85), ("symbol", "resx_data", "f#", "@::data::f#", "@", 3, 3, None, 0.85), ("symbol", "resx_metadata", "m#", "@::metadata::m#", "@", 4, 4, None, 0.85),
        ("relation", "contains", None, "@", None, None, None, "@::data::k#", 0.9), ("relation", "contains", None, "@", None, None, None, "@::data::f#", 0.9), ("relation", "contains", None, "@", None, None, None, "@::metadata::m#", 0.9),
        ("relation", "references", None, "@::data::k#", None, None, None, "T#", 0.55), ("relation", "references", None, "@::data::f#", None, None, None, "System.Resources.ResXFileRef", 0.55), ("relation", "imports", None, "@", None, None, None, "img/p#.png", 0.8),
    ),
    "smarty": (
        ("symbol", "template", "@", "@", None, 1, 7, None, 0.9), ("symbol", "template-block", "b#", "@::b#", "@", 2, 5, None, 1.0), ("symbol", "template-function", "f#", "@::f#", "@", 6, 6, None, 1.0), ("relation", "contains", None, "@", None, None, None, "@::b#", 1.0),
        ("relation", "contains", None, "@", None, None, None, "@::f#", 1.0), ("relation", "imports", None, "@", None, None, None, "base#.tpl", 0.8), ("relation", "imports", None, "@", None, None, None, "d/part#.tpl", 0.8), ("relation", "imports", None, "@", None, None, None, "js/s#.js", 0.75),
        ("relation", "calls", None, "@::b#", None, None, None, "@::f#", 0.7), ("relation", "calls", None, "@::b#", None, None, None, "g#", 0.7),
    ),
}
SOURCES = {"xaml": (XAML, "xaml", "supplier", "s_suppkey"), "dotnet-resource": (RESX, "resx", "customer", "c_custkey"), "smarty": (TEMPLATE, "tpl", "customer", "c_custkey")}


def _value(x, ending: str) -> str:
    if x is None:
        return "NULL"
    if not isinstance(x, str):
        return f"CAST({x} AS {'DOUBLE' if isinstance(x, float) else 'BIGINT'})"
    own = x.replace("@", f"d/#.{ending}").replace("'", "''")
    return f"replace('{own}', '#', k)"


def _register(language: str) -> None:
    text, ending, source, key = SOURCES[language]
    names = ("entity", "kind", "name", "qualified_name", "parent", "start_line", "end_line", "target", "confidence")
    each = " UNION ALL ".join("SELECT k, " + ", ".join(f"{_value(x, ending)} AS {n}" for x, n in zip(row, names)) + " FROM c" for row in ROWS[language])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.col(key).cast("string")
        files = table(spark, sf_dir, source).select(F.concat(F.lit("d/"), k, F.lit(f".{ending}")).alias("path"), F.lit(language).alias("language"), F.replace(F.lit(text.replace("\\\\", "\\")), F.lit("#"), k).alias("content"))
        return markup.extractions(files).select("path", *names)

    run.__name__ = "extract_" + {"dotnet-resource": "resx", "smarty": "template"}.get(language, language)
    query(f"WITH c AS (SELECT CAST({key} AS VARCHAR) AS k FROM {source}) SELECT 'd/' || k || '.{ending}' AS path, {', '.join(names)} FROM ({each})")(run)


for _language in SOURCES:
    _register(_language)
