"""Registered queries over manifests and the index's upkeep, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.catalog import AFTER, DELTA, perturbed, query
from lodestone.sources import index, manifests, views
from lodestone.sources.store import shared_folder
from lodestone.sources.views import FILES, table

#: Manifests of customers, by their number: (file, text with # for the number).
TEXTS = (
    ("go.mod", "module example.org/m#\n\nrequire (\n\ta.b/c v1\n)\nreplace x.y/z => ../z#\n"),
    ("package.json", '{"name": "p#", "main": "lib/m#.js", "workspaces": ["w/#"], "exports": {"./x": "./x#.js", "./y": {"import": "./y.js"}}}'),
    ("tsconfig.json", '// settings\n{"compilerOptions": {"baseUrl": "./src", /* aliases */ "paths": {"@#/*": ["a//#/*",],},},}'),
    ("App.csproj", '<Project><PropertyGroup><RootNamespace> N# </RootNamespace></PropertyGroup><ItemGroup><ProjectReference Include="../L#/L.csproj" /></ItemGroup></Project>'),
    ("Cargo.toml", '[package]\nname = "c#"\n[dependencies]\nserde = "1"\nown = { path = "../own#" }\n[workspace]\nmembers = ["m#"]\n'),
    ("composer.json", '{"autoload": {"psr-4": {"N#\\\\": ["src/", "lib#/"]}, "files": ["f#.php"]}}'),
    ("package.json", '{"name": broken #}'),
    ("setup.cfg", "[metadata]\nname = s#\n[options]\npackage_dir =\n    =src#\n"),
    ("x.gemspec", "s.name = 'g#'\ns.require_paths = ['lib#']\nrequire_relative 'r#'\n"),
    ("x.nimble", 'name = "n#"\nsrcDir = "src#"\nrequires "nim >= 1", "./local#"\n'),
    ("build.zig.zon", '.{ .name = "z#",\n .dependencies = .{ .a = .{ .path = "a#" } } }'),
    ("x.vbp", "Type=Exe\nForm=f#.frm\nModule=M; m#.bas\n"),
)
#: What these say: (text, kind, name, target, confidence).
SAID = (
    (0, "module", "", "example.org/m#", 1.0), (0, "replace", "x.y/z => ../z#", "../z#", 0.9), (1, "package", "", "p#", 1.0), (1, "main", "", "lib/m#.js", 0.9), (1, "workspace", "", "w/#", 0.8), (1, "export", "./x", "./x#.js", 0.8),
    (2, "project-config", "tsconfig.json", "", 1.0), (2, "baseUrl", "", "./src", 0.9), (2, "path-alias", "@#/*", "src/a/#/*", 0.8), (3, "namespace", "", "N#", 0.9), (3, "project-reference", "", "../L#/L.csproj", 0.9),
    (4, "package", "", "c#", 0.9), (4, "path-dependency", "own", "../own#", 0.8), (4, "workspace-member", "", "m#", 0.8), (5, "psr-4", "N#\\", "src/", 0.9), (5, "psr-4", "N#\\", "lib#/", 0.9), (5, "files", "", "f#.php", 0.8),
    (6, "diagnostic", "", "metadata_json_invalid", 1.0), (7, "package", "", "s#", 0.9), (7, "package-dir", "", "src#", 0.8), (8, "gem", "", "g#", 0.9), (8, "require-path", "", "lib#", 0.8), (8, "require-relative", "", "r#", 0.9),
    (9, "package", "", "n#", 0.8), (9, "src-dir", "", "src#", 0.8), (9, "path-dependency", "", "./local#", 0.7), (10, "package", "", "z#", 0.8), (10, "path", "", "a#", 0.8), (11, "component", "Form", "f#.frm", 0.9), (11, "component", "Module", "M; m#.bas", 0.9),
)


def _sql(x: str) -> str:
    return "replace('" + x.replace("'", "''") + "', '#', k)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda i: F.replace(F.element_at(F.array(*[F.lit(t[i]) for t in TEXTS]), (k % len(TEXTS) + 1).cast("int")), F.lit("#"), k.cast("string"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), k.cast("string"), F.lit("/"), pick(0)).alias("path"), pick(1).alias("content"))


@query("WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_custkey % 12 AS form FROM customer) " + " UNION ALL ".join(f"SELECT 'd' || k || '/{TEXTS[i][0]}' AS source_path, '{kind}' AS kind, {_sql(name)} AS name, {_sql(target)} AS target, {sure}::DOUBLE AS confidence FROM c WHERE form = {i}" for i, kind, name, target, sure in SAID))
def manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of manifests of ten families, comments and trailing commas and one broken file included."""
    return manifests.manifest_facts(texts(spark, sf_dir))


def fresh_index(spark: SparkSession) -> index.Index:
    return index.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")


def extracted(f: DataFrame) -> dict[str, DataFrame]:
    """One symbol and one chunk a file, and a relation to what its folder is called."""
    handle = F.concat(F.lit("s:"), "path")
    where = F.regexp_extract("path", "^([^/]*)/", 1)
    one, lines = F.lit(1).cast("long"), F.size(F.split("content", "\n")).cast("long")
    return {
        "symbols": f.select(handle.alias("handle"), "path", "language", F.lit("file").alias("kind"), F.col("sha256").alias("name"), F.concat_ws(".", where, F.col("sha256")).alias("qualified_name"), F.lit(None).cast("string").alias("parent_handle"), one.alias("start_line"), lines.alias("end_line"), F.lit(0.9).alias("confidence")),
        "chunks": f.select(F.concat(F.lit("c:"), "path").alias("handle"), "path", handle.alias("symbol_handle"), one.alias("start_line"), lines.alias("end_line"), "content"),
        "relations": f.select(handle.alias("from_handle"), F.lit(None).cast("string").alias("to_handle"), where.alias("unresolved_to"), F.lit("imports").alias("kind"), F.lit(0.9).alias("confidence"), "path"),
    }


def twice_applied(spark: SparkSession, sf_dir: str) -> index.Index:
    """An index of all files, then of their later state, whose extraction covers only what is new or changed."""
    f = views.files(spark, sf_dir)
    own = fresh_index(spark)
    own.apply(f, extracted(f), "settings")
    later = perturbed(f)
    changed = later.join(own.raw("files").select("path", F.col("sha256").alias("old")), "path", "left").filter("old is null or old <> sha256").drop("old")
    own.apply(later, extracted(changed), "settings")
    return own


LATER = f"{AFTER}, {DELTA}"


@query(f"WITH {FILES}, {LATER} SELECT l.path, l.sha256 AS name, 's:' || l.path AS handle FROM later l")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols after an incremental run: those of unchanged files as they were, of changed and new ones anew, of deleted ones gone."""
    return twice_applied(spark, sf_dir).read("symbols").select("path", "name", "handle")


@query(f"WITH {FILES}, {LATER}, n AS (SELECT count(*) AS n FROM later) SELECT t AS entity, CASE WHEN t = 'runs' THEN 2 ELSE n END AS n FROM n, (SELECT unnest(['files', 'symbols', 'relations', 'chunks', 'runs']) AS t)")
def store_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table after the run: deletions reach all of them."""
    return twice_applied(spark, sf_dir).status()


@query(f"""WITH {FILES}, {LATER} SELECT CAST(1 AS BIGINT) AS version, count(*) AS added, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS unchanged, true AS "full", 'no_index' AS reason FROM files
UNION ALL SELECT 2, count(*) FILTER (WHERE change = 'added'), count(*) FILTER (WHERE change = 'changed'), count(*) FILTER (WHERE change = 'deleted'), count(*) FILTER (WHERE change = 'unchanged'), false, '' FROM delta""")
def store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run records, with why a run was a full one."""
    return twice_applied(spark, sf_dir).read("runs").select("version", "added", "changed", "deleted", "unchanged", "full", "reason")


@query(f"""WITH {FILES}, {LATER}, s AS (SELECT path, sha256, lower(regexp_extract(path, '^([^/]*)/', 1)) AS folder FROM files UNION ALL SELECT path, sha256, lower(regexp_extract(path, '^([^/]*)/', 1)) FROM later),
k AS (SELECT path, unnest(['name:' || lower(sha256), 'qualified:' || folder || '.' || lower(sha256), 'name:' || folder, 'qualified:' || folder]) AS key FROM s), now AS (SELECT path, unnest(['name:' || lower(sha256), 'qualified:' || folder || '.' || lower(sha256), 'name:' || folder, 'qualified:' || folder]) AS key FROM (SELECT path, sha256, lower(regexp_extract(path, '^([^/]*)/', 1)) AS folder FROM later)),
ch AS (SELECT path FROM delta WHERE change <> 'unchanged')
SELECT path FROM ch UNION SELECT path FROM now WHERE key IN (SELECT key FROM k WHERE path IN (SELECT path FROM ch))""")
def store_relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to link again after the run: changed ones, and those that share a name or a target with what they had or have."""
    own = twice_applied(spark, sf_dir)
    changed = own.delta().filter("change <> 'unchanged'").select("path")
    keys = lambda v: index.lookup_keys(own.raw("symbols", v), own.raw("relations", v))
    return index.relink_paths(changed, keys(1), keys(2))
