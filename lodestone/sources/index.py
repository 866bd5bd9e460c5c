"""The versioned index: four tables and a run record in one folder, replaced file by file, with a pointer as the commit.

``root/v=N/<table>`` holds version N; ``root/CURRENT`` names the version that readers see. A run writes a whole new version
and then moves the pointer, so readers never see half of a run, and a run that dies leaves the old version in place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import changes
from lodestone.sources.store import file_system

#: Version of the layout; a store of another one must be built anew.
LAYOUT = 1
TABLES = {
    "files": "path string, language string, sha256 string, size_bytes long",
    "symbols": "handle string, path string, language string, kind string, name string, qualified_name string, parent_handle string, start_line long, end_line long, confidence double",
    "relations": "from_handle string, to_handle string, unresolved_to string, kind string, confidence double, path string",
    "chunks": "handle string, path string, symbol_handle string, start_line long, end_line long, content string",
    "runs": "version long, added long, changed long, deleted long, unchanged long, full boolean, reason string, fingerprint string, linked boolean",
}


class StaleIndex(RuntimeError):
    """Reads are refused: there is no index, it has another layout, or its linking isn't done."""


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # pointer and metadata

    def _text(self, name: str) -> str | None:
        fs, path = file_system(self.spark, f"{self.root}/{name}")
        if not fs.exists(path):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(str(path.toString())).collect())

    def _put(self, name: str, text: str) -> None:
        """Written beside and then renamed over, which is one step in the file system."""
        fs, path = file_system(self.spark, f"{self.root}/{name}")
        beside = file_system(self.spark, f"{self.root}/{name}.next")[1]
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(beside, path):
            raise OSError(f"could not move {beside} to {path}")

    def meta(self) -> dict:
        """What ``CURRENT`` says, or, if a run died while moving it, what it was about to say; {} without an index."""
        text = self._text("CURRENT") or self._text("CURRENT.next")
        return json.loads(text) if text else {}

    def version(self) -> int | None:
        return self.meta().get("version")

    # reading

    def raw(self, table: str, version: int | None = None) -> DataFrame:
        n = self.version() if version is None else version
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/v={n}/{table}") if n is not None else self.spark.createDataFrame([], TABLES[table])

    def read(self, table: str) -> DataFrame:
        """A table of the current version, if the index may be read."""
        problem = self.problem()
        if problem:
            raise StaleIndex(problem)
        return self.raw(table)

    def problem(self) -> str:
        m = self.meta()
        if not m:
            return "no_index"
        if m["layout"] != LAYOUT:
            return "layout_changed"
        return "linking_pending" if not m["linked"] else ""

    # writing

    def reindex_reason(self, fingerprint: str, force: bool = False) -> str:
        """Why all files must be indexed again: asked for, no index, another layout, other settings or manifests; '' if not."""
        m = self.meta()
        if force:
            return "requested"
        if not m or m["layout"] != LAYOUT:
            return "no_index" if not m else "layout_changed"
        return "settings_changed" if m["fingerprint"] != fingerprint else ""

    def apply(self, files: DataFrame, extracted: dict[str, DataFrame], fingerprint: str = "", force: bool = False, linked: bool = True) -> DataFrame:
        """One run: ``files`` are all files there are now; ``extracted`` has the other tables' rows of at least the files that
        are new or changed. Rows of changed and deleted files go, theirs come, everything else is carried over. Returns the
        run's record."""
        reason = self.reindex_reason(fingerprint, force)
        now = self.version()
        before = self.raw("files")
        delta = changes.file_delta(before, files).withColumn("changed", F.col("change"))
        delta = delta.select("path", F.when(F.lit(bool(reason)) & (F.col("change") == "unchanged"), "changed").otherwise(F.col("change")).alias("change"))
        new = (now or 0) + 1
        folder = f"{self.root}/v={new}"
        delta.write.mode("overwrite").parquet(f"{folder}/delta")
        delta = self.spark.read.schema("path string, change string").parquet(f"{folder}/delta")
        touched = delta.filter("change <> 'unchanged'").select("path")
        fresh = delta.filter("change in ('added', 'changed')").select("path")
        for table, rows in {"files": files, **extracted}.items():
            names = [c.split(" ")[0] for c in TABLES[table].split(", ")]
            kept = self.raw(table).join(touched, "path", "left_anti").select(*names)
            kept.unionByName(rows.join(fresh, "path", "left_semi").select(*names)).write.mode("overwrite").parquet(f"{folder}/{table}")
        for table in TABLES.keys() - {"files", "runs", *extracted}:
            self.raw(table).join(touched, "path", "left_anti").write.mode("overwrite").parquet(f"{folder}/{table}")
        count = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
        record = delta.agg(count("added"), count("changed"), count("deleted"), count("unchanged")).select(
            F.lit(new).cast("long").alias("version"), "added", "changed", "deleted", "unchanged", F.lit(bool(reason)).alias("full"), F.lit(reason).alias("reason"), F.lit(fingerprint).alias("fingerprint"), F.lit(linked).alias("linked"),
        )
        self.raw("runs").unionByName(record).coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs")
        self._put("CURRENT", json.dumps({"version": new, "layout": LAYOUT, "fingerprint": fingerprint, "linked": linked}))
        return self.raw("runs").filter(F.col("version") == new)

    def finish_linking(self) -> None:
        self._put("CURRENT", json.dumps(self.meta() | {"linked": True}))

    def replace_file(self, file: DataFrame, extracted: dict[str, DataFrame]) -> DataFrame:
        """One file's rows anew; all others stay."""
        others = self.raw("files").join(file.select("path"), "path", "left_anti")
        return self.apply(others.unionByName(file), extracted, self.meta().get("fingerprint", ""))

    def delete_file(self, path: str) -> DataFrame:
        return self.apply(self.raw("files").filter(F.col("path") != path), {}, self.meta().get("fingerprint", ""))

    def delta(self) -> DataFrame:
        """``path, change`` of the last run."""
        return self.spark.read.schema("path string, change string").parquet(f"{self.root}/v={self.version()}/delta")

    def status(self) -> DataFrame:
        """``entity, n`` of the current version."""
        out = [self.raw(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("entity"), "n") for t in TABLES]
        for x in out[1:]:
            out[0] = out[0].unionByName(x)
        return out[0]


def lookup_keys(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """``path, lookup_key``: names and qualified names that a file's symbols have, and targets that its relations name."""
    own = symbols.select("path", F.explode(F.array(F.concat(F.lit("name:"), F.lower("name")), F.concat(F.lit("qualified:"), F.lower("qualified_name")))).alias("lookup_key"))
    targets = relations.filter("unresolved_to is not null")
    low = F.lower("unresolved_to")
    last = F.regexp_extract(low, r"([^.:>]*)$", 1)
    asked = targets.select("path", F.explode(F.array_distinct(F.array(F.concat(F.lit("name:"), last), F.concat(F.lit("name:"), low), F.concat(F.lit("qualified:"), low)))).alias("lookup_key"))
    return own.unionByName(asked).distinct()


def relink_paths(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Files to link again: those that changed, and those that name or hold a key that a changed file had or has.

    before, after: ``path, lookup_key`` of the two states; changed: ``path``.
    """
    keys = before.join(changed, "path", "left_semi").unionByName(after.join(changed, "path", "left_semi")).select("lookup_key").distinct()
    return after.join(keys, "lookup_key", "left_semi").select("path").unionByName(changed.select("path")).distinct()
