"""A directory or repository as a table of files, with reasons for what is left out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import extension_language

MAX_BYTES = 2 << 20
#: Directories, files and secrets that a scan leaves out.
FOLDERS = (".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", "out", "target", "bin", "obj", ".idea", ".vscode", "__pycache__", ".venv")
GENERATED = r"(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|go\.sum|cargo\.lock|composer\.lock|poetry\.lock)$|\.(lock|map|min\.js|min\.css)$"
SECRETS = r"(?i)(^|/)(\.env(\.[^/]*)?|id_rsa|id_ed25519|[^/]*\.(pem|key|p12|pfx))$"


def glob_pattern(glob: str) -> str:
    """A shell glob as a regular expression over whole paths; ``**`` crosses directories, a bare name is a prefix too."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}(?:/.*)?$" if not re.search(r"[*?\[]", glob) else f"^{out}$"


def excluded(path: Column, exclude: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> Column:
    """Left out by directory, kind, secret or a caller's glob; secrets come back by an explicit include."""
    parts = F.split(path, "/")
    named = F.lit(False)
    for g in include:
        named |= path.rlike(glob_pattern(g))
    out = F.arrays_overlap(parts, F.array(*map(F.lit, FOLDERS))) | path.rlike(GENERATED) | (path.rlike(SECRETS) & ~named)
    for g in exclude:
        out |= path.rlike(glob_pattern(g))
    return out


def classify(raw: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, content binary, length`` with ``problem`` (file_too_large, binary_skipped, invalid_utf8 or null), text, hash and language.

    A byte-order mark is taken off; ``offset`` says by how many bytes spans move.
    """
    text = F.col("content").cast("string")
    problem = F.when(F.col("length") > max_bytes, "file_too_large").when(F.instr(text, "\0") > 0, "binary_skipped").when(~F.is_valid_utf8(text), "invalid_utf8")
    bom = F.substring("content", 1, 3) == F.lit(b"\xef\xbb\xbf")
    good = F.col("problem").isNull()
    return raw.withColumn("problem", problem).select(
        "path", "problem", F.when(good, F.when(bom, F.substring(text, 2, 1 << 30)).otherwise(text)).alias("text"), F.when(good, F.sha2("content", 256)).alias("sha256"),
        F.col("length").cast("long").alias("size_bytes"), F.when(bom, 3).otherwise(0).alias("offset"), extension_language(F.col("path")).alias("language"),
    )


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), include: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files under a root by Spark's binary reader; oversized ones are never read whole by a text column."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    path = F.regexp_replace("path", rf"^(?:[a-z0-9]+:)?/*{base}/", "")
    return classify(raw.withColumn("path", path).filter(~excluded(F.col("path"), exclude, include)), max_bytes)
