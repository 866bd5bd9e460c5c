"""Languages of files: by path, by content, by override; names that a path implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by file extension.
EXTENSIONS = {
    "go": "go", "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "h": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "inl": "cpp", "ipp": "cpp", "tpp": "cpp", "ixx": "cpp", "cppm": "cpp",
    "cs": "csharp", "csx": "csharp", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "php": "php", "phtml": "php", "php3": "php", "php4": "php", "php5": "php", "php7": "php", "php8": "php", "phps": "php", "rs": "rust", "py": "python", "pyw": "python", "pyi": "python",
    "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "nim": "nim", "nims": "nim", "nimble": "nim", "zig": "zig", "bas": "vb6", "cls": "vb6", "frm": "vb6", "ctl": "vb6", "pag": "vb6", "vbp": "vb6-project",
    "vb": "vbnet", "xaml": "xaml", "resx": "dotnet-resource", "settings": "dotnet-resource", "lua": "lua", "rockspec": "lua", "sma": "pawn", "pwn": "pawn", "md": "markdown", "markdown": "markdown",
    "json": "config", "yaml": "config", "yml": "config", "toml": "config", "xml": "config", "ps1": "powershell", "sh": "shell", "bash": "shell",
}
#: Names and endings that come before the extension, in order.
ENDINGS = ((r"\.xaml\.cs$", "csharp"), (r"\.xaml\.vb$", "vbnet"), (r"\.d\.(ts|mts|cts)$", "typescript"), (r"(^|/)(rakefile|gemfile)$", "ruby"), (r"(^|/)build\.nims$", "nim"), (r"(^|/)build\.zig$", "zig"))
#: Words that speak for Pawn, and how many points are enough.
PAWN_WORDS = {"#include": 3, "include": 3, "public": 2, "stock": 2, "native": 2, "forward": 2, "plugin_init": 3, "plugin_precache": 3, "register_plugin": 3, "new": 1, "enum": 1}
PAWN_ENOUGH = 3
#: Languages that an override may name.
KNOWN = frozenset(EXTENSIONS.values()) | {"smarty", "template", "text"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def has_php(content: Column) -> Column:
    """An opening tag of PHP."""
    return content.rlike(r"(?i)<\?(php\b|=)")


def has_smarty(content: Column) -> Column:
    """A Smarty tag: a comment, a block keyword, a closing tag or a variable in braces."""
    return content.rlike(r"\{\*|\{/?(if|else|elseif|foreach|foreachelse|section|include|extends|block|assign|literal|capture|function|while|for)\b[^}]*\}|\{\$[A-Za-z_]")


def without_comments(content: Column) -> Column:
    """Code without comments and without what stands in quotes."""
    return F.regexp_replace(content, r"(?s)/\*.*?(\*/|$)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", " ")


def pawn_score(content: Column) -> Column:
    code = without_comments(content)
    found = F.lit(0)
    for word, points in PAWN_WORDS.items():
        start = r"(?<![A-Za-z0-9_#])" if word.startswith("#") else r"(?<![A-Za-z0-9_])"
        found = found + F.when(code.rlike(f"{start}{word}(?![A-Za-z0-9_])"), points).otherwise(0)
    return found


def detected(path: Column, content: Column) -> Column:
    """The language of a file, as a struct ``language, reason, confidence``, overrides apart."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    ext = extension(low)
    told = lambda language, reason, sure: F.struct((F.lit(language) if isinstance(language, str) else language).alias("language"), F.lit(reason).alias("reason"), F.lit(sure).alias("confidence"))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    out = None
    for pattern, language in ENDINGS:
        here = (low.rlike(pattern), told(language, "extension", 0.95))
        out = F.when(*here) if out is None else out.when(*here)
    out = out.when((ext == "tpl") & has_smarty(content), told("smarty", "content", 0.9)).when((ext == "tpl") & has_php(content), told("php", "content", 0.85)).when(ext == "tpl", told("template", "extension", 0.75))
    out = out.when(ext == "smarty", told("smarty", "extension", 0.95))
    out = out.when((ext == "inc") & has_php(content), told("php", "content", 0.95)).when((ext == "inc") & (pawn_score(content) >= PAWN_ENOUGH), told("pawn", "content", 0.8)).when(ext == "inc", told("text", "fallback", 0.3))
    by_extension = F.try_element_at(known, ext)
    return out.when(by_extension.isNotNull(), told(by_extension, "extension", 0.95)).otherwise(told("text", "fallback", 0.2))


def implied(language: Column, path: Column) -> Column:
    """Whether a path's extension alone tells the language, so that it needn't be written down."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)) == language, F.lit(False))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` is any number of folders, ``*`` and ``?`` stay inside one."""
    out = []
    parts = pattern.replace("\\", "/").removeprefix("./").strip("/").split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:.*/)?")
            continue
        at, own = 0, ""
        while at < len(part):
            c = part[at]
            end = part.find("]", at + 1) if c == "[" else -1
            if end > 0:
                own += "[" + part[at + 1 : end].replace("\\", "\\\\") + "]"
                at = end + 1
                continue
            own += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "_/ " else c)
            at += 1
        out.append(own + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def specificity(pattern: str) -> int:
    """Characters of a glob that aren't wildcards."""
    return sum(c not in "*?[]" for c in pattern)


def override_problems(overrides: dict[str, str]) -> list[str]:
    """What is wrong with each override: empty, absolute or escaping patterns, unknown languages."""
    out = []
    for pattern, language in sorted(overrides.items()):
        clean = pattern.replace("\\", "/")
        if not clean.strip():
            out.append("empty pattern")
        elif clean.startswith("/") or clean[1:2] == ":":
            out.append(f"{pattern}: not relative")
        elif ".." in clean.split("/"):
            out.append(f"{pattern}: leaves the root")
        if language not in KNOWN:
            out.append(f"{pattern}: unknown language {language}")
    return out


def override(path: Column, overrides: dict[str, str]) -> Column:
    """The language of the most specific pattern that matches (the first by name on ties), or null: one CASE, no join."""
    out = F.lit(None).cast("string")
    for pattern in sorted((p for p, v in overrides.items() if v in KNOWN), key=lambda p: (-specificity(p), p), reverse=True):
        out = F.when(path.rlike(glob_regex(pattern)), overrides[pattern]).otherwise(out)
    return out


def detect(files: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``files`` (with ``path, content``) with ``language, reason, confidence``."""
    own = override(F.col("path"), overrides or {})
    forced = F.struct(own.alias("language"), F.lit("override").alias("reason"), F.lit(1.0).alias("confidence"))
    got = F.when(own.isNotNull(), forced).otherwise(detected(F.col("path"), F.col("content")))
    return files.drop("language").withColumn("d", got).select(*[c for c in files.columns if c != "language"], "d.language", "d.reason", "d.confidence")
