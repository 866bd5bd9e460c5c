"""Column functions of the engine: estimates, handles, identifiers, lookup keys, language rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens of a text: 1.12 * (ascii/4 + other/1.8 + punctuation/8 + identifiers/3 + 4), rounded up; 0 for ''.

    0x7F counts as non-ASCII. Null stays null.
    """
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    ascii_chars = count(r"[\x00-\x7E]")
    base = (
        ascii_chars / 4.0
        + (F.length(text) - ascii_chars) / 1.8
        + count(r"[\p{P}\p{S}&&[^_]]") / 8.0
        + count(r"[\p{L}\p{Nd}_]+") / 3.0
        + 4
    )
    return F.when(text == "", F.lit(0)).otherwise(F.ceil(base * 1.12)).cast("long")


def normalize_signature(text: Column) -> Column:
    """Trimmed, every run of white space one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stable_handle(prefix: str, *fields: Column) -> Column:
    """prefix_ and 16 characters of the URL-safe base64 SHA-256 of the fields, each after a zero byte."""
    joined = F.concat(*[F.concat(F.chr(F.lit(0)), F.coalesce(f.cast("string"), F.lit(""))) for f in fields])
    digest = F.base64(F.unhex(F.sha2(joined, 256)))
    return F.concat(F.lit(prefix + "_"), F.substring(F.translate(digest, "+/", "-_"), 1, 16))


def split_identifier(name: Column) -> Column:
    """Parts at case changes, digits before capitals, and the delimiters _ : . / \\ -."""
    cut = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[_:./\\\-]+"
    return F.filter(F.split(name, cut), lambda x: x != "")


def is_identifier(name: Column) -> Column:
    """A capital after the first character, or one of _ : ."""
    return name.rlike(r"^.+\p{Lu}") | name.rlike(r"[_:.]")


def like_escaped(value: Column) -> Column:
    """A value to be matched literally by LIKE with a backslash as escape."""
    return F.regexp_replace(value, r"([\\%_])", r"\\$1")


def terminal_name(name: Column) -> Column:
    """What follows the last ., :: or ->."""
    return F.regexp_extract(name, r"([^.:>]*)$", 1)


def target_keys(target: Column) -> Column:
    """Equi-join keys of an unresolved target: the whole, and what follows its last ., :: or ->."""
    return F.array_distinct(F.array(target, terminal_name(target)))


def path_keys(path: Column) -> Column:
    """Every suffix of a path at a directory boundary, with and without its extension, and its directories."""
    parts = F.split(path, "/")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
    bare = F.transform(suffixes, lambda x: F.regexp_replace(x, r"\.[^./]+$", ""))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(suffixes, bare, folders))


#: Languages whose names compare without case, and the kinds for which PHP's do.
CASELESS = ("vb6", "vbnet", "nim")
PHP_CASELESS_KINDS = ("function", "method", "class", "interface", "trait", "enum", "namespace")
#: Languages that call one another, relations that hold across languages.
FAMILIES = {"c": "c-family", "cpp": "c-family", "javascript": "js-family", "typescript": "js-family"}
ANY_LANGUAGE = ("imports", "exports", "references")


def fold_name(language: Column, kind: Column, name: Column) -> Column:
    """The form in which names of a language compare equal."""
    caseless = language.isin(*CASELESS) | ((language == "php") & kind.isin(*PHP_CASELESS_KINDS))
    return F.when(caseless, F.lower(name)).otherwise(name)


def family(language: Column) -> Column:
    out = language
    for name, group in FAMILIES.items():
        out = F.when(language == name, F.lit(group)).otherwise(out)
    return out


def languages_compatible(a: Column, b: Column, relation: Column) -> Column:
    return relation.isin(*ANY_LANGUAGE) | (family(a) == family(b))


#: Languages by file extension.
EXTENSIONS = {
    "go": "go", "php": "php", "phtml": "php", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp",
    "js": "javascript", "cjs": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "cts": "typescript", "mts": "typescript", "tsx": "typescript",
    "lua": "lua", "pwn": "pawn", "rs": "rust", "py": "python", "pyi": "python", "rb": "ruby", "bas": "vb6", "cls": "vb6", "frm": "vb6", "vb": "vbnet", "nim": "nim", "nims": "nim",
    "zig": "zig", "tpl": "template", "smarty": "template", "xaml": "xaml", "resx": "resx", "md": "markdown", "markdown": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "txt": "text",
}


def extension_language(path: Column) -> Column:
    """Language by extension; text where it isn't known."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("text"))


def is_test(kind: Column, symbol: Column, path: Column) -> Column:
    """A test by kind or name that also lies on a test path."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    on_path = p.contains("/test") | p.startswith("test") | p.contains("_test.") | p.contains(".test.") | p.contains(".spec.")
    return (kind.isin("test", "test-suite") | symbol.startswith("Test")) & on_path


def is_documentation(kind: Column, language: Column) -> Column:
    return (kind == "heading") | language.isin("markdown", "text")


def is_outline(kind: Column) -> Column:
    return kind.endswith("-outline") | (kind == "test-suite")


def is_reference_kind(kind: Column) -> Column:
    k = F.lower(kind)
    return k.contains("trait") | k.contains("interface") | k.contains("protocol")
