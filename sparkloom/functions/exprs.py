"""Column expressions shared by the operators: identifiers, paths, tokens, tool names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages by file name, tools by what they do, extensions of code, accented letters and what they fold to.
LANGUAGES = {"kotlin": r"\.kts?$", "xml": r"\.xml$", "gradle": r"\.gradle(\.kts)?$", "typescript": r"\.tsx?$", "dart": r"\.dart$", "python": r"\.py$"}
ENGINE = r"^(?:mcp__.*engine.*__(?:engine_)?|pi:engine_)(search|lookup|map|context|deps|source)$"
NATIVE = r"^(?:Read|Grep|Glob|pi:(?:read|grep|glob))$"
ADMIN = r"^(?:mcp__.*engine.*__(?:engine_)?|pi:engine_)(status|statistics|export|reindex)$"
CODE_EXTENSIONS = ("kt", "ts", "tsx", "js", "jsx", "dart", "py", "rb", "go", "rs", "java", "sql")
ACCENTED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Fixed value: the space separators of Unicode.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Base names that say nothing, and words that hint at a symbol in a file name.
GENERIC_NAMES = ("app", "build", "config", "constants", "helpers", "index", "main", "package", "readme", "settings", "setup", "types", "utils")
SYMBOL_WORDS = ("adapter", "api", "client", "controller", "dao", "handler", "hook", "manager", "model", "module", "provider", "repo", "repository", "screen", "service", "store", "use", "view", "viewmodel")


def classify(path: Column) -> Column:
    """Language of a path; a Gradle script in Kotlin is gradle."""
    p = F.lower(path)
    out = F.when(p.rlike(LANGUAGES["gradle"]), "gradle")
    for name in ("kotlin", "xml", "typescript", "dart", "python"):
        out = out.when(p.rlike(LANGUAGES[name]), name)
    return out.otherwise("other")


def module_of(path: Column) -> Column:
    """``:a:b`` for ``a/b/src/...``; null at the root."""
    m = F.regexp_extract(path, r"^(.+?)/src/", 1)
    return F.when(m != "", F.concat(F.lit(":"), F.translate(m, "/", ":")))


def source_set_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"/src/(\w+)/", 1), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_id(path: Column, start: Column, end: Column, text_hash: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string"), text_hash), 256), 1, 24)


def strip(text: Column) -> Column:
    """The text without white space at either end."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def without_spaces(text: Column) -> Column:
    """The text without spaces of any width at either end, as SQL trims it; other white space stays."""
    return F.btrim(text, F.lit(SPACES))


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up; null has none."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def truncate_tokens(text: Column, budget: int) -> Column:
    cut = F.concat(F.substring(text, 1, budget * 4), F.lit("\n... (truncated)"))
    return F.when(F.length(text) <= budget * 4, text).otherwise(cut)


def terms_of(text: Column) -> Column:
    """Letters-and-digits runs in lower case, without accents."""
    low = F.lower(text)
    plain = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))
def counted(terms: pa.Array) -> pa.Array:
    """term and tf of every different one of some terms, in order; a batch of rows at a time as arrays."""
    size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = terms.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words, place = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    kinds = max(1, len(words))
    once, tf = np.unique(np.repeat(np.arange(len(size)), size) * kinds + place[coded.indices.to_numpy()], return_counts=True)
    ends = np.searchsorted(once, np.arange(len(size) + 1) * kinds)
    rows = pa.StructArray.from_arrays([words.take(pa.array(once % kinds)), pa.array(tf)], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def compact(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, "[^a-zA-Z0-9]", ""))


def round_half_up(x: Column, digits: int = 1) -> Column:
    """Rounds a half towards plus infinity, also below zero."""
    return F.floor(x * 10**digits + F.lit(0.5)) / 10**digits


def categorize(tool: Column) -> Column:
    """engine or native exploration, admin or other use of a tool."""
    return F.when(tool.rlike(ENGINE), "engine").when(tool.rlike(NATIVE), "native").when(tool.rlike(ADMIN), "admin").otherwise("other")


def tool_short(tool: Column) -> Column:
    """The tool's own name: without its server, and without the engine's prefix; a native one of another agent is capitalised."""
    served, own, other = (F.regexp_extract(tool, p, 1) for p in (r"^mcp__.*__(?:engine_)?(.+)$", r"^pi:engine_(.+)$", r"^pi:(.+)$"))
    return F.when(served != "", served).when(own != "", own).when(other != "", F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, 2, 2**31 - 1))).otherwise(tool)


def path_extension(path: Column) -> Column:
    name = base_name(path)
    out = F.when(path.isNull() | (path == ""), "(unknown)").when(F.lower(name).endswith(".d.ts"), ".d.ts")
    return out.when(~name.contains("."), "(no ext)").otherwise(F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1))))


def is_code_path(path: Column) -> Column:
    name = F.lower(base_name(path))
    return name.contains(".") & F.substring_index(name, ".", -1).isin(*CODE_EXTENSIONS)


def time_ago(then: Column, now: Column) -> Column:
    """How long ago in words: minutes under an hour, hours under a day, else days."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    some = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 1, "just now").when(minutes < 60, some(minutes, " min ago")).when(minutes < 1440, some(F.floor(minutes / 60), "h ago")).otherwise(some(F.floor(minutes / 1440), "d ago"))


def string_array(text: Column, filled: bool = False) -> Column:
    """The strings of a JSON array; none of a malformed text or another value. With ``filled`` blank ones and what is no string are left out."""
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda v: F.trim(v) != "") if filled else items


def looks_like_regex(text: Column) -> Column:
    return text.rlike(r"[\[\]{}()^$|\\]") | text.contains(".*") | text.contains(".+")


def reason_code(tool: Column, path: Column, query: Column) -> Column:
    """Why a native call is no exploration: it reads no code, or its pattern is for a known path."""
    return F.when((tool == "Read") & ~is_code_path(path), "non_code_file").when((tool == "Grep") & looks_like_regex(query) & path.isNotNull(), "known_path_regex")


def _pascal(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2**31 - 1)))), "")


def _hinted(parts: Column) -> Column:
    return F.size(parts).between(2, 5) & F.exists(parts, lambda p: F.lower(p).isin(*SYMBOL_WORDS))


def symbol_of_path(path: Column) -> Column:
    """The symbol that a file's name looks like, or null."""
    base = F.regexp_replace(base_name(path), r"(?i)(\.d)?\.[^.]+$", "")
    compacted = F.regexp_replace(base, "[^a-zA-Z0-9]", "")
    parts = F.filter(F.split(base, "[-_.]+"), lambda p: p != "")
    ok = ~F.lower(base).isin(*GENERIC_NAMES) & (F.length(compacted) >= 3)
    return F.when(ok & base.rlike("[A-Z]"), compacted).when(ok & _hinted(parts), _pascal(parts))


def symbol_of(value: Column) -> Column:
    """The symbol that a search text looks like, or null."""
    text = F.regexp_replace(F.trim(value), "^[\"'`]+|[\"'`]+$", "")
    tail = F.regexp_replace(F.coalesce(F.try_element_at(F.filter(F.split(text, r"\."), lambda p: p != ""), F.lit(-1)), text), "[^a-zA-Z0-9_-]", "")
    parts = F.filter(F.split(tail, "[-_]+"), lambda p: p != "")
    own = F.when(F.length(tail) >= 3, F.when(tail.rlike("[A-Z]"), F.regexp_replace(tail, "[^a-zA-Z0-9]", "")).when(_hinted(parts), _pascal(parts)))
    return F.when(text == "", None).when(text.contains("/") | text.rlike(r"(?i)\.[a-z0-9]+$"), symbol_of_path(text)).otherwise(own)
