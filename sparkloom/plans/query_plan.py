"""Planning of searches: a table of query texts gets its terms, expansions, hints and weighted variants as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words left out of a query, what terms also stand for, and the languages and kinds of chunk that terms hint at.
STOP_WORDS = "a an and are as at be by can does for from get give how i in into is it its me of on or please show that the this to using what where which with".split()
ALIASES = {
    "api": ["service", "client", "endpoint"], "auth": ["authentication", "authorization"], "cfg": ["config", "configuration", "settings"], "config": ["cfg", "configuration", "settings"],
    "configuration": ["config", "cfg", "settings"], "db": ["database", "sql", "sqlite"], "database": ["db", "sql", "sqlite"], "impl": ["implementation"], "kt": ["kotlin"], "py": ["python"],
    "repo": ["repository"], "repository": ["repo"], "service": ["api", "client"], "svc": ["service"], "ts": ["typescript"], "tsx": ["typescript", "react"], "ui": ["screen", "view"],
    "util": ["utility", "utils"], "utility": ["util", "utils"], "utils": ["util", "utility"], "vm": ["viewmodel", "view", "model"], "viewmodel": ["vm", "view", "model"],
}
LANGUAGE_HINTS = {"dart": "dart", "gradle": "gradle", "kt": "kotlin", "kotlin": "kotlin", "py": "python", "python": "python", "ts": "typescript", "tsx": "typescript", "typescript": "typescript", "xml": "xml"}
KIND_HINTS = {
    "api": "api_interface", "composable": "composable", "dao": "dao", "function": "function", "gradle": "build_config", "hook": "hook", "interface": "api_interface", "layout": "layout", "manifest": "manifest",
    "method": "function", "module": "hilt_module", "repo": "class", "repository": "class", "screen": "screen", "service": "api_interface", "viewmodel": "viewmodel", "vm": "viewmodel", "xml": "layout",
}
#: How much each way of matching counts, and how many terms it takes.
WEIGHTS = {"exact": 1.45, "strict": 1.2, "broad": 1.0, "expanded": 0.7, "symbol_path": 1.35}
EXPANSIONS, LIKE_TERMS, BROAD_TERMS, CORE_TERMS = 10, 8, 10, 4
CAMEL = "[a-z][A-Z]|[A-Z][a-z]"


def _table(values: dict[str, str | list[str]]) -> Column:
    pairs = []
    for k, v in values.items():
        pairs += [F.lit(k), F.array(*map(F.lit, v if isinstance(v, list) else [v]))]
    return F.create_map(*pairs)


def _looked_up(terms: Column, values: dict) -> Column:
    table = _table(values)
    return F.array_distinct(F.flatten(F.filter(F.transform(terms, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull())))


def tokens(query: Column) -> Column:
    """Words of two letters or more, camel case parted, in lower case, each once."""
    parted = F.regexp_replace(F.regexp_replace(query, "([a-z0-9])([A-Z])", "$1 $2"), r"[^a-zA-Z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(F.lower(parted), r"\s+"), lambda t: F.length(t) >= 2))


def identifier_like(query: Column) -> Column:
    q = F.trim(query)
    return (q != "") & (~q.rlike(r"\s") | q.rlike(CAMEL) | q.rlike("[./_-]"))


def exact_terms(query: Column) -> Column:
    trimmed = F.transform(F.split(query, r"\s+"), lambda t: F.regexp_replace(t, "^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", ""))
    kept = F.filter(trimmed, lambda t: t.rlike("^[a-zA-Z0-9]+$") | t.rlike(CAMEL))
    return F.array_distinct(F.filter(F.transform(kept, lambda t: F.lower(F.regexp_replace(t, "[^a-zA-Z0-9]", ""))), lambda t: F.length(t) >= 3))


def singular(term: Column) -> Column:
    """A plural's singular, or null."""
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    n = F.length(term)
    out = F.when(n <= 3, None).when(term.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))).when(term.endswith("sses") & (n > 5), cut(2))
    return out.when(term.endswith("s") & ~term.endswith("ss"), cut(1))


def plan(queries: DataFrame) -> DataFrame:
    """``queries`` (query and others) with identifier_like, terms, exact, expansions, like_terms, languages, kinds and
    variants (name, needs_all, terms, weight). A null query has no terms; one of stop words alone keeps them."""
    q = queries.withColumn("query", F.coalesce("query", F.lit("")))
    raw = tokens(F.col("query"))
    told = F.filter(raw, lambda t: ~t.isin(STOP_WORDS))
    q = q.withColumns({"identifier_like": identifier_like(F.col("query")), "terms": F.when(F.size(told) > 0, told).otherwise(raw), "exact": exact_terms(F.col("query"))})
    q = q.withColumn("exact", F.when(F.col("identifier_like"), F.col("exact")).otherwise(F.array().cast("array<string>")))
    table = _table(ALIASES)
    more = F.flatten(F.transform(F.concat("terms", "exact"), lambda t: F.concat(F.array_compact(F.array(singular(t))), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))
    fresh = F.filter(F.array_distinct(more), lambda t: (F.length(t) >= 2) & ~F.array_contains("terms", t) & ~F.array_contains("exact", t))
    q = q.withColumn("expansions", F.slice(fresh, 1, EXPANSIONS))
    hints = F.array_distinct(F.concat("terms", "expansions"))
    by_length = F.array_sort(F.transform("terms", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    core = F.transform(F.slice(by_length, 1, CORE_TERMS), lambda x: x["t"])
    both = F.array_distinct(F.concat("exact", "terms"))
    q = q.withColumns({
        "like_terms": F.slice(F.array_distinct(F.concat("exact", "terms", "expansions")), 1, LIKE_TERMS),
        "languages": _looked_up(hints, LANGUAGE_HINTS), "kinds": _looked_up(hints, KIND_HINTS),
        "strict": F.when(F.size(core) > 1, core).otherwise(F.array().cast("array<string>")), "broad": F.slice(both, 1, BROAD_TERMS),
    })
    variants = [F.struct(F.lit(n).alias("name"), F.lit(n == "strict").alias("needs_all"), F.col(c).alias("terms"), F.lit(WEIGHTS[n]).alias("weight")) for n, c in (("exact", "exact"), ("strict", "strict"), ("broad", "broad"), ("expanded", "expansions"))]
    return q.withColumn("variants", F.filter(F.array(*variants), lambda v: F.size(v["terms"]) > 0)).drop("strict", "broad")
