"""Scalar functions on names, queries and scores, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V


def empty(of: str = "string") -> Column:
    return F.array().cast(f"array<{of}>")


def split_identifier(name: Column) -> Column:
    """camelCase and snake_case to lower-case tokens; every upper-case letter begins one (HTTPClient: h, t, t, p, client)."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"(?<=[^_])(?=\p{Lu})", "_")), "_"), lambda t: t != "")


def camel_tokens(name: Column) -> Column:
    """Tokens of two or more letters, acronyms kept whole (HTTPClient: http, client)."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)


def query_tokens(query: Column) -> Column:
    """Distinct lower-case words of three or more letters that are not stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*V.STOP_WORDS)))


def search_tokens(text: Column) -> Column:
    """Distinct identifier tokens of two or more characters, in order of appearance."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9]*"), F.lit(0))
    return F.array_distinct(F.filter(F.flatten(F.transform(words, split_identifier)), lambda t: F.length(t) >= 2))


def search_text(*parts: Column) -> Column:
    """Tokens of names, signature, package, annotations and capabilities, as one string."""
    return F.array_join(search_tokens(F.concat_ws(" ", *parts)), " ")


def normalize_name(name: Column) -> Column:
    """Lower case, without generics, arguments and member."""
    return F.lower(F.regexp_extract(name, r"^[^<(#]*", 0))


def qgrams(text: Column, q: int = 3) -> Column:
    """Sliding q-grams; a shorter text is its own gram."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (q - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(q)))
    return F.when(n == 0, empty()).when(n < q, F.array(text)).otherwise(grams)


def simple_name(fqn: Column) -> Column:
    return F.element_at(F.split(fqn, r"\."), -1)


def enclosing_type(fqn: Column) -> Column:
    return F.substring_index(fqn, "#", 1)


def is_external(fqn: Column) -> Column:
    return enclosing_type(fqn).rlike(r"^(java|javax|jakarta|org\.springframework|lombok)\.")


def looks_like_identifier(query: Column) -> Column:
    """PascalCase or SCREAMING_SNAKE of 2 to 200 characters."""
    return F.length(query).between(2, 200) & query.rlike(r"^([A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*|[A-Z][A-Z0-9]*(_[A-Z0-9]+)+)$")


def phantom_arity(needle: Column) -> Column:
    """``(3)`` to ``(?)``, as members of unknown arity are named."""
    return F.regexp_replace(needle, r"\(\d+\)$", "(?)")


def looks_like_node_id(text: Column) -> Column:
    return text.rlike(r"^(r:|c:|p:|ucs:)|^[0-9a-f]{40}$")


# --- scores ---


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def l2_to_score(distance: Column) -> Column:
    return F.lit(1.0) - distance * distance / 2


def display_score(distance: Column) -> Column:
    return clamp01(F.lit(1.0) - distance / 2)


def rrf_max(lists: int, k: int = V.RRF_K) -> float:
    return lists / (k + 1)


def is_jvm(language: Column, filename: Column) -> Column:
    """Java and Kotlin rows, by language if that is known, else by the file's name: roles and names weigh for these alone."""
    known = F.lower(F.coalesce(language, F.lit("")))
    return F.when(known != "", known.isin("java", "kotlin")).otherwise(F.lower(F.coalesce(filename, F.lit(""))).rlike(r"\.(java|kt|kts)$"))


def role_weight(role: Column, locked: bool = False) -> Column:
    """The weight of a role; none for unknown roles, or if the caller asked for one role."""
    if locked:
        return F.lit(0.0)
    table = F.create_map(*[x for r, w in V.ROLE_WEIGHTS.items() for x in (F.lit(r), F.lit(w))])
    return F.coalesce(F.try_element_at(table, F.upper(F.coalesce(role, F.lit("")))), F.lit(0.0))


def symbol_bonus(symbols: Column, type_fqn: Column, tokens: Column) -> Column:
    """What a chunk gains from declared names and its type's name that share tokens with the query."""
    names = F.filter(F.transform(F.coalesce(symbols, empty()), lambda s: F.trim(F.substring_index(s, "(", 1))), lambda s: s != "")
    hits = F.size(F.filter(names, lambda s: F.arrays_overlap(split_identifier(s), tokens)))
    action = F.exists(names, lambda s: F.get(split_identifier(s), F.lit(0)).isin(*V.ACTION_VERBS))
    of_type = F.size(F.array_intersect(split_identifier(simple_name(F.coalesce(type_fqn, F.lit("")))), tokens))
    return F.least(hits * V.SYMBOL_HIT, F.lit(V.SYMBOL_CAP)) + F.when(action, V.ACTION_BONUS).otherwise(0.0) + F.least(of_type * V.TYPE_HIT, F.lit(V.TYPE_CAP))


def effective_distance(distance: Column, import_heavy: Column, role: Column, bonus: Column) -> Column:
    return distance + F.when(import_heavy, V.IMPORT_PENALTY).otherwise(0.0) - role - bonus


def hybrid_score(rrf: Column, import_heavy: Column, role: Column, bonus: Column) -> Column:
    """Composite of a two-list fusion, divided by its greatest possible value."""
    most = rrf_max(2) + max(V.ROLE_WEIGHTS.values()) + V.SYMBOL_CAP + V.TYPE_CAP + V.ACTION_BONUS
    return clamp01((rrf * F.when(import_heavy, V.IMPORT_FACTOR).otherwise(1.0) + role + bonus) / most)


def explained(**parts: Column) -> Column:
    """``name=value`` of every part that is not zero."""
    return F.concat_ws(" ", *[F.when(F.coalesce(c, F.lit(0.0)) != 0, F.concat(F.lit(f"{k}="), F.format_number(c, 3))) for k, c in parts.items()])


def token_overlap(have: Column, want: Column) -> Column:
    return F.when(F.size(want) == 0, 0.0).otherwise(F.size(F.array_intersect(have, want)) / F.size(want))


def import_heavy(text: Column) -> Column:
    """Three or more lines, at least 55 % of which are imports."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) >= 3) & (F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("import "))) >= 0.55 * F.size(lines))


def declaration_line(text: Column, name: str) -> Column:
    """Line (from 0) of the declaration of a type in a chunk, comments skipped; null if there is none."""
    lines = F.split(text, "\n")
    hit = rf"\b(class|interface|enum|record|object)\s+{name}\b"
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(hit) & ~F.ltrim(x).rlike(r"^(//|\*|/\*)"), i)), lambda x: x.isNotNull()))


def snippet(text: Column, start: Column, end: Column, otherwise: Column, lines: int = 20, chars: int = 800) -> Column:
    """Lines start to end (from 1) of a file, at most 20 and 800 characters; else the signature."""
    part = F.trim(F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.least(F.greatest(end - start + 1, F.lit(1)), F.lit(lines))), "\n"))
    cut = F.when(F.length(part) > chars, F.concat(F.substring(part, 1, chars - 1), F.lit("…"))).otherwise(part)
    return F.when((start > 0) & (F.coalesce(cut, F.lit("")) != ""), cut).otherwise(otherwise)
