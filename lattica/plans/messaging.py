"""Interfaces by which robot nodes talk: topics, services and actions, joined by their resolved names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token classes of interface names and of their types, pointer wrappers, and the side of each relationship type.
NAME_TOKENS = {"q": r"""["']""", "h": "~", "j": "/", "w": "[A-Za-z_][A-Za-z0-9_]*", "x": r"[\s\S]"}
TYPE_TOKENS = {"c": r"const\b", "p": r"(?:SharedPtr|ConstSharedPtr|UniquePtr|Ptr)\b", "w": "[A-Za-z_][A-Za-z0-9_]*", "j": "::|[./]", "m": "[<>&*]", "s": r"\s+", "x": r"[\s\S]"}
SIDES = {
    "PUBLISHES_TOPIC": "provides",
    "PROVIDES_SERVICE": "provides",
    "PROVIDES_ACTION": "provides",
    "SUBSCRIBES_TOPIC": "uses",
    "USES_TOPIC": "uses",
    "CALLS_SERVICE": "uses",
    "USES_ACTION": "uses",
}
#: The grammars, over the letters of the token classes: a name has a mark of its home or root and words between slashes; a
#: type has words between joints, to which qualifiers and marks (left out before) and wrappers at the end add nothing.
NAME, QUOTED = "(?:h?j|h)?w(?:jw)*", "q{}q"
TYPE, WRAPPED = "^s?j*([wp](?:j+[wp])*?)((?:j+p)*)j*s?$", 2
#: Characters of a computed name that are kept as its label.
LABEL = 80


#: What the middle part of a type's full name says it is for.
NAMESPACES = {"msg": "topic", "srv": "service", "action": "action"}


def scanned(raw: Column, classes: dict[str, str]) -> Column:
    """The tokens of a text from left to right as (kind, text), by the first class that fits."""

    def token(text: Column) -> Column:
        kind = F.lit(None).cast("string")
        for letter, pattern in reversed(classes.items()):
            kind = F.when(text.rlike(f"^(?:{pattern})$"), letter).otherwise(kind)
        return F.struct(kind.alias("kind"), text.alias("text"))

    return F.transform(F.regexp_extract_all(raw, F.lit("|".join(classes.values())), F.lit(0)), token)


def _kinds(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["kind"]), "")


def _texts(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["text"])


def interface_name(raw: Column, literal: Column) -> Column:
    """A name as written: a legal literal without its quotes, a computed one as a short line; null if neither."""
    tokens = scanned(F.trim(raw), NAME_TOKENS)
    kinds, n = _kinds(tokens), F.size(tokens)
    same = F.element_at(tokens, 1)["text"] == F.element_at(tokens, -1)["text"]
    name = F.when(kinds.rlike(f"^{NAME}$"), _texts(tokens)).when(kinds.rlike(f"^{QUOTED.format(NAME)}$") & same, F.slice(_texts(tokens), F.lit(2), n - 2))
    label = F.nullif(F.left(F.regexp_replace(F.trim(raw), r"\s+", " "), F.lit(LABEL)), F.lit(""))
    return F.when(literal & (n > 0), F.array_join(name, "")).when(~literal, label)


def resolved_name(name: Column, node: Column, dynamic: Column) -> Column:
    """The full name in the default namespace. A name is a mark and tokens: ``~`` puts the node's name before them.

    Computed names stay as they are, and private ones whose node is unknown.
    """
    tokens = F.split(name, "/")
    private = tokens[0] == "~"
    home = F.when(private, F.array(node)).otherwise(F.array().cast("array<string>"))
    full = F.concat(F.lit("/"), F.array_join(F.concat(home, F.filter(tokens, lambda t: ~t.isin("", "~"))), "/"))
    return F.when(dynamic | (private & node.isNull()), name).otherwise(full)


def type_parts(raw: Column) -> Column:
    """Package, namespace and name of a type as written in either language, as an array; null for other expressions."""
    tokens = F.filter(scanned(raw, TYPE_TOKENS), lambda t: ~t["kind"].isin("c", "m"))
    # spaces that a qualifier or mark leaves behind each other are one
    kinds = F.regexp_replace(_kinds(tokens), "s+", "s")
    wrappers = F.length(F.regexp_replace(F.regexp_extract(kinds, TYPE, WRAPPED), "j", ""))
    words = _texts(F.filter(tokens, lambda t: t["kind"].isin("w", "p")))
    return F.when(kinds.rlike(TYPE), F.slice(words, F.lit(1), F.size(words) - wrappers))


def interface_type(raw: Column) -> Column:
    """``package/namespace/Type``, or fewer parts where fewer are written."""
    return F.array_join(type_parts(raw), "/")


def refined_kind(kind: Column, type_: Column) -> Column:
    """topic, service or action as the type's own namespace says, else ``kind``."""
    parts = F.split(type_, "/")
    return F.coalesce(*(F.when(F.array_contains(parts, space), meant) for space, meant in reversed(NAMESPACES.items())), kind)


def interfaces(sites: DataFrame) -> DataFrame:
    """(kind, name, dynamic, node, side, type) of call sites (node, raw_name, literal, raw_type, kind, side), each once.

    Sites without a usable name or without a node are left out; sides are ``provides`` and ``uses``.
    """
    literal = F.coalesce("literal", F.lit(False))
    named = sites.where("node IS NOT NULL").select("node", "side", (~literal).alias("dynamic"), interface_name(F.col("raw_name"), literal).alias("written"), interface_type(F.col("raw_type")).alias("type"), "kind").where("written IS NOT NULL")
    name = resolved_name(F.col("written"), F.col("node"), F.col("dynamic"))
    return named.select(refined_kind(F.col("kind"), F.col("type")).alias("kind"), name.alias("name"), "dynamic", "node", "side", "type").distinct()


def overview(found: DataFrame, only_connected: bool = False) -> DataFrame:
    """(kind, name, dynamic, providers, users, types): how many nodes are on either side of each interface, and its types' number.

    Counts, not lists, since one interface may have very many nodes. ``only_connected`` keeps those with both sides.
    """
    side = {n: F.count_distinct(F.when(F.col("side") == s, F.col("node"))).alias(n) for n, s in (("providers", "provides"), ("users", "uses"))}
    out = found.groupBy("kind", "name", "dynamic").agg(side["providers"], side["users"], F.count_distinct("type").alias("types"))
    return out.where("providers > 0 AND users > 0") if only_connected else out
