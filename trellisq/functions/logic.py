"""log: terms as structs (kind, lex, dt, lang), equality keys, and functions on them.

kind: I (IRI), L (literal), B (blank node), T (list), G (graph). Three equalities hold between terms, so joins and
deduplication use keys: ``unify_key`` for matching and ``known_key`` for "is this fact known". Numbers are equal only
within one datatype, the integer types count as one, plain text is a string, and truth values match by value but are
different facts when they're spelt differently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, number
from .datatypes import INTEGERS, canonical

XSD = "http://www.w3.org/2001/XMLSchema#"


def term(kind: str, lex, dt=None, lang=None) -> Column:  # noqa: ANN001
    text = lambda x: F.lit("") if x is None else col(x).cast("string")
    return F.struct(F.lit(kind).alias("kind"), text(lex).alias("lex"), text(dt).alias("dt"), text(lang).alias("lang"))


def _literal_key(t: Column, by_value: bool) -> Column:
    dt = F.when(t["dt"].isin("", f"{XSD}string"), F.lit("string")).when(t["dt"].isin(*[XSD + i for i in INTEGERS]), F.lit("integer")).otherwise(t["dt"])
    value = F.when(dt == "integer", F.coalesce(canonical(t["lex"], "integer"), t["lex"])).when(t["dt"] == f"{XSD}decimal", F.coalesce(canonical(t["lex"], "decimal"), t["lex"]))
    value = value.when(t["dt"].isin(f"{XSD}double", f"{XSD}float"), F.coalesce(number(t["lex"]).cast("string"), t["lex"]))
    if by_value:
        value = value.when(t["dt"] == f"{XSD}boolean", F.coalesce(canonical(t["lex"], "boolean"), t["lex"]))
    return F.concat_ws("|", F.lit("L"), dt, F.lower(t["lang"]), value.otherwise(t["lex"]))


def unify_key(t) -> Column:  # noqa: ANN001
    """Equal for terms that match."""
    t = col(t)
    return F.when(t["kind"] == "L", _literal_key(t, True)).otherwise(F.concat_ws("|", t["kind"], t["lex"]))


def known_key(t) -> Column:  # noqa: ANN001
    """Equal for terms that are the same in known facts."""
    t = col(t)
    return F.when(t["kind"] == "L", _literal_key(t, False)).otherwise(F.concat_ws("|", t["kind"], t["lex"]))


def raw_type(t) -> Column:  # noqa: ANN001
    kind = col(t)["kind"]
    return F.when(kind == "G", "log:Formula").when(kind == "L", "log:Literal").when(kind == "T", "rdf:List").otherwise("log:Other")


def uri_text(t) -> Column:  # noqa: ANN001
    return F.when(col(t)["kind"] == "I", col(t)["lex"])


def text_uri(s) -> Column:  # noqa: ANN001
    """An IRI from text; null where a character isn't allowed in one."""
    return F.when(~col(s).rlike(r'[\x00-\x20<>"{}|^`\\]'), term("I", s))


def skolem(*key) -> Column:  # noqa: ANN002
    """A name in place of an existential: the same for the same key."""
    return F.concat(F.lit("_:sk_"), F.substring(F.sha2(F.to_json(F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(key)])), 256), 1, 24))


BUILTINS = {
    "log:equalTo": lambda a, b: col(a).eqNullSafe(col(b)) & col(a).isNotNull(),
    "log:notEqualTo": lambda a, b: F.coalesce(col(a) != col(b), F.lit(False)),
    "log:rawType": raw_type,
    "log:dtlit": lambda lex, dt: term("L", lex, dt),
    "log:langlit": lambda lex, lang: term("L", lex, None, lang),
    "log:uri": uri_text,
    "log:skolem": skolem,
    "log:conjunction": lambda *graphs: F.array_distinct(F.flatten(F.array(*map(col, graphs)))),
}
#: For a bound result: a literal's text and datatype (plain text is a string), or its text and language tag; null for other terms.
INVERSES = {
    "log:dtlit": lambda t: F.when((col(t)["kind"] == "L") & (col(t)["lang"] == ""), F.struct(col(t)["lex"].alias("lex"), F.when(col(t)["dt"] == "", f"{XSD}string").otherwise(col(t)["dt"]).alias("dt"))),
    "log:langlit": lambda t: F.when((col(t)["kind"] == "L") & (col(t)["lang"] != ""), F.struct(col(t)["lex"].alias("lex"), col(t)["lang"].alias("lang"))),
    "log:uri": text_uri,
}
