"""Line-oriented triple files, multi-source merging, a Parquet triple store, and text sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import number

#: Fixed patterns of N-Triples and N-Quads terms.
IRI, BLANK = r"<([^\x00-\x20<>\"{}|^`\\]*)>", r"(_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.·-]*[\p{L}\p{N}_·-])?)"
LITERAL = r'"((?:[^"\\\n\r]|\\.)*)"(?:@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|\^\^<([^\x00-\x20<>]*)>)?'
LINE = rf"^\s*(?:{IRI}|{BLANK})\s*{IRI}\s*(?:{IRI}|{BLANK}|{LITERAL})\s*(?:{IRI}|{BLANK})?\s*\.\s*(?:#.*)?$"
TERM = "struct<kind: string, lex: string, dt: string, lang: string>"


def _unescaped(x: Column) -> Column:
    for old, new in ((r"\t", "\t"), (r"\n", "\n"), (r"\r", "\r"), (r"\"", '"')):
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.replace(x, F.lit("\\\\"), F.lit("\\"))


def _term(iri: Column, blank: Column, lit: Column | None = None, lang: Column | None = None, dt: Column | None = None) -> Column:
    make = lambda kind, lex, d, g: F.struct(F.lit(kind).alias("kind"), lex.alias("lex"), d.alias("dt"), g.alias("lang"))
    none = F.lit("")
    out = F.when(iri != "", make("I", iri, none, none)).when(blank != "", make("B", blank, none, none))
    return out if lit is None else out.otherwise(make("L", _unescaped(lit), dt, lang))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o, g) terms from lines of N-Triples or N-Quads; g is null without a graph. Blank lines and comments are skipped.

    A line in any richer syntax gives a row with null s, for the caller to refuse or to treat otherwise.
    """
    line = F.col(column)
    text = lines.where(~line.rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract(line, LINE, k)
    ok = line.rlike(LINE)
    return text.select(
        F.when(ok, _term(part(1), part(2))).alias("s"), F.when(ok, part(3)).alias("p"), F.when(ok, _term(part(4), part(5), part(6), part(7), part(8))).alias("o"),
        F.when(ok, F.nullif(F.concat(part(9), part(10)), F.lit(""))).alias("g"),
    )


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Triples of several files, with column source; blank nodes of different files stay different."""
    out = None
    for k, path in enumerate(paths):
        t = parse_lines(spark.read.text(path)).withColumn("source", F.lit(k))
        for c in ("s", "o"):
            t = t.withColumn(c, F.when(F.col(c)["kind"] == "B", F.col(c).withField("lex", F.concat(F.lit(f"_:s{k}_"), F.substring(F.col(c)["lex"], F.lit(3), F.length(F.col(c)["lex"]))))).otherwise(F.col(c)))
        out = t if out is None else out.unionByName(t)
    return out


def content(spark: SparkSession, paths: DataFrame, path: str = "path") -> DataFrame:
    """log:content: paths (a short list of names that Spark can read) with column content, the whole text of each file."""
    names = [r[0] for r in paths.select(path).distinct().collect()]
    files = spark.read.text(names, wholetext=True).select(F.input_file_name().alias("__file"), F.col("value").alias("content"))
    tail = F.regexp_replace(F.col(path), "^[a-z0-9]+:/+", "/")
    return paths.join(files.withColumn("__file", F.regexp_replace("__file", "^[a-z0-9]+:/+", "/")), tail == F.col("__file"), "left").drop("__file")


def text(term: Column) -> Column:
    """A term as N-Triples text."""
    quoted = term["lex"]
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(old), F.lit(new))
    tail = F.when(term["lang"] != "", F.concat(F.lit("@"), term["lang"])).when(term["dt"] != "", F.concat(F.lit("^^<"), term["dt"], F.lit(">"))).otherwise("")
    return F.when(term["kind"] == "I", F.concat(F.lit("<"), term["lex"], F.lit(">"))).when(term["kind"] == "B", term["lex"]).otherwise(F.concat(F.lit('"'), quoted, F.lit('"'), tail))


def lines(facts: DataFrame) -> DataFrame:
    """Facts (s, p, o) of terms as lines of text, column value."""
    return facts.select(F.concat(text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), text(F.col("o")), F.lit(" .")).alias("value"))


def save(facts: DataFrame, path: str, kind: str = "explicit", mode: str = "append", rows: int = 1_000_000) -> None:
    """Adds facts to a Parquet store: a folder for each kind (explicit, inferred) and predicate, sorted by subject and object.

    A predicate's facts are dealt by their subjects to a task for each so many ``rows``: one that most facts have isn't
    written by one task, and a rare one is one file.
    """
    share = facts.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / rows).alias("__files")).withColumnRenamed("p", "__p")
    dealt = facts.join(share, F.col("p") == F.col("__p")).withColumn("__file", F.pmod(F.xxhash64("s"), F.col("__files"))).drop("__p", "__files")
    dealt = dealt.withColumn("kind", F.lit(kind)).repartition("p", "__file").sortWithinPartitions("p", "s", "o").drop("__file")
    dealt.write.partitionBy("kind", "p").mode(mode).parquet(path)


def load(spark: SparkSession, path: str, s: str | None = None, p: str | None = None, o: str | None = None, kind: str | None = None) -> DataFrame:
    """Facts of a store that match the bound places; p and kind prune folders, s and o skip row groups."""
    out = spark.read.parquet(path)
    for column, value in (("s", s), ("p", p), ("o", o), ("kind", kind)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.select("s", "p", "o", "kind")


def rows(facts: DataFrame) -> Iterator[tuple]:
    """Facts one by one on the driver, a partition at a time, for a program that consumes them as they come."""
    return (tuple(r) for r in facts.toLocalIterator(prefetchPartitions=True))


def derived(facts: DataFrame, asserted: DataFrame) -> DataFrame:
    """What saturation added: the facts that weren't asserted."""
    return facts.join(asserted, ["s", "p", "o"], "left_anti")


def output_string(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One text of all values in the order of their keys: numbers by value first, then the others by code point.

    One row with everything, so only for output that a person reads.
    """
    by = number(key)
    order = F.struct(by.isNull().alias("__text"), by.alias("__number"), F.col(key).alias("__key"), F.col(value).alias(value))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x[value]), "").alias("text"))
