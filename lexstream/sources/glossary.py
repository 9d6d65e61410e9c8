"""Glossary and case files as DataFrames.

A glossary file is a small YAML (or JSON) document.  ``binaryFile`` reads it where the cluster can
see it; one document is one row, parsed in a task, and its parts become dimension tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERMS = "term_id string, domains array<string>, priority int, policy string, declaration_order int"
FORMS = (
    "term_id string, lang string, form string, form_order int, canonical string, is_alias boolean, boost double"
)
SPOKEN = "term_id string, lang string, spoken_form string"

_FORM = "struct<canonical:string,aliases:array<string>,asr_boost:double>"
_ENTRY = (
    f"struct<id:string,domain:array<string>,priority:int,translation_policy:string,"
    f"forms:map<string,{_FORM}>,tts:map<string,struct<spoken_form:string>>>"
)
_BUNDLE = (
    f"bundle_id string, schema_version int, description string, default_domains array<string>, "
    f"entries array<{_ENTRY}>"
)
_CASE = (
    "struct<id:string,category:string,domain:string,source_language:string,target_language:string,"
    "source:string,chunks:array<string>,route:array<string>,"
    "expected_terms:array<struct<term_id:string,target:string>>,excluded_terms:array<string>>"
)


@dataclass(frozen=True)
class Glossary:
    """Dimension tables of one or more bundles."""

    terms: DataFrame
    forms: DataFrame
    spoken: DataFrame
    default_domains: list[str]


def _as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        docs = [json.dumps(yaml.safe_load(bytes(c)), ensure_ascii=False, default=str) for c in b["content"]]
        yield pd.DataFrame({"path": b["path"], "doc": docs})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): each YAML or JSON file as a JSON string."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_as_json, "path string, doc string")


def unknown_fields(docs: DataFrame) -> DataFrame:
    """(path, at, field): keys that a bundle, an entry, a form or a spoken form must not have."""
    keys = lambda j: F.coalesce(F.json_object_keys(j), F.array().cast("array<string>"))
    obj = lambda c, path: F.get_json_object(c, path)
    entries = F.posexplode(F.from_json(obj(F.col("doc"), "$.entries"), "array<string>"))
    top = docs.select("path", F.lit("bundle").alias("at"), F.explode(keys(F.col("doc"))).alias("field"))
    e = docs.select("path", entries.alias("i", "e"))
    entry = e.select("path", F.concat(F.lit("entries["), "i", F.lit("]")).alias("at"), F.explode(keys(F.col("e"))).alias("field"))
    parts = [(top, ["bundle_id", "schema_version", "description", "default_domains", "entries"]),
             (entry, ["id", "domain", "priority", "translation_policy", "forms", "tts"])]
    for name, allowed in (("forms", ["canonical", "aliases", "asr_boost"]), ("tts", ["spoken_form"])):
        m = e.select("path", "i", F.explode(F.from_json(obj(F.col("e"), f"$.{name}"), "map<string,string>")).alias("lang", "f"))
        at = F.concat(F.lit("entries["), "i", F.lit(f"].{name}."), "lang")
        parts.append((m.select("path", at.alias("at"), F.explode(keys(F.col("f"))).alias("field")), allowed))
    out = None
    for df, allowed in parts:
        bad = df.filter(~F.col("field").isin(allowed))
        out = bad if out is None else out.unionByName(bad)
    return out


#: The one schema version that is read.
SCHEMA_VERSION = 1


def bundle_violations(docs: DataFrame) -> DataFrame:
    """Every breach of the rules for a bundle as (path, rule, detail): its id, schema version, description, default
    domains, entries, and fields that it must not have.  Takes (path, doc) as ``read_documents`` gives them.
    """
    obj = lambda name: F.get_json_object("doc", f"$.{name}")
    listed = F.from_json(obj("default_domains"), "array<string>")
    blank = lambda c: F.coalesce(~c.rlike("[^\\s\\p{Z}]"), F.lit(True))
    has = F.array_contains(F.coalesce(F.json_object_keys("doc"), F.array().cast("array<string>")), F.lit("default_domains"))
    entries = F.from_json(obj("entries"), "array<string>")
    rules = [
        ("bundle_id", blank(obj("bundle_id")), obj("bundle_id")),
        ("schema_version", F.coalesce(obj("schema_version") != str(SCHEMA_VERSION), F.lit(True)), obj("schema_version")),
        ("default_domains", has & (listed.isNull() | F.exists(listed, lambda d: d.isNull() | blank(d))), obj("default_domains")),
        ("duplicate_default_domain", F.size(listed) > F.size(F.array_distinct(listed)), obj("default_domains")),
        ("entries", F.coalesce(F.size(entries) < 1, F.lit(True)), obj("entries")),
    ]
    breach = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(name).alias("rule"), F.coalesce(detail, F.lit("")).alias("detail"))) for name, bad, detail in rules
    ]))
    out = docs.select("path", F.explode(breach).alias("b")).select("path", "b.rule", "b.detail")
    odd = unknown_fields(docs).select("path", F.lit("unknown_field").alias("rule"), F.concat("at", F.lit("."), "field").alias("detail"))
    return out.unionByName(odd)


def load_glossary(spark: SparkSession, path: str) -> Glossary:
    """Terms, forms and spoken forms of the bundle at ``path``, in declaration order."""
    doc = read_documents(spark, path).select(F.from_json("doc", _BUNDLE).alias("b")).select("b.*")
    domains = doc.select(F.explode("default_domains").alias("d")).distinct().orderBy("d").collect()
    e = doc.select(F.posexplode("entries").alias("declaration_order", "e"))
    terms = e.select(
        F.trim("e.id").alias("term_id"),
        F.transform("e.domain", lambda d: F.trim(d)).alias("domains"),
        F.col("e.priority").alias("priority"),
        F.col("e.translation_policy").alias("policy"),
        "declaration_order",
    )
    per_lang = e.select(F.trim("e.id").alias("term_id"), F.explode("e.forms").alias("lang", "f"))
    every = F.concat(F.array("f.canonical"), F.coalesce("f.aliases", F.array().cast("array<string>")))
    forms = per_lang.select(
        "term_id", "lang", F.col("f.canonical").alias("canonical"), F.col("f.asr_boost").alias("boost"),
        F.posexplode(every).alias("form_order", "form"),
    ).select(
        "term_id", "lang", F.trim("form").alias("form"), "form_order", F.trim("canonical").alias("canonical"),
        (F.col("form_order") > 0).alias("is_alias"), "boost",
    )
    spoken = e.select(F.trim("e.id").alias("term_id"), F.explode("e.tts").alias("lang", "t")).select(
        "term_id", "lang", F.trim("t.spoken_form").alias("spoken_form")
    )
    return Glossary(terms, forms, spoken, [r["d"] for r in domains])


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases, one row each, with expected and excluded terms as arrays."""
    doc = read_documents(spark, path).select(F.from_json("doc", f"cases array<{_CASE}>").alias("d"))
    c = doc.select(F.explode("d.cases").alias("c"))
    return c.select(
        F.col("c.id").alias("case_id"), "c.category", "c.domain", "c.source_language", "c.target_language",
        "c.source", "c.chunks", "c.route", F.col("c.expected_terms").alias("expected"),
        F.col("c.excluded_terms").alias("excluded"),
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
