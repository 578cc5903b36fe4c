"""Metadata of a geodatabase: items, domains, subtypes, groups, relationships and spatial references, as DataFrames.

The XML of definitions is taken apart by Column expressions, so metadata of many databases can be read
like any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.text import attribute_text, leaf_name, parent_path, tag_blocks, tag_text


def layer_item(items: DataFrame, name: str) -> DataFrame:
    """The first item of the name, or of the physical name, in any case; items: fid, name, physical_name, ..."""
    wanted = name.lower()
    return items.where((F.lower("name") == wanted) | (F.lower("physical_name") == wanted)).orderBy("fid").limit(1)


def spatial_reference(refs: DataFrame, wkid: int) -> DataFrame:
    return refs.where(F.col("wkid") == wkid).limit(1)


def _first(*columns: Column) -> Column:
    """The first that is not empty."""
    out = columns[-1]
    for c in reversed(columns[:-1]):
        out = F.when(c != "", c).otherwise(out)
    return out


def domains(items: DataFrame) -> DataFrame:
    """Coded and range domains of all definitions; items: definition."""
    xml = F.col("definition")
    listed = xml.contains("<Domain>") | xml.contains("<Domain ")
    own = F.when(listed, tag_blocks(xml, "Domain")).otherwise(F.array(xml))
    # a definition may be a domain itself; fields of tables name domains too, but are none
    block = items.where(listed | xml.contains("Domain2")).select(F.explode(own).alias("b"))
    b = F.col("b")
    codes = F.transform(tag_blocks(b, "CodedValue"), lambda c: F.struct(tag_text(c, "Code").alias("code"), tag_text(c, "Name").alias("name")))
    out = block.select(
        _first(tag_text(b, "DomainName"), tag_text(b, "Name")).alias("name"),
        _first(attribute_text(b, "xsi:type"), F.lit("Domain")).alias("type"),
        tag_text(b, "FieldType").alias("field_type"),
        tag_text(b, "Description").alias("description"),
        tag_text(b, "MergePolicy").alias("merge_policy"),
        tag_text(b, "SplitPolicy").alias("split_policy"),
        tag_text(b, "MinValue").alias("min_value"),
        tag_text(b, "MaxValue").alias("max_value"),
        codes.alias("coded_values"),
    )
    return out.where((F.col("name") != "") | (F.size("coded_values") > 0) | (F.col("min_value") != "") | (F.col("max_value") != ""))


def subtypes(items: DataFrame) -> DataFrame:
    """code, name and default of every subtype in the definitions."""
    b = F.col("b")
    found = items.select(F.explode(tag_blocks(F.col("definition"), "Subtype")).alias("b")).select(
        F.coalesce(F.expr("try_cast(regexp_extract(b, '(?s)<SubtypeCode>\\\\s*(-?[0-9]+)', 1) as int)"), F.lit(0)).alias("code"), _first(tag_text(b, "SubtypeName"), tag_text(b, "Name")).alias("name"), tag_text(b, "DefaultValue").alias("default_value")
    )
    return found.where((F.col("code") != 0) | (F.col("name") != ""))


def field_bindings(items: DataFrame) -> DataFrame:
    """table, field, domain: fields whose definition names a domain."""
    b = F.col("b")
    found = items.select(F.col("name").alias("table"), F.explode(tag_blocks(F.col("definition"), "GPFieldInfoEx")).alias("b"))
    return found.select("table", tag_text(b, "Name").alias("field"), tag_text(b, "DomainName").alias("domain")).where("domain <> ''")


def relationship_attributes(items: DataFrame) -> DataFrame:
    """Cardinality, labels and keys of relationship classes."""
    xml = F.col("definition")
    keys = tag_blocks(xml, "RelationshipClassKey")

    def key(role: str) -> Column:
        return F.coalesce(F.get(F.filter(F.transform(keys, lambda k: F.struct(tag_text(k, "KeyRole").alias("role"), tag_text(k, "ObjectKeyName").alias("name"))), lambda k: k["role"] == role), F.lit(0))["name"], F.lit(""))

    return items.where(xml.contains("<Cardinality>")).select(
        "name",
        F.regexp_replace(tag_text(xml, "Cardinality"), "^esriRelCardinality", "").alias("cardinality"),
        tag_text(xml, "ForwardPathLabel").alias("forward_label"),
        tag_text(xml, "BackwardPathLabel").alias("backward_label"),
        key("esriRelKeyRoleOriginPrimary").alias("origin_primary_key"),
        key("esriRelKeyRoleOriginForeign").alias("origin_foreign_key"),
        (F.lower(tag_text(xml, "IsAttributed")) == "true").alias("is_attributed"),
        (F.lower(tag_text(xml, "IsComposite")) == "true").alias("is_composite"),
    )


def groups(items: DataFrame) -> DataFrame:
    """parent, members by name; items: path."""
    return items.select(parent_path(F.col("path")).alias("parent"), leaf_name(F.col("path")).alias("name")).groupBy("parent").agg(F.sort_array(F.collect_list("name")).alias("members"))
