"""Entities and their names."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions import text as T


def entity_display(c: Column) -> Column:
    """Compatibility form (NFKC, which has no built-in function) with single spaces."""
    def compose(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return F.trim(F.regexp_replace(F.pandas_udf(compose, "string")(F.coalesce(c, F.lit(""))), r"[\s\p{Z}]+", " "))


def same_identity(names: DataFrame) -> DataFrame:
    """(name) -> keys that several names share, with those names: one group by key, no pairs."""
    keyed = names.select(T.entity_key(F.col("name")).alias("entity_key"), "name").filter("entity_key <> ''").distinct()
    return keyed.groupBy("entity_key").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"), F.max("name").alias("last_name")).filter("n_names > 1")


def entity_build(mentions: DataFrame) -> DataFrame:
    """(corpus_id, name, mention_id, chunk_id) -> one entity per key: name and chunk of the first mention, number of mentions."""
    keyed = mentions.withColumn("entity_key", T.entity_key(F.col("name"))).filter("entity_key <> ''")
    first = F.min(F.struct("mention_id", "name", "chunk_id"))
    out = keyed.groupBy("corpus_id", "entity_key").agg(first.alias("first"), F.count("*").alias("support_count"))
    return out.select("corpus_id", "entity_key", F.col("first.name").alias("display_name"), F.col("first.chunk_id").alias("first_seen_chunk_id"), "support_count")


def entity_resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each name: attached to a live entity of its key, else to that of an alias, else new; too short ones need review."""
    keyed = names.withColumn("entity_key", T.entity_key(F.col("name")))
    live = entities.filter("resolution_state <> 'MERGE'").select("corpus_id", "entity_key", F.col("entity_id").alias("by_key"))
    known = aliases.select("corpus_id", F.col("alias_key").alias("entity_key"), F.col("entity_id").alias("by_alias"))
    both = keyed.join(live, ["corpus_id", "entity_key"], "left").join(known, ["corpus_id", "entity_key"], "left")
    found = F.coalesce("by_key", "by_alias")
    action = F.when(F.length("entity_key") < 2, "NEEDS_REVIEW").when(found.isNotNull(), "ATTACH").otherwise("CREATE")
    return both.select(*names.columns, "entity_key", action.alias("action"), F.when(action == "ATTACH", found).alias("entity_id"))


def alias_add(aliases: DataFrame) -> DataFrame:
    """(corpus_id, alias, entity_id) -> per alias key: support, or a conflict if entities claim it."""
    keyed = aliases.withColumn("alias_key", T.entity_key(F.col("alias"))).filter("alias_key <> ''")
    each = keyed.groupBy("corpus_id", "alias_key", "entity_id").agg(F.count("*").alias("n"))
    out = each.groupBy("corpus_id", "alias_key").agg(F.count("*").alias("n_entities"), F.min("entity_id").alias("entity_id"), F.sum("n").alias("support_count"))
    return out.withColumn("state", F.when(F.col("n_entities") > 1, "CONFLICT").otherwise("OK"))


def entity_listing(entities: DataFrame) -> DataFrame:
    return entities.filter("resolution_state <> 'MERGE'").orderBy(F.desc("support_count"), "display_name")


def entity_search(entities: DataFrame, part: str, most: int = 200) -> DataFrame:
    """Live entities whose name or key has the part in it, the most supported first."""
    low = F.lit(part.lower())
    hit = F.contains(F.lower("display_name"), low) | F.contains(F.col("entity_key"), low)
    return entities.filter("resolution_state <> 'MERGE'").filter(hit).orderBy(F.desc("support_count"), "display_name").limit(most)


def entity_profile(entities: DataFrame, aliases: DataFrame, triples: DataFrame) -> DataFrame:
    """Entities with the number and first of their aliases and their approved relations."""
    a = aliases.groupBy("entity_id").agg(F.count("*").alias("n_aliases"), F.min("alias").alias("first_alias"))
    r = triples.filter("status = 'APPROVED'").withColumn("entity_key", T.entity_key(F.col("subject_text")))
    r = r.groupBy("corpus_id", "entity_key").agg(F.count("*").alias("n_relations"), F.countDistinct("predicate").alias("n_predicates"))
    out = entities.join(a, "entity_id", "left").join(r, ["corpus_id", "entity_key"], "left")
    return out.fillna(0, ["n_aliases", "n_relations", "n_predicates"])


def entity_profile_nested(entities: DataFrame, aliases: DataFrame, relations: DataFrame, key: list[str]) -> DataFrame:
    """Entities with their sorted aliases and outgoing relations (predicate, object) inside, empty where there are none."""
    a = aliases.groupBy(*key).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    r = relations.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("predicate", "object"))).alias("relations"))
    out = entities.join(a, key, "left").join(r, key, "left")
    return out.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "relations": F.coalesce("relations", F.array().cast("array<struct<predicate:string,object:string>>"))})
