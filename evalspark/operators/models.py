"""Turning the names people type into catalogue models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.identity import short_model


def model_aliases(models: DataFrame) -> DataFrame:
    """(alias, model): full, short and enum name in lower case; the last entry wins a clash."""
    names = F.array(F.col("model"), short_model(F.col("model")), F.col("enum_name"))
    return (
        models.select("position", "model", F.explode(names).alias("name"))
        .groupBy(F.lower("name").alias("alias"))
        .agg(F.max_by("model", "position").alias("model"))
    )


def alias_prefixes(models: DataFrame) -> DataFrame:
    """(prefix, resolved): what every possible beginning of an alias stands for.

    An exact alias wins; otherwise the prefix must begin exactly one alias. Listing prefixes
    makes the lookup an equi-join; the table is as small as the catalogue (its size is the sum
    of the alias lengths) and does not depend on the requests.
    """
    lengths = F.sequence(F.lit(0), F.length("alias"))
    prefixes = model_aliases(models).select(
        "alias",
        "model",
        F.explode(F.transform(lengths, lambda n: F.left(F.col("alias"), n))).alias("prefix"),
    )
    exact = F.max(F.when(F.col("prefix") == F.col("alias"), F.col("model")))
    only = F.when(F.count("*") == 1, F.max("model"))
    return prefixes.groupBy("prefix").agg(F.coalesce(exact, only).alias("resolved"))


def resolve_models(requests: DataFrame, models: DataFrame, name: str = "name") -> DataFrame:
    """Add ``model`` to the requests: the catalogue model meant by ``name``, NULL if unclear.

    Names repeat, often heavily, so the distinct ones are resolved and then joined back.
    """
    key = F.lower(F.col(name))
    known = (
        requests.select(key.alias("prefix"))
        .distinct()
        .join(alias_prefixes(models), "prefix")
        .filter(F.col("resolved").isNotNull())
    )
    return (
        requests.withColumn("prefix", key)
        .join(known, "prefix", "left")
        .select(*requests.columns, F.col("resolved").alias("model"))
    )


def available_models(models: DataFrame) -> Column:
    """The sorted distinct short names of the catalogue, as an array (a scalar subquery)."""
    names = F.sort_array(F.collect_set(short_model(F.col("model"))))
    return models.agg(names).scalar()


def unresolved_models(requests: DataFrame, models: DataFrame, name: str = "name") -> DataFrame:
    """(name, available): the distinct names that mean no model, with what could be asked for."""
    unclear = resolve_models(requests.select(name).distinct(), models, name)
    return unclear.filter(F.col("model").isNull()).select(
        name, available_models(models).alias("available")
    )
