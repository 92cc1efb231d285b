"""Building a name vocabulary: frequencies, salts, brands, strengths, canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.names import bracket_brand, has_dose, ingredient_head

NAME_TYPES, SYNONYM_TYPES, PRODUCT_TYPES = ("IN", "BN", "PIN"), ("SY", "TMSY"), ("SCD", "SBD", "PSN")
CANONICAL_ORDER = ("IN", "PIN", "BN", "PSN", "SCD", "SBD", "SY", "TMSY")
BEST_ORDER = ("IN", "PIN", "BN", "TMSY", "SY")


def type_rank(tty: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(tty == t, i) for i, t in enumerate(order)), F.lit(99))


def route_names(concepts: DataFrame) -> DataFrame:
    """F-01/F-02: 'name' (names, and synonyms without a dose), 'product', or 'other' per concept row."""
    tty = F.upper(F.trim("tty"))
    target = F.when(tty.isin(*NAME_TYPES) | (tty.isin(*SYNONYM_TYPES) & ~has_dose(F.col("str"))), "name").when(tty.isin(*PRODUCT_TYPES), "product").otherwise("other")
    return concepts.withColumn("target", target)


def ingredient_frequency(products: DataFrame) -> DataFrame:
    """A-01/A-02: marketed products per ingredient key, and the prior log1p(n) / log1p(max)."""
    tty = F.upper(F.trim("tty"))
    counted = products.where(tty.isin("SCD", "SBD") & (F.trim("ingredient_key") != "")).groupBy(F.col("ingredient_key")).agg(F.count("*").alias("product_count"))
    top = counted.agg(F.max("product_count")).first()[0] or 1
    return counted.withColumn("prior", F.round(F.least(F.lit(1.0), F.log1p("product_count") / F.log1p(F.lit(top))), 9))


def salt_pairs(names: DataFrame, products: DataFrame) -> DataFrame:
    """J-13/J-14/A-03/A-04: ingredients with at least two salts, and those salts.

    A precise ingredient belongs to the ingredient that its salt-free key names.
    It must be marketed (a product has its full key) if ``products`` is given.
    """
    own = names.where("tty = 'IN'").select(F.col("rxcui").alias("in_rxcui"), F.col("key").alias("in_key"))
    salts = names.where("tty = 'PIN'").select(F.col("rxcui").alias("pin_rxcui"), F.col("str").alias("pin_name"), F.col("key").alias("pin_key"), F.col("salt_key").alias("in_key"))
    pairs = salts.join(own, "in_key").where("pin_key <> in_key")
    marketed = products.select(F.lower(F.trim("ingredient_full_key")).alias("pin_key")).distinct()
    pairs = pairs.withColumn("marketed", F.lit(True)).join(marketed, "pin_key", "left_semi")
    one = pairs.groupBy("in_rxcui", "in_key", "pin_rxcui").agg(F.min("pin_name").alias("pin_name"))
    many = one.groupBy("in_rxcui").agg(F.count_distinct("pin_rxcui").alias("n_salts")).where("n_salts >= 2")
    return one.join(many, "in_rxcui")


def brand_pairs(products: DataFrame) -> DataFrame:
    """J-15/A-05: distinct (brand_key, ingredient_key) of branded products, with the first brand name by code and the number of products."""
    pairs = products.select("rxcui", bracket_brand(F.col("str")).alias("brand_name"), ingredient_head(F.col("str")).alias("ingredient_name")).where("brand_name is not null and ingredient_name <> ''")
    keyed = pairs.withColumn("brand_key", F.lower("brand_name")).withColumn("ingredient_key", F.lower("ingredient_name"))
    return keyed.groupBy("brand_key", "ingredient_key").agg(F.min_by("brand_name", F.struct("rxcui", "brand_name")).alias("brand_name"), F.count("*").alias("n"))


def brand_ingredients(products: DataFrame, top: int = 12, per: str = "ingredient_key") -> DataFrame:
    """J-15/A-05/T-03/T-04: brand and ingredient pairs of branded products, ranked per ingredient (or per brand).

    Display names are those of the first product (by rxcui); ties go by name.
    """
    counted = brand_pairs(products)
    order = Window.partitionBy(per).orderBy(F.desc("n"), "brand_key", "ingredient_key")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def strengths(products: DataFrame) -> DataFrame:
    """J-16/X-21: distinct strengths (first amount and unit of each product) per ingredient."""
    unit = F.lower(F.regexp_extract("str", r"(\d+(?:\.\d+)?)\s*(MG|MCG|ML|G|UNT)\b", 2))
    amount = F.regexp_extract("str", r"(\d+(?:\.\d+)?)\s*(MG|MCG|ML|G|UNT)\b", 1)
    parsed = products.select("ingredient_key", amount.alias("amount"), F.when(unit == "unt", "unit").when(unit == "ml", "mL").otherwise(unit).alias("unit")).where("amount <> '' and ingredient_key is not null")
    return parsed.groupBy("ingredient_key", "unit").agg(F.count("*").alias("n_products"), F.count_distinct("amount").alias("n_strengths"), F.min(F.col("amount").cast("double")).alias("least"), F.max(F.col("amount").cast("double")).alias("most"))


def dose_forms(products: DataFrame, forms: DataFrame) -> DataFrame:
    """X-05/S-04: the longest known form that a product's string (without brand) ends with.

    Every suffix of whole words is looked up, so products and forms meet in an
    equi-join however long the list of forms is.
    """
    base = F.lower(F.trim(F.regexp_replace("str", r"\s*\[[^\]]*\]\s*$", "")))
    words = products.select("rxcui", F.split(base, " ").alias("w")).distinct()
    suffixes = words.select("rxcui", F.explode(F.expr("transform(sequence(2, greatest(2, size(w))), i -> array_join(slice(w, i, greatest(0, size(w) - i + 1)), ' '))")).alias("form")).where("form <> ''")
    known = forms.select(F.lower(F.trim("dose_form")).alias("form")).where("form <> ''").distinct()
    return suffixes.join(known, "form").groupBy("rxcui").agg(F.max_by("form", F.length("form")).alias("form"))


def canonical_names(names: DataFrame) -> DataFrame:
    """T-05: per code the name of the best type, then the shortest, then the first."""
    rank = F.struct(type_rank(F.col("tty"), CANONICAL_ORDER), F.length("str"), F.col("str"))
    return names.groupBy("rxcui").agg(F.min_by(F.struct("str", "tty"), rank).alias("c")).select("rxcui", F.col("c.str").alias("canonical_name"), F.col("c.tty").alias("tty"))
