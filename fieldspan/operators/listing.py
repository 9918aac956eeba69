"""Names, keys and listings: classified outputs, report manifests, tiles, content keys, registries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Names that match `pattern` (a regular expression for the whole name) are of a category and group. Labels are templates:
    {2} is the pattern's second part, {2:title} the same in title case with blanks for underscores, {2:02} as a number of two
    digits; {variant} is the variant. Variant, year and page are numbers of parts."""

    pattern: str
    category: str
    group: str = ""
    label: str = "{0}"
    variant: int | None = None
    year: int | None = None
    page: int | None = None


_BLANK = re.compile(r"\{(\w+)(?::(\w+))?\}")


def _title(c: Column) -> Column:
    runs = F.regexp_extract_all(F.translate(c, "_", " "), F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def _filled(template: str, part, variant: Column) -> Column:
    out, at = [], 0
    for m in _BLANK.finditer(template):
        value = variant if m[1] == "variant" else part(int(m[1]))
        if m[2] == "title":
            value = _title(value)
        elif m[2]:
            value = F.format_string(f"%{m[2]}d", value.cast("int"))
        out += [F.lit(template[at : m.start()]), value]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def classify(df: DataFrame, rules: list[Rule], variants: dict[str, str] | None = None, name: str = "name") -> DataFrame:
    """df with category, grp, label, variant, year and page by the first rule that fits a name; names that no rule fits are left
    out. variants: what stands for stems that begin so."""
    n, found = F.col(name), None
    for r in rules:
        part = lambda i, p=r.pattern: F.regexp_extract(n, p, i)
        variant = F.lit("") if r.variant is None else part(r.variant)
        if r.variant is not None:
            for begins, stands in reversed((variants or {}).items()):
                variant = F.when(part(r.variant).startswith(begins), stands).otherwise(variant)
        number = lambda i: F.lit(None).cast("int") if i is None else part(i).cast("int")  # noqa: B023, E731
        value = F.struct(F.lit(r.category).alias("category"), F.lit(r.group).alias("grp"), _filled(r.label, part, variant).alias("label"), variant.alias("variant"), number(r.year).alias("year"), number(r.page).alias("page"))
        fits = n.rlike(r.pattern)
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return df.withColumn("_f", found).where("_f IS NOT NULL").select(*df.columns, "_f.*")


def variants_in_order(assets: DataFrame, name: str = "name") -> DataFrame:
    """variant, ord: the variants in the order in which they first appear among names in natural order."""
    first = assets.where("variant <> ''").groupBy("variant").agg(F.min(F.struct(natural_key(F.col(name)).alias("k"), F.col(name))).alias("first"))
    return first.select("variant", F.row_number().over(Window.orderBy("first")).alias("ord"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """name and path of the files of a folder, by Spark's own reader, so of any store; none: no rows."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path")


def natural_key(name: Column) -> Column:
    """A text that sorts names with their numbers as numbers: runs of digits are padded to 12 places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def manifest(assets: DataFrame, sections: list[str], name: str = "name") -> DataFrame:
    """ord, section, name: assets by section in natural order; sections without assets are left out."""
    s = assets.sparkSession.createDataFrame(list(enumerate(sections)), "sec int, category string")
    x = assets.join(F.broadcast(s), "category")
    order = Window.partitionBy("sec").orderBy(natural_key(F.col(name)), name)
    return x.select("sec", F.row_number().over(order).cast("int").alias("ord"), F.col("category").alias("section"), F.col(name).alias("name"))


def tile_names(spark: SparkSession, west: float, south: float, east: float, north: float) -> DataFrame:
    """The 1-degree tiles over a box: every whole latitude with every whole longitude in it."""
    box = spark.createDataFrame([(west, south, east, north)], "w double, s double, e double, n double")
    lat = box.select("w", "e", F.explode(F.expr("sequence(cast(floor(s) AS int), cast(ceil(n) AS int) - 1)")).alias("lat"))
    both = lat.select("lat", F.explode(F.expr("sequence(cast(floor(w) AS int), cast(ceil(e) AS int) - 1)")).alias("lon"))
    name = F.format_string("%s%02d_%s%03d", F.when(F.col("lat") < 0, "S").otherwise("N"), F.abs("lat"), F.when(F.col("lon") < 0, "W").otherwise("E"), F.abs("lon"))
    return both.select("lat", "lon", name.alias("tile"))


def content_keys(df: DataFrame, place: list[str], start: str, end: str) -> DataFrame:
    """place_hash and time_hash of rows: sha256 of the coordinates rounded to 3 places, and of the two dates."""
    rounded = F.concat(F.lit("["), F.concat_ws(", ", *[F.format_string("%.3f", F.col(c).cast("double")) for c in place]), F.lit("]"))
    return df.withColumns({"place_hash": F.sha2(rounded, 256), "time_hash": F.sha2(F.concat(F.col(start).cast("string"), F.col(end).cast("string")), 256)})


def upsert(registry: DataFrame, new: DataFrame, keys: list[str], seen: str = "last_run", made: str = "created") -> DataFrame:
    """The registry with new rows added, and the run time of known ones moved on."""
    r, n = registry.select(*keys, F.col(made), F.col(seen)), new.groupBy(*keys).agg(F.max("run").alias("run"), F.min("run").alias("first_run"))
    return r.join(n, keys, "full_outer").select(*keys, F.coalesce(made, "first_run").alias(made), F.coalesce(F.greatest("run", seen), seen, "run").alias(seen))


def expected_status(expected: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    return expected.join(existing.select(name).distinct().withColumn("exists", F.lit(True)), name, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
