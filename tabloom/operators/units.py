"""Units of measurement: dimension table, lookup by name or alias, affine conversion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.numbers import decimals_in
from tabloom.functions.sampling import uniform
from tabloom.functions.text import normalize_label

# Fixed values: (domain, unit, canonical unit, quantity kind, factor, offset, aliases) in list order.
UNITS: list[tuple[str, str, str, str, float | None, float | None, list[str]]] = [
    ("finance", "unit", "unit", "DecimalScale", 1.0, None, ["ones"]),
    ("finance", "thousand", "unit", "DecimalScale", 1e3, None, ["k", "thousands"]),
    ("finance", "million", "unit", "DecimalScale", 1e6, None, ["mn", "millions", "mio"]),
    ("finance", "billion", "unit", "DecimalScale", 1e9, None, ["bn", "billions"]),
    ("finance", "trillion", "unit", "DecimalScale", 1e12, None, ["tn", "trillions"]),
    ("finance", "pure", "pure", "Ratio", 1.0, None, ["ratio", "xbrli:pure"]),
    ("finance", "percent", "pure", "Ratio", 0.01, None, ["%", "pct"]),
    ("finance", "basis_point", "pure", "Ratio", 0.0001, None, ["bp", "bps", "bips"]),
    ("finance", "count", "count", "Count", 1.0, None, ["units", "items"]),
    ("finance", "shares", "count", "Count", 1.0, None, ["share"]),
    ("finance", "USD", "currency", "CurrencyRepresentation", None, None, ["$"]),
    ("finance", "EUR", "currency", "CurrencyRepresentation", None, None, ["€"]),
    ("finance", "GBP", "currency", "CurrencyRepresentation", None, None, ["£"]),
    ("finance", "JPY", "currency", "CurrencyRepresentation", None, None, ["¥"]),
    ("healthcare", "g", "g", "Mass", 1.0, None, ["gram"]),
    ("healthcare", "kg", "g", "Mass", 1e3, None, ["kilogram"]),
    ("healthcare", "mg", "g", "Mass", 1e-3, None, ["milligram"]),
    ("healthcare", "ug", "g", "Mass", 1e-6, None, ["microgram"]),
    ("healthcare", "ng", "g", "Mass", 1e-9, None, ["nanogram"]),
    ("healthcare", "pg", "g", "Mass", 1e-12, None, ["picogram"]),
    ("healthcare", "L", "L", "Volume", 1.0, None, ["liter", "litre"]),
    ("healthcare", "mL", "L", "Volume", 1e-3, None, ["milliliter", "millilitre"]),
    ("healthcare", "uL", "L", "Volume", 1e-6, None, ["microliter", "microlitre"]),
    ("healthcare", "dL", "L", "Volume", 0.1, None, ["deciliter", "decilitre"]),
    ("healthcare", "m", "m", "Length", 1.0, None, ["meter", "metre"]),
    ("healthcare", "cm", "m", "Length", 1e-2, None, ["centimeter", "centimetre"]),
    ("healthcare", "mm", "m", "Length", 1e-3, None, ["millimeter", "millimetre"]),
    ("healthcare", "um", "m", "Length", 1e-6, None, ["micrometer", "micrometre"]),
    ("healthcare", "nm", "m", "Length", 1e-9, None, ["nanometer", "nanometre"]),
    ("healthcare", "s", "s", "Time", 1.0, None, ["second"]),
    ("healthcare", "min", "s", "Time", 60.0, None, ["minute"]),
    ("healthcare", "h", "s", "Time", 3600.0, None, ["hour"]),
    ("healthcare", "d", "s", "Time", 86400.0, None, ["day"]),
    ("healthcare", "wk", "s", "Time", 604800.0, None, ["week"]),
    ("healthcare", "mo", "s", "Time", 2629800.0, None, ["month"]),
    ("healthcare", "a", "s", "Time", 31557600.0, None, ["year"]),
    ("healthcare", "mol", "mol", "AmountOfSubstance", 1.0, None, ["mole"]),
    ("healthcare", "mmol", "mol", "AmountOfSubstance", 1e-3, None, ["millimole"]),
    ("healthcare", "umol", "mol", "AmountOfSubstance", 1e-6, None, ["micromole"]),
    ("healthcare", "nmol", "mol", "AmountOfSubstance", 1e-9, None, ["nanomole"]),
    ("healthcare", "mol/L", "mol/L", "AmountConcentration", 1.0, None, ["molar", "mole per liter", "mole per litre"]),
    ("healthcare", "mmol/L", "mol/L", "AmountConcentration", 1e-3, None, ["millimolar", "millimole per liter", "millimole per litre"]),
    ("healthcare", "umol/L", "mol/L", "AmountConcentration", 1e-6, None, ["micromolar", "micromole per liter", "micromole per litre"]),
    ("healthcare", "g/L", "g/L", "MassConcentration", 1.0, None, ["gram per liter", "gram per litre"]),
    ("healthcare", "mg/dL", "g/L", "MassConcentration", 0.01, None, ["milligram per deciliter", "milligram per decilitre"]),
    ("healthcare", "g/dL", "g/L", "MassConcentration", 10.0, None, ["gram per deciliter", "gram per decilitre"]),
    ("healthcare", "%", "Ratio", "Ratio", None, None, ["percent", "pct"]),
    ("healthcare", "[ppth]", "Ratio", "Ratio", None, None, ["per thousand"]),
    ("healthcare", "[ppm]", "Ratio", "Ratio", None, None, ["ppm", "parts per million"]),
    ("healthcare", "[ppb]", "Ratio", "Ratio", None, None, ["ppb", "parts per billion"]),
    ("healthcare", "Pa", "Pa", "Pressure", 1.0, None, ["pascal"]),
    ("healthcare", "kPa", "Pa", "Pressure", 1e3, None, ["kilopascal"]),
    ("healthcare", "mm[Hg]", "Pa", "Pressure", 133.322387415, None, ["mmHg", "millimeter mercury"]),
    ("healthcare", "K", "K", "Temperature", 1.0, 0.0, ["kelvin"]),
    ("healthcare", "Cel", "K", "Temperature", 1.0, 273.15, ["celsius", "degC"]),
    ("healthcare", "[degF]", "K", "Temperature", 5.0 / 9.0, 255.3722222222222, ["fahrenheit", "degF"]),
    ("healthcare", "/uL", "/uL", "CellCountConcentration", None, None, ["per microliter", "per microlitre"]),
    ("healthcare", "10*3/uL", "/uL", "CellCountConcentration", None, None, ["thousand per microliter", "10^3 per microliter"]),
    ("healthcare", "10*6/uL", "/uL", "CellCountConcentration", None, None, ["million per microliter", "10^6 per microliter"]),
    ("healthcare", "[iU]", "self", "ArbitraryClinicalUnit", None, None, ["IU", "international unit"]),
    ("healthcare", "U", "self", "ArbitraryClinicalUnit", None, None, ["unit"]),
]
NULL_TOKENS = ["n.a.", "-", "not available", "", "\\", "N/A"]
MAX_DECIMALS = 12
SURROGATE = {"CurrencyRepresentation": ("DecimalScale", "unit")}

SCHEMA = (
    "ordinal int, domain string, unit string, canonical_unit string, kind string, "
    "factor double, offset double, aliases array<string>"
)


def dimension(spark: SparkSession, units: Sequence[tuple] = tuple(UNITS)) -> DataFrame:
    """The unit table; its size is fixed by the list, so it may always be broadcast."""
    return spark.createDataFrame([(i, *u) for i, u in enumerate(units)], SCHEMA)


def names(units: DataFrame) -> DataFrame:
    """One entry per domain and name; of several entries with a name the last one counts."""
    named = units.withColumn("name", F.explode(F.array_distinct(F.concat(F.array("unit"), "aliases"))))
    entry = F.struct("kind", "unit", "factor", F.coalesce("offset", F.lit(0.0)).alias("offset"))
    return named.groupBy("domain", "name").agg(F.max_by(entry, "ordinal").alias("entry"))


def sample_from(domain: str, units: Sequence[tuple] = tuple(UNITS)) -> list[str]:
    """Units that a table of the domain may be given: all of them, but in finance only currencies that have other names."""
    offered = [u[1] for u in units if u[0] == domain and (domain != "finance" or (u[3] == "CurrencyRepresentation" and u[6]))]
    return list(dict.fromkeys(offered))


def sized(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A frame made from a unit table, to be broadcast if it is counted to be small; a larger one is joined as usual."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def lookup(df: DataFrame, units: DataFrame, source: str = "from_unit", target: str = "to_unit") -> DataFrame:
    """Resolve both units of a row; rows whose units differ in kind or lack a factor are not convertible."""
    found = names(units)
    for column, prefix in ((source, "f"), (target, "t")):
        side = found.select("domain", F.col("name").alias(column), F.col("entry").alias(f"_{prefix}"))
        df = df.join(sized(side), ["domain", column], "left")
    same = F.col("_f.kind") == F.col("_t.kind")
    usable = same & F.col("_f.factor").isNotNull() & F.col("_t.factor").isNotNull()
    return df.select(
        *[c for c in df.columns if c not in ("_f", "_t")],
        F.col("_f.kind").alias("kind"),
        F.coalesce(usable, F.lit(False)).alias("convertible"),
        F.col("_f.factor").alias("f1"),
        F.col("_f.offset").alias("o1"),
        F.col("_t.factor").alias("f2"),
        F.col("_t.offset").alias("o2"),
    )


def converted(value: Column, factor: Callable[[str], Column] = F.col) -> Column:
    return (value * factor("f1") + factor("o1") - factor("o2")) / factor("f2")


def scale_of(text: Column) -> Column:
    """Ten to the decimals of a number as it is written."""
    return F.pow(F.lit(10.0), decimals_in(text))


def roundtrip_decimals(value: Column, scale: Column, factor: Callable[[str], Column] = F.col) -> Column:
    """Fewest decimals of the converted value that convert back to the value at its ``scale``; -1 if none do."""
    there = converted(value, factor)
    fewest = F.lit(-1)
    for i in range(MAX_DECIMALS, -1, -1):
        rounded = F.rint(there * F.lit(10.0**i)) / F.lit(10.0**i)
        back = ((rounded * factor("f2") + factor("o2")) - factor("o1")) / factor("f1")
        fewest = F.when(F.rint(back * scale) == F.rint(value * scale), F.lit(i)).otherwise(fewest)
    return fewest


def membership(units: DataFrame) -> DataFrame:
    """Quantity kind that contains a name: the first kind it is canonical for, else the last that lists it."""
    ordinals = units.groupBy("domain", "kind").agg(F.min("ordinal").alias("place"), F.max("canonical_unit").alias("canonical"))
    canonical = ordinals.select("domain", "kind", "place", F.col("canonical").alias("name"), F.lit(True).alias("is_canonical"))
    listed = (
        units.withColumn("name", F.explode(F.concat(F.array("unit"), "aliases")))
        .join(ordinals.select("domain", "kind", "place"), ["domain", "kind"])
        .select("domain", "kind", "place", "name", F.lit(False).alias("is_canonical"))
    )
    place = F.col("place")
    first = F.min_by("kind", F.when(F.col("is_canonical"), place))
    last = F.max_by("kind", F.when(~F.col("is_canonical"), place))
    return canonical.unionByName(listed).groupBy("domain", "name").agg(
        F.coalesce(first, last).alias("kind")
    )


def random_targets(units: DataFrame) -> DataFrame:
    """Names a unit may be converted to; a currency uses the decimal scales of its amount."""
    options = units.filter("factor IS NOT NULL AND factor <> 0 AND factor <> 1").select(
        "domain", F.col("kind").alias("target_kind"), F.col("unit").alias("target"), F.col("aliases").alias("target_aliases")
    )
    member = membership(units)
    kind, unit = F.col("kind"), F.col("name")
    for category, (replacement, surrogate) in SURROGATE.items():
        unit = F.when(F.col("kind") == category, surrogate).otherwise(unit)
        kind = F.when(F.col("kind") == category, replacement).otherwise(kind)
    wanted = member.select("domain", "name", kind.alias("target_kind"), unit.alias("surrogate"))
    pairs = wanted.join(options, ["domain", "target_kind"]).filter(
        (F.col("target") != F.col("surrogate")) & ~F.array_contains("target_aliases", F.col("surrogate"))
    )
    listed = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("target"), "target_aliases")))))
    return pairs.groupBy("domain", "name", "surrogate").agg(listed.alias("targets"))


def random_target(df: DataFrame, units: DataFrame, unit: str, seed: int, op: str, *keys: str) -> DataFrame:
    """Add a random convertible target and the unit the conversion starts from; both null where there is none."""
    options = random_targets(units).withColumnRenamed("name", unit)
    index = F.floor(uniform(seed, op, *keys) * F.size("targets")).cast("int")
    return (
        df.join(sized(options), ["domain", unit], "left")
        .withColumn("to_unit", F.get("targets", index))
        .drop("targets")
    )


def canonical_pick(df: DataFrame, kind: str, unit_id: str, multiplier: str, offset: str, code: str) -> DataFrame:
    """Canonical unit per kind: multiplier one without offset, then with a code, then the shortest id."""
    score = F.struct(
        F.when((F.col(multiplier) == 1) & (F.coalesce(F.col(offset), F.lit(0.0)) == 0), 0).otherwise(1).alias("a"),
        F.when(F.col(code).isNotNull(), 0).otherwise(1).alias("b"),
        F.length(unit_id).alias("c"),
        F.col(unit_id).alias("d"),
    )
    return df.groupBy(kind).agg(F.min(score)["d"].alias("canonical"))


def enrich_aliases(entries: DataFrame, codes: DataFrame, key: str, label: str, aliases: str) -> DataFrame:
    """Add code and name of trade units whose normalised name equals the label or an alias."""
    keyed = entries.withColumn(
        "_key",
        F.explode(F.array_distinct(F.transform(F.concat(F.array(label), aliases), normalize_label))),
    )
    coded = codes.select(normalize_label(F.col("name")).alias("_key"), F.array("code", "name").alias("_add"))
    added = keyed.join(coded, "_key").groupBy(key).agg(F.flatten(F.collect_set("_add")).alias("_add"))
    merged = F.concat(aliases, F.coalesce("_add", F.array().cast("array<string>")))
    return entries.join(added, key, "left").withColumn(aliases, F.array_sort(F.array_distinct(merged))).drop("_add")


def convert_tables(df: DataFrame, units: DataFrame, table: str, value: str, unit: str, seed: int, tries: int = 5) -> DataFrame:
    """Convert whole tables, trying up to ``tries`` random targets per table.

    The first target whose every value converts back is used; the display precision is the largest one needed.  Null
    tokens pass through.  Rows of a table that no target converts stay, with null target and ``reason`` set.  Every row
    meets all targets of its table at once, in one aggregate.
    """
    attempts = F.explode(F.array(*[F.lit(i) for i in range(tries)]))
    tables = df.select(table, "domain", unit).distinct().withColumn("attempt", attempts)
    targets = random_target(tables, units, unit, seed, "convert-table", table, "attempt")
    resolved = lookup(targets, units, "surrogate", "to_unit").filter("convertible")
    parts = ("to_unit", "f1", "o1", "f2", "o2")
    wide = resolved.groupBy(table).agg(
        F.array(*[F.max(F.when(F.col("attempt") == i, F.struct(*parts))) for i in range(tries)]).alias("_targets")
    )
    number = F.col(value).try_cast("double")
    # The values that convert back to a number depend on the number and its scale alone.
    numbers = df.select(table, number.alias("_x"), scale_of(F.col(value)).alias("_scale")).filter("_x is not null").distinct()
    needed = F.transform("_targets", lambda t: F.when(t.isNotNull(), roundtrip_decimals(F.col("_x"), F.col("_scale"), t.getField)))
    checked = (
        numbers.join(wide, table)
        .select(table, needed.alias("_d"))
        .groupBy(table)
        .agg(*[f(F.get("_d", F.lit(i))).alias(f"_{name}{i}") for i in range(tries) for name, f in (("worst", F.min), ("most", F.max))])
    )
    options = [
        F.when(F.col(f"_worst{i}") >= 0, F.struct(F.col(f"_most{i}").alias("decimals"), F.get("_targets", F.lit(i)).alias("t")))
        for i in range(tries)
    ]
    plan = checked.join(wide, table).select(table, F.coalesce(*options).alias("_plan"))
    plan = plan.select(table, "_plan.decimals", *[F.col(f"_plan.t.{p}").alias(p) for p in parts])
    found = df.join(plan, table, "left").withColumn("converted", converted(number))
    return found.withColumn("reason", F.when(F.col("to_unit").isNull(), "no target converts the table")).drop(*parts[1:])
