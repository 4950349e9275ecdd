"""Design expansion and randomisation: cells, variants, replicates, texts, seeds, summaries.

The design is a handful of short tables, so its products are products of short tables by definition; what grows is the
number of replicates, and those are generated row by row on the executors. Everything about a row is a pure function of
the design, the arguments and the row's place in it, so any subset of cells gives the same rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seeds are 1 + (place * A + B) mod this prime: distinct and never 0 for up to that many rows.
MODULUS = (1 << 31) - 1
SLOT = r"\{([a-z][a-z0-9_]*)\}"


@dataclass
class Design:
    """factors: key to (level, code, place, slots); nested: key, parent factor and (parent, variant, place, slots);
    tables: name to (by factors, joint, item slot or None, rows with the by columns and items)."""

    factors: dict[str, DataFrame]
    persona: str
    reminder: str
    n_per_cell: int
    n_turns: int
    modes: tuple[str, ...] = ("reinforced",)
    nested: tuple[str, str, DataFrame] | None = None
    tables: dict[str, tuple[tuple[str, ...], str, str | None, DataFrame]] = field(default_factory=dict)
    derived: dict[str, str] = field(default_factory=dict)
    control: dict | None = None
    prefix: str = "w"
    sizes: dict[str, int] | None = field(default=None, repr=False)


def template_slots(template: str) -> list[str]:
    return list(dict.fromkeys(re.findall(SLOT, template)))


def fill(template: str, slots: Column) -> Column:
    """AS-7: the template with its slots replaced; a slot without a value stays as it is, for DQ-5 to find."""
    return reduce(lambda text, s: F.replace(text, F.lit(f"{{{s}}}"), F.coalesce(F.element_at(slots, s), F.lit(f"{{{s}}}"))), template_slots(template), F.lit(template))


def _product(design: Design, keys: list[str]) -> DataFrame | None:
    out = None
    for k in keys:
        levels = design.factors[k].select(F.col("level").alias(k), F.col("code").alias(f"{k}_code"), F.col("place").alias(f"{k}_place"), F.col("slots").alias(f"{k}_slots"))
        out = levels if out is None else out.crossJoin(levels)
    return out


def factor_sizes(design: Design) -> dict[str, int]:
    """The number of levels of each factor, counted once for a design, in one job."""
    if design.sizes is None:
        each = [df.agg(F.lit(k).alias("k"), F.count("*").alias("n")) for k, df in design.factors.items()]
        design.sizes = {r["k"]: r["n"] for r in reduce(DataFrame.union, each).collect()} if each else {}
    return design.sizes


def _ordinal(design: Design, keys: list[str]) -> Column:
    """Mixed radix over the factors' places, the first factor outermost."""
    sizes = factor_sizes(design)
    return reduce(lambda o, k: o * sizes[k] + F.col(f"{k}_place"), keys, F.lit(0).cast("long"))


def treated_cells(design: Design) -> DataFrame:
    """AS-1: every combination of levels, with its key and place."""
    keys = list(design.factors)
    return _product(design, keys).withColumn("cell", F.concat_ws("/", *keys)).withColumn("cell_place", _ordinal(design, keys)).withColumn("kind", F.lit("treated"))


def control_cells(design: Design) -> DataFrame:
    """AS-2: a control for every combination of its ``by`` factors, null elsewhere, its level on its own factor."""
    by = list(design.control["by"])
    cells = _product(design, by).withColumn("cell_place", _ordinal(design, by))
    for k in design.factors:
        if k not in by:
            cells = cells.withColumns({k: F.lit(design.control["level"] if k == design.control["factor"] else None).cast("string"), f"{k}_code": F.lit(None).cast("string"), f"{k}_slots": F.lit(None).cast("map<string,string>"), f"{k}_place": F.lit(0)})
    return cells.withColumn("cell", F.concat_ws("/", *by, F.lit(design.control["level"]))).withColumn("kind", F.lit("control"))


def cells(design: Design) -> DataFrame:
    """SE-1: treated and control cells."""
    out = treated_cells(design)
    return out.unionByName(control_cells(design)) if design.control else out


def with_variants(design: Design, treated: DataFrame) -> DataFrame:
    """AS-3: the variants of each cell's parent level, and how many there are."""
    if design.nested is None:
        return treated.withColumns({"variant": F.lit(None).cast("string"), "variant_place": F.lit(0), "variant_slots": F.lit(None).cast("map<string,string>"), "n_variants": F.lit(1)})
    _, within, variants = design.nested
    counted = variants.withColumn("n_variants", F.count("*").over(Window.partitionBy("parent")))
    return treated.join(counted.select(F.col("parent").alias(within), "variant", F.col("place").alias("variant_place"), F.col("slots").alias("variant_slots"), "n_variants"), within)


def with_slots(design: Design, rows: DataFrame) -> DataFrame:
    """AS-4: a map of all slot values: levels, level slots, variant, lookup tables joined and item by item, derived texts."""
    empty = F.lit(None).cast("map<string,string>")
    none = F.create_map().cast("map<string,string>")
    parts = [F.map_from_arrays(F.array(*[F.lit(k) for k in design.factors]), F.array(*[F.col(k) for k in design.factors]))]
    parts += [F.coalesce(F.col(f"{k}_slots"), none) for k in design.factors]
    if design.nested:
        parts.append(F.coalesce(F.col("variant_slots"), none))
        parts.append(F.when(F.col("variant").isNotNull(), F.create_map(F.lit(design.nested[0]), F.col("variant"))).otherwise(none))
    for name, (by, joint, item, table) in design.tables.items():
        rows = rows.join(table.select(*by, F.col("items").alias(f"{name}_items")), list(by), "left")
        items = F.col(f"{name}_items")
        parts.append(F.when(items.isNotNull(), F.create_map(F.lit(name), F.array_join(items, joint))).otherwise(none))
        if item:
            parts.append(F.coalesce(F.map_from_entries(_numbered(items, item)), none))
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(p, none)) for p in parts]))
    # a slot without a value is no slot; of equal names the last source counts
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda x: x["key"] == e["key"]))
    rows = rows.withColumn("slots", F.coalesce(F.map_from_entries(last), empty))
    for name, template in design.derived.items():
        text = fill(template, F.col("slots"))
        rows = rows.withColumn("slots", F.when(~text.rlike(SLOT), F.map_concat(F.map_filter("slots", _other_than(name)), F.create_map(F.lit(name), text))).otherwise(F.col("slots")))
    return rows


def _numbered(items: Column, item: str) -> Column:
    return F.transform(items, lambda x, i: F.struct(F.concat(F.lit(item), (i + 1).cast("string")).alias("key"), x.alias("value")))


def _other_than(name: str):
    return lambda k, _: k != name


def manifest(design: Design, seed: int, chosen: list[str] | None = None) -> DataFrame:
    """RP-6: the assignment table, a row for each planned dialogue (AS-5 to AS-8), in a seeded order by ``shuffle_key``.

    ``chosen`` keeps the rows of some cells as they are in the whole table (PF-13).
    """
    if design.nested and (bad := design.nested[2].groupBy("parent").count().where(F.lit(design.n_per_cell) % F.col("count") != 0).join(design.factors[design.nested[1]], F.col("parent") == F.col("level"), "left_semi").first()):
        raise ValueError(f"{design.n_per_cell} rows do not split evenly over the variants of {bad['parent']}")
    modes = F.posexplode(F.array(*map(F.lit, design.modes)))
    treated = with_variants(design, treated_cells(design)).select("*", modes.alias("mode_place", "mode"))
    treated = treated.withColumn("per", (F.lit(design.n_per_cell) / F.col("n_variants")).cast("int"))
    rows = with_slots(design, treated).withColumns({"persona_text": F.trim(fill(design.persona, F.col("slots"))), "persona_reminder": F.trim(fill(design.reminder, F.col("slots")))})
    if design.control:
        c = design.control
        bare = control_cells(design).withColumns({"variant": F.lit(None).cast("string"), "variant_place": F.lit(0), "variant_slots": F.lit(None).cast("map<string,string>"), "n_variants": F.lit(1), "mode": F.lit(c["mode"]), "mode_place": F.lit(0), "per": F.lit(c["n"])})
        bare = with_slots(design, bare).withColumns({"persona_text": F.trim(fill(c["persona"], F.col("slots"))), "persona_reminder": F.trim(fill(c["reminder"], F.col("slots")))})
        rows = rows.unionByName(bare, allowMissingColumns=True)
    if chosen is not None:
        rows = rows.where(F.col("cell").isin(chosen))
    rows = rows.where("per > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("per"))))
    n_control = design.control["n"] if design.control else 0
    n_cells = reduce(lambda a, n: a * n, factor_sizes(design).values(), 1)
    treated_rows = n_cells * len(design.modes) * design.n_per_cell
    within = (F.col("mode_place") * F.lit(design.n_per_cell) + F.col("variant_place") * F.col("per") + F.col("k") - 1).cast("long")
    place = F.when(F.col("kind") == "treated", F.col("cell_place") * (len(design.modes) * design.n_per_cell) + within).otherwise(treated_rows + F.col("cell_place") * n_control + F.col("k") - 1)
    a, b = (seed * 2_654_435_761 + 1) % (MODULUS - 1) + 1, (seed * 40_503 + 7) % MODULUS
    rows = rows.withColumn("place", place)
    number = F.when(F.col("k") < 1000, F.lpad(F.col("k").cast("string"), 3, "0")).otherwise(F.col("k").cast("string"))
    treated_id = F.concat_ws("-", F.lit(design.prefix), *[F.col(f"{k}_code") for k in design.factors], "variant", "mode", number)
    control_id = F.concat_ws("-", F.lit(design.prefix), *[F.col(f"{k}_code") for k in (design.control or {"by": []})["by"]], F.lit("control"), "mode", number)
    names = [*design.factors, *([design.nested[0]] if design.nested else [])]
    condition = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(k) for k in design.factors], *([F.col("variant")] if design.nested else [])))
    return rows.select(
        F.when(F.col("kind") == "treated", treated_id).otherwise(control_id).alias("dyad_id"), "cell", "kind", "variant", condition.alias("condition"), "persona_text", "persona_reminder",
        F.col("mode").alias("persona_mode"), (F.pmod(F.col("place") * F.lit(a) + F.lit(b), F.lit(MODULUS)) + 1).alias("seed"), F.lit(design.n_turns).alias("n_turns"),
        F.sha2(F.concat_ws("|", F.lit(seed), "place").cast("binary"), 256).alias("shuffle_key"), "place")


def topic_code(topic: Column) -> Column:
    """AS-8: a short code for a topic: six letters of its first word."""
    return F.substring(F.element_at(F.split(topic, "_"), 1), 1, 6)


def cell_key(condition: Column, factors: list[str], control: dict | None = None) -> Column:
    """AS-8: the cell that a row's condition names; null if a level that the key needs is missing."""
    whole = lambda keys: F.when(F.forall(F.array(*[condition[k] for k in keys]), lambda x: x.isNotNull()), F.concat_ws("/", *[condition[k] for k in keys]))
    if control is None:
        return whole(factors)
    by = [k for k in factors if k in control["by"]]
    bare = F.concat_ws("/", *[condition[k] for k in by], F.lit(control["level"]))
    return F.when(condition[control["factor"]] == control["level"], F.when(whole(by).isNotNull() if by else F.lit(True), bare)).otherwise(whole(factors))


def summary(rows: DataFrame) -> DataFrame:
    """AS-9: rows by cell, by cell and variant, and by mode, as (grouping, key, n): one pass over grouping sets."""
    c, v, m = F.col("cell"), F.col("variant"), F.col("persona_mode")
    by = rows.groupingSets([[c], [c, v], [m]], c, v, m).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "cell").when(F.col("g") == 1, "cell/variant").otherwise("mode")
    return by.select(name.alias("grouping"), F.when(F.col("g") == 6, m).when(F.col("g") == 1, F.concat_ws("/", "cell", "variant")).otherwise(c).alias("key"), "n")


def study_size(design: Design, chosen: list[str] | None = None) -> DataFrame:
    """AS-10: cells, chosen cells, rows of the chosen cells and of the whole design, messages."""
    each = cells(design).select("cell", "kind", F.when(F.col("kind") == "treated", design.n_per_cell * len(design.modes)).otherwise(design.control["n"] if design.control else 0).alias("rows"))
    each = each.withColumn("chosen", F.lit(True) if chosen is None else F.col("cell").isin(chosen))
    rows = F.sum(F.when(F.col("chosen"), F.col("rows")).otherwise(0))
    return each.agg(F.count_if(F.col("kind") == "treated").alias("cells_treated"), F.count_if(F.col("kind") == "control").alias("cells_control"), F.count_if("chosen").alias("cells_chosen"), rows.alias("rows"), F.sum("rows").alias("rows_design"), (rows * design.n_turns * 2).alias("messages"))


def preview(rows: DataFrame, k: int = 20) -> DataFrame:
    """SO-6: the first rows of the shuffled table, 500 at most, with the number of all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("shuffle_key").limit(min(k, 500)).crossJoin(total)  # total: one row
