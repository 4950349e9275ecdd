"""Audits: each returns its violations as rows, so that an empty table is good news."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import derived_seed
from ..schemas import MODES, RUN_KEY
from .assignment import SLOT, Design, template_slots
from .attempts import last_row


def _found(df: DataFrame, where: Column, reason: str, *keys: str) -> DataFrame:
    return df.where(where).select(*keys, F.lit(reason).alias("reason"))


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """DQ-1: (run_id, dyad_id, reason) of planned rows that cannot be run."""
    keys = ["run_id", "dyad_id"]
    mode = F.coalesce("persona_mode", F.lit("reinforced"))
    checks = [
        (F.col("dyad_id").isNull() | F.col("persona_text").isNull() | F.col("n_turns").isNull(), "missing field"), (~mode.isin(MODES), "unknown persona_mode"), (F.col("n_turns") <= 0, "n_turns not positive"),
        ((mode == "reinforced") & (F.trim(F.coalesce("persona_reminder", F.lit(""))) == ""), "reinforced without a reminder")]
    # one pass: every failed check of a row, then a row for each
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in checks]), lambda r: r.isNotNull())
    out = manifest.select(*keys, F.explode(reasons).alias("reason"))
    repeated = manifest.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("repeated dyad_id").alias("reason"))
    return out.unionByName(repeated)


def conditions_outside(manifest: DataFrame, levels: DataFrame, control: str = "none") -> DataFrame:
    """JN-8, DQ-2: rows whose condition is no cell of the grid, with the reason; levels: (factor, level).

    A manifest that was read with its lines (``logs.read_planned``) says which line it is.
    """
    known = {r["factor"]: r["levels"] for r in levels.groupBy("factor").agg(F.collect_set("level").alias("levels")).collect()}  # a row for each factor
    c = lambda k: F.col("condition")[k]
    is_control = c("ideology").eqNullSafe(F.lit(control))
    reason = (F.when(~F.coalesce(c("topic").isin(known.get("topic", [])), F.lit(False)), "topic not in the grid")
              .when(is_control & (c("openness").isNotNull() | c("role").isNotNull()), "control with openness or role").when(is_control, None)
              .when(~F.coalesce(c("ideology").isin(known.get("ideology", [])), F.lit(False)), "ideology not in the grid")
              .when(~F.coalesce(c("openness").isin(known.get("openness", [])), F.lit(False)), "openness not in the grid").when(F.coalesce(c("role"), F.lit("")) == "", "treated row without a role"))
    return manifest.withColumn("reason", reason).where("reason is not null").select("run_id", "dyad_id", *(["line"] if "line" in manifest.columns else []), "reason")


def catalogue_gaps(parents: DataFrame, topics: DataFrame, variants: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """DQ-3, SE-4: (kind, key) of what the catalogue lacks or has too much of.

    parents, topics: (level); variants: (parent, variant); anchors: (parent, topic, items).
    """
    wanted = parents.select(F.col("level").alias("parent")).crossJoin(topics.select(F.col("level").alias("topic")))
    key = F.concat_ws("/", "parent", "topic")
    gaps = wanted.join(anchors.where("size(items) > 0"), ["parent", "topic"], "left_anti").select(F.lit("no anchors").alias("kind"), key.alias("key"))
    extra = anchors.join(wanted, ["parent", "topic"], "left_anti").select(F.lit("anchors never looked up").alias("kind"), key.alias("key"))
    stray = variants.join(parents.select(F.col("level").alias("parent")), "parent", "left_anti").select(F.lit("variant under an unknown level").alias("kind"), F.col("variant").alias("key"))
    bare = parents.select(F.col("level").alias("parent")).join(variants, "parent", "left_anti").select(F.lit("level without a variant").alias("kind"), F.col("parent").alias("key"))
    twice = variants.groupBy("variant").count().where("count > 1").select(F.lit("repeated slug").alias("kind"), F.col("variant").alias("key"))
    many = variants.groupBy("parent").count().where(F.col("count") > most).select(F.lit("too many variants").alias("kind"), F.col("parent").alias("key"))
    return gaps.unionByName(extra).unionByName(stray).unionByName(bare).unionByName(twice).unionByName(many)


def instrument_items(items: DataFrame) -> DataFrame:
    """DQ-4: (item_id, reason) of survey items (item_id, battery, lo, hi, text)."""
    checks = [(F.coalesce("item_id", F.lit("")) == "", "missing id"), (F.coalesce("battery", F.lit("")) == "", "missing battery"), (F.coalesce("text", F.lit("")) == "", "missing text"), (F.col("lo").isNull() | F.col("hi").isNull(), "missing scale"), (F.col("lo") > F.col("hi"), "minimum above maximum"), (F.col("lo") == F.col("hi"), "scale without range")]
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in checks]), lambda r: r.isNotNull())
    repeated = items.groupBy("item_id").count().where("count > 1").select("item_id", F.lit("repeated id").alias("reason"))
    return items.select("item_id", F.explode(reasons).alias("reason")).unionByName(repeated)


def open_slots(rows: DataFrame) -> DataFrame:
    """DQ-5: slots that texts still hold: (template, slot, n, example)."""
    each = rows.select("dyad_id", F.explode(F.array(*[F.struct(F.lit(c).alias("template"), F.col(c).alias("text")) for c in ("persona_text", "persona_reminder")])).alias("t"))
    slots = each.select("dyad_id", "t.template", F.explode(F.array_distinct(F.regexp_extract_all("t.text", F.lit(SLOT), F.lit(1)))).alias("slot"))
    return slots.groupBy("template", "slot").agg(F.count("*").alias("n"), F.min("dyad_id").alias("example"))


def slot_sources(design: Design) -> DataFrame:
    """DQ-5: (slot, source, cells): who gives a slot, in treated and in control cells.

    A control has its ``by`` factors with their levels' slots, and of the derived texts, in their order, those whose template
    uses nothing else. Levels, variants and tables stay tables; templates are a design's few texts.
    """
    spark = next(iter(design.factors.values())).sparkSession
    fixed, parts = [(k, f"factor:{k}", "treated") for k in design.factors], []
    names = lambda rows, source: rows.select(F.explode(F.map_keys("slots")).alias("slot")).distinct().select("slot", F.lit(source).alias("source"))
    for k, levels in design.factors.items():
        parts.append(names(levels, f"level:{k}").withColumn("cells", F.lit("treated")))
    if design.nested:
        fixed.append((design.nested[0], f"nested:{design.nested[0]}", "treated"))
        parts.append(names(design.nested[2], f"variant:{design.nested[0]}").withColumn("cells", F.lit("treated")))
    for name, (_, _, item, rows) in design.tables.items():
        fixed.append((name, f"table:{name}", "treated"))
        if item:
            most = rows.agg(F.coalesce(F.max(F.size("items")), F.lit(0)).alias("n"))
            parts.append(most.where("n > 0").select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(F.concat(F.lit(item), F.col("i").cast("string")).alias("slot"), F.lit(f"table:{name}").alias("source"), F.lit("treated").alias("cells")))
    fixed += [(name, "derived", "treated") for name in design.derived]
    if design.control:
        by = [k for k in design.factors if k in design.control["by"]]
        fixed += [(k, f"factor:{k}", "control") for k in by]
        given = [names(design.factors[k], f"level:{k}") for k in by]
        parts += [g.withColumn("cells", F.lit("control")) for g in given]
        known = {*by, *(r["slot"] for r in reduce(DataFrame.unionByName, given).select("slot").distinct().collect())} if by else set()  # names of slots
        for name, template in design.derived.items():
            if {*template_slots(template)} <= known:
                known.add(name)
                fixed.append((name, "derived", "control"))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(fixed, "slot string, source string, cells string"))


def _template_slots(design: Design) -> DataFrame:
    """(template, cells, place, slot): the slots that templates use; ``place`` counts the derived ones, which see only earlier ones."""
    spark = next(iter(design.factors.values())).sparkSession
    texts = [(f"derived.{name}", "treated", i, text) for i, (name, text) in enumerate(design.derived.items())]
    last = len(texts)
    texts += [("templates.persona", "treated", last, design.persona), ("templates.reminder", "treated", last, design.reminder)]
    if design.control:
        texts += [("control.persona", "control", last, design.control["persona"]), ("control.reminder", "control", last, design.control["reminder"])]
    rows = [(template, cells, i, slot) for template, cells, i, text in texts for slot in template_slots(text)]
    return spark.createDataFrame(rows, "template string, cells string, place int, slot string")


def unused_slots(design: Design) -> DataFrame:
    """DQ-5: (slot, source) that no template uses. Factors and the nested key may go unused; a table is used if its name or one of its items is."""
    given = slot_sources(design).where("cells = 'treated'").where(~F.col("source").startswith("factor:") & ~F.col("source").startswith("nested:"))
    used = _template_slots(design).select("slot").distinct().withColumn("used", F.lit(True))
    marked = given.join(F.broadcast(used), "slot", "left")  # the slots of a design's few templates
    is_table = F.col("source").startswith("table:")
    tables = marked.where(is_table).groupBy("source").agg(F.bool_or(F.coalesce("used", F.lit(False))).alias("used")).where("not used").select(F.substring_index("source", ":", -1).alias("slot"), "source")
    return marked.where(~is_table & F.col("used").isNull()).select("slot", F.col("source")).distinct().unionByName(tables)


def clashing_slots(design: Design) -> DataFrame:
    """DQ-5: (slot, sources) of the names that more than one source gives to treated cells."""
    return slot_sources(design).where("cells = 'treated'").groupBy("slot").agg(F.array_sort(F.collect_set("source")).alias("sources")).where("size(sources) > 1")


def unavailable_slots(design: Design) -> DataFrame:
    """DQ-5: (template, slot, reason) of the slots that a template uses and its cells do not have.

    A derived text sees what is no derived text, and those before it. What is wrong with a derived text is said once, not
    again for the control's templates that use it.
    """
    order = {name: i for i, name in enumerate(design.derived)}
    given = slot_sources(design)
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("slot")], F.lit(-1)) if order else F.lit(-1)
    sees = given.select("cells", "slot", F.when(F.col("source") == "derived", rank).otherwise(-1).alias("from")).groupBy("cells", "slot").agg(F.min("from").alias("from"))
    used = _template_slots(design)
    known = used.join(sees, ["cells", "slot"], "left")
    missing = known.where(F.col("from").isNull() | (F.col("from") >= F.col("place")))
    broken = missing.where(F.col("template").startswith("derived.")).select(F.substring_index("template", ".", -1).alias("slot"), F.lit("control").alias("cells")).distinct()
    out = missing.join(broken, ["slot", "cells"], "left_anti")
    reason = F.when(F.col("cells") == "control", "not available in the control").when(F.col("template").startswith("derived."), "not defined by anything before").otherwise("not defined")
    return out.select("template", "slot", reason.alias("reason")).distinct()


def design_rules(levels: DataFrame, variants: DataFrame, n_per_cell: int, control_level: str | None) -> DataFrame:
    """DQ-6: levels (factor, level, code) and variants (parent, variant) against the rules of a design."""
    twice = levels.groupBy("factor", "level").count().where("count > 1").select(F.concat_ws("/", "factor", "level").alias("key"), F.lit("repeated level").alias("reason"))
    codes = levels.select("factor", "level", "code").distinct().groupBy("factor", "code").count().where("count > 1").select(F.concat_ws("/", "factor", "code").alias("key"), F.lit("repeated code").alias("reason"))
    uneven = variants.groupBy("parent").count().where(F.lit(n_per_cell) % F.col("count") != 0).select(F.col("parent").alias("key"), F.lit("rows do not split evenly over variants").alias("reason"))
    clash = levels.where(F.col("level").eqNullSafe(F.lit(control_level))).select(F.concat_ws("/", "factor", "level").alias("key"), F.lit("control level is a treated level").alias("reason"))
    return twice.unionByName(codes).unionByName(uneven).unionByName(clash)


def id_collisions(rows: DataFrame) -> DataFrame:
    """DQ-7: dyad ids that more than one planned row has."""
    return rows.groupBy("dyad_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds")).where("n > 1")


def empty_texts(rows: DataFrame) -> DataFrame:
    """DQ-8: planned rows whose persona or reminder is empty."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reasons = F.filter(F.array(F.when(blank("persona_text"), F.lit("empty persona")), F.when(blank("persona_reminder"), F.lit("empty reminder"))), lambda r: r.isNotNull())
    return rows.select("dyad_id", F.explode(reasons).alias("reason"))


def wrong_seeds(rows: DataFrame, dyads: DataFrame, run_seed: int, tag: Column | None = None) -> DataFrame:
    """DQ-9: logged rows whose seed is not the one that their six parts give."""
    given = last_row(dyads.select(*RUN_KEY, F.col("seed").alias("dyad_seed"), "pos"), RUN_KEY).drop("pos")
    want = derived_seed(F.lit(run_seed), F.col("dyad_seed"), F.col("dyad_id"), F.col("attempt"), F.col("turn"), F.col("agent") if tag is None else tag)
    return rows.join(given, RUN_KEY).withColumn("expected", want).where("seed <> expected")


def model_mismatches(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """JN-9: by run, agent and model, the messages whose model is not the one in the run's manifest."""
    want = F.when(F.col("agent") == "seeker", F.col("seeker_sha256")).otherwise(F.col("mentor_sha256"))
    return turns.join(runs.select("run_id", "seeker_sha256", "mentor_sha256"), "run_id").where(F.col("model_sha256") != want).groupBy("run_id", "agent", "model_sha256").agg(F.count("*").alias("n"))


def run_records(runs: DataFrame) -> DataFrame:
    """DQ-10: runs with a changed tree or an unknown commit, and dates that differ between runs."""
    reasons = F.filter(F.array(F.when(F.col("dirty"), F.lit("changed tree")), F.when(F.col("harness_commit").isNull(), F.lit("unknown commit"))), lambda r: r.isNotNull())
    usual = runs.groupBy("now").count().orderBy(F.desc("count"), "now").limit(1).select(F.col("now").alias("usual"))
    odd = runs.join(usual, runs["now"] == usual["usual"], "left_anti").select("run_id", F.lit("another date than most runs").alias("reason"))
    return runs.select("run_id", F.explode(reasons).alias("reason")).unionByName(odd)


def instrument_changes(surveys: DataFrame, column: str = "batteries_sha256") -> DataFrame:
    """DQ-10: runs that asked more than one version of the instrument."""
    return surveys.groupBy("run_id").agg(F.count_distinct(column).alias("versions")).where("versions > 1")


def config_conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """SNK-5, DQ-12: runs whose stored configuration differs from the incoming one in a key that affects results."""
    from ..schemas import RUN_AFFECTING

    one = lambda df, name: df.select("run_id", F.to_json(F.create_map(*[x for k in RUN_AFFECTING for x in (F.lit(k), F.coalesce(F.col("config")[k], F.lit("")))])).alias(name))
    return one(stored, "stored").join(one(incoming, "incoming"), "run_id").where("stored <> incoming")


def capped(problems: DataFrame, most: int = 20) -> DataFrame:
    """SO-7: problems (path, message, example) grouped, with count and first example; the first ``most``, then how many more."""
    groups = problems.groupBy("path", "message").agg(F.count("*").alias("n"), F.min("example").alias("example"))
    first = groups.orderBy("path", "message").limit(most)
    rest = groups.agg(F.count("*").alias("all")).where(F.col("all") > most).select(F.lit("templates").alias("path"), F.format_string("and %d more problems", F.col("all") - most).alias("message"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("example"))
    return first.unionByName(rest)
