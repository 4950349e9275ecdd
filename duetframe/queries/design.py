"""Queries over designs, audits and serving benchmarks.

The design comes out of the tables: topics are the documents' languages, stances the orders' priorities, openness the
order states; variants are customers, looked-up lines the documents' sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import derived_seed, survey_turn
from ..operators import assignment, audits, serving, summaries
from ..sources import logs
from ..sources.projections import RUN_SEED
from ..storage import scratch_path
from .base import Registry, Tables

R = Registry()
SEED, N_PER_CELL, N_CONTROL = 42, 12, 12
PERSONA = "You care about {topic}. You are {name}, {ideology}, {openness}. {sources} First: {source_1}. {opening}"
REMINDER = "Stay {name} on {topic}."
OPENING = "What should I think about {topic}?"


def _levels(df: DataFrame, column: str) -> DataFrame:
    """(level, code, place, slots) of the values of a column."""
    seen = df.select(F.col(column).alias("level")).where("level is not null").distinct()
    return seen.select("level", F.substring(F.lower("level"), 1, 6).alias("code"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("level")) - 1).alias("place"), F.create_map().cast("map<string,string>").alias("slots"))  # a row for each level


def _variants(t: Tables) -> DataFrame:
    """The design's rule: the variants of a priority are its first three customers by number."""
    each = t.orders.select(F.col("o_orderpriority").alias("parent"), "o_custkey").distinct()
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("o_custkey"))
    first = each.withColumn("rank", rank).where("rank <= 3").withColumn("place", F.col("rank") - 1)  # each task keeps its first three
    return first.select("parent", F.concat(F.lit("v"), "o_custkey").alias("variant"), "place", F.create_map(F.lit("name"), F.concat(F.lit("Customer "), "o_custkey")).alias("slots"))


def _sources(t: Tables) -> DataFrame:
    """The design's rule: the lines looked up for a topic are the first three sources of its language."""
    return t.documents.where("lang is not null and source is not null").groupBy(F.col("lang").alias("topic")).agg(F.slice(F.array_sort(F.collect_set("source")), 1, 3).alias("items"))


def design(t: Tables) -> assignment.Design:
    factors = {"topic": _levels(t.documents, "lang"), "ideology": _levels(t.orders, "o_orderpriority"), "openness": _levels(t.orders, "o_orderstatus")}
    control = {"factor": "ideology", "level": "none", "by": ["topic"], "persona": "You want advice. {opening}", "reminder": "Ask about {topic}.", "mode": "reinforced", "n": N_CONTROL}
    return assignment.Design(factors, PERSONA, REMINDER, N_PER_CELL, 40, ("reinforced", "once"), ("role", "ideology", _variants(t)), {"sources": (("topic",), " ", "source_", _sources(t))}, {"opening": OPENING}, control)


# The same design in SQL, up to the expanded rows.
SQL = f"""WITH topics AS (SELECT lang AS topic, row_number() OVER (ORDER BY lang) - 1 AS tp FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) x),
ideologies AS (SELECT p AS ideology, row_number() OVER (ORDER BY p) - 1 AS ip FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) x),
opens AS (SELECT s AS openness, row_number() OVER (ORDER BY s) - 1 AS op FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) x),
variants AS (SELECT * FROM (SELECT ideology, 'v' || c AS variant, 'Customer ' || c AS name, row_number() OVER (PARTITION BY ideology ORDER BY c) - 1 AS vp FROM (SELECT DISTINCT o_orderpriority AS ideology, o_custkey AS c FROM orders) x) y WHERE vp < 3),
sources AS (SELECT lang AS topic, (list_sort(list_distinct(list(source))))[1:3] AS items FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang),
treated AS (SELECT *, topic || '/' || ideology || '/' || openness AS cell, (tp * (SELECT count(*) FROM ideologies) + ip) * (SELECT count(*) FROM opens) + op AS cp FROM topics, ideologies, opens),
controls AS (SELECT topic, tp, topic || '/none' AS cell FROM topics),
modes AS (SELECT 'reinforced' AS mode, 0 AS mp UNION ALL SELECT 'once', 1),
expanded AS (
  SELECT 'w-' || substr(lower(topic), 1, 6) || '-' || substr(lower(ideology), 1, 6) || '-' || substr(lower(openness), 1, 6) || '-' || variant || '-' || mode || '-' || lpad(cast(k AS varchar), 3, '0') AS dyad_id, cell, 'treated' AS kind, variant, topic, ideology, openness, name, mode AS persona_mode,
         cp * {2 * N_PER_CELL} + mp * {N_PER_CELL} + vp * {N_PER_CELL // 3} + k - 1 AS place
  FROM treated JOIN variants USING (ideology) CROSS JOIN modes CROSS JOIN (SELECT unnest(range(1, {N_PER_CELL // 3 + 1})) AS k) r
  UNION ALL
  SELECT 'w-' || substr(lower(topic), 1, 6) || '-control-reinforced-' || lpad(cast(k AS varchar), 3, '0'), cell, 'control', NULL, topic, 'none', NULL, NULL, 'reinforced', (SELECT count(*) FROM treated) * {2 * N_PER_CELL} + tp * {N_CONTROL} + k - 1
  FROM controls CROSS JOIN (SELECT unnest(range(1, {N_CONTROL + 1})) AS k) r),
planned AS (SELECT e.*, ((place * {(SEED * 2_654_435_761 + 1) % (assignment.MODULUS - 1) + 1} + {(SEED * 40_503 + 7) % assignment.MODULUS}) % {assignment.MODULUS}) + 1 AS seed, sha256('{SEED}|' || place) AS shuffle_key,
  CASE kind WHEN 'treated' THEN 'You care about ' || topic || '. You are ' || name || ', ' || ideology || ', ' || openness || '. ' || array_to_string(items, ' ') || ' First: ' || items[1] || '. What should I think about ' || topic || '?' ELSE 'You want advice. What should I think about ' || topic || '?' END AS persona_text,
  CASE kind WHEN 'treated' THEN 'Stay ' || name || ' on ' || topic || '.' ELSE 'Ask about ' || topic || '.' END AS persona_reminder FROM expanded e LEFT JOIN sources USING (topic))
"""


def add(name: str, sql: str | None):
    """Register a query whose SQL goes on from the design's."""
    def register(f):
        R.add(name, "", None)(f)
        if sql is not None:
            R.sql[name] = SQL + sql
        return f

    return register


@add("as01_treated_cells", "SELECT cell, cp AS cell_place FROM treated")
def _(t: Tables):
    return assignment.treated_cells(design(t)).select("cell", "cell_place")


@add("as02_control_cells", "SELECT cell, topic, 'none' AS ideology, cast(NULL AS varchar) AS openness FROM controls")
def _(t: Tables):
    return assignment.control_cells(design(t)).select("cell", "topic", "ideology", "openness")


@add("se01_all_cells", "SELECT cell, 'treated' AS kind FROM treated UNION ALL SELECT cell, 'control' FROM controls")
def _(t: Tables):
    return assignment.cells(design(t)).select("cell", "kind")


@add("as03_nested_variants", "SELECT cell, variant, cast(vp AS int) AS variant_place FROM treated JOIN variants USING (ideology)")
def _(t: Tables):
    d = design(t)
    return assignment.with_variants(d, assignment.treated_cells(d)).select("cell", "variant", "variant_place")


@add("as04_looked_up_slots", "SELECT cell, array_to_string(items, ' ') AS sources, items[2] AS source_2 FROM treated LEFT JOIN sources USING (topic)")
def _(t: Tables):
    d = design(t)
    rows = assignment.with_slots(d, assignment.with_variants(d, assignment.treated_cells(d)))
    return rows.select("cell", F.col("slots")["sources"].alias("sources"), F.col("slots")["source_2"].alias("source_2")).distinct()


@add("as05_replicates", "SELECT cell, persona_mode, variant, count(*) AS n FROM planned GROUP BY ALL")
def _(t: Tables):
    return assignment.manifest(design(t), SEED).groupBy("cell", "persona_mode", "variant").agg(F.count("*").alias("n"))


@add("as06_seeds", "SELECT dyad_id, seed, shuffle_key FROM planned")
def _(t: Tables):
    return assignment.manifest(design(t), SEED).select("dyad_id", "seed", "shuffle_key")


@add("as07_persona_texts", "SELECT dyad_id, persona_text, persona_reminder FROM planned")
def _(t: Tables):
    return assignment.manifest(design(t), SEED).select("dyad_id", "persona_text", "persona_reminder")


@add("as08_ids_and_keys", "SELECT dyad_id, cell AS key, substr(string_split(topic, '_')[1], 1, 6) AS code FROM planned")
def _(t: Tables):
    d = design(t)
    key = assignment.cell_key(F.col("condition"), list(d.factors), d.control)
    return assignment.manifest(d, SEED).select("dyad_id", key.alias("key"), assignment.topic_code(F.col("condition")["topic"]).alias("code"))


@add("as09_summary", "SELECT 'cell' AS grouping, cell AS key, count(*) AS n FROM planned GROUP BY cell UNION ALL SELECT 'cell/variant', cell || coalesce('/' || variant, ''), count(*) FROM planned GROUP BY cell, variant UNION ALL SELECT 'mode', persona_mode, count(*) FROM planned GROUP BY persona_mode")
def _(t: Tables):
    return assignment.summary(assignment.manifest(design(t), SEED))


@add("as10_study_size", f"SELECT (SELECT count(*) FROM treated) AS cells_treated, (SELECT count(*) FROM controls) AS cells_control, (SELECT count(*) FROM treated) + (SELECT count(*) FROM controls) AS cells_chosen, count(*) AS rows, count(*) AS rows_design, count(*) * 80 AS messages FROM planned")
def _(t: Tables):
    return assignment.study_size(design(t))


@add("pf13_chosen_cells", "SELECT dyad_id, seed FROM planned WHERE cell LIKE 'en/%' AND kind = 'treated'")
def _(t: Tables):
    d = design(t)
    chosen = [r["cell"] for r in assignment.treated_cells(d).where("topic = 'en'").select("cell").collect()]  # cells of a design
    return assignment.manifest(d, SEED, chosen).select("dyad_id", "seed")


@add("so06_preview", "SELECT dyad_id, (SELECT count(*) FROM planned) AS total FROM (SELECT * FROM planned ORDER BY shuffle_key LIMIT 20) x")
def _(t: Tables):
    return assignment.preview(assignment.manifest(design(t), SEED)).select("dyad_id", "total")


@add("se04_catalogue_differences", """, wanted AS (SELECT ideology AS parent, topic FROM ideologies, topics), anchors AS (SELECT DISTINCT o_orderpriority AS parent, CASE o_orderkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'xx' END AS topic FROM orders WHERE o_orderpriority < '4')
SELECT 'no anchors' AS kind, parent || '/' || topic AS key FROM wanted w ANTI JOIN anchors a USING (parent, topic) UNION ALL SELECT 'anchors never looked up', parent || '/' || topic FROM anchors a ANTI JOIN wanted w USING (parent, topic)""")
def _(t: Tables):
    return _gaps(t).where(F.col("kind").isin("no anchors", "anchors never looked up"))


def _gaps(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 5
    anchors = t.orders.where("o_orderpriority < '4'").select(F.col("o_orderpriority").alias("parent"), F.when(k == 0, "en").when(k == 1, "de").when(k == 2, "fr").otherwise("xx").alias("topic")).distinct().withColumn("items", F.array("topic"))
    variants = _variants(t).where("parent < '5'").unionByName(_variants(t).where("place = 0").withColumn("parent", F.lit("elsewhere")))
    return audits.catalogue_gaps(_levels(t.orders, "o_orderpriority"), _levels(t.documents, "lang"), variants, anchors, 2)


@add("dq03_catalogue_coverage", """, wanted AS (SELECT ideology AS parent, topic FROM ideologies, topics), anchors AS (SELECT DISTINCT o_orderpriority AS parent, CASE o_orderkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'xx' END AS topic FROM orders WHERE o_orderpriority < '4'),
v AS (SELECT ideology AS parent, variant FROM variants WHERE ideology < '5' UNION ALL SELECT 'elsewhere', variant FROM variants WHERE vp = 0)
SELECT 'no anchors' AS kind, parent || '/' || topic AS key FROM wanted w ANTI JOIN anchors a USING (parent, topic) UNION ALL SELECT 'anchors never looked up', parent || '/' || topic FROM anchors a ANTI JOIN wanted w USING (parent, topic)
UNION ALL SELECT 'variant under an unknown level', variant FROM v WHERE parent = 'elsewhere' UNION ALL SELECT 'level without a variant', ideology FROM ideologies WHERE ideology >= '5'
UNION ALL SELECT 'repeated slug', variant FROM v GROUP BY variant HAVING count(*) > 1 UNION ALL SELECT 'too many variants', parent FROM v GROUP BY parent HAVING count(*) > 2""")
def _(t: Tables):
    return _gaps(t)


@add("dq05_open_slots", "SELECT 'persona_text' AS template, 'name' AS slot, count(*) AS n, min(dyad_id) AS example FROM planned WHERE kind = 'treated' UNION ALL SELECT 'persona_reminder', 'name', count(*), min(dyad_id) FROM planned WHERE kind = 'treated'")
def _(t: Tables):
    d = design(t)
    d.nested = (d.nested[0], d.nested[1], d.nested[2].withColumn("slots", F.create_map().cast("map<string,string>")))  # variants that lack their name
    return audits.open_slots(assignment.manifest(d, SEED))


def flawed(t: Tables) -> assignment.Design:
    """A design with slots that are given twice, unused, out of order, or hidden from the control."""
    d = design(t)
    d.factors["openness"] = d.factors["openness"].withColumn("slots", F.create_map(F.lit("mood"), "level", F.concat(F.lit("only_"), F.lower("level")), "level"))
    d.factors["topic"] = d.factors["topic"].withColumn("slots", F.create_map(F.lit("short"), "code", F.lit("name"), "code"))  # variants have a name as well
    d.tables["extra"] = (("topic",), ", ", "extra_", d.tables["sources"][3])
    d.derived = {"later": "{opening} {mood}", "opening": OPENING, "known": "{short}, {topic}"}
    d.persona += " {missing} {mood}"
    d.control["persona"] = "You want advice on {known}. {opening} {mood} {later}"
    return d


@add("dq05_unused_slots", """SELECT 'only_' || lower(openness) AS slot, 'level:openness' AS source FROM opens UNION ALL SELECT 'extra', 'table:extra' UNION ALL SELECT 'later', 'derived' WHERE false""")
def _(t: Tables):
    return audits.unused_slots(flawed(t))


@add("dq05_clashing_slots", "SELECT 'name' AS slot, 'level:topic,variant:role' AS sources FROM (SELECT count(*) AS n FROM topics) x WHERE n > 0")
def _(t: Tables):
    return audits.clashing_slots(flawed(t)).withColumn("sources", F.array_join("sources", ","))


@add("dq05_unavailable_slots", """SELECT * FROM (VALUES ('derived.later', 'opening', 'not defined by anything before'), ('templates.persona', 'missing', 'not defined'), ('control.persona', 'mood', 'not available in the control')) v(template, slot, reason) WHERE (SELECT count(*) FROM opens) > 0""")
def _(t: Tables):
    return audits.unavailable_slots(flawed(t))


@add("dq05_slot_sources", """SELECT 'topic' AS slot, 'factor:topic' AS source, 'treated' AS cells UNION ALL SELECT 'ideology', 'factor:ideology', 'treated' UNION ALL SELECT 'openness', 'factor:openness', 'treated' UNION ALL SELECT 'role', 'nested:role', 'treated' UNION ALL SELECT 'name', 'variant:role', 'treated'
UNION ALL SELECT 'mood', 'level:openness', 'treated' UNION ALL SELECT 'only_' || lower(openness), 'level:openness', 'treated' FROM opens UNION ALL SELECT s, 'level:topic', c FROM (VALUES ('short'), ('name')) a(s), (VALUES ('treated'), ('control')) b(c)
UNION ALL SELECT n || x, 'table:' || n, 'treated' FROM (VALUES ('sources'), ('extra')) a(n), (SELECT '' AS x) b UNION ALL SELECT replace(n, 'sources', 'source') || '_' || i, 'table:' || n, 'treated' FROM (VALUES ('sources'), ('extra')) a(n), (SELECT unnest(range(1, (SELECT max(len(items)) FROM sources) + 1)) AS i) r
UNION ALL SELECT s, 'derived', 'treated' FROM (VALUES ('later'), ('opening'), ('known')) a(s) UNION ALL SELECT 'topic', 'factor:topic', 'control' UNION ALL SELECT s, 'derived', 'control' FROM (VALUES ('opening'), ('known')) a(s)""")
def _(t: Tables):
    return audits.slot_sources(flawed(t))


@add("dq06_design_rules", """, v AS (SELECT ideology AS parent, variant FROM variants)
SELECT ideology AS key, 'rows do not split evenly over variants' AS reason FROM ideologies UNION ALL SELECT 'openness/' || openness, 'control level is a treated level' FROM opens WHERE openness = 'F'""")
def _(t: Tables):
    d = design(t)
    levels = d.factors["ideology"].select(F.lit("ideology").alias("factor"), "level", F.col("level").alias("code")).unionByName(d.factors["openness"].select(F.lit("openness").alias("factor"), "level", "code"))
    return audits.design_rules(levels, _variants(t), 13, "F")


@add("dq07_id_collisions", "SELECT 'w-' || substr(lower(topic), 1, 6) || '-' || k AS dyad_id, count(*) AS n FROM treated, (SELECT unnest(range(1, 4)) AS k) r GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables):
    rows = assignment.treated_cells(design(t)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return audits.id_collisions(rows.withColumn("dyad_id", F.concat_ws("-", F.lit("w"), "topic_code", "k"))).select("dyad_id", "n")


@add("dq08_empty_texts", "SELECT dyad_id, 'empty reminder' AS reason FROM planned WHERE kind = 'control'")
def _(t: Tables):
    d = design(t)
    d.control["reminder"] = "  "
    return audits.empty_texts(assignment.manifest(d, SEED))


@add("so07_capped_problems", ", p AS (SELECT 'persona' AS path, cell AS message, count(*) AS n, min(dyad_id) AS example FROM planned GROUP BY cell), t AS (SELECT * FROM p ORDER BY path, message LIMIT 20) SELECT * FROM t UNION ALL SELECT 'templates', 'and ' || (count(*) - 20) || ' more problems', NULL, NULL FROM p HAVING count(*) > 20")
def _(t: Tables):
    return audits.capped(assignment.manifest(design(t), SEED).select(F.lit("persona").alias("path"), F.col("cell").alias("message"), F.col("dyad_id").alias("example")))


@add("rp06_manifest", "SELECT dyad_id, cell, kind, persona_mode, seed, 40 AS n_turns, sha256(persona_text) AS persona FROM planned")
def _(t: Tables):
    return assignment.manifest(design(t), SEED).select("dyad_id", "cell", "kind", "persona_mode", "seed", "n_turns", F.sha2(F.col("persona_text").cast("binary"), 256).alias("persona"))


@R.add("jn08_conditions_outside", "manifest", ", numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, dyad_id, run_id, seed) AS line FROM manifest) SELECT run_id, dyad_id, line, 'ideology not in the grid' AS reason FROM numbered WHERE ideology = 'far_out'")
def _(t: Tables):
    path = scratch_path(t.spark, "planned")
    t.manifest.repartitionByRange(5, "conv_id").sortWithinPartitions("conv_id", "dyad_id", "run_id", "seed").select("run_id", "dyad_id", "condition", "persona_mode", "seed", "n_turns").write.json(path)
    return audits.conditions_outside(logs.read_planned(t.spark, path), _grid(t))


def _grid(t: Tables) -> DataFrame:
    """The levels that the treatments use, but for the control's."""
    keys = ("topic", "ideology", "openness")
    each = t.flat("dyads").select(F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("level")) for k in keys])).alias("x")).select("x.*")
    return each.where("level is not null and level <> 'none'").distinct()


@R.add("dq01_manifest_rows", "manifest", """SELECT run_id, dyad_id, 'unknown persona_mode' AS reason FROM manifest WHERE persona_mode = 'twice' UNION ALL SELECT run_id, dyad_id, 'n_turns not positive' FROM manifest WHERE n_turns <= 0
UNION ALL SELECT run_id, dyad_id, 'reinforced without a reminder' FROM manifest WHERE persona_mode = 'reinforced' AND persona_reminder IS NULL UNION ALL SELECT run_id, dyad_id, 'repeated dyad_id' FROM manifest GROUP BY ALL HAVING count(*) > 1""")
def _(t: Tables):
    return audits.manifest_rows(t.manifest)


@R.add("dq02_grid_gate", "manifest", "SELECT count(*) AS n FROM manifest WHERE ideology <> 'far_out'")
def _(t: Tables):
    outside = audits.conditions_outside(t.manifest, _grid(t)).select("run_id", "dyad_id").distinct()
    return t.manifest.join(outside, ["run_id", "dyad_id"], "left_anti").agg(F.count("*").alias("n"))


@R.add("dq04_instrument", "surveys", """, items AS (SELECT DISTINCT item_id || CASE WHEN lo = 0 THEN '' ELSE '_x' END AS item_id, CASE WHEN item_id <> 'click' THEN battery END AS battery, lo, hi FROM surveys)
SELECT item_id, 'missing battery' AS reason FROM items WHERE battery IS NULL UNION ALL SELECT item_id, 'scale without range' FROM items WHERE lo = hi""")
def _(t: Tables):
    items = t.surveys.select(F.concat("item_id", F.when(F.col("lo") == 0, "").otherwise("_x")).alias("item_id"), F.when(F.col("item_id") != "click", F.col("battery")).alias("battery"), "lo", "hi", F.lit("How much?").alias("text")).distinct()
    return audits.instrument_items(items)


@R.add("dq09_wrong_seeds", "turns dyads", "SELECT t.run_id, t.dyad_id, t.attempt, t.turn, t.agent, t.seed - 1 AS expected FROM turns t JOIN dyads d USING (run_id, dyad_id, attempt) WHERE t.conv_id % 29 = 3")
def _(t: Tables):
    return audits.wrong_seeds(t.turns, t.dyads, RUN_SEED).select("run_id", "dyad_id", "attempt", "turn", "agent", "expected")


SEED_OF = f"cast('0x' || substr(sha256('{RUN_SEED}|' || d.seed || '|' || x.dyad_id || '|' || x.attempt || '|' || {{}} || '|' || {{}}), 1, 8) AS bigint)"
SURVEY_SEED = SEED_OF.format("CASE phase WHEN 'pre' THEN 0 ELSE d.n_turns + 1 END", "'survey:' || phase || ':' || item_id")
SCORE_SEED = SEED_OF.format("x.turn", "'judge:' || agent || ':' || metric")


def logged_seeds(rows: DataFrame, dyads: DataFrame, turn, tag) -> DataFrame:
    """``rows`` with the seed that their log should have, one off where ``pos`` is a multiple of 13."""
    given = dyads.select("run_id", "dyad_id", "attempt", F.col("seed").alias("dyad_seed"), "n_turns")
    right = derived_seed(F.lit(RUN_SEED), F.col("dyad_seed"), F.col("dyad_id"), F.col("attempt"), turn, tag)
    return rows.join(given, ["run_id", "dyad_id", "attempt"]).withColumn("turn", turn).withColumn("seed", right + (F.col("pos") % 13 == 0).cast("int")).drop("dyad_seed", "n_turns")


@R.add("dq09_survey_seeds", "surveys survey_dyads", f"SELECT x.run_id, x.dyad_id, x.attempt, item_id, phase, x.pos, {SURVEY_SEED} AS expected FROM surveys x JOIN survey_dyads d USING (run_id, dyad_id, attempt) WHERE x.pos % 13 = 0")
def _(t: Tables):
    tag = F.concat(F.lit("survey:"), F.col("phase"), F.lit(":"), F.col("item_id"))
    rows = logged_seeds(t.surveys, t.survey_dyads, survey_turn(F.col("phase"), F.col("n_turns")), tag)
    return audits.wrong_seeds(rows, t.survey_dyads, RUN_SEED, tag).select("run_id", "dyad_id", "attempt", "item_id", "phase", "pos", "expected")


@R.add("dq09_score_seeds", "scores dyads", f"SELECT x.run_id, x.dyad_id, x.attempt, x.turn, agent, metric, x.pos, {SCORE_SEED} AS expected FROM scores x JOIN (SELECT DISTINCT run_id, dyad_id, attempt, seed FROM dyads) d USING (run_id, dyad_id, attempt) WHERE x.pos % 13 = 0")
def _(t: Tables):
    tag = F.concat_ws(":", F.lit("judge"), "agent", "metric")
    rows = logged_seeds(t.scores, t.dyads.select("run_id", "dyad_id", "attempt", "seed", "n_turns").distinct(), F.col("turn"), tag)
    return audits.wrong_seeds(rows, t.dyads, RUN_SEED, tag).select("run_id", "dyad_id", "attempt", "turn", "agent", "metric", "pos", "expected")


@R.add("dq10_run_records", "runs", "SELECT run_id, 'changed tree' AS reason FROM runs WHERE dirty UNION ALL SELECT run_id, 'unknown commit' FROM runs WHERE harness_commit IS NULL UNION ALL SELECT run_id, 'another date than most runs' FROM runs WHERE now <> '2026-01-01'")
def _(t: Tables):
    return audits.run_records(t.runs)


@R.add("dq10_instrument_changes", "surveys", "SELECT run_id, count(DISTINCT user_id % 2) AS versions FROM surveys GROUP BY run_id HAVING count(DISTINCT user_id % 2) > 1")
def _(t: Tables):
    return audits.instrument_changes(t.surveys.withColumn("batteries_sha256", F.sha2((F.col("user_id") % 2).cast("string").cast("binary"), 256)))


@R.add("dq12_config_conflicts", "runs", "SELECT run_id FROM runs WHERE run_id = 'r1'")
def _(t: Tables):
    stored = t.runs.select("run_id", F.create_map(F.lit("run_seed"), F.lit("7"), F.lit("now"), F.col("now"), F.lit("concurrency"), F.lit("8")).alias("config"))
    incoming = t.runs.select("run_id", F.create_map(F.lit("run_seed"), F.when(F.col("run_id") == "r1", "8").otherwise("7"), F.lit("now"), F.col("now"), F.lit("concurrency"), F.lit("4")).alias("config"))
    return audits.config_conflicts(stored, incoming).select("run_id")


@R.add("jn09_model_mismatches", "turns runs", "SELECT t.run_id, agent, model_sha256, count(*) AS n FROM turns t JOIN runs r USING (run_id) WHERE model_sha256 <> CASE agent WHEN 'seeker' THEN seeker_sha256 ELSE mentor_sha256 END GROUP BY ALL")
def _(t: Tables):
    return audits.model_mismatches(t.turns, t.runs)


@R.add("ag17_configurations", "streams", "SELECT model, np, count(*) AS streams_ok, sum(tokens) AS tokens, round(max(seconds), 6) AS wall_s, round(sum(tokens) / max(seconds), 6) AS aggregate_tps, round(avg(tokens / seconds), 6) AS per_stream_tps, round(avg(prompt_tokens), 6) AS prefill_per_turn FROM streams WHERE error IS NULL AND tokens > 0 GROUP BY ALL")
def _(t: Tables):
    return serving.configurations(t.streams)


@R.add("ag17_accepted_depths", "streams", "SELECT model, count(*) AS n FROM streams WHERE abs(prompt_tokens - 1000) <= 50 GROUP BY 1")
def _(t: Tables):
    return serving.acceptance(t.streams, 1000).groupBy("model").agg(F.count("*").alias("n"))


RATES = ", rates AS (SELECT model, np, sum(tokens) / max(seconds) AS tps FROM streams WHERE error IS NULL AND tokens > 0 GROUP BY ALL)"


@R.add("ag18_parallel_gain", "streams", RATES + " SELECT model, np, round(tps, 6) AS aggregate_tps, round(tps / first_value(tps) OVER (PARTITION BY model ORDER BY np), 6) AS gain FROM rates")
def _(t: Tables):
    return serving.parallel_gain(serving.configurations(t.streams))


@R.add("ag18_arm_days", "streams", RATES + " SELECT model, np, round(500 / tps, 6) AS days FROM rates")
def _(t: Tables):
    return serving.arm_days(serving.configurations(t.streams), turns=40)


@R.add("ag19_context_need", "runs", "SELECT run_id, cast(max_turns * 400 + 2048 AS bigint) AS need, n_ctx, n_ctx >= max_turns * 400 + 2048 AS fits FROM runs")
def _(t: Tables):
    return summaries.context_need(t.runs)


@R.add("ag20_text_balance", "", r"SELECT lang AS level, count(*) AS n, round(avg(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))), 6) AS mean_words, round(avg(len(regexp_extract_all(coalesce(text, ''), '[.!?]'))), 6) AS mean_anchors FROM documents GROUP BY lang")
def _(t: Tables):
    return summaries.text_balance(t.documents, "lang")
