"""The run log's relations projected from plain tables, as one SQL text for two dialects.

``conversations`` become dialogues (turns, dyads, ledger, judge scores), ``orders`` a ledger of many attempts, ``events``
surveys, ``lineitem`` benchmark streams. The text is run by Spark for the queries and put in front of the DuckDB SQL that
checks them, so that both see the same rows; only a few spellings differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SEED = 7
# The levels strong_left, lean_left, moderate, lean_right and strong_right, and the control's none, are fixed values of the design.


@dataclass(frozen=True)
class Dialect:
    """What Spark and DuckDB spell differently."""

    name: str
    div: str
    text: str

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.name == "spark" else f"sha256({x})"

    def bits(self, x: str) -> str:
        return f"cast(conv(substr({self.sha(x)}, 1, 8), 16, 10) as bigint)" if self.name == "spark" else f"cast('0x' || substr(sha256({x}), 1, 8) as bigint)"

    def rows(self, array: str, alias: str) -> str:
        """One row for each element of an array of integers, beside the row it comes from."""
        return f"LATERAL VIEW explode({array}) t AS {alias}" if self.name == "spark" else f", unnest({array}) AS t({alias})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.name == "spark" else f"[{', '.join(items)}]"


SPARK, DUCKDB = Dialect("spark", "div", "string"), Dialect("duckdb", "//", "varchar")


def messages(d: Dialect) -> str:
    return """SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role <> 'system'"""


def turns(d: Dialect) -> str:
    """A message of a dialogue; every seventh dialogue was tried twice. Some messages failed, some seeds are wrong on purpose."""
    seed = d.bits(f"'{RUN_SEED}|' || cast(1000 + conv_id as {d.text}) || '|d' || cast(conv_id as {d.text}) || '|' || cast(attempt as {d.text}) || '|' || cast((rn + 1) {d.div} 2 as {d.text}) || '|' || CASE rn % 2 WHEN 1 THEN 'seeker' ELSE 'mentor' END")
    return f"""
SELECT conv_id, 'r' || cast(conv_id % 4 as {d.text}) AS run_id, 'd' || cast(conv_id as {d.text}) AS dyad_id, cast(attempt as int) AS attempt,
       cast((rn + 1) {d.div} 2 as int) AS turn, CASE rn % 2 WHEN 1 THEN 'seeker' ELSE 'mentor' END AS agent,
       attempt * 1000000000000 + conv_id * 1000 + rn AS pos, text,
       CASE WHEN (conv_id * 7 + rn) % 23 = 0 THEN 'error' WHEN (conv_id + rn) % 11 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
       CASE WHEN (conv_id * 7 + rn) % 23 = 0 THEN 'server' END AS error,
       {d.sha(f"'model-' || CASE WHEN conv_id % 31 = 5 THEN 'other' WHEN rn % 2 = 1 THEN 'seeker' ELSE 'mentor' END")} AS model_sha256,
       cast(length(text) {d.div} 4 + (conv_id % 5) * 40 as int) AS prompt_n, cast(length(text) {d.div} 4 as int) AS expected_new,
       length(text) {d.div} 4 + (conv_id % 5) * 40 > length(text) {d.div} 4 + 64 AS cache_warning,
       (conv_id + rn) % 37 = 0 AS truncated,
       {seed} + CASE WHEN conv_id % 29 = 3 THEN 1 ELSE 0 END AS seed,
       '2026-01-' || lpad(cast(1 + conv_id % 28 as {d.text}), 2, '0') || 'T' || lpad(cast(rn % 24 as {d.text}), 2, '0') || ':00:00+0000' AS ts
FROM messages {d.rows(f"CASE WHEN conv_id % 7 = 0 THEN {d.array('1', '2')} ELSE {d.array('1')} END", 'attempt')}"""


def dyads(d: Dialect) -> str:
    """A dialogue's treatment; every seventeenth attempt lacks it, every eleventh dialogue is a control."""
    return f"""
SELECT conv_id, run_id, dyad_id, attempt, 1000 + conv_id AS seed, n_turns, pos,
       CASE conv_id % 2 WHEN 0 THEN 'immigration_enforcement' ELSE 'decarbonization' END AS topic,
       CASE WHEN conv_id % 11 = 0 THEN 'none' WHEN conv_id % 5 = 0 THEN 'strong_left' WHEN conv_id % 5 = 1 THEN 'lean_left' WHEN conv_id % 5 = 2 THEN 'moderate' WHEN conv_id % 5 = 3 THEN 'lean_right' ELSE 'strong_right' END AS ideology,
       CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 4 < 2 THEN 'open' ELSE 'closed' END AS openness,
       CASE WHEN conv_id % 11 = 0 THEN NULL ELSE 'role' || cast(conv_id % 3 as {d.text}) END AS role,
       CASE WHEN conv_id % 3 = 0 THEN 'once' ELSE 'reinforced' END AS persona_mode,
       'You are persona ' || cast(conv_id as {d.text}) AS persona_text,
       CASE WHEN conv_id % 13 <> 6 THEN 'Stay persona ' || cast(conv_id as {d.text}) END AS persona_reminder
FROM (SELECT conv_id, run_id, dyad_id, attempt, max(turn) AS n_turns, min(pos) AS pos FROM turns GROUP BY conv_id, run_id, dyad_id, attempt) t
WHERE conv_id % 17 <> 4"""


def status(d: Dialect) -> str:
    """The ledger of the dialogues: a start for each attempt, failures before retries, completion of most."""
    return f"""
SELECT run_id, dyad_id, attempt, status, CASE status WHEN 'failed' THEN 'server error in turn ' || cast(conv_id % 4 as {d.text}) END AS reason, conv_id * 10 + step AS pos,
       '2026-02-' || lpad(cast(1 + conv_id % 28 as {d.text}), 2, '0') || 'T' || lpad(cast(step as {d.text}), 2, '0') || ':30:00+0000' AS ts
FROM (
  SELECT DISTINCT conv_id, run_id, dyad_id, 1 AS attempt, 'started' AS status, 1 AS step FROM turns
  UNION ALL SELECT DISTINCT conv_id, run_id, dyad_id, 1, 'failed', 2 FROM turns WHERE conv_id % 7 = 0
  UNION ALL SELECT DISTINCT conv_id, run_id, dyad_id, 2, 'started', 3 FROM turns WHERE conv_id % 7 = 0
  UNION ALL SELECT DISTINCT conv_id, run_id, dyad_id, CASE WHEN conv_id % 7 = 0 THEN 2 ELSE 1 END, CASE WHEN conv_id % 20 = 10 THEN 'failed' ELSE 'complete' END, 4 FROM turns WHERE conv_id % 20 <> 0
) l"""


def scores(d: Dialect) -> str:
    """Two judges' scores of every message by its agent's metrics; some are null, some failed, some repeat."""
    return f"""
SELECT conv_id, run_id, dyad_id, attempt, turn, agent, metric, {d.sha("'judge-' || cast(judge_no as " + d.text + ")")} AS judge_sha256,
       CASE WHEN (conv_id + turn) % 13 = 0 OR (conv_id + turn) % 29 = 0 THEN NULL ELSE cast((conv_id * 37 + turn * 11 + judge_no * 7 + metric_no * 13 + again * 5) % 101 AS double) / 100 END AS score,
       CASE WHEN (conv_id + turn) % 29 = 0 THEN 'judge down' END AS error,
       ((again * 2 + judge_no) * 10 + metric_no) * 10000000000000 + pos AS pos,
       '2026-03-' || lpad(cast(1 + conv_id % 28 as {d.text}), 2, '0') || 'T00:00:00+0000' AS ts
FROM (
  SELECT t.*, metric, metric_no, judge_no, again FROM turns t
  JOIN (SELECT 'prompt_to_line' AS metric, 0 AS metric_no, 'seeker' AS by_agent UNION ALL SELECT 'line_to_line', 1, 'seeker' UNION ALL SELECT 'alignment', 2, 'mentor') m ON t.agent = m.by_agent
  CROSS JOIN (SELECT 1 AS judge_no UNION ALL SELECT 2) j
  JOIN (SELECT 0 AS again UNION ALL SELECT 1) a ON again = 0 OR conv_id % 6 = 1
) s"""


def surveys(d: Dialect) -> str:
    """Answers before and after, an item for each kind of event; some are null, some were asked again later."""
    return f"""
SELECT 'e' || cast(user_id % 3 as {d.text}) AS run_id, 'u' || cast(user_id as {d.text}) AS dyad_id, 1 AS attempt, event_id AS pos, event_type AS item_id, user_id,
       CASE WHEN event_type IN ('view', 'click') THEN 'ideological' ELSE 'thermometer' END AS battery,
       CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS lo,
       CASE WHEN event_type IN ('view', 'click') THEN 5 WHEN event_type = 'purchase' THEN 0 ELSE 10 END AS hi,
       CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'pre' ELSE 'post' END AS phase,
       CASE WHEN event_id % 41 = 0 THEN 'readministered' WHEN event_id % 3 = 0 THEN 'run' END AS origin,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE cast(event_id % 5 + 1 as int) END AS answer,
       CASE WHEN event_id % 17 = 0 THEN 'none' WHEN event_id % 9 = 0 THEN 'labelled' ELSE 'json' END AS answer_method,
       CASE event_id % 8 WHEN 0 THEN '{{"answer": ' || cast(event_id % 7 as {d.text}) || '}}' WHEN 1 THEN '{{"answer": "' || cast(event_id % 5 + 1 as {d.text}) || '"}}'
            WHEN 2 THEN cast(event_id % 5 + 1 as {d.text}) || '/5' WHEN 3 THEN '3 or 4' WHEN 4 THEN 'My answer is ' || cast(event_id % 6 as {d.text}) || '.'
            WHEN 5 THEN cast(event_id % 12 as {d.text}) WHEN 6 THEN 'four' ELSE 'I cannot answer that.' END AS raw_text
FROM events"""


def survey_dyads(d: Dialect) -> str:
    return f"""
SELECT DISTINCT run_id, dyad_id, attempt, user_id, user_id AS pos, user_id AS seed, 4 AS n_turns,
       CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 5 < 2 THEN 'left' WHEN user_id % 5 = 2 THEN 'moderate' ELSE 'right' END AS ideology,
       CASE WHEN user_id % 2 = 0 THEN 'open' ELSE 'closed' END AS openness, 'energy' AS topic
FROM surveys WHERE user_id % 23 <> 1"""


def survey_status(d: Dialect) -> str:
    return """
SELECT run_id, dyad_id, 1 AS attempt, CASE WHEN user_id % 10 = 0 THEN 'failed' ELSE 'complete' END AS status, user_id AS pos FROM (SELECT DISTINCT run_id, dyad_id, user_id FROM surveys) u
UNION ALL SELECT 'e0', 'silent' || run_id, 1, 'complete', 1000000000 FROM (SELECT DISTINCT run_id FROM surveys) s"""


def ledger(d: Dialect) -> str:
    """A long ledger: a customer is a dyad and each order an attempt."""
    return f"""
SELECT 'o' || cast(o_custkey % 5 as {d.text}) AS run_id, 'c' || cast(o_custkey as {d.text}) AS dyad_id,
       cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) as int) AS attempt, o_orderkey AS pos, o_orderpriority AS level,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'started' ELSE 'complete' END AS status
FROM orders"""


def manifest(d: Dialect) -> str:
    """What was planned: every dialogue, some that never started, and a few bad rows."""
    return f"""
SELECT run_id, dyad_id, n_turns, persona_mode, persona_text, persona_reminder, topic, ideology, openness, role, seed, conv_id FROM dyads WHERE attempt = 1
UNION ALL SELECT run_id, 'x' || dyad_id, CASE WHEN conv_id % 50 = 0 THEN 0 ELSE n_turns END, CASE WHEN conv_id % 3 = 0 THEN 'twice' ELSE persona_mode END, persona_text, persona_reminder, topic, CASE WHEN conv_id % 2 = 0 THEN 'far_out' ELSE ideology END, openness, role, seed, conv_id FROM dyads WHERE attempt = 1 AND conv_id % 25 = 0
UNION ALL SELECT run_id, dyad_id, n_turns, persona_mode, persona_text, persona_reminder, topic, ideology, openness, role, seed, conv_id FROM dyads WHERE attempt = 1 AND conv_id % 37 = 1"""


def runs(d: Dialect) -> str:
    """A run's manifest."""
    return f"""
SELECT run_id, planned, {d.sha("'model-seeker'")} AS seeker_sha256, {d.sha("'model-mentor'")} AS mentor_sha256, '/models/Qwen3.6-35B.gguf' AS seeker_path,
       CASE WHEN run_id = 'r1' THEN '/models/gpt-oss-20b.gguf' ELSE '/models/Olmo-3-7B.gguf' END AS mentor_path,
       CASE WHEN run_id = 'r2' THEN '2026-01-02' ELSE '2026-01-01' END AS now, run_id = 'r3' AS dirty, CASE WHEN run_id <> 'r0' THEN 'abc123' END AS harness_commit,
       200 AS n_predict, CASE WHEN run_id = 'r1' THEN NULL WHEN run_id = 'r2' THEN 2048 ELSE 65536 END AS n_ctx, max_turns
FROM (SELECT run_id, count(*) AS planned, max(n_turns) AS max_turns FROM manifest GROUP BY run_id) m"""


def streams(d: Dialect) -> str:
    """Streams of a serving benchmark."""
    return """
SELECT cast(l_suppkey as int) AS model, l_linenumber AS np, l_quantity AS tokens, l_extendedprice / 1000 AS seconds, l_partkey AS prompt_tokens, CASE WHEN l_returnflag = 'R' THEN 'failed' END AS error FROM lineitem"""


RELATIONS = {f.__name__: f for f in (messages, turns, dyads, status, scores, surveys, survey_dyads, survey_status, ledger, manifest, runs, streams)}
#: What each relation reads.
NEEDS = {"messages": ["conversations"], "turns": ["messages"], "dyads": ["turns"], "status": ["turns"], "scores": ["turns"], "surveys": ["events"], "survey_dyads": ["surveys"], "survey_status": ["surveys"], "ledger": ["orders"], "manifest": ["dyads"], "runs": ["manifest"], "streams": ["lineitem"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in NEEDS and n not in out:
            out += [x for x in [*_closure(NEEDS[n]), n] if x not in out]
    return out


def prelude(*names: str, recursive: bool = False) -> str:
    """DuckDB's WITH clause of relations; further ones may follow after a comma."""
    parts = [f"{n} AS ({RELATIONS[n](DUCKDB)})" for n in _closure(list(names))]
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) if parts else ""


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over the tables in ``sf_dir``."""
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_named(name), **{n: relation(spark, sf_dir, n) for n in NEEDS[name]})


def _named(name: str) -> str:
    """The relation's text with its inputs as parameters of ``spark.sql``."""
    import re

    text = RELATIONS[name](SPARK).replace("{", "{{").replace("}", "}}")
    for n in NEEDS[name]:
        text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return text


def with_condition(df: DataFrame, keys: tuple[str, ...] = ("topic", "ideology", "openness", "role")) -> DataFrame:
    """The treatment's columns as the map that the log holds."""
    here = [k for k in keys if k in df.columns]
    return df.withColumn("condition", F.create_map(*[x for k in here for x in (F.lit(k), F.col(k))])).drop(*here)
