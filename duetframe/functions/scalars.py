"""Column functions of the experiment's data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import METRICS, NONE_LEVEL, SEEKER

# Model families by name pattern; the first that matches counts.
FAMILIES = [("gpt-oss", r"gpt[-_]?oss"), ("qwen", "qwen"), ("olmo", "olmo"), ("glm", r"\bglm|(^|[^a-z])glm"), ("gemma", "gemma"), ("llama", "llama"), ("mistral", "mistral|mixtral"), ("phi", r"(^|[^a-z])phi[-_ ]?\d"), ("deepseek", "deepseek")]
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ssZ"


def attempt_or_first(attempt: Column) -> Column:
    """PF-1: a missing or non-numeric attempt is the first."""
    return F.coalesce(attempt.try_cast("int"), F.lit(1))


def status_label(status: Column) -> Column:
    """PF-7: complete, failed, or running for anything else."""
    return F.when(status.isin("complete", "failed"), status).otherwise("running")


def level_label(value: Column) -> Column:
    """PF-8: a condition value as a level."""
    return F.coalesce(value.cast("string"), F.lit(NONE_LEVEL))


def sha256(text: Column) -> Column:
    """SC-1: hex digest of the UTF-8 text."""
    return F.sha2(text.cast("binary"), 256)


def first_32_bits(text: Column) -> Column:
    """The number in the first eight hex digits of a text's SHA-256."""
    return F.conv(F.substring(sha256(text), 1, 8), 16, 10).cast("bigint")


def derived_seed(run_seed: Column, dyad_seed: Column, dyad_id: Column, attempt: Column, turn: Column, tag: Column) -> Column:
    """SC-2: a seed that depends on nothing but its six parts; a missing dyad seed is 0 and other missing parts are empty."""
    parts = [run_seed, F.coalesce(dyad_seed, F.lit(0)), dyad_id, attempt, turn, tag]
    return first_32_bits(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def in_subsample(run_seed: int, dyad_id: Column, fraction: float) -> Column:
    """PF-12: whether a whole dyad belongs to a deterministic fraction of all dyads."""
    if not 0 < fraction <= 1:
        raise ValueError(f"the fraction must be in (0, 1], not {fraction}")
    return first_32_bits(F.concat(F.lit(f"{run_seed}|"), F.coalesce(dyad_id, F.lit("")))) / F.lit(float(1 << 32)) < fraction


def model_family(name: Column) -> Column:
    """SC-5: the family in a path or alias; null if none is known."""
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    out = F.lit(None).cast("string")
    for family, pattern in reversed(FAMILIES):
        out = F.when(base.rlike(pattern), family).otherwise(out)
    return F.when(name.isNull() | (name == ""), None).otherwise(out)


def normalised_delta(delta: Column, low: Column, high: Column) -> Column:
    """SC-6: a shift as a share of its scale; null on a scale without range."""
    return F.try_divide(delta.cast("double"), (high - low).cast("double"))


def finish_reason(raw: Column) -> Column:
    """SC-10: why a generation stopped, from the server's raw response; old and new servers say it differently."""
    limit = (F.coalesce(F.get_json_object(raw, "$.stop_type"), F.lit("")) == "limit") | (F.coalesce(F.get_json_object(raw, "$.stopped_limit"), F.lit("")) == "true")
    return F.when(limit, "length").otherwise("stop")


def instant(ts: Column) -> Column:
    """SC-11: a log's timestamp text as an instant; null if it is none."""
    return F.try_to_timestamp(ts, F.lit(TS_FORMAT))


def canonical_digest(entries: Column) -> Column:
    """SC-12: a digest of a map that does not depend on the order of its keys."""
    return sha256(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))))


def canonical_json(text: Column) -> Column:
    """SC-12: a JSON text with sorted keys at every depth and no space between; null if it is none.

    Variants keep the fields of an object by name, so writing one is canonical. Repeated keys are no valid variant.
    """
    return F.to_json(F.try_parse_json(text))


def canonical_json_digest(text: Column) -> Column:
    """SC-12: a digest of a JSON text of any depth that depends on neither the order of keys nor on white space."""
    return sha256(canonical_json(text))


def speaker_rank(agent: Column) -> Column:
    """Within a turn the seeker speaks first."""
    return F.when(agent == SEEKER, 0).otherwise(1)


def metric_rank(metric: Column) -> Column:
    """The defined order of metrics; unknown ones follow."""
    out = F.lit(len(METRICS))
    for i, (name, _) in reversed(list(enumerate(METRICS))):
        out = F.when(metric == name, i).otherwise(out)
    return out


def is_number(value: Column) -> Column:
    """PF-5: whether a variant holds a number, booleans excluded."""
    return F.coalesce(F.schema_of_variant(value).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))


def standard_error(value: Column) -> Column:
    """Sample deviation over the root of n; null below two values."""
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def well_formed_id(name: Column) -> Column:
    """PF-6: a run or dyad id that is safe as a folder name."""
    return name.rlike(r"^[A-Za-z0-9_.-]+$") & ~name.isin(".", "..") & ~name.startswith("-")


def survey_turn(phase: Column, n_turns: Column) -> Column:
    """SC-9: the turn that a survey's seeds use: 0 before the dialogue, one past the last after it."""
    return F.when(phase == "pre", 0).otherwise(n_turns + 1)
