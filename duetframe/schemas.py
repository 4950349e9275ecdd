"""Declared schemas of the run log's relations, one row a line of JSON in the log."""

from __future__ import annotations

RUN_KEY = ["run_id", "dyad_id", "attempt"]

SCHEMAS = {
    "dyads": "run_id string, dyad_id string, attempt int, condition map<string,string>, persona_text string, persona_reminder string, persona_mode string, seed bigint, n_turns int, ts string",
    "status": "run_id string, dyad_id string, attempt int, status string, reason string, ts string",
    "turns": "run_id string, dyad_id string, attempt int, turn int, agent string, model_sha256 string, persona_mode string, id_slot int, temperature double, top_p double, n_predict int, prompt_sha256 string, prompt_chars int, seed bigint, prompt_n int, predicted_n int, expected_new int, cache_warning boolean, truncated boolean, tokens_evaluated int, tokens_cached int, finish_reason string, text string, timings map<string,double>, adherence double, error string, ts string",
    "surveys": "run_id string, dyad_id string, attempt int, phase string, origin string, item_id string, battery string, scale struct<min:int,max:int>, batteries_sha256 string, model_sha256 string, template_sha256 string, id_slot int, turn int, temperature double, n_predict int, prompt_sha256 string, prompt_chars int, seed bigint, answer int, answer_method string, raw_text string, prompt_n int, error string, ts string",
    "scores": "run_id string, dyad_id string, attempt int, turn int, agent string, metric string, judge_sha256 string, id_slot int, harness_commit string, seed bigint, judge_prompt_sha256 string, prompt_chars int, score double, rationale string, raw_text string, error string, ts string",
    "flags": "run_id string, dyad_id string, attempt int, ideology string, topic string, openness string, role string, persona_mode string, metric string, threshold double, run_length int, rule string, judge_sha256 string, flagged boolean, first_flag_turn int, scored_turns int, unscored_turns int, turns_under int, min_score double, mean_score double, final_turn int, harness_commit string, ts string",
}
MANIFEST = "run_id string, started_at string, seeker struct<model_path:string,model_sha256:string,alias:string,family:string>, mentor struct<model_path:string,model_sha256:string,alias:string,family:string>, judge struct<model_path:string,model_sha256:string,alias:string,family:string>, config map<string,string>, input_manifest struct<path:string,sha256:string>, harness_commit string, dirty boolean"
PLANNED = "run_id string, dyad_id string, condition map<string,string>, persona_text string, persona_reminder string, persona_mode string, seed bigint, n_turns int"
INSTRUMENT = "version string, items array<struct<id:string,battery:string,scale:struct<min:int,max:int>,text:string>>"
BENCH = "model string, backend string, run string, depth int, n_parallel int, kv string, ctx_total int, load_s double, streams_ok int, cold_wall_s double, cold_pp_tokens bigint, cold_agg_prefill_tps double, warm_wall_s double, warm_gen_tokens bigint, warm_agg_tps double, warm_per_stream_tps double, warm_prefill_per_turn double, gtt_gib double, note string"

# Fixed values of the data model.
SEEKER, MENTOR = "seeker", "mentor"
NONE_LEVEL, ALL_LEVEL = "(none)", "all"
METRICS = [("prompt_to_line", SEEKER), ("line_to_line", SEEKER), ("alignment", MENTOR)]
RUN_AFFECTING = ["seeker", "mentor", "judge", "generation", "run_seed", "batteries", "now"]
MODES = ["once", "reinforced"]
