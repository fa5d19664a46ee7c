"""Names, vocabularies and thresholds that all operators share."""

from __future__ import annotations

from pyspark.sql import types as T

#: Version stamped on every table.
SCHEMA_VERSION = "0.4"

#: Identity columns in front of every table, and the stored names they come from.
IDENTITY = ["sample_id", "task_set", "epoch", "transcript_id", "agent"]
STORED_IDENTITY = {
    "sample_id": "transcript_task_id",
    "task_set": "transcript_task_set",
    "epoch": "transcript_task_repeat",
    "transcript_id": "transcript_id",
    "agent": "transcript_agent",
}

#: Thresholds and limits of the rules.
DOUBT = 0.60  # confidence or agreement below which a unit is reviewed, and the gate of an overturn
FILL_CONFIDENCE = 0.3
WEDGE_TURNS = 2
DROP_RATIO = 0.6
SUPPRESS_RADIUS = 1
Z = 1.96
CI_MIN_N = 8
RELIABLE, TENTATIVE, SUSPICIOUS_K_ROLL, RELABEL_WARN, UNJUDGED_WARN = 0.80, 0.66, 0.95, 0.20, 0.25
SPOT_SEED, SPOT_SHARE = 20260831, 0.05
SAMPLE_SEED, SAMPLE_MIN = 20260616, 3
DIGEST = {"text_chars": 300, "final_text_chars": 4000, "tool_call_chars": 200, "tool_result_chars": 0, "tool_only_turns": True}
TARGET_REPLY_CHARS, TASK_CHARS, TASK_PROMPT_CHARS, EXPLANATION_CHARS = 1000, 800, 2400, 120
EXCERPT_CHARS, CARD_BUDGET, TOOLS_SHOWN, PREVIEW_CHARS, ERROR_CHARS = 400, 10, 6, 60, 300
EVIDENCE_LINES, LANE_NAME_CHARS, SPAN_DESCRIPTION_CHARS = 200, 120, 80
CHUNK_TURNS, REVIEWS_PER_CALL, NARRATIONS_PER_CALL = 40, 8, 6

#: Closed vocabularies.
BASES = ["judged", "filled", "attributed", "unattributed", "refusal", "no_answer", "missing_turn"]
UNJUDGED = ["refusal", "no_answer", "missing_turn"]
UNSEEN = ["attributed", "unattributed"]
LABEL_SOURCES = ["single_judge", "majority_vote", "verifier"]
TRIGGERS = ["low_confidence", "low_agreement", "wedge", "random_sample"]
CALL_STATUSES = ["ok", "no_answer", "refusal", "error"]
CHANNELS = ["operator", "input", "input_event", "approval"]
NARRATION = ["complete", "invalid_partition", "empty_groups", "no_narrative", "not_run"]
OPS_LABEL, NONE_LABEL = "ops", "none_of_the_above"

USAGE = ["input_tokens", "output_tokens", "cache_read", "cache_write"]

BALLOT = T.StructType(
    [
        T.StructField("transcript_id", T.StringType()),
        T.StructField("unit", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("roll", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)
