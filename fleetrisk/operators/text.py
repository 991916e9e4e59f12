"""Text operators over message tables: intent routing, canned answers, summaries, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- FIXED VALUES: routing words (ordered rule sets) -----------------------
CAUSE_WORDS = ["why", "cause", "root cause", "reason"]
ACTION_WORDS = ["recommend", "action", "what should", "maintenance"]
FEATURE_WORDS = ["shap", "important", "feature"]
PERFORMANCE_WORDS = ["accuracy", "performance", "metric"]
RISK_WORDS = ["risk", "level"]

# --- FIXED VALUES: canned answers ------------------------------------------
CAUSE_ANSWER = (
    "Based on the model's analysis, the most common root causes for inverter issues include:\n"
    "1. **Temperature stress** — prolonged high inverter temperatures reduce component lifespan\n"
    "2. **PV string degradation** — zero or low-current strings indicate panel/wiring issues\n"
    "3. **Grid instability** — frequency deviations from 50Hz stress the inverter's synchronization\n"
    "4. **Accumulated alarms** — repeated alarm events signal developing faults\n\n"
    "For a specific diagnosis, please provide the inverter telemetry data."
)
ACTION_ANSWER = (
    "**Recommended maintenance actions:**\n"
    "- **No Risk (Level 0):** Continue routine monitoring. Schedule next inspection per normal cycle.\n"
    "- **Degradation Risk (Level 1):** Inspect within 7 days. Check PV string connections, clean panels, verify power factor.\n"
    "- **Shutdown Risk (Level 2):** Immediate inspection required. Check alarm codes, inverter temperature, grid connection stability.\n\n"
    "Always correlate findings with local weather data and grid conditions."
)
HELP_ANSWER = (
    "I'm the Solar Inverter AI Assistant. I can help with:\n"
    "- Explaining failure predictions and risk levels\n"
    "- Identifying root causes from SHAP analysis\n"
    "- Recommending maintenance actions\n"
    "- Analyzing inverter performance trends\n\n"
    "Try asking: 'What are the top risk factors?' or 'Why is inverter X showing degradation?'"
)
FEATURE_ANSWER = ("The top risk-driving features are: %s. These were identified using SHAP analysis "
                  "on the XGBoost binary classifier.")
PERFORMANCE_ANSWER = "Binary classifier CV performance — Mean F1: %.3f, Mean AUC: %.3f, Mean Precision: %.3f"
RISK_ANSWER = ("Risk levels: 0=No Risk (system healthy), 1=Degradation Risk (performance drop, inspect in 7 days), "
               "2=Shutdown Risk (immediate action needed, check alarms).")
DEFAULT_ANSWER = ("I'm the Solar Inverter AI Assistant. Ask me about model performance, SHAP feature importance, "
                  "risk levels, or provide inverter data for analysis.")
SUMMARY_HEAD = "**Inverter %s** — "
SUMMARY_LEVEL = {
    "no_risk": "Operating normally (failure probability: %s). ",
    "degradation_risk": "⚠️ Degradation risk detected (failure probability: %s). ",
    "other": "\U0001f6a8 HIGH SHUTDOWN RISK (failure probability: %s). ",
}
ANOMALY_SUFFIX = " ⚠️ Anomalous behavior detected by Isolation Forest."


def contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def route_intent(text: Column) -> Column:
    """TX1: cause -> maintenance -> help, first matching rule wins."""
    return (F.when(contains_any(text, CAUSE_WORDS), "cause")
            .when(contains_any(text, ACTION_WORDS), "maintenance").otherwise("help"))


def intent_answer(intent: Column) -> Column:
    return (F.when(intent == "cause", CAUSE_ANSWER).when(intent == "maintenance", ACTION_ANSWER)
            .otherwise(HELP_ANSWER))


def route_topic(text: Column) -> Column:
    """TX2: features -> performance -> risk -> default."""
    return (F.when(contains_any(text, FEATURE_WORDS), "features")
            .when(contains_any(text, PERFORMANCE_WORDS), "performance")
            .when(contains_any(text, RISK_WORDS), "risk").otherwise("default"))


def topic_answer(topic: Column, top_features: Column, f1: Column, auc: Column, precision: Column) -> Column:
    """TX2 answers; ``top_features`` is an array of names (first five are used)."""
    feats = F.array_join(F.slice(top_features, 1, 5), ", ")
    return (F.when(topic == "features", F.format_string(FEATURE_ANSWER, feats))
            .when(topic == "performance", F.format_string(PERFORMANCE_ANSWER, f1, auc, precision))
            .when(topic == "risk", RISK_ANSWER).otherwise(DEFAULT_ANSWER))


def pct1(prob: Column) -> Column:
    """Python's ``{:.1%}``."""
    return F.format_string("%.1f%%", prob * 100)


def prediction_summary(inverter_id: Column, level: Column, prob: Column, factors: Column,
                       is_anomaly: Column) -> Column:
    """TX3: one sentence per prediction; ``factors`` = array<struct<feature, direction>>."""
    head = F.format_string(SUMMARY_HEAD, inverter_id)
    body = (F.when(level == "no_risk", F.format_string(SUMMARY_LEVEL["no_risk"], pct1(prob)))
            .when(level == "degradation_risk", F.format_string(SUMMARY_LEVEL["degradation_risk"], pct1(prob)))
            .otherwise(F.format_string(SUMMARY_LEVEL["other"], pct1(prob))))
    top = F.slice(factors, 1, 3)
    drivers = F.array_join(F.transform(top, lambda f: F.concat(f["feature"], F.lit(" ("), f["direction"], F.lit(")"))), ", ")
    key = F.when(F.size(factors) > 0, F.concat(F.lit("Key drivers: "), drivers, F.lit("."))).otherwise(F.lit(""))
    tail = F.when(is_anomaly, F.lit(ANOMALY_SUFFIX)).otherwise(F.lit(""))
    return F.concat(head, body, key, tail)


def prompt_text(context_json: Column, question: Column) -> Column:
    """TX4: optional JSON context block, then the question."""
    ctx = F.when(context_json.isNotNull(),
                 F.concat(F.lit("Context data:\n```json\n"), context_json, F.lit("\n```\n\n"))).otherwise(F.lit(""))
    return F.concat(ctx, F.lit("User question: "), question)


def _json_value(c: Column) -> Column:
    listed = F.to_json(F.array(c))  # a value alone isn't valid input of to_json
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def context_json(context: Column, inverter_id: Column | None = None) -> Column:
    """TX4: a map of any values as JSON, one key a line, 2 spaces in; NULL where there is nothing to tell.

    ``inverter_id``, where not NULL, replaces the entry of that name or follows the others. Nested values stay on one line.
    """
    own = inverter_id if inverter_id is not None else F.lit(None).cast("string")
    entries = F.coalesce(F.map_entries(context), F.array())
    lines = F.transform(entries, lambda e: F.concat(
        F.lit("  "), _json_value(e["key"]), F.lit(": "),
        F.when((e["key"] == "inverter_id") & own.isNotNull(), _json_value(own)).otherwise(_json_value(e["value"]))))
    named = F.exists(entries, lambda e: e["key"] == "inverter_id")
    lines = F.when(own.isNull() | named, lines).otherwise(
        F.concat(lines, F.array(F.concat(F.lit('  "inverter_id": '), _json_value(own)))))
    return F.when(F.size(lines) > 0, F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))
