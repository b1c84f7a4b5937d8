"""Usage events: consent, wire rows, jobs, settings and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import ellipsis, first_non_empty, truthy
from .records import one_json

# Fixed value: what an error message becomes without consent.
MASKED_ERROR = "Error occurred (details withheld without consent)"
ERROR_LENGTH = 200


def mask(events: DataFrame, consent: Column) -> DataFrame:
    """Without consent, prompt and metadata are null and an error that says something becomes a constant. With it,
    long errors are cut. A null consent is none."""
    yes = F.coalesce(consent, F.lit(False))
    error = F.col("error_message")
    return events.withColumns({
        "prompt_text": F.when(yes, F.col("prompt_text")),
        "metadata": F.when(yes, F.col("metadata")),
        "error_message": F.when(yes, ellipsis(error, ERROR_LENGTH)).when(F.length(error) > 0, MASKED_ERROR).otherwise(error),
    })


#: Columns of a row on the wire, in order.
WIRE = (
    "customer_uuid", "session_id", "event_type", "tool_name", "prompt_text", "success", "duration_ms", "error_message", "version", "platform",
    "app_version", "metadata", "event_timestamp",
)


def wire_row(events: DataFrame, consent: Column) -> DataFrame:
    """Events, masked by consent, as the rows that are sent: missing metadata is an empty object, times are whole seconds."""
    masked = mask(events, consent)
    return masked.withColumns({"metadata": F.coalesce("metadata", F.lit("{}")), "event_timestamp": epoch_seconds(F.col("ts"))}).select(*WIRE)


def enabled(configured: Column, *disabling: Column) -> Column:
    """Whether events are recorded: configured so, and no disabling setting means yes."""
    off = F.lit(False)
    for x in disabling:
        off = off | truthy(x)
    return F.coalesce(configured, F.lit(False)) & ~off


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds; what is behind the second is lost."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("bigint")


# Job states by service, as running or done. What is in neither list has failed.
RUNNING = {"list": (), "queue": ("IN_QUEUE", "IN_PROGRESS"), "run": ("WAIT", "RUN")}
DONE = {"list": ("Done",), "queue": ("COMPLETED",), "run": ("DONE",)}


def job_status(status: Column) -> Column:
    """Whether a job's statuses are all done; an empty list is."""
    return F.forall(status, lambda s: s == "Done")


def job_state(status: Column, service: str) -> Column:
    """running, done or failed, by the service's own words; null for a null status."""
    return F.when(status.isNull(), None).when(status.isin(*DONE[service]), "done").when(status.isin(*RUNNING[service]), "running").otherwise("failed")


def last_status(rows: DataFrame, job: str, status: str, order: str) -> DataFrame:
    return rows.groupBy(job).agg(F.max_by(status, order).alias("last_status"), F.max(order).alias("last_order"))


def setting(preference: Column, scene: Column, env: Column) -> Column:
    """The first of preference, scene and environment that isn't empty, else the empty string."""
    return first_non_empty(preference, scene, env)


def setting_with_trial(preference: Column, scene: Column, env: Column, trial: str) -> Column:
    """As ``setting``, but a scene that holds the trial key wins."""
    return F.when(scene == trial, scene).otherwise(setting(preference, scene, env))


def command(raw: Column) -> dict[str, Column]:
    """Type and parameters of a command envelope; null, and not ``valid``, for text that isn't one JSON value, or is two."""
    valid = one_json(raw)
    text = lambda k: F.when(valid, F.get_json_object(raw, f"$.{k}"))
    return {"type": text("type"), "params": text("params"), "valid": valid}


def respond(known: list[str], kind: Column, valid: Column | None = None) -> dict[str, Column]:
    """A response: success for a known command, else an error that names it."""
    ok = F.coalesce(kind.isin(known), F.lit(False))
    message = F.concat(F.lit("Unknown command type: "), F.coalesce(kind, F.lit("null")))
    if valid is not None:
        ok, message = ok & valid, F.when(valid, message).otherwise("Invalid JSON")
    return {"status": F.when(ok, "success").otherwise("error"), "message": F.when(~ok, message)}


def response_json(reply: dict[str, Column], result: Column) -> Column:
    """The response as it is sent: status with the result, or with the message."""
    good = reply["status"] == "success"
    return F.to_json(F.struct(reply["status"].alias("status"), F.when(good, result).alias("result"), reply["message"].alias("message")))


def http_route(status: Column) -> Column:
    return F.when(status == 200, "ok").when(status == 401, "unauthorised").when(status == 404, "not found").otherwise("failed")
