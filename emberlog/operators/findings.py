"""Read findings from loosely formed JSON responses and shape them into alerts.

A response is one text per chunk, made outside this package. Items are held as VARIANT, since one array may mix
objects, strings and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.schema import ALERT, MAX_AFFECTED_LINES, MAX_TITLE_CHARS, REMEDIATION, SEVERITIES, conform

# --- fixed values -----------------------------------------------------------------
FENCES = r"```(?:json)?\s*|\s*```"
DEFAULT_TITLE = "Unknown threat"
ERROR_TITLE = "Analysis error"
ERROR_TEXT = "LLM response was not valid JSON: "
QUOTED_CHARS = 300
# ----------------------------------------------------------------------------------
NO_ANSWER = "The scoring model gave no answer."
ERROR_ADVICE = "Check that the scoring model is running and reachable."


def cleanup(raw: Column) -> Column:
    """Drop code fences, then any text before the first brace."""
    bare = F.regexp_replace(F.regexp_replace(raw, FENCES, ""), r"^\s+|\s+$", "")
    at = F.instr(bare, "{")
    return F.when(at > 1, F.substr(bare, at)).otherwise(bare)


def decode(cleaned: Column) -> Column:
    """Members of the leading JSON object, each as VARIANT; text after the object is ignored, null if malformed.

    Of a member given twice the last one counts, as inside of items (``session.configure``).
    """
    return F.from_json(cleaned, "map<string,variant>", {"allowSingleQuotes": "false"})


def _member(decoded: Column, name: str) -> Column:
    given = F.filter(F.map_entries(decoded), lambda e: e["key"] == name)
    return F.try_element_at(given, F.lit(-1))["value"]


def items(decoded: Column) -> Column:
    """Elements of ``alerts``; an absent or ill-typed list is empty."""
    listed = F.try_variant_get(_member(decoded, "alerts"), "$", "array<variant>")
    return F.when(decoded.isNotNull(), F.coalesce(listed, F.array().cast("array<variant>")))


def _is_object(item: Column) -> Column:
    return F.schema_of_variant(item).startswith("OBJECT")


def objects(listed: Column) -> Column:
    return F.filter(listed, _is_object)


def chunk_summary(decoded: Column) -> Column:
    return F.coalesce(F.try_variant_get(_member(decoded, "chunk_summary"), "$", "string"), F.lit(""))


def text_field(item: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(default))


def severity(item: Column) -> Column:
    """Upper-cased severity; INFO when absent, not a text, or not one of the five."""
    given = F.upper(F.try_variant_get(item, "$.severity", "string"))
    return F.when(given.isin(*SEVERITIES), given).otherwise("INFO")


def title(item: Column) -> Column:
    return F.left(text_field(item, "title", DEFAULT_TITLE), F.lit(MAX_TITLE_CHARS))


def string_list(item: Column, name: str) -> Column:
    """A list of texts; a lone text counts as a list of one, anything else as empty."""
    lone = F.try_variant_get(item, f"$.{name}", "string")
    is_text = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING"
    return F.coalesce(
        F.try_variant_get(item, f"$.{name}", "array<string>"),
        F.when(is_text, F.array(lone)),
        F.array().cast("array<string>"),
    )


def remediation(item: Column) -> Column:
    """Kept only when it is an object with a command."""
    r = F.try_variant_get(item, "$.remediation", "variant")
    command = F.try_variant_get(r, "$.command", "string")
    kept = F.struct(
        text_field(r, "action", "none").alias("action"),
        command.alias("command"),
        F.coalesce(F.try_variant_get(r, "$.reversible", "boolean"), F.lit(True)).alias("reversible"),
        text_field(r, "undo_command").alias("undo_command"),
    ).cast(REMEDIATION)
    return F.when(_is_object(r) & (command != ""), kept)


def needs_repair(decoded: Column) -> Column:
    """No object among the items, but a text in their place."""
    listed = items(decoded)
    text = F.exists(listed, lambda i: F.schema_of_variant(i) == "STRING")
    bare = F.try_variant_get(_member(decoded, "alerts"), "$", "string") != ""
    bare = bare & (F.schema_of_variant(_member(decoded, "alerts")) == "STRING")
    return F.coalesce(
        decoded.isNotNull() & ~F.exists(listed, _is_object) & (text | F.coalesce(bare, F.lit(False))),
        F.lit(False),
    )


def read_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add ``decoded``, ``items`` (objects only), ``chunk_summary`` and ``needs_repair``; no shuffle."""
    out = responses.withColumn("decoded", decode(cleanup(F.col(response))))
    return out.withColumns({
        "items": objects(items(F.col("decoded"))),
        "chunk_summary": chunk_summary(F.col("decoded")),
        "needs_repair": needs_repair(F.col("decoded")),
    })


def repair_resolve(responses: DataFrame, repaired: DataFrame, keys: list[str]) -> DataFrame:
    """Second answers replace first ones that needed repair; where none came the first one stands.

    ``repaired`` holds ``keys`` and ``repaired_response``, at most one row per key.
    """
    read = read_responses(responses)
    picked = F.when(F.col("needs_repair"), F.col("repaired_response"))
    return (
        read.join(repaired.select(*keys, "repaired_response"), keys, "left")
        .withColumn("response", F.coalesce(picked, F.col("response")))
        .drop("decoded", "items", "chunk_summary", "needs_repair", "repaired_response")
    )


def alert_id(*parts: Column) -> Column:
    """A repeatable id in UUID form, so that a task run again gives the same alert."""
    h = F.md5(F.concat_ws("\u0001", *[p.cast("string") for p in parts]))
    return F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def alerts_from_responses(responses: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Alerts of every response, and one INFO alert for each response that is not JSON.

    ``responses``: ``source_file, chunk_index, response`` and, from ``chunks.chunk_table``, ``log_format``,
    ``timestamp_first``, ``timestamp_last``, ``first_lines``. No shuffle.
    """
    read = read_responses(responses)
    now = generated_at if generated_at is not None else F.current_timestamp()
    item = F.col("item")
    found = (
        read.select("*", F.posexplode("items").alias("pos", "item"))
        .withColumns({
            "severity": severity(item),
            "title": title(item),
            "description": text_field(item, "description"),
            "recommendation": text_field(item, "recommendation"),
            "iocs": string_list(item, "iocs"),
            "affected_lines": F.slice(string_list(item, "affected_lines"), 1, MAX_AFFECTED_LINES),
            "remediation": remediation(item),
        })
    )
    failed = (
        read.filter(F.col("decoded").isNull())
        .withColumns({
            "pos": F.lit(-1),
            "severity": F.lit("INFO"),
            "title": F.lit(ERROR_TITLE),
            "description": F.when(F.col("response").isNull(), NO_ANSWER).otherwise(
                F.concat(F.lit(ERROR_TEXT), F.left("response", F.lit(QUOTED_CHARS)))),
            "recommendation": F.lit(ERROR_ADVICE),
            "iocs": F.array().cast("array<string>"),
            "affected_lines": F.slice("first_lines", 1, MAX_AFFECTED_LINES),
            "timestamp_first": F.lit(None),
            "timestamp_last": F.lit(None),
        })
    )
    named = F.col("source_file"), F.col("chunk_index"), F.col("pos")
    both = found.drop("item").unionByName(failed, allowMissingColumns=True)
    return conform(both.withColumns({"id": alert_id(*named), "generated_at": now}), ALERT)
