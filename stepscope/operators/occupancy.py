"""Accelerator occupancy from monitor snapshots."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LIST_SEPARATOR, OWNER_GONE, OWNER_HOST, OWNER_UNKNOWN
from ..functions.layout import latest_before
from .classify import sql_text

CSV = r"split(text, ', *')"


def csv_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards and processes from snapshots in CSV form ``(node, line_no, text)`` with two section marks."""
    marks = lines.filter("startswith(text, '===')").groupBy("node").agg(
        F.expr("min(IF(startswith(text, '===NAMES==='), line_no, NULL)) AS names_at"),
        F.expr("min(IF(startswith(text, '===APPS==='), line_no, NULL)) AS apps_at"))
    rows = lines.filter("NOT startswith(text, '===')").join(marks, "node", "left").selectExpr(
        "node", f"{CSV} AS f", "CASE WHEN line_no > apps_at THEN 'apps' WHEN line_no > names_at THEN 'names' ELSE 'cards' END AS section")
    cards = rows.filter(r"section = 'cards' AND size(f) >= 6 AND f[0] RLIKE '^[0-9]+$'").selectExpr(
        "node", "CAST(f[0] AS BIGINT) AS card", "f[1] AS uuid", "f[2] AS bus", "concat(f[3], 'MB') AS mem_used",
        "concat(f[4], 'MB') AS mem_total", "concat(f[5], '%') AS util")
    names = rows.filter(r"section = 'names' AND f[0] RLIKE '^[0-9]+$'").selectExpr(
        "node", "CAST(f[0] AS BIGINT) AS pid", "IF(coalesce(f[1], '') IN ('', '[Not Supported]'), '-', f[1]) AS process") \
        .groupBy("node", "pid").agg(F.expr("max(process) AS process"))
    apps = rows.filter(r"section = 'apps' AND f[1] RLIKE '^[0-9]+$'").selectExpr(
        "node", "f[0] AS uuid", "CAST(f[1] AS BIGINT) AS pid", "f[2] AS process_mem")
    processes = apps.join(cards.select("node", "uuid", "card"), ["node", "uuid"]).join(names, ["node", "pid"], "left").selectExpr(
        "node", "card", "pid", "coalesce(process, '-') AS process", "process_mem")
    return cards.drop("uuid"), processes


def table_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards and processes from snapshots in boxed-table form ``(node, line_no, text)``."""
    words = lines.selectExpr("node", "line_no", "text", r"split(trim(text), '\\s+') AS w")
    heads = words.filter(r"text RLIKE '^[|] *[0-9]+ +[A-Za-z]'").selectExpr(
        "node", "line_no", "w[1] AS card", "w[4] AS bus", "w[7] AS util")
    memory = words.filter("contains(text, 'MB')").filter(r"NOT text RLIKE '^[|] *[0-9]+ +[A-Za-z]'")
    paired = latest_before(memory.select("node", "line_no", "w"), heads.select("node", "line_no", "card", "bus", "util"), ["node"],
                           "line_no", F.struct(F.col("line_no").alias("head"), "card", "bus", "util"), F.lit(0), "h")
    cards = paired.filter("h IS NOT NULL").groupBy("node", "h").agg(F.expr("min_by(w, line_no) AS w")).selectExpr(
        "node", "CAST(h.card AS BIGINT) AS card", "h.bus AS bus", "w[4] AS mem_used", "w[6] AS mem_total", "h.util AS util")
    after = lines.filter("contains(text, 'Processes:')").groupBy("node").agg(F.expr("min(line_no) AS from_line"))
    processes = words.filter(r"text RLIKE '^[|] *[0-9]+ +[0-9]+'").join(after, "node").filter("line_no > from_line").selectExpr(
        "node", "CAST(w[1] AS BIGINT) AS card", "CAST(w[2] AS BIGINT) AS pid",
        "coalesce(nullif(array_join(slice(w, 4, greatest(size(w) - 6, 0)), ' '), ''), '-') AS process", "w[size(w) - 3] AS process_mem")
    return cards, processes


def owners(processes: DataFrame, lookup: DataFrame) -> DataFrame:
    """Processes with their container, host or exited label; ``lookup`` is ``(node, pid, tag, container)``."""
    label = (f"CASE tag WHEN 'MAP' THEN container WHEN 'GONE' THEN {sql_text(OWNER_GONE)} WHEN 'HOST' THEN {sql_text(OWNER_HOST)} "
             f"ELSE {sql_text(OWNER_UNKNOWN)} END AS owner")
    return processes.join(lookup, ["node", "pid"], "left").selectExpr("node", "card", "pid", "process", "process_mem", label)


def card_state(cards: DataFrame, owned: DataFrame) -> DataFrame:
    """Busy (has a process), stuck (memory held without one) or idle, with the owners of each card."""
    per_card = owned.select("node", "card", "pid", "owner").groupBy("node", "card").agg(
        F.expr("count(DISTINCT pid) AS process_count"),
        F.expr(f"array_join(array_sort(collect_set(owner)), '{LIST_SEPARATOR}') AS owners"))
    return cards.join(per_card, ["node", "card"], "left").selectExpr(
        "node", "card", "bus", "mem_used", "mem_total", "util", "coalesce(process_count, 0L) AS process_count", "owners",
        "CASE WHEN process_count > 0 THEN 'busy' WHEN coalesce(try_cast(regexp_replace(mem_used, 'MB$', '') AS BIGINT), 0) > 0 "
        "THEN 'stuck' ELSE 'idle' END AS state")


def idle_cards(cards: DataFrame) -> DataFrame:
    """Cards without memory in use and without load."""
    return cards.filter("try_cast(regexp_replace(mem_used, 'MB$', '') AS DOUBLE) = 0 AND try_cast(regexp_replace(util, '%$', '') AS DOUBLE) = 0")
