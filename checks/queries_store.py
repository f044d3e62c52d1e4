"""Store, alert, ignore-list, rewrite, fleet, stream and source queries over whole tables."""

from __future__ import annotations

import functools
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions import fixed
from sievelight.operators import alerts as A
from sievelight.operators import fleet, store
from sievelight.operators.builtin import (
    HITS_TYPE,
    detect_builtin,
    explode_hits,
    with_builtin_hits,
)
from sievelight.operators.evaluate import case_counts, confusion, dedup_cases, evaluate_cases
from sievelight.operators.ignore import (
    apply_ignored_values,
    mark_ignored,
    unmark_ignored,
)
from sievelight.operators.merge import merge_matches
from sievelight.operators.ranks import page, with_places
from sievelight.operators.reveal import (
    reveal_pairs,
    reveal_requested,
    revealed_report,
    trim_reveal_hits,
    trim_reveal_pairs,
)
from sievelight.operators.rewrite import neutralize, neutralize_spans
from sievelight.operators.rules import compile_rules
from sievelight.plans.scan import scan
from sievelight.plans.session import stored
from sievelight.sources.archives import (
    audit_zip_encryption,
    docx_text,
    expand_zip,
    zip_budget,
    zip_texts,
)
from sievelight.sources.catalog import load_rules
from sievelight.sources.files import (
    decode_text,
    file_size_gate,
    is_hidden_path,
    is_ignored_extension,
    is_in_watched_dirs,
    missing_files,
    recent_first,
    route_by_extension,
    text_if_not_binary,
)
from sievelight.sources.sheets import sheet_cells_to_text
from sievelight.sources.tables import scan_table_text
from sievelight.streaming.debounce import debounce_batch
from sievelight.streaming.sessions import session_batch

from . import corpora
from . import detect_sql as D
from .queries_detect import _catalog_rules, _rules_sql
from .registry import (
    DOCS,
    ORDER_NOTES,
    PROFILES,
    documents,
    joined,
    order_notes,
    profiles,
    query,
    ranked,
    table,
)

SALT = "pepper"


def epoch(column: str):
    return F.unix_timestamp(F.col(column).cast("timestamp"))


# --- stored scans: one per order line, of files that are parts ---------------------------------

_Q = "l_quantity::int"
_SCAN_COLUMNS = {
    "scan_id": "l_orderkey * 10 + l_linenumber",
    "file_id": "l_partkey",
    "risk_score": "l_quantity::bigint",
    "n_mail": f"{_Q} % 4",
    "n_card": f"case when {_Q} % 7 = 0 then {_Q} % 3 + 1 else 0 end",
    "n_name": "l_linenumber % 2",
    "n_rule": f"case when l_returnflag = 'R' then {_Q} % 3 else 0 end",
    "weak": f"{_Q} = 50 and l_linenumber = 1",
    "risk_level": f"case when {_Q} >= 45 then 'critical' when {_Q} >= 30 then 'high' when {_Q} >= 10 then 'medium' else 'low' end",
}
_FILE_COLUMNS = {
    "file_id": "p_partkey",
    "path": "concat('/data/', p_partkey::string, '/', p_name, '.csv')",
    "size": "p_size::bigint",
    "last_seen_at": "(1000000 + p_partkey * 7)::bigint",
    "ignored": "p_partkey % 10 = 0",
    "deleted": "p_partkey % 13 = 0",
}
_RULE_NAME = "case when file_id % 2 = 0 then 'badge' else 'contract' end"

_SCANS_SQL = "scans as (" + corpora.select(
    {**_SCAN_COLUMNS, "scanned_at": "epoch(l_shipdate)::bigint"}, "lineitem"
) + ")"
_FILES_SQL = "files as (" + corpora.select(_FILE_COLUMNS, "part") + ")"
_LATEST_SQL = (
    "latest as (select * from scans qualify row_number() over (partition by file_id "
    "order by scanned_at desc, scan_id desc) = 1)"
)
_KEEP = "(n_mail > 0 or n_card > 0 or weak or n_rule > 0 or (n_name > 0 and risk_score >= 10))"
_PRIMARY = (
    "case when weak then 'weak_archive_encryption' when n_mail + n_card = 0 then 'file_name_signal' "
    "when n_mail >= n_card then 'email' else 'credit_card' end"
)


def _one(category, count):
    return F.struct(
        category.alias("category"),
        count.cast("bigint").alias("count"),
        F.array(F.lit("**")).alias("redacted_examples"),
    )


def _scans(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr(
        *[f"{e} as {n}" for n, e in _SCAN_COLUMNS.items()], "l_shipdate"
    )
    return raw.select(
        "scan_id",
        "file_id",
        epoch("l_shipdate").alias("scanned_at"),
        "risk_score",
        "risk_level",
        F.col("weak").alias("weak_zip_encryption"),
        F.array(
            _one(F.lit("email"), F.col("n_mail")),
            _one(F.lit("credit_card"), F.col("n_card")),
            _one(F.lit("file_name_signal"), F.col("n_name")),
        ).alias("findings"),
        F.array(_one(F.expr(_RULE_NAME), F.col("n_rule"))).alias("custom_findings"),
    )


def _files(spark, sf):
    return table(spark, sf, "part").selectExpr(*[f"{e} as {n}" for n, e in _FILE_COLUMNS.items()])


@query(
    "latest_scan",
    f"with {_SCANS_SQL}, {_LATEST_SQL} select file_id, scan_id, scanned_at, risk_score, risk_level from latest",
)
def latest_scan(spark, sf):
    return store.latest_scans(_scans(spark, sf)).select(
        "file_id", "scan_id", "scanned_at", "risk_score", "risk_level"
    )


@query(
    "alerts",
    f"""with {_SCANS_SQL}, {_LATEST_SQL}, {_FILES_SQL}
    select f.file_id, f.path, risk_score, risk_level, scanned_at, {_PRIMARY} as primary_type,
      concat_ws(', ', case when weak then 'weak_archive_encryption' end,
        case when n_mail > 0 then concat('email (', n_mail, ')') end,
        case when n_card > 0 then concat('credit_card (', n_card, ')') end,
        case when n_rule > 0 then concat({_RULE_NAME.replace('file_id', 'f.file_id')}, ' (', n_rule, ')') end) as summary
    from files f join latest s on s.file_id = f.file_id where not deleted and {_KEEP}""",
)
def alerts(spark, sf):
    found = A.latest_alerts(_files(spark, sf), _scans(spark, sf))
    weak = F.col("weak_zip_encryption")
    return found.select(
        "file_id", "path", "risk_score", "risk_level", "scanned_at",
        A.primary_type(F.col("findings"), weak).alias("primary_type"),
        A.summarize_types(F.col("findings"), F.col("custom_findings"), weak).alias("summary"),
    )


_PAYLOAD_TYPES = (
    "concat_ws('|', case when n_mail > 0 then 'email' end, case when n_card > 0 then 'credit_card' end, "
    f"case when n_name > 0 then 'file_name_signal' end, case when n_rule > 0 then {_RULE_NAME.replace('file_id', 'f.file_id')} end)"
)


@query(
    "alert_payload",
    f"""with {_SCANS_SQL}, {_LATEST_SQL}, {_FILES_SQL}
    select f.file_id, path, risk_level, risk_score, {_PAYLOAD_TYPES} as types, last_seen_at
    from files f join latest s on s.file_id = f.file_id""",
)
def alert_payload(spark, sf):
    reports = store.files_with_latest_scan(_files(spark, sf), _scans(spark, sf))
    return A.alert_payload(reports).withColumn("types", joined(F.col("types")))


# fleet alerts: one per event, from devices that are users
_FLEET_COLUMNS = {
    "device_id": "concat('d', user_id::string)",
    "device_name": "concat('pc-', user_id::string, '-', event_type)",
    "file_id": "event_id",
    "path": "concat('/home/', event_id::string)",
    "risk_level": "case when value > 90 then 'critical' when value > 50 then 'high' when value > 20 then 'medium' else 'low' end",
    "risk_score": "floor(value)::bigint",
    "type": "case event_id % 4 when 0 then 'email' when 1 then 'badge' when 2 then 'weak_archive_encryption' else event_type end",
}


def _fleet_alerts(spark, sf):
    raw = table(spark, sf, "events").selectExpr(
        *[f"{e} as {n}" for n, e in _FLEET_COLUMNS.items()], "ts"
    )
    return raw.select(
        "device_id",
        "device_name",
        epoch("ts").alias("received_at"),
        "file_id",
        "path",
        "risk_level",
        "risk_score",
        F.array("type").alias("types"),
        epoch("ts").alias("last_seen_at"),
    )


_FLEET_SQL = "fleet as (" + corpora.select(
    {**_FLEET_COLUMNS, "received_at": "floor(epoch(ts))::bigint"}, "events"
) + ")"


@query(
    "visible_alerts",
    f"""with {_SCANS_SQL}, {_LATEST_SQL}, {_FILES_SQL}, {_FLEET_SQL},
    items as (
      select 'local' as kind, 'local' as device_id, f.file_id::string as file_id, path, risk_level, risk_score,
             last_seen_at as alert_time, {_PRIMARY} as primary_type,
             n_mail > 0 or weak or (n_rule > 0 and f.file_id % 2 = 0) as wanted
      from files f join latest s on s.file_id = f.file_id where not deleted and {_KEEP} and not ignored
      union all
      select 'server', device_id, file_id::string, path, risk_level, risk_score, received_at, type,
             type in ('email', 'badge', 'weak_archive_encryption') from fleet)
    select * exclude (wanted) from items where wanted and risk_level in ('high', 'critical')""",
)
def visible_alerts(spark, sf):
    local = A.alert_rows(_files(spark, sf), _scans(spark, sf))
    items = A.visible_alerts(
        local, _fleet_alerts(spark, sf), risks=["high", "critical"],
        types=["email", "badge", "weak_archive_encryption"],
    )
    return items.select(
        "kind", "device_id", "file_id", "path", "risk_level", "risk_score", "alert_time", "primary_type"
    )


_ITEMS_SQL = f"""with {_SCANS_SQL}, {_LATEST_SQL}, {_FILES_SQL}, {_FLEET_SQL},
    items as (
      select 'local' as kind, 'local' as device_id, f.file_id::string as file_id, risk_level,
             last_seen_at as alert_time, {_PRIMARY} as primary_type
      from files f join latest s on s.file_id = f.file_id where not deleted and {_KEEP} and not ignored
      union all
      select 'server', device_id, file_id::string, risk_level, received_at, type from fleet)"""
_RANK = "case risk_level when 'low' then 0 when 'medium' then 1 when 'high' then 2 else 3 end"
_ORDERS = {
    "risk_desc": f"{_RANK} desc, alert_time desc",
    "risk_asc": f"{_RANK}, alert_time desc",
    "recent": "alert_time desc",
    "type": "primary_type",
}


@query(
    "alert_orders",
    _ITEMS_SQL
    + " union all ".join(
        f"""(select '{name}' as sort, kind, device_id, file_id,
        row_number() over (order by {order}, kind, device_id, file_id) as rank from items)"""
        for name, order in _ORDERS.items()
    ),
)
def alert_orders(spark, sf):
    """The whole alert list in each of its orders, with the place of each row."""
    local = stored(A.alert_rows(_files(spark, sf), _scans(spark, sf)), "alerts")
    remote = stored(_fleet_alerts(spark, sf), "alerts")
    heads = [
        with_places(A.visible_alerts(local, remote, sort=name).select("kind", "device_id", "file_id")).select(
            F.lit(name).alias("sort"), "kind", "device_id", "file_id", "rank"
        )
        for name in _ORDERS
    ]
    return functools.reduce(DataFrame.unionByName, heads)


@query(
    "alerts_order",
    f"""with {_SCANS_SQL}, {_LATEST_SQL}, {_FILES_SQL}
    select f.file_id, row_number() over (order by risk_score desc, scanned_at desc, f.file_id) as rank
    from files f join latest s on s.file_id = f.file_id where not deleted and {_KEEP}""",
)
def alerts_order(spark, sf):
    return with_places(A.latest_alerts(_files(spark, sf), _scans(spark, sf)).select("file_id"))


@query(
    "alerts_page",
    f"""with {_SCANS_SQL}, {_LATEST_SQL}, {_FILES_SQL}, placed as (
    select f.file_id, row_number() over (order by risk_score desc, scanned_at desc, f.file_id) as rank
    from files f join latest s on s.file_id = f.file_id where not deleted and {_KEEP})
    select * from placed where rank > 50 and rank <= 100""",
)
def alerts_page(spark, sf):
    """The second page of fifty alerts."""
    return page(with_places(A.latest_alerts(_files(spark, sf), _scans(spark, sf)).select("file_id")), 2, 50)


@query(
    "device_alerts",
    f"""with {_FLEET_SQL} select device_id, file_id::string as file_id, received_at as alert_time, type as primary_type
    from fleet where device_id = 'd1'""",
)
def device_alerts(spark, sf):
    local = A.alert_rows(_files(spark, sf), _scans(spark, sf))
    items = A.visible_alerts(local, _fleet_alerts(spark, sf), device="d1", sort="recent")
    return items.select("device_id", "file_id", "alert_time", "primary_type")


@query(
    "type_options",
    f"""with {_SCANS_SQL}, {_LATEST_SQL}, {_FILES_SQL}, {_FLEET_SQL}
    select distinct type from (
      select {_RULE_NAME.replace('file_id', 'f.file_id')} as type from files f join latest s on s.file_id = f.file_id
      where not deleted and {_KEEP}
      union all select type from fleet where type not in {D.in_list(fixed.CATEGORIES)})""",
)
def type_options(spark, sf):
    local = A.alert_rows(_files(spark, sf), _scans(spark, sf))
    return A.type_options(local, _fleet_alerts(spark, sf))


@query(
    "device_options",
    f"with {_FLEET_SQL} select device_id, max_by(device_name, received_at * 100000000 + file_id) as device_name from fleet group by device_id",
)
def device_options(spark, sf):
    return A.device_options(_fleet_alerts(spark, sf), F.struct("received_at", "file_id"))


# --- fleet ------------------------------------------------------------------------------------

_NOW = 1705276800  # 2024-01-15
_REQUEST_AUTH = (
    "case when event_id % 7 = 0 then '' when event_id % 11 = 0 then 'Bearer tok-nobody' "
    "when event_id % 3 = 0 then ' Bearer tok-5' when event_id % 13 = 0 then concat('Basic tok-', user_id::string) "
    "else concat('Bearer tok-', user_id::string) end"
)
_DEVICE_COLUMNS = {
    "device_id": "concat('d', c_custkey::string)",
    "device_name": "c_name",
    "token": "concat('tok-', c_custkey::string)",
    "paired_at": "(1700000000 + c_custkey)::bigint",
    "expires_at": "(1704200000 + c_custkey % 40 * 50000)::bigint",
    "enabled": "c_custkey % 7 <> 0",
    "last_seen_at": "case when c_custkey % 2 = 0 then 1704000000::bigint end",
}
_DEVICES_SQL = "devices as (" + corpora.select(_DEVICE_COLUMNS, "customer") + ")"
_JUDGED_SQL = f"""requests as (select event_id, floor(epoch(ts))::bigint as received_at, trim({_REQUEST_AUTH}) as auth from events),
    asked as (select *, case when auth like 'Bearer %' then substr(auth, 8) else '' end as tok from requests),
    judged as (select event_id, received_at, device_id, device_name,
      case when tok = '' then 'missing_token' when device_id is null then 'unknown_token'
           when not enabled then 'device_disabled' when expires_at <= received_at then 'device_expired'
           else 'accepted' end as status
      from asked left join devices on token = tok)"""


def _devices(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        *[f"{e} as {n}" for n, e in _DEVICE_COLUMNS.items()]
    )


def _judged(spark, sf, **options):
    requests = table(spark, sf, "events").select(
        "event_id", epoch("ts").alias("received_at"), F.expr(_REQUEST_AUTH).alias("authorization")
    )
    return fleet.authorize_alerts(requests, _devices(spark, sf), F.col("received_at"), **options)


@query(
    "fleet_authorize",
    f"with {_DEVICES_SQL}, {_JUDGED_SQL} select event_id, received_at, device_id, device_name, status from judged",
)
def fleet_authorize(spark, sf):
    return _judged(spark, sf).drop("authorization")


@query(
    "fleet_authorize_salted",
    f"with {_DEVICES_SQL}, {_JUDGED_SQL} select status, count(*) as n, count(distinct device_id) as devices from judged group by status",
)
def fleet_authorize_salted(spark, sf):
    """The way taken for device tables too large to broadcast."""
    return (
        _judged(spark, sf, hint="merge")
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("device_id").alias("devices"))
    )


@query(
    "device_last_seen",
    f"""with {_DEVICES_SQL}, {_JUDGED_SQL},
    calls as (select device_id, max(received_at) as seen from judged where status = 'accepted' group by device_id)
    select device_id, greatest(last_seen_at, seen) as last_seen_at from devices left join calls using (device_id)""",
)
def device_last_seen(spark, sf):
    accepted = _judged(spark, sf).filter(F.col("status") == "accepted")
    return fleet.device_last_seen(_devices(spark, sf), accepted).select("device_id", "last_seen_at")


@query(
    "fleet_top",
    f"with {_FLEET_SQL} select device_id, file_id, received_at, risk_score from fleet order by received_at desc, device_id, file_id limit 50",
)
def fleet_top(spark, sf):
    top = fleet.fleet_alerts_top(_fleet_alerts(spark, sf), 50)
    return top.select("device_id", "file_id", "received_at", "risk_score")


@query(
    "fleet_retention",
    f"""with {_FLEET_SQL}, kept as (select * from fleet order by received_at desc, file_id desc limit 1000)
    select device_id, count(*) as n, min(received_at) as oldest from kept group by device_id""",
)
def fleet_retention(spark, sf):
    kept = fleet.fleet_retention(
        _fleet_alerts(spark, sf), 1_000, "received_at", "file_id"
    )
    return kept.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("received_at").alias("oldest")
    )


# --- files, reminders, flags ------------------------------------------------------------------


@query(
    "file_upsert",
    """with known as (select concat('/p/', p_partkey) as path, p_size::bigint as size, 5::bigint as mtime,
        (100 + p_partkey)::bigint as first_seen_at, (200 + p_partkey)::bigint as last_seen_at, p_partkey % 4 = 0 as ignored
        from part where p_partkey % 3 <> 0),
    seen as (select concat('/p/', l_partkey) as path, l_quantity::bigint as size, l_linenumber::bigint as mtime,
        epoch(l_shipdate)::bigint as seen_at from lineitem),
    news as (select path, arg_max(row(size, mtime), row(seen_at, mtime, size)) as n, min(seen_at) as a, max(seen_at) as b from seen group by path)
    select coalesce(known.path, news.path) as path, coalesce(n[1], size) as size, coalesce(n[2], mtime) as mtime,
      coalesce(first_seen_at, a) as first_seen_at, coalesce(b, last_seen_at) as last_seen_at, coalesce(ignored, false) as ignored
    from known full join news on known.path = news.path""",
)
def file_upsert(spark, sf):
    known = table(spark, sf, "part").filter("p_partkey % 3 <> 0").selectExpr(
        "p_partkey::string as file_id", "concat('/p/', p_partkey) as path", "p_size::bigint as size",
        "5::bigint as mtime", "(100 + p_partkey)::bigint as first_seen_at",
        "(200 + p_partkey)::bigint as last_seen_at", "p_partkey % 4 = 0 as ignored", "false as deleted",
    )
    seen = table(spark, sf, "lineitem").select(
        F.expr("concat('/p/', l_partkey)").alias("path"),
        F.col("l_quantity").cast("bigint").alias("size"),
        F.col("l_linenumber").cast("bigint").alias("mtime"),
        epoch("l_shipdate").alias("seen_at"),
    )
    return store.upsert_files(known, seen).select(
        "path", "size", "mtime", "first_seen_at", "last_seen_at", "ignored"
    )


_CUST_FILES_SQL = """cfiles as (select c_custkey as file_id, concat('/c/', c_custkey) as path,
    c_custkey % 10 = 0 as ignored, c_custkey % 13 = 0 as deleted from customer)"""
_REMINDERS_SQL = """reminders as (select o_custkey as file_id, o_orderkey::string as threshold,
    epoch(o_orderdate)::bigint + 86400 as due_at, case when o_orderkey % 4 = 0 then 1::bigint end as sent_at from orders)"""
_REMIND_NOW = 820454400  # 1996-01-01


def _cust_files(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as file_id", "concat('/c/', c_custkey) as path",
        "c_custkey % 10 = 0 as ignored", "c_custkey % 13 = 0 as deleted",
    )


def _reminders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("file_id"),
        F.col("o_orderkey").cast("string").alias("threshold"),
        (epoch("o_orderdate") + 86400).alias("due_at"),
        F.when(F.col("o_orderkey") % 4 == 0, 1).cast("bigint").alias("sent_at"),
    )


@query(
    "due_reminders",
    f"""with {_CUST_FILES_SQL}, {_REMINDERS_SQL} select file_id, threshold, due_at, path from reminders join cfiles using (file_id)
    where due_at <= {_REMIND_NOW} and sent_at is null and not ignored and not deleted""",
)
def due_reminders(spark, sf):
    return store.due_reminders(_reminders(spark, sf), _cust_files(spark, sf), _REMIND_NOW).select(
        "file_id", "threshold", "due_at", "path"
    )


_PRESENT = "c_custkey % 5 <> 0"
_DUE_SQL = f"""due as (select file_id, threshold, path, file_id % 5 <> 0 as there from reminders join cfiles using (file_id)
    where due_at <= {_REMIND_NOW} and sent_at is null and not ignored and not deleted)"""


def _round(spark, sf):
    inventory = table(spark, sf, "customer").filter(_PRESENT).selectExpr("concat('/c/', c_custkey) as path")
    return store.send_reminders(
        _reminders(spark, sf), _cust_files(spark, sf), inventory, _REMIND_NOW
    )


@query(
    "reminder_events",
    f"with {_CUST_FILES_SQL}, {_REMINDERS_SQL}, {_DUE_SQL} select 'reminder_due' as event_type, file_id, threshold from due where there",
)
def reminder_events(spark, sf):
    return _round(spark, sf)[0]


@query(
    "reminders_sent",
    f"""with {_CUST_FILES_SQL}, {_REMINDERS_SQL}, {_DUE_SQL}
    select r.file_id, r.threshold, due_at, coalesce(sent_at, case when d.file_id is not null then {_REMIND_NOW}::bigint end) as sent_at
    from reminders r left join due d on d.file_id = r.file_id and d.threshold = r.threshold""",
)
def reminders_sent(spark, sf):
    return _round(spark, sf)[1]


@query(
    "files_vanished",
    f"""with {_CUST_FILES_SQL}, {_REMINDERS_SQL}, {_DUE_SQL}
    select file_id, deleted or file_id in (select file_id from due where not there) as deleted from cfiles""",
)
def files_vanished(spark, sf):
    return _round(spark, sf)[2].select("file_id", "deleted")


@query(
    "set_ignored",
    f"""with {_CUST_FILES_SQL}, changes as (select s_suppkey as file_id, s_suppkey % 2 = 0 as new from supplier)
    select file_id, coalesce(new, ignored) as ignored from cfiles left join changes using (file_id)""",
)
def set_ignored(spark, sf):
    changes = table(spark, sf, "supplier").selectExpr(
        "s_suppkey as file_id", "s_suppkey % 2 = 0 as ignored"
    )
    return store.set_ignored(_cust_files(spark, sf), changes).select("file_id", "ignored")


@query(
    "schedule_reminders",
    """with existing as (select o_orderkey as file_id, '24h' as threshold, 7::bigint as due_at from orders where o_orderkey % 2 = 0),
    steps as (select * from (values ('24h', 86400), ('7j', 604800), ('30j', 2592000)) t(threshold, secs)),
    new as (select l_orderkey as file_id, threshold, min(epoch(l_shipdate)::bigint + secs) as due_at from lineitem, steps group by all)
    select file_id, threshold, due_at from existing
    union all select n.file_id, n.threshold, n.due_at from new n left join existing e on e.file_id = n.file_id and e.threshold = n.threshold
    where e.file_id is null""",
)
def schedule_reminders(spark, sf):
    existing = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").selectExpr(
        "o_orderkey as file_id", "'24h' as threshold", "7::bigint as due_at", "null::bigint as sent_at"
    )
    alerted = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), epoch("l_shipdate").alias("at")
    )
    return store.schedule_reminders(existing, alerted, F.col("at")).select(
        "file_id", "threshold", "due_at"
    )


# --- stored JSON and retired categories -------------------------------------------------------

_JSON = (
    "case when l_linenumber = 1 then '[' when l_linenumber = 2 then '[]' else concat('[{\"category\":\"email\",\"count\":', "
    "l_linenumber::string, ',\"redacted_examples\":[\"a\"]},{\"category\":\"phone\",\"count\":2,\"redacted_examples\":[]}]') end"
)


@query(
    "decode_scan_json",
    """select l_orderkey, l_linenumber, case when l_linenumber <= 2 then 0 else 2 end as n,
    case when l_linenumber <= 2 then 0 else l_linenumber + 2 end::bigint as total,
    case when l_returnflag = 'R' then 'high' else 'low' end as alert_level, case when l_returnflag = 'R' then 'high' else 'medium' end as rule_level
    from lineitem""",
)
def decode_scan_json(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", store.decode_findings(F.expr(_JSON)).alias("f"),
        F.when(F.col("l_returnflag") == "R", "high").otherwise(F.col("l_returnflag")).alias("lv"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", F.size("f").alias("n"),
        F.aggregate("f", F.lit(0).cast("bigint"), lambda a, x: a + x["count"]).alias("total"),
        store.decode_risk_level(F.col("lv")).alias("alert_level"),
        store.decode_risk_level(F.col("lv"), "medium").alias("rule_level"),
    )


_OLD_TEXT = fixed.SUGGESTION_REPAIRS[2][0]


@query(
    "removed_categories",
    f"""select l_orderkey * 10 + l_linenumber as scan_id,
      case when l_linenumber % 3 = 0 then 'email' else 'email|phone' end as findings,
      case when l_linenumber % 3 = 0 then 1 else 2 end as n_reasons,
      case when l_returnflag = 'R' then {D.q(fixed.SUGGESTION_LOW)} else 'x' end as suggestion
    from lineitem where l_linenumber % 3 = 0 or l_returnflag = 'R'""",
)
def removed_categories(spark, sf):
    third = F.col("l_linenumber") % 3 == 0
    second = F.when(third, "loyalty_id").otherwise("phone")
    reason = lambda c: F.struct(
        F.lit("reason.categoryCount").alias("key"), F.create_map(F.lit("category"), c).alias("vars")
    )
    scans = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scan_id"),
        F.array(_one(F.lit("email"), F.lit(1)), _one(second, F.lit(2))).alias("findings"),
        F.array(reason(F.lit("email")), reason(second)).alias("reasons"),
        F.when(F.col("l_returnflag") == "R", _OLD_TEXT).otherwise("x").alias("suggestion"),
    )
    changed = store.drop_removed_categories(scans)
    return changed.select(
        "scan_id",
        joined(F.transform("findings", lambda f: f.category)).alias("findings"),
        F.size("reasons").alias("n_reasons"),
        "suggestion",
    )


# --- ignore list and reveal -------------------------------------------------------------------

_IGNORED_VALUES = (
    "select 'user_id' as category, md5(c_custkey::string) as value from customer where c_custkey % 3 = 0 "
    "union all select 'email', concat(' ', upper(concat('john', (c_custkey % 100)::string, '@mail.shop.org')), ' ') from customer "
    "union all select 'postal_code', (c_custkey % 90000 + 10000)::string from customer where c_custkey % 5 = 0"
)
_MATCHES_SQL = f"m as materialized ({D.matches('profiles')})"
_NORM = (
    "case category when 'email' then lower(trim(value)) when 'iban' then upper(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) "
    "when 'phone' then regexp_replace(value, '[^0-9]', '', 'g') else trim(value) end"
)
_IGNORED_SQL = f"ignored as (select distinct category, {_NORM} as nv from ({_IGNORED_VALUES}))"
_FLAGGED_SQL = (
    f"flagged as (select m.*, {_NORM.replace('category', 'm.category')} in "
    "(select nv from ignored i where i.category = m.category) as is_ignored from m)"
)


def _ignored(spark, sf):
    customer = table(spark, sf, "customer")
    k = F.col("c_custkey")
    values = (
        customer.filter(k % 3 == 0)
        .select(F.lit("user_id").alias("category"), F.md5(k.cast("string").cast("binary")).alias("value"))
        .unionByName(
            customer.selectExpr(
                "'email' as category",
                "concat(' ', upper(concat('john', (c_custkey % 100)::string, '@mail.shop.org')), ' ') as value",
            )
        )
        .unionByName(
            customer.filter(k % 5 == 0).selectExpr(
                "'postal_code' as category", "(c_custkey % 90000 + 10000)::string as value"
            )
        )
    )
    return mark_ignored(None, values, SALT, 1)


def _profile_matches(spark, sf):
    return detect_builtin(profiles(spark, sf), "text", "doc_id")


_IGNORED_FILTER = f"""with {PROFILES}, {_MATCHES_SQL}, {_IGNORED_SQL}, {_FLAGGED_SQL}
    select doc_id, category, pos, value from flagged where not is_ignored"""


@query("ignored_filter", _IGNORED_FILTER)
def ignored_filter(spark, sf):
    kept = apply_ignored_values(_profile_matches(spark, sf), _ignored(spark, sf), SALT)
    return kept.drop("scope")


@query("ignored_filter_salted", _IGNORED_FILTER)
def ignored_filter_salted(spark, sf):
    """The way taken for ignore lists too large to broadcast."""
    kept = apply_ignored_values(
        _profile_matches(spark, sf), _ignored(spark, sf), SALT, hint="merge"
    )
    return kept.drop("scope")


@query(
    "ignored_marks",
    f"""with {_IGNORED_SQL}, again as (select 'email' as category, lower(concat('john', c_custkey % 100, '@mail.shop.org')) as nv from customer where c_custkey % 2 = 0)
    select category, sha256(concat('{SALT}', chr(10), nv)) as value_hash, 1::bigint as created_at from ignored
    where not (category = 'email' and nv in (select nv from again))""",
)
def ignored_marks(spark, sf):
    marked = _ignored(spark, sf)
    again = table(spark, sf, "customer").filter("c_custkey % 2 = 0").selectExpr(
        "'email' as category", "concat('John', c_custkey % 100, '@mail.shop.org') as value"
    )
    twice = mark_ignored(marked, again, SALT, 9)
    return unmark_ignored(twice, again, SALT)


@query(
    "scan_with_ignored",
    f"""with {PROFILES}, m0 as materialized ({D.matches('profiles')}), {_IGNORED_SQL},
    m as (select doc_id, ord, category, row_number() over (partition by doc_id, category order by pos) - 1 as pos, value
          from m0 where {_NORM.replace('category', 'm0.category')} not in (select nv from ignored i where i.category = m0.category)),
    nc as (select null::bigint as doc_id, '' as category, 0 as pos, '' as value where false),
    nn as (select null::bigint as doc_id, 0 as i, '' as value, 0 as score where false),
    {D.risk_report('profiles', 'm', 'nc', 'nn', {})}
    select doc_id, risk_score, risk_level, findings from report""",
)
def scan_with_ignored(spark, sf):
    corpus = scan_table_text(profiles(spark, sf), "doc_id", "text")
    reports = scan(corpus, ignored=_ignored(spark, sf), salt=SALT)
    line = lambda f: F.concat(
        f.category, F.lit("="), f["count"].cast("string"), F.lit("["), joined(f.redacted_examples), F.lit("]")
    )
    return reports.select(
        "doc_id", "risk_score", "risk_level", joined(F.transform("findings", line), ";").alias("findings")
    )


# what a session asks for: redacted values it has seen, of every third note, and some that occur nowhere
_REQUESTS = (
    "select c_custkey as doc_id, 'email' as category, concat(substr('johmarpieanncaringhugchl', (c_custkey % 8 * 3 + 1)::int, 3), '***@mail.shop.org') as redacted "
    "from {t} where c_custkey % 3 = 0 "
    "union all select c_custkey, 'user_id', concat(repeat('*', 28), right(md5(c_custkey::string), 4)) from {t} where c_custkey % 3 = 0"
)


@query(
    "reveal_lookup",
    f"""with {PROFILES}, {_MATCHES_SQL}, {_IGNORED_SQL}, {_FLAGGED_SQL}, asked as ({_REQUESTS.format(t='customer')})
    select doc_id, category, redacted, arg_min(value, pos) as clear
    from (select *, {D.redact('category', 'value')} as redacted from flagged) join asked using (doc_id, category, redacted)
    where not is_ignored group by all""",
)
def reveal_lookup_query(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("reveal_customer")
    requests = spark.sql(_REQUESTS.format(t="reveal_customer"))
    return reveal_requested(
        requests, profiles(spark, sf).select("doc_id", "text"), _ignored(spark, sf), SALT, "doc_id",
        categories=["email", "user_id", "secret"],
    )


@query(
    "revealed_report",
    f"""with {PROFILES}, {_MATCHES_SQL}, {_IGNORED_SQL}, {_FLAGGED_SQL}
    select doc_id, category, pos, value as clear, {D.redact('category', 'value')} as redacted, is_ignored from flagged""",
)
def revealed_report_query(spark, sf):
    pairs = reveal_pairs(_profile_matches(spark, sf))
    return revealed_report(pairs, _ignored(spark, sf), SALT).drop("scope")


_PER_CATEGORY, _PER_FILE = 2, 9
_TRIM_SQL = f"""with {PROFILES}, {_MATCHES_SQL},
    top as (select * from m where pos < {_PER_CATEGORY}),
    cut as (select *, count(*) over (partition by doc_id) - {_PER_FILE} as excess,
      row_number() over (partition by doc_id order by category, pos desc) as c from top)
    select doc_id, category, pos, value as clear from cut where c > excess"""


@query("reveal_trim", _TRIM_SQL)
def reveal_trim(spark, sf):
    hits = with_builtin_hits(profiles(spark, sf).select("doc_id", "text"))
    trimmed = hits.withColumn(
        "hits", F.expr(trim_reveal_hits("hits", _PER_CATEGORY, _PER_FILE))
    )
    return explode_hits(trimmed, ["doc_id"]).select(
        "doc_id", "category", "pos", F.col("value").alias("clear")
    )


@query("reveal_trim_long", _TRIM_SQL)
def reveal_trim_long(spark, sf):
    pairs = reveal_pairs(_profile_matches(spark, sf))
    return trim_reveal_pairs(pairs, "doc_id", _PER_CATEGORY, _PER_FILE).select(
        "doc_id", "category", "pos", "clear"
    )


# --- neutralize -------------------------------------------------------------------------------


def _neutralize_sql(cte: str, docs: str) -> str:
    return f"""with {cte}, m as materialized ({D.matches(docs)}),
    pairs as (select doc_id, list([old, new] order by strlen(old) desc, ord, pos) as ps
      from (select doc_id, ord, min(pos) as pos, old, any_value({D.redact('category', 'old')}) as new
            from (select *, trim(value) as old from m) group by doc_id, ord, category, old)
      where old <> new and old <> '' group by doc_id),
    done as (select d.doc_id, case when ps is null then [text, '0'] else
        list_reduce(ps, lambda acc, p: [replace(acc[1], p[1], p[2]),
          (acc[2]::bigint + (length(acc[1]) - length(replace(acc[1], p[1], ''))) // length(p[1]))::varchar], [text, '0']) end as r
      from {docs} d left join pairs using (doc_id))
    select doc_id, md5(r[1]) as text_md5, r[2]::bigint as replaced_total from done"""


def _neutralized(df):
    done = neutralize(with_builtin_hits(df))
    return done.select(
        "doc_id", F.md5(F.col("redacted_text").cast("binary")).alias("text_md5"), "replaced_total"
    )


@query("neutralize_documents", _neutralize_sql(DOCS, "docs"))
def neutralize_documents(spark, sf):
    return _neutralized(documents(spark, sf))


@query("neutralize_profiles", _neutralize_sql(PROFILES, "profiles"))
def neutralize_profiles(spark, sf):
    return _neutralized(profiles(spark, sf).select("doc_id", "text"))


_WORD_CHAR = r"[\p{L}\p{N}_]"


def _spans_sql(cte: str, docs: str) -> str:
    """Places by splitting at each value, islands of overlapping places, one new text of gaps and new forms."""
    written = (
        f"list_transform(list_filter({D.all_matches(fixed.CARD)}, lambda v: {D.card_ok(D.digits('v'))}), "
        "lambda v: regexp_replace(v, '[ -]+$', ''))"
    )
    new = D.redact("category", "old")
    inside = lambda a, b: f"(regexp_matches({a}, '{_WORD_CHAR}') and regexp_matches({b}, '{_WORD_CHAR}'))"
    return f"""with {cte}, m as materialized ({D.matches(docs)}),
    v as (select doc_id, ord, category, trim(value) as old from m
      union all select doc_id, 99, 'credit_card', unnest({written}) from {docs}),
    p as (select doc_id, old, arg_min(case when new = old then repeat('*', length(old)) else new end, ord) as new
      from (select doc_id, ord, old, {new} as new from v where old <> '') group by doc_id, old),
    c as (select doc_id, text, old, new, string_split(text, old) as cuts from p join {docs} using (doc_id)),
    o as (select doc_id, text, old, new, unnest(list_transform(range(1, len(cuts)),
        lambda j: list_sum(list_transform(cuts[1:j], lambda x: length(x))) + (j - 1) * length(old))) as s from c),
    w as (select doc_id, old, new, s, s + length(old) as e from o
      where not (s > 0 and {inside("substr(text, s::int, 1)", "left(old, 1)")})
        and not (s + length(old) < length(text) and {inside("right(old, 1)", "substr(text, (s + length(old) + 1)::int, 1)")})),
    g as (select *, sum(case when s >= prev then 1 else 0 end) over (partition by doc_id order by s, e desc) as island
      from (select *, coalesce(max(e) over (partition by doc_id order by s, e desc
        rows between unbounded preceding and 1 preceding), 0) as prev from w)),
    f as (select *, first_value(new) over i as lead, first_value(e) over i as covered, row_number() over i as n
      from g window i as (partition by doc_id, island order by s, e desc)),
    u as (select doc_id, min(s) as a, max(e) as b, case when min(covered) = max(e)
        and not bool_or(n > 1 and contains(lead, old)) then min(lead) else repeat('*', (max(e) - min(s))::int) end as new
      from f group by doc_id, island),
    t as (select doc_id, count(*) as n, max(b) as last,
        array_to_string(list(concat(substr(text, (before + 1)::int, (a - before)::int), new) order by a), '') as head
      from (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from u) join {docs} using (doc_id)
      group by doc_id)
    select doc_id, md5(case when n is null then text else concat(head, substr(text, (last + 1)::int)) end) as text_md5,
      coalesce(n, 0)::bigint as replaced_total from {docs} left join t using (doc_id)"""


def _spliced(df):
    done = neutralize_spans(with_builtin_hits(df))
    return done.select(
        "doc_id", F.md5(F.col("redacted_text").cast("binary")).alias("text_md5"), "replaced_total"
    )


@query("neutralize_spans_documents", _spans_sql(DOCS, "docs"))
def neutralize_spans_documents(spark, sf):
    return _spliced(documents(spark, sf))


# a card in groups of four, an e-mail behind a user id, a password alone and inside a longer word
_SPACED = "case doc_id % 3 when 0 then '4539 1488 0343 6467' when 1 then '5425-2334 3010-9903' else '3782 822463 10005' end"
_SECRET = "substr(md5(doc_id::string), 1, (8 + doc_id % 9)::int)"
_NOTED = (
    f"concat(text, chr(10), 'paid with ', {_SPACED}, '; user id: u', (doc_id + 100000)::string, '@mail.shop.org, again ', "
    f"{_SECRET}, ' and z', {_SECRET}, 'z')"
)


@query(
    "neutralize_spans",
    _spans_sql(f"{PROFILES}, noted as materialized (select doc_id, {_NOTED} as text from profiles)", "noted"),
)
def neutralize_spans_profiles(spark, sf):
    """Values that overlap, cards with spaces, and values inside longer words."""
    return _spliced(profiles(spark, sf).selectExpr("doc_id", f"{_NOTED} as text"))


_MANY = "c_custkey % 3"
_ADDRESS = "concat('user', c_custkey::string, '@shop', (c_custkey % 7)::string, '.org')"


@query(
    "neutralize_many",
    f"""with many as (select {_MANY} as doc_id, string_agg({_ADDRESS}, ' ' order by c_custkey) as text from customer group by all)
    select doc_id, length(text) as chars, (length(text) - length(replace(text, '@', '')))::bigint as replaced_total,
      md5(regexp_replace(text, 'user?(?:r)[0-9]+@', 'use***@', 'g')) as text_md5, 0 as clear from many""",
)
def neutralize_many(spark, sf):
    """Three texts with the addresses of all customers: none stays readable."""
    row = table(spark, sf, "customer").selectExpr(
        f"{_MANY} as doc_id", "c_custkey", f"{_ADDRESS} as address"
    )
    listed = F.sort_array(F.collect_list(F.struct("c_custkey", "address")))
    many = row.groupBy("doc_id").agg(F.array_join(listed["address"], " ").alias("text"))
    done = neutralize(with_builtin_hits(many))
    return done.select(
        "doc_id",
        F.length("text").alias("chars"),
        "replaced_total",
        F.md5(F.col("redacted_text").cast("binary")).alias("text_md5"),
        F.regexp_count("redacted_text", F.lit("user[0-9]")).alias("clear"),
    )


# --- sources ----------------------------------------------------------------------------------


@query(
    "path_filters",
    f"""with {PROFILES} select doc_id, path,
      contains(path, '/.cache') as hidden, path like '%.part' as unfinished,
      starts_with(path, '/data/u1/') or starts_with(path, '/data/u22/') as watched,
      strlen(path) > 25 as too_large,
      case when path like '%.PNG' then 'image' when path like '%.pst' or path like '%.part' then 'other' else 'text' end as kind,
      path not like '%.ics' as secrets_enabled
    from profiles""",
)
def path_filters(spark, sf):
    return route_by_extension(profiles(spark, sf).select("doc_id", "path")).select(
        "doc_id", "path",
        is_hidden_path("path").alias("hidden"),
        is_ignored_extension("path").alias("unfinished"),
        is_in_watched_dirs("path", ["/data/u1", "/data/u22/"]).alias("watched"),
        file_size_gate(F.octet_length("path"), 25).alias("too_large"),
        F.col("content_kind").alias("kind"),
        "secrets_enabled",
    )


@query(
    "not_a_file",
    f"""with {PROFILES} select path, 'low' as risk_level, 0::bigint as risk_score, 'reason.notAFile' as reason
    from profiles where doc_id % 3 <> 0""",
)
def not_a_file(spark, sf):
    every = profiles(spark, sf).select("doc_id", "path")
    return missing_files(every, every.filter("doc_id % 3 = 0")).select(
        "path", "risk_level", "risk_score", F.col("reasons")[0]["key"].alias("reason")
    )


@query(
    "recent_files",
    """select p_partkey, p_size, row_number() over (order by p_size desc, concat('/', p_partkey)) as rank from part
    qualify rank <= 150""",
)
def recent_files(spark, sf):
    inventory = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_size", "p_size as mtime", "concat('/', p_partkey) as path"
    )
    return ranked(recent_first(inventory, 150), 150).select("p_partkey", "p_size", "rank")


@query(
    "decode_text",
    """select c_custkey, case c_custkey % 3 when 0 then c_name else concat('é', c_name, case c_custkey % 3 when 1 then chr(65533) else '' end) end as whole,
    case when c_custkey % 3 = 0 then null else concat('é', c_name, case c_custkey % 3 when 1 then chr(65533) else '' end) end as if_text,
    case c_custkey % 3 when 0 then left(c_name, 6) else concat('é', left(c_name, 4)) end as first_bytes
    from (select c_custkey, case c_custkey % 3 when 0 then concat(c_name, chr(0)) else c_name end as c_name from customer)""",
)
def decode_text_query(spark, sf):
    third = F.col("c_custkey") % 3
    content = (
        F.when(third == 0, F.concat(F.encode("c_name", "UTF-8"), F.lit(bytearray(b"\0"))))
        .when(third == 1, F.concat(F.encode(F.concat(F.lit("é"), "c_name"), "UTF-8"), F.lit(bytearray(b"\xff"))))
        .otherwise(F.encode(F.concat(F.lit("é"), "c_name"), "UTF-8"))
    )
    return table(spark, sf, "customer").select(
        "c_custkey",
        decode_text(content).alias("whole"),
        text_if_not_binary(content).alias("if_text"),
        decode_text(content, 6).alias("first_bytes"),
    )


_CELLS = {
    "path": "concat('/b/', l_suppkey::string)",
    "sheet_no": "l_linenumber",
    "sheet": "concat('S', l_linenumber::string)",
    "row": "l_orderkey",
    "col": "l_partkey % 60",
    "value": "case when l_quantity::int % 9 = 0 then '' else concat('é', l_quantity::int::string, l_returnflag) end",
}


def _cells(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _CELLS.items()])


@query(
    "sheet_text",
    f"""with cells as ({corpora.select(_CELLS, 'lineitem')})
    select path, sheet_no, md5(concat('sheet:', sheet, chr(10), string_agg(concat(value, chr(10)), '' order by row, col, value))) as text_md5
    from cells where value <> '' group by path, sheet_no, sheet""",
)
def sheet_text(spark, sf):
    return sheet_cells_to_text(_cells(spark, sf)).select(
        "path", "sheet_no", F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


@query(
    "sheet_text_budget",
    f"""with cells as ({corpora.select(_CELLS, 'lineitem')}),
    kept as (select *, row_number() over (partition by path, sheet_no order by row, col) = 1 as first
             from cells where value <> ''),
    sized as (select *, strlen(value) + 1 + case when first then strlen(sheet) + 7 else 0 end as size from kept),
    summed as (select *, sum(size) over (partition by path order by sheet_no, row, col) as upto from sized),
    shown as (select *, upto <= 300 as fits, first and upto - size < 300 as opens,
              coalesce(bool_and(upto <= 300) over (partition by path order by sheet_no, row, col rows between unbounded preceding and 1 preceding), true) as before
              from summed)
    select path, sheet_no, concat('sheet:', sheet, chr(10), coalesce(string_agg(concat(value, chr(10)), '' order by row, col) filter (where fits), '')) as text
    from shown where before and (fits or opens) group by path, sheet_no, sheet""",
)
def sheet_text_budget(spark, sf):
    return sheet_cells_to_text(_cells(spark, sf), max_bytes=300).select("path", "sheet_no", "text")


def _archive(doc_id: int, text: str) -> bytes:
    """A small archive around a text: direct, nested, hidden among binaries, or flagged."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("pic.bin", b"\0\1")
        z.writestr("nul.txt", b"a\0b")
        if doc_id % 3 == 1:
            inner = io.BytesIO()
            with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as y:
                y.writestr("in/note.md", text)
            z.writestr("more.zip", inner.getvalue())
        else:
            z.writestr("note.TXT", text)
    data = bytearray(out.getvalue())
    if doc_id % 3 == 2:  # mark the last entry as encrypted in the directory
        at = data.rfind(b"PK\x01\x02")
        data[at + 8] |= 1
    return bytes(data)


def _archives(spark, sf):
    @F.pandas_udf("binary")
    def build(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_archive(int(i), t) for i, t in zip(ids, texts)])

    return documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("path"), build("doc_id", "text").alias("content")
    )


@query(
    "zip_texts",
    """select doc_id::string as path, case when doc_id % 3 = 1 then 'more.zip!in/note.md' else 'note.TXT' end as entry,
    case when doc_id % 3 = 1 then 1 else 0 end as depth, md5(text) as text_md5 from documents where doc_id % 3 <> 2""",
)
def zip_texts_query(spark, sf):
    return zip_texts(expand_zip(_archives(spark, sf))).select(
        "path", "entry", "depth", F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


@query(
    "zip_audit",
    """select doc_id::string as path, case when doc_id % 3 = 2 then 'zipcrypto' else 'none' end as zip_encryption,
    doc_id % 3 = 2 as weak_zip_encryption from documents""",
)
def zip_audit(spark, sf):
    return audit_zip_encryption(_archives(spark, sf))


@query(
    "zip_scan",
    f"""with d as (select doc_id, text from documents where doc_id % 3 <> 2), m as ({D.matches('d')})
    select doc_id::string as path, category, count(*) as cnt from m group by all""",
)
def zip_scan(spark, sf):
    parts = with_builtin_hits(zip_texts(expand_zip(_archives(spark, sf)))).select(
        "path", "part", "hits", F.array().cast(HITS_TYPE).alias("custom_hits")
    )
    merged = merge_matches(parts, "path", "part")
    return explode_hits(merged, ["path"]).groupBy("path", "category").agg(
        F.count(F.lit(1)).alias("cnt")
    )


_ENTRIES = {
    "path": "concat('/z/', l_suppkey::string, '.zip')",
    "part": "l_orderkey * 10 + l_linenumber",
    "size": "(l_quantity * 1000)::bigint",
    "encrypted": "l_linenumber = 6",
    "line": "l_partkey",
}


@query(
    "zip_budget",
    f"""with e as ({corpora.select(_ENTRIES, 'lineitem')}),
    n as (select *, row_number() over (partition by path order by part, line) as no from e),
    t as (select *, sum(case when encrypted then 0 else size end) over (partition by path order by part, line) as total from n where no <= 40)
    select path, count(*) as n, sum(size)::bigint as bytes from t
    where not encrypted and total <= 900000 and size <= 45000 group by path""",
)
def zip_budget_query(spark, sf):
    entries = table(spark, sf, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _ENTRIES.items()])
    ordered = entries.withColumn("at", F.struct("part", "line"))
    kept = zip_budget(ordered, order="at", max_total_bytes=900_000, max_entry_bytes=45_000, max_entries=40)
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def _docx(texts: pd.Series) -> pd.Series:
    def build(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", "<types/>")
            z.writestr("word/document.xml", f"<w>{text}</w>")
            z.writestr("word/media.png", b"\0")
            z.writestr("docProps/core.XML", "<core/>")
        return out.getvalue()

    return texts.map(build)


@query(
    "docx_text",
    "select doc_id::string as path, md5(concat(chr(10), '<w>', text, '</w>', chr(10), '<core/>')) as text_md5 from documents",
)
def docx_text_query(spark, sf):
    build = F.pandas_udf(_docx, "binary")
    files = documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("path"), build("text").alias("content")
    )
    return docx_text(files).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --- labelled cases ---------------------------------------------------------------------------

_CASE_COLUMNS = {
    "id": "doc_id::string",
    "target_type": "case doc_id % 5 when 0 then 'ethereum' when 1 then 'fr_nir' when 2 then 'mac_address' when 3 then 'es_dni' else 'bitcoin' end",
    "should_detect": "case doc_id % 5 when 0 then doc_id % 3 = 0 when 1 then doc_id % 4 = 0 when 2 then true when 3 then doc_id % 26 <> 8 else doc_id % 3 = 1 end",
}


@query(
    "evaluate_cases",
    f"""with {ORDER_NOTES}, r as ({_rules_sql(_catalog_rules(None), 'notes')}),
    b as ({D.matches('notes')}),
    cases as (select doc_id, {", ".join(f"{e} as {n}" for n, e in _CASE_COLUMNS.items())} from notes),
    hits as (select distinct doc_id, category from r union select distinct doc_id, category from b),
    judged as (select c.*, h.doc_id is not null as has from cases c left join hits h on h.doc_id = c.doc_id and h.category = c.target_type)
    select target_type, count(*) filter (where should_detect and has) as hit, count(*) filter (where should_detect and not has) as miss,
      count(*) filter (where not should_detect and has) as false_pos, count(*) filter (where not should_detect and not has) as clean
    from judged group by target_type""",
)
def evaluate_cases_query(spark, sf):
    cases = order_notes(spark, sf).selectExpr(
        *[f"{e} as {n}" for n, e in _CASE_COLUMNS.items()], "text"
    )
    rules = compile_rules(load_rules(spark, "fr"))
    return confusion(evaluate_cases(cases, rules))


@query(
    "case_counts",
    "select event_type as target_type, count(*) filter (where value > 50) as positives, count(*) filter (where not value > 50) as negatives from events group by event_type",
)
def case_counts_query(spark, sf):
    return case_counts(
        table(spark, sf, "events").selectExpr("event_type as target_type", "value > 50 as should_detect")
    )


@query(
    "dedup_cases",
    """select arg_min(event_id, event_id) as id, event_type as target_type, value > 50 as should_detect, props as text
    from events group by event_type, value > 50, props""",
)
def dedup_cases_query(spark, sf):
    cases = table(spark, sf, "events").selectExpr(
        "event_id as id", "event_type as target_type", "value > 50 as should_detect", "props as text"
    )
    return dedup_cases(cases, "id")


# --- sessions and debounced changes -----------------------------------------------------------

_GAP = 6 * 3600
_ISLANDS = f"""with e as (select user_id, ts, value, ts - lag(ts) over (partition by user_id order by ts) as gap from events),
    s as (select *, sum(case when gap is null or gap >= interval {_GAP} second then 1 else 0 end) over (partition by user_id order by ts) as sid from e)"""


@query(
    "session_activity",
    f"""{_ISLANDS} select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as n_events, round(sum(value), 4) as total
    from s group by user_id, sid""",
)
def session_activity_query(spark, sf):
    found = session_batch(
        table(spark, sf, "events").select("user_id", "ts", "value"), "user_id", "ts", _GAP,
        total=("sum", "value"),
    ).withColumn("total", F.round("total", 4))
    return found.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    )


def _changes(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"),
        F.col("event_id").alias("size"),
        epoch("ts").alias("mtime"),
        F.date_trunc("SECOND", F.col("ts").cast("timestamp")).alias("changed_at"),
    )


_CHANGES_SQL = f"""e0 as (select concat('/u/', user_id) as path, event_id, date_trunc('second', ts) as t from events),
    e as (select *, t - lag(t) over (partition by path order by t, event_id) as gap from e0),
    s as (select *, sum(case when gap is null or gap >= interval {_GAP} second then 1 else 0 end) over (partition by path order by t, event_id) as sid from e)"""


def _debounced(spark, sf, cap_seconds: int):
    stable = debounce_batch(
        _changes(spark, sf), quiet_seconds=_GAP, cap_seconds=cap_seconds
    )
    return stable.select(
        "path", "size",
        *[F.unix_timestamp(c).alias(c) for c in ("first_seen", "last_change", "ready_at")],
    )


@query(
    "debounce_quiet",
    f"""with {_CHANGES_SQL}
    select path, arg_max(event_id, row(t, event_id)) as size, epoch(min(t))::bigint as first_seen,
      epoch(max(t))::bigint as last_change, epoch(max(t))::bigint + {_GAP} as ready_at
    from s group by path, sid""",
)
def debounce_quiet(spark, sf):
    """Ready six hours after the last change, however long that takes."""
    return _debounced(spark, sf, 10 * 365 * 86400)


_CAP = 9 * 3600


@query(
    "debounce_capped",
    f"""with recursive {_CHANGES_SQL},
    cuts as (
      select path, sid, min(t) as f from s group by path, sid
      union all
      select s.path, s.sid, min(s.t) from s join cuts c on c.path = s.path and c.sid = s.sid and s.t >= c.f + interval {_CAP} second
      group by s.path, s.sid, c.f),
    entries as (select path, sid, f, lead(f) over (partition by path, sid order by f) as next from (select distinct path, sid, f from cuts))
    select n.path, arg_max(event_id, row(t, event_id)) as size, epoch(f)::bigint as first_seen, epoch(max(t))::bigint as last_change,
      least(epoch(max(t)) + {_GAP}, epoch(f) + {_CAP})::bigint as ready_at
    from entries n join s on s.path = n.path and s.sid = n.sid and s.t >= n.f and (next is null or s.t < next)
    group by n.path, n.sid, n.f""",
)
def debounce_capped(spark, sf):
    """Ready six hours after the last change, or nine hours after the first."""
    return _debounced(spark, sf, _CAP)
