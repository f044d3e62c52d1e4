"""Streams, stores, folders and file formats, over data that Spark writes from the test tables.

Every query writes its input to a new folder of the session's shared folder, reads it back with the
library and returns rows that plain SQL gives from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievelight.operators import file_table, store
from sievelight.operators.builtin import detect_builtin, with_builtin_hits
from sievelight.operators.evaluate import case_counts
from sievelight.operators.rewrite import neutralize, write_neutralized
from sievelight.operators.rules import compile_rules, detect_rules, validate_rule_regex
from sievelight.plans.scan import as_scans, scan, scan_files, signals_only
from sievelight.plans.session import checkpoint_dir
from sievelight.schemas import RULES
from sievelight.sources.cases import read_labelled_cases
from sievelight.sources.files import read_file_inventory
from sievelight.sources.tables import scan_table_text
from sievelight.streaming.debounce import debounce
from sievelight.streaming.pipeline import (
    change_stream,
    current_files,
    current_fleet_alerts,
    fleet_ingest,
    read_log,
    scan_stream,
    trim_fleet_alerts,
)
from sievelight.streaming.inventories import inventory_changes
from sievelight.streaming.late import late_counts, late_router, on_time_stream, routed
from sievelight.streaming.sessions import session_activity

from . import detect_sql as D
from . import queries_store as S
from .queries_detect import _NO_CUSTOM, _NO_NAMES
from .registry import DOCS, SQL, documents, query, table


def shared(spark, label: str) -> str:
    """A new folder that the driver and all executors see."""
    return f"{checkpoint_dir(spark)}/checks/{label}-{uuid.uuid4().hex}"


def finished(writer) -> None:
    """Run a stream over what is there."""
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


# --- folders ----------------------------------------------------------------------------------

# a row of bars between the texts of a file, longer than any context that is looked at
_FILES_OF_DOCS = "(select doc_id, concat(text, chr(10), repeat('|', 80)) as text from documents)"


def _folder(spark, sf) -> str:
    root = shared(spark, "folder")
    texts = documents(spark, sf).select(F.concat("text", F.lit("\n" + "|" * 80)).alias("value"))
    texts.write.option("maxRecordsPerFile", 60).text(f"{root}/in")
    # what a scan must not see: hidden folders and unfinished files
    texts.limit(5).write.text(f"{root}/in/.cache")
    return f"{root}/in"


@query("file_inventory", f"select sum(strlen(text) + 1)::bigint as bytes, 0 as hidden from {_FILES_OF_DOCS}")
def file_inventory(spark, sf):
    found = read_file_inventory(spark, [_folder(spark, sf), "/no/such/root"])
    texts = found.filter(F.col("path").endswith(".txt"))
    return texts.agg(
        F.sum("size").alias("bytes"), F.count_if(F.col("path").contains("/.")).cast("int").alias("hidden")
    )


@query(
    "scan_folder",
    f"""with d as {_FILES_OF_DOCS}, m as ({D.matches('d')})
    select category, count(*) as n from m group by category""",
)
def scan_folder(spark, sf):
    """Files of many documents each: what is found in them together."""
    reports = scan_files(spark, [_folder(spark, sf)])
    found = reports.select(F.explode("findings").alias("f"))
    return found.filter("f.category <> 'file_name_signal'").groupBy(F.col("f.category").alias("category")).agg(
        F.sum("f.count").alias("n")
    )


@query(
    "weak_archives",
    f"""with {DOCS}, m as materialized ({D.matches('docs')}), {_NO_CUSTOM}, {_NO_NAMES},
    {D.risk_report('docs', 'm', 'nc', 'nn', {})}
    select doc_id, risk_score + case when doc_id % 5 = 0 then 18 else 0 end as risk_score, doc_id % 5 = 0 as weak,
      case when doc_id % 5 = 0 then 'weak_archive_encryption=1[ZipCrypto]' end as finding from report""",
)
def weak_archives(spark, sf):
    """Eight points for the finding and ten for the archive."""
    corpus = scan_table_text(documents(spark, sf), "doc_id", "text")
    reports = scan(corpus.withColumn("weak_zip_encryption", F.col("doc_id") % 5 == 0))
    weak = F.filter("findings", lambda f: f["category"] == "weak_archive_encryption")
    line = F.concat(
        weak[0]["category"], F.lit("="), weak[0]["count"].cast("string"), F.lit("["),
        F.array_join(weak[0]["redacted_examples"], ","), F.lit("]"),
    )
    return reports.select(
        "doc_id", "risk_score", F.col("weak_zip_encryption").alias("weak"),
        F.when(F.size(weak) > 0, line).alias("finding"),
    )


# --- secrets and rules given as data ----------------------------------------------------------

_HEX = r"\b[0-9a-f]{40}\b"


@query(
    "scan_extra_secrets",
    f"""with {DOCS}, s as ({D.matches('docs', ['secret'])}),
    x as (select doc_id, unnest(range(len(v))) as k, unnest(v) as value from (select doc_id, {D.all_matches(_HEX)} as v from docs)),
    b as (select doc_id, count(*) as n from s group by doc_id)
    select doc_id, category, pos::bigint as pos, value from s
    union all select x.doc_id, 'secret', (k + coalesce(n, 0))::bigint, value from x left join b on b.doc_id = x.doc_id""",
)
def scan_extra_secrets(spark, sf):
    found = detect_builtin(
        documents(spark, sf), "text", "doc_id", categories=["secret"], extra_secret_patterns=[_HEX]
    )
    return found.select("doc_id", "category", "pos", "value")


@query(
    "rules_from_table",
    """with r as (select distinct p_brand as id from part),
    t as (select p_partkey as doc_id, concat(p_name, ' by ', lower(p_brand), ', not ', p_brand, 'x') as text from part)
    select t.doc_id, r.id as category, lower(r.id) as value, 'ok' as checked from t join r on contains(t.text, concat(' by ', lower(r.id), ','))""",
)
def rules_from_table(spark, sf):
    """One rule for each brand, validated and compiled from a table."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("id")).distinct()
    given = brands.withColumns(
        {"value_regex": F.concat(F.lit(r"(?i)\b\Q"), "id", F.lit(r"\E\b")), "enabled": F.lit(True), "risk_level": F.lit("low")}
    )
    rules = given.select(
        *[
            (F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RULES.fields
        ]
    )
    compiled = compile_rules(rules)
    checked = {validate_rule_regex(spark, r.value_regex) or "ok" for r in compiled}
    texts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        F.concat("p_name", F.lit(" by "), F.lower("p_brand"), F.lit(", not "), "p_brand", F.lit("x")).alias("text"),
    )
    return detect_rules(texts, "text", "doc_id", compiled).select(
        "doc_id", "category", "value", F.lit(",".join(sorted(checked))).alias("checked")
    )


@query(
    "labelled_cases",
    """select event_type as target_type, count(*) filter (where value > 50) as positives,
      count(*) filter (where not value > 50) as negatives from events group by event_type""",
)
def labelled_cases(spark, sf):
    folder = shared(spark, "cases")
    table(spark, sf, "events").selectExpr(
        "string(event_id) as id", "event_type as target_type", "props as text", "value > 50 as should_detect",
        "'table' as origin",
    ).write.json(folder)
    return case_counts(read_labelled_cases(spark, folder))


# --- stores -----------------------------------------------------------------------------------

_SIGNALS = f"""with {DOCS}, m as materialized ({D.matches('docs')}), {_NO_CUSTOM}, {_NO_NAMES},
    {D.risk_report('docs', 'm', 'nc', 'nn', {})}"""


@query(
    "append_scans",
    _SIGNALS + " select concat('/d/', doc_id) as path, risk_score, risk_level, 7::bigint as scanned_at from report where findings <> ''",
)
def append_scans(spark, sf):
    """Two batches, one of them written again after a failure."""
    folder = shared(spark, "scans")
    corpus = scan_table_text(
        documents(spark, sf).withColumn("path", F.concat(F.lit("/d/"), "doc_id")), "doc_id", "text", path_col="path"
    )
    for part in (0, 1, 0):
        reports = signals_only(scan(corpus.filter(F.col("doc_id") % 2 == part)))
        store.append_scans(as_scans(reports, F.lit(7)), folder, str(part))
    return read_log(spark, folder).select("path", "risk_score", "risk_level", "scanned_at")


@query("neutralized_sink", S._neutralize_sql(DOCS, "docs"))
def neutralized_sink(spark, sf):
    folder = shared(spark, "neutral")
    write_neutralized(neutralize(with_builtin_hits(documents(spark, sf))), folder)
    return spark.read.parquet(folder).select(
        "doc_id", F.md5(F.col("redacted_text").cast("binary")).alias("text_md5"), "replaced_total"
    )


# a thousandth of the parts is seen again, another one is flagged
_BUCKETS = 64
_AGAIN, _FLAGGED = "p_partkey % 1000 = 7", "p_partkey % 1000 = 13"
_BUCKET_SQL = f"('0x' || substr(sha256(path), 1, 8))::bigint % {_BUCKETS}"


@query(
    "file_buckets",
    f"""with f as (select concat('/p/', p_partkey) as path, p_size::bigint as size, p_partkey, {_AGAIN} as again, {_FLAGGED} as flagged from part),
    b as (select *, {_BUCKET_SQL} as bucket from f),
    touched as (select distinct bucket from b where again or flagged)
    select path, case when again then size + 1000 else size end as size, case when again then 9 else 5 end::bigint as last_seen_at,
      5::bigint as first_seen_at, flagged as ignored, flagged as deleted, b.bucket::int as bucket,
      case when t.bucket is null then 0 else 1 end::bigint as batch
    from b left join touched t on t.bucket = b.bucket""",
)
def file_buckets(spark, sf):
    """A table of files after a batch about few of them, given twice: which batch wrote each file's bucket."""
    folder = shared(spark, "files")
    parts = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("/p/"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("size")
    )
    seen = parts.selectExpr("p_partkey", "path", "size", "5L as mtime", "5L as seen_at")
    again = seen.where(_AGAIN).withColumns({"size": F.col("size") + 1000, "seen_at": F.lit(9).cast("long")})
    flags = parts.where(_FLAGGED).select(
        store.file_id_of(F.col("path")).alias("file_id"), F.lit(True).alias("ignored"), F.lit(True).alias("deleted")
    )
    file_table.update_files(spark, folder, 0, seen=seen, buckets=_BUCKETS)
    for _ in range(2):
        file_table.update_files(spark, folder, 1, seen=again, flags=flags)
    file_table.drop_old_versions(spark, folder, 1)
    return file_table.read_files(spark, folder, versions=True).select(
        "path", "size", "last_seen_at", "first_seen_at", "ignored", "deleted", "bucket", "batch"
    )


# --- streams ----------------------------------------------------------------------------------

_PATH = "concat('/w', (user_id % 4)::string, '/', case when event_id % 9 = 0 then '.h/' else '' end, event_id::string, case when event_id % 7 = 0 then '.part' else '.txt' end)"


@query(
    "change_stream",
    f"""select {_PATH} as path, event_id as size from events
    where event_id % 5 <> 0 and event_id % 9 <> 0 and event_id % 7 <> 0 and user_id % 4 in (1, 2)""",
)
def change_stream_query(spark, sf):
    source, out = shared(spark, "changes"), shared(spark, "kept")
    table(spark, sf, "events").select(
        F.expr(_PATH.replace("::string", "")).alias("path"),
        F.col("event_id").alias("size"),
        S.epoch("ts").alias("mtime"),
        F.col("ts").cast("timestamp").alias("changed_at"),
        F.expr("event_id % 5 <> 0").alias("is_file"),
    ).write.parquet(source)
    stream = change_stream(spark, source, ["/w1", "/w2/"])
    finished(
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared(spark, "cp"))
    )
    return spark.read.parquet(out).select("path", "size")


def _far(spark, columns: dict) -> object:
    """One row far in the future, which moves the watermark past everything else."""
    return spark.range(1).select(*[F.lit(v).cast(t).alias(n) for n, (v, t) in columns.items()])


def _run_twice(start, rows, end, folder: str) -> None:
    """Run a stream over all rows, in the files they come in, then over the last row, with the same checkpoint."""
    rows.write.parquet(folder)
    finished(start())
    end.write.mode("append").parquet(folder)
    finished(start())


# three inventories of files that are parts, an hour apart; some are missing from one, some grow
_LISTED = "(p_partkey + n) % 5 <> 0 and p_partkey % 11 <> n + 4"
_LISTING = {
    "path": "concat('/parts/', p_partkey::string)",
    "size": "(p_size + case when p_partkey % 7 <= n then n else 0 end)::bigint",
    "mtime": "(1700000000 + case when p_partkey % 13 < n then n * 60 else 0 end)::bigint",
    "moment": "(1704067200 + n * 3600)::bigint",
}
_GONE = 5400


@query(
    "inventory_stream",
    f"""with l as (select {', '.join(f'{e} as {n}' for n, e in _LISTING.items())} from part, (select unnest([0, 1, 2]) as n) where {_LISTED}),
    w as (select *, lag(moment) over p as before, lag(size) over p as old_size, lag(mtime) over p as old_mtime, lead(moment) over p as after
          from l window p as (partition by path order by moment))
    select path, 'created' as change, size, mtime, moment from w where before is null or moment - before > {_GONE}
    union all
    select path, 'changed', size, mtime, moment from w where moment - before <= {_GONE} and (size <> old_size or mtime <> old_mtime)
    union all
    select path, 'gone', size, mtime, moment + {_GONE} from w where after is null or after - moment > {_GONE}""",
)
def inventory_stream(spark, sf):
    """Each inventory arrives by itself; the last one, much later, is empty but for one path."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    source, out, checkpoint = shared(spark, "inventories"), shared(spark, "changes"), shared(spark, "cp")
    parts = table(spark, sf, "part").select("p_partkey", "p_size")

    def arrives(rows) -> None:
        rows.selectExpr("path", "size", "mtime", "timestamp_seconds(moment) as taken_at").write.mode("append").parquet(source)
        stream = spark.readStream.schema("path string, size bigint, mtime bigint, taken_at timestamp").parquet(source)
        changes = inventory_changes(stream, gone_seconds=_GONE)
        finished(changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))

    for n in range(3):
        listing = parts.withColumn("n", F.lit(n)).where(_LISTED)
        arrives(listing.selectExpr(*[f"{e} as {name}" for name, e in _LISTING.items()]))
    arrives(spark.sql("select '/end' as path, 0L as size, 0L as mtime, 4102444800L as moment"))
    return spark.read.parquet(out).where("path <> '/end'").select(
        "path", "change", "size", "mtime", F.unix_seconds("changed_at").alias("moment")
    )


@query("debounce_stream", SQL["debounce_capped"])
def debounce_stream(spark, sf):
    """The stream form of ``debounce_capped``."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    source, out = shared(spark, "changes"), shared(spark, "stable")
    changes = S._changes(spark, sf)
    end = _far(
        spark,
        {"path": ("/end", "string"), "size": (0, "bigint"), "mtime": (0, "bigint"), "changed_at": ("2100-01-01", "timestamp")},
    )
    checkpoint = shared(spark, "cp")

    def start():
        stream = spark.readStream.schema(changes.schema).parquet(source)
        stable = debounce(stream, quiet_seconds=S._GAP, cap_seconds=S._CAP)
        return stable.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)

    _run_twice(start, changes, end, source)
    return spark.read.parquet(out).filter("path <> '/end'").select(
        "path", "size", *[F.unix_timestamp(c).alias(c) for c in ("first_seen", "last_change", "ready_at")]
    )


@query("session_stream", SQL["session_activity"])
def session_stream(spark, sf):
    """The stream form of ``session_activity``."""
    source, out = shared(spark, "events"), shared(spark, "sessions")
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    end = _far(spark, {"user_id": (-1, "bigint"), "ts": ("2100-01-01", "timestamp"), "value": (0, "double")})
    checkpoint = shared(spark, "cp")

    def start():
        stream = spark.readStream.schema(events.schema).parquet(source)
        found = session_activity(stream, "user_id", "ts", S._GAP, total=F.sum("value"))
        writer = found.writeStream.format("parquet").outputMode("append")
        return writer.option("path", out).option("checkpointLocation", checkpoint)

    _run_twice(start, events, end.select(*[F.col(f.name).cast(f.dataType) for f in events.schema]), source)
    done = spark.read.parquet(out).filter("user_id <> -1").withColumn("total", F.round("total", 4))
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


# events arrive in three parts by their time; some arrive one or two parts later than they should
_ARRIVAL = "least(2, case when day(ts) <= 10 then 0 when day(ts) <= 20 then 1 else 2 end + case when event_id % 17 = 0 then 1 when event_id % 23 = 0 then 2 else 0 end)"
_DELAY = 5 * 86_400
_LATE_SQL = f"""e as (select event_id, user_id, ts::timestamp as ts, value, {_ARRIVAL} as part from events),
    m as (select a.part, max(e.ts) as newest from (select distinct part from e) a join e on e.part < a.part group by a.part),
    r as (select e.*, coalesce(ts < newest - interval '{_DELAY} seconds', false) as late from e left join m on m.part = e.part)"""


def _routed_events(spark, sf, after=lambda store, schema: None) -> tuple[str, object]:
    """Route the events part by part; ``after`` runs behind each part."""
    source, where, checkpoint = shared(spark, "events"), shared(spark, "routed"), shared(spark, "cp")
    events = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    for n in range(3):
        events.where(f"{_ARRIVAL} = {n}").write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        finished(late_router(stream, where, "ts", _DELAY, checkpoint=checkpoint))
        after(where, events.schema)
    return where, events.schema


@query(
    "late_rows",
    f"""with {_LATE_SQL} select event_id, late, count(*) filter (where late) over () as n_late from r""",
)
def late_rows(spark, sf):
    """All events again: those on time and those behind the watermark, with the number that was counted."""
    where, schema = _routed_events(spark, sf)
    n = late_counts(spark, where).agg(F.sum("late")).first()[0]
    sides = [routed(spark, where, side, schema).select("event_id", F.lit(side == "late").alias("late")) for side in ("on_time", "late")]
    return sides[0].unionByName(sides[1]).withColumn("n_late", F.lit(n))


@query(
    "late_sessions",
    f"""with {_LATE_SQL}, o as (select * from r where not late),
    g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) < {S._GAP * 1_000_000} then 0 else 1 end as fresh from o window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sid from g)
    select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as n_events, round(sum(value), 4) as total from s group by user_id, sid""",
)
def late_sessions(spark, sf):
    """Sessions of the events on time, as a stream behind the router: none of them is dropped."""
    out, checkpoint = shared(spark, "sessions"), shared(spark, "cp")

    def sessions(where, schema) -> None:
        found = session_activity(
            on_time_stream(spark, where, schema), "user_id", "ts", S._GAP, late=f"{_DELAY} seconds", total=F.sum("value")
        )
        writer = found.writeStream.format("parquet").outputMode("append")
        finished(writer.option("path", out).option("checkpointLocation", checkpoint))

    where, schema = _routed_events(spark, sf, sessions)
    end = _far(spark, {"event_id": (-1, "bigint"), "user_id": (-1, "bigint"), "ts": ("2100-01-01", "timestamp"), "value": (0, "double")})
    end.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{where}/on_time/end")
    sessions(where, schema)
    done = spark.read.parquet(out).filter("user_id <> -1").withColumn("total", F.round("total", 4))
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query(
    "scan_stream",
    _SIGNALS
    + """, kept as (select * from report where findings <> '' and doc_id % 10 <> 0)
    select concat('/d/', doc_id) as path, risk_score, risk_level, 3 as reminders, 1 as events,
      (select count(*) from documents) as files from kept""",
)
def scan_stream_query(spark, sf):
    """A live scan of documents: files seen, scans, reminders and events in the store."""
    source, where = shared(spark, "docs"), shared(spark, "store")
    docs = documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("/d/"), "doc_id").alias("path"),
        F.octet_length("text").cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime"), "text",
        F.lit(True).alias("secrets_enabled"),
    )
    docs.write.parquet(source)
    skip = docs.filter(F.col("doc_id").cast("long") % 10 == 0).select("path", F.lit(True).alias("ignored"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 16).parquet(source)
    finished(
        scan_stream(stream, where, checkpoint=shared(spark, "cp"), clock=lambda: 7, ignored_files=lambda: skip)
    )
    scans = read_log(spark, f"{where}/scans")
    reminders = read_log(spark, f"{where}/reminders").groupBy("file_id").agg(F.count(F.lit(1)).alias("reminders"))
    events = read_log(spark, f"{where}/events").groupBy("file_id").agg(F.count(F.lit(1)).alias("events"))
    files = current_files(spark, where).count()
    return (
        scans.join(reminders, "file_id").join(events, "file_id")
        .select("path", "risk_score", "risk_level", "reminders", "events", F.lit(files).alias("files"))
    )


@query(
    "fleet_stream",
    f"""with {S._DEVICES_SQL}, {S._JUDGED_SQL}
    select device_id, count(*) as n, max(received_at) as last_at from judged where status = 'accepted' group by device_id""",
)
def fleet_stream(spark, sf):
    where = _fleet_store(spark, sf)
    return current_fleet_alerts(spark, where).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("received_at").alias("last_at")
    )


def _fleet_store(spark, sf) -> str:
    """A store that collected the requests of all devices in three batches."""
    source, where = shared(spark, "requests"), shared(spark, "fleet")
    requests = table(spark, sf, "events").select(
        F.expr(S._REQUEST_AUTH).alias("authorization"), S.epoch("ts").alias("received_at"),
        F.col("event_id").cast("string").alias("file_id"), F.lit("/p").alias("path"), F.lit("low").alias("risk_level"),
        F.lit(1).cast("bigint").alias("risk_score"), F.array("event_type").alias("types"),
        S.epoch("ts").alias("last_seen_at"),
    )
    requests.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    finished(fleet_ingest(stream, where, lambda: S._devices(spark, sf), shared(spark, "cp")))
    return where


@query(
    "fleet_trim",
    f"""with {S._DEVICES_SQL}, {S._JUDGED_SQL}, a as (select * from judged where status = 'accepted'),
    r as (select *, row_number() over (order by received_at desc, device_id desc, event_id::varchar desc) as place from a)
    select device_id, event_id::varchar as file_id, received_at, 1::bigint as folders from r where place <= (select count(*) // 2 from a)""",
)
def fleet_trim(spark, sf):
    """The store itself keeps the newer half of the alerts, and one of three folders."""
    where = _fleet_store(spark, sf)
    trim_fleet_alerts(spark, where, current_fleet_alerts(spark, where).count() // 2)
    left = spark.read.parquet(f"{where}/fleet_alerts").select("batch").distinct().count()
    return current_fleet_alerts(spark, where).select(
        "device_id", "file_id", "received_at", F.lit(left).cast("long").alias("folders")
    )
