"""Data-quality, diff and profile operators (Q1..Q11)."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import mask_name, mask_phone
from ..functions.scalars import date_prefix_depth, num_text, strip, strip_date_prefixes
from ..functions.timeparse import parse_ts_mixed

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
# Display masking by lower-cased, trimmed column name.
NAME_COLUMNS = ("name", "greeter", "greeter_actual", "hname", "hse_manage", "insertby",
                "성명", "이름", "접견자", "담당자", "작성자", "신청자", "작업자")
PHONE_COLUMNS = ("phone", "연락처", "전화", "전화번호", "hp", "tel", "mobile")
# Weather rule thresholds and their keyword / warning texts.
WEATHER_RULES = {"temp_min_cold": 0, "temp_max_hot": 30, "rainfall_heavy": 30, "wind_strong": 15,
                 "wave_high": 1.0}
# Curated table names checked by the health report.
EXPECTED_TABLES = ("trial_schedule", "fuel_usage", "fuel_price", "lng_usage", "fuel_plan",
                   "pjtmethod", "ptwlist", "mapping", "out", "ra", "pjtlist", "milestone",
                   "shipbbs", "date", "weather", "message", "accident", "guide")


def analyze_diff(new: DataFrame, existing: DataFrame, key: str,
                 legacy_key: str | None = None) -> DataFrame:
    """Q1: added / changed / kept key counts plus row counts, in one pass.

    Keys are distinct per side and compared as text; a FULL OUTER join of the
    two distinct key sets classifies them (added = only new, changed = both,
    kept = only old).  Row counts come from the same aggregate.  An empty load compares nothing:
    all key counts are 0.
    """
    if legacy_key and key not in existing.columns and legacy_key in existing.columns:
        existing = existing.withColumnRenamed(legacy_key, key)
    nk = new.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("nr"))
    ok = existing.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("er"))
    j = nk.join(ok, nk["k"].eqNullSafe(ok["k"]), "full")
    hasn, haso = F.col("nr").isNotNull(), F.col("er").isNotNull()
    kept = F.when(F.count_if(hasn) > 0, F.count_if(~hasn & haso)).otherwise(F.lit(0).cast("long"))
    return j.agg(F.count_if(hasn & ~haso).alias("added"), F.count_if(hasn & haso).alias("changed"), kept.alias("kept"),
                 F.coalesce(F.sum("nr"), F.lit(0)).cast("long").alias("new_rows"),
                 F.coalesce(F.sum("er"), F.lit(0)).cast("long").alias("exist_rows"))


def mask_for_display(df: DataFrame, name_cols: Sequence[str] = NAME_COLUMNS,
                     phone_cols: Sequence[str] = PHONE_COLUMNS) -> DataFrame:
    """Q4: mask name-like and phone-like columns (by trimmed lower-case name); others untouched."""
    names, phones = set(name_cols), set(phone_cols)
    out = []
    for c in df.columns:
        low = c.strip().lower()
        col = F.col(f"`{c}`")
        if low in names:
            out.append(mask_name(col.cast("string")).alias(c))
        elif low in phones:
            out.append(mask_phone(col.cast("string")).alias(c))
        else:
            out.append(col)
    return df.select(*out)


def risk_rules(df: DataFrame, rules: Mapping[str, float] = WEATHER_RULES) -> DataFrame:
    """Q7: rule keywords (joined ', ') and warnings (joined ' / '); none -> null."""
    r = rules
    checks = [
        (F.col("tmp_min") <= r["temp_min_cold"], "동파위험",
         [F.lit("최저기온 "), num_text("tmp_min"), F.lit("°C — 블랙아이스·동파 주의")]),
        (F.col("tmp_max") >= r["temp_max_hot"], "온열질환",
         [F.lit("최고기온 "), num_text("tmp_max"), F.lit("°C — 온열질환 주의")]),
        (F.col("pop_max") >= r["rainfall_heavy"], "미끄럼주의",
         [F.lit("강수확률 "), num_text("pop_max"), F.lit("% — 침수·미끄럼 주의")]),
        (F.col("wsd_max") >= r["wind_strong"], "강풍",
         [F.lit("최대풍속 "), num_text("wsd_max"), F.lit("m/s — 고소작업 제한")]),
        (F.col("wav_height") >= r["wave_high"], "수중작업금지",
         [F.lit("파고 "), num_text("wav_height"), F.lit("m — 수중작업 중지")]),
    ]
    kw = F.concat_ws(", ", *[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for c, k, _ in checks])
    wn = F.concat_ws(" / ", *[F.when(F.coalesce(c, F.lit(False)), F.concat(*t)) for c, _, t in checks])
    return df.withColumn("keyword", F.nullif(kw, F.lit(""))).withColumn("warning", F.nullif(wn, F.lit("")))


def rejected_report(raw: DataFrame, keep: Column, group_col: str, start_col: str, start: Column, end: Column,
                    unmapped: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Q5: rows in / kept / expanded / dropped, kept rows whose non-blank start time is not understood, the top dropped
    values of ``group_col`` (``value (n)``, a top-k report), the unmapped headers, and the likely cause if no row is left.

    ``keep`` is the filter, ``start`` and ``end`` the parsed times: one aggregate over the raw rows and one for the top
    values; nothing is joined back.
    """
    from .aggregate import top_n_values
    kept = F.coalesce(keep, F.lit(False))
    days = F.datediff(F.greatest(F.to_date(start), F.coalesce(F.to_date(end), F.to_date(start))), F.to_date(start)) + 1
    r = raw.select(kept.alias("_kept"), days.alias("_days"),
                   (start.isNull() & (F.coalesce(strip(F.col(start_col).cast("string")), F.lit("")) != "")).alias("_bad"))
    counts = r.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if("_kept").alias("rows_kept"),
                   F.coalesce(F.sum(F.when(F.col("_kept"), F.col("_days"))), F.lit(0)).cast("long").alias("rows_expanded"),
                   F.count_if(F.col("_kept") & F.col("_bad")).alias("rows_unparsed"))
    tops = top_n_values(raw.filter(~kept), group_col, top)
    unread = F.col("rows_unparsed") > 0
    # why nothing is left, if nothing is: the first of these that holds
    cause = (F.when(F.col("rows_expanded") > 0, F.lit(None).cast("string")).when(F.col("rows_in") == 0, "no rows")
             .when(F.lit(bool(unmapped)), "unmapped headers").when(F.col("rows_kept") == 0, "all rows filtered")
             .when(unread, "start times not understood").otherwise("no start times"))
    counts = counts.withColumn("cause", cause)
    tagged = counts.select("*", F.lit(None).cast("string").alias("_v"), F.lit(None).cast("long").alias("_n")).unionByName(
        tops.select(F.col("value").alias("_v"), F.col("n").cast("long").alias("_n")), allowMissingColumns=True)
    top_list = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct((-F.col("_n")).alias("neg"), F.col("_v").alias("value"))))),
        lambda x: F.concat(x["value"], F.lit(" ("), (-x["neg"]).cast("string"), F.lit(")")))
    one = tagged.agg(*[F.max(c).alias(c) for c in ("rows_in", "rows_kept", "rows_expanded", "rows_unparsed", "cause")], top_list.alias("top_dropped"))
    return (one.withColumn("rows_dropped", F.col("rows_in") - F.col("rows_kept"))
            .withColumn("unmapped", F.array(*[F.lit(u) for u in unmapped]).cast("array<string>")))


def adaptive_datetime_columns(df: DataFrame, pattern: str = "오전|오후", max_loss: float = 0.5,
                              skip: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Q6: string columns holding 오전/오후 times are converted with N3, unless more than
    ``max_loss`` of their non-null values would be lost.  Two aggregates in total
    (probe, then loss check); returns (frame, converted columns)."""
    from .aggregate import any_match, convertible_columns
    cands = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in skip]
    if not cands:
        return df, []
    probe = any_match(df, cands, pattern).head().asDict()
    hits = [c for c in cands if probe.get(c)]
    if not hits:
        return df, []
    ok = convertible_columns(df, hits, parse_ts_mixed, max_loss).filter("ok").select("column").collect()
    conv = [r[0] for r in ok]
    return df.withColumns({c: parse_ts_mixed(F.col(f"`{c}`")) for c in conv}), conv


def catalog_profile(tables: Mapping[str, DataFrame], keys: Mapping[str, str] | None = None,
                    approx: bool = False) -> DataFrame:
    """Q2: per table rows, columns and distinct keys — one small aggregate each, unioned.
    ``approx=True`` uses HyperLogLog (``approx_count_distinct``) instead of an exact
    distinct, which on a 100 TB table avoids shuffling every key."""
    keys = keys or {}
    parts = []
    for name, df in tables.items():
        k = keys.get(name)
        distinct = (F.approx_count_distinct(F.col(k)) if approx else F.count_distinct(F.col(k))) if k else None
        aggs = [F.count(F.lit(1)).alias("rows"),
                (distinct if distinct is not None else F.lit(None).cast("long")).alias("keys")]
        parts.append(df.agg(*aggs).select(F.lit(name).alias("table"), "rows",
                                          F.lit(len(df.columns)).cast("long").alias("cols"), "keys"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("rows") == 0, F.lit("empty")).otherwise(F.lit("saved")))


def catalog_metadata(tables: Mapping[str, DataFrame], keys: Mapping[str, str], files: DataFrame, as_of: str,
                     approx: bool = False) -> DataFrame:
    """Q2 in full: the profile with recency and the status empty / auto / saved.

    ``files`` gives (table, modified, auto), as a file manifest does; ``as_of`` is the date of the report.
    """
    from ..functions.scalars import recency_class
    prof = catalog_profile(tables, keys, approx).drop("status").join(files, "table", "left")
    status = (F.when(F.col("rows") == 0, F.lit("empty")).when(F.coalesce(F.col("auto"), F.lit(False)), F.lit("auto"))
              .otherwise(F.lit("saved")))
    return prof.select("table", "rows", "cols", "keys", status.alias("status"), recency_class("modified", F.lit(as_of)).alias("recency"))


def read_profiles(tables: Mapping[str, DataFrame | Callable[[], DataFrame]], keys: Mapping[str, str] | None = None,
                  approx: bool = False) -> DataFrame:
    """Q2/Q3: table, rows, cols, keys and reason of every table, found by reading it.

    Each table is opened and counted on its own, one small aggregate each: one that is missing, unreadable or broken in a later
    row gets a null profile and the reason, and does not stop the others.
    """
    rows = []
    for name, table in tables.items():
        try:
            df = table() if callable(table) else table
            row = catalog_profile({name: df}, keys, approx).first()
            rows.append((name, row["rows"], row["cols"], row["keys"], None))
        except Exception as e:  # noqa: BLE001 - what cannot be read is a finding
            rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
    return SparkSession.getActiveSession().createDataFrame(rows, "table string, rows long, cols long, keys long, reason string")


def catalog_of_readable(tables: Mapping[str, DataFrame | Callable[[], DataFrame]], keys: Mapping[str, str], files: DataFrame, as_of: str,
                        approx: bool = False) -> DataFrame:
    """Q2 in full over tables some of which cannot be read: their status is 'warn'; otherwise as :func:`catalog_metadata`."""
    from ..functions.scalars import recency_class
    prof = read_profiles(tables, keys, approx).join(files, "table", "left")
    status = (F.when(F.col("reason").isNotNull(), "warn").when(F.col("rows") == 0, "empty")
              .when(F.coalesce(F.col("auto"), F.lit(False)), "auto").otherwise("saved"))
    return prof.select("table", "rows", "cols", "keys", status.alias("status"), recency_class("modified", F.lit(as_of)).alias("recency"))


def health_report(spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], expected: Sequence[str]) -> DataFrame:
    """Q3 in full: every expected table read and judged (:func:`table_health`), and the line '(found)' with how many passed."""
    prof = read_profiles({t: tables[t] for t in expected if t in tables})
    reasons = {r["table"]: r["reason"] for r in prof.where("reason is not null").collect()}  # of the expected tables
    h = table_health(spark, prof.where("reason is null").drop("reason"), expected, reasons)
    total = h.agg(F.lit("(found)").alias("table"), F.when(F.count_if(F.col("check") != "PASS") == 0, "PASS").otherwise("WARN").alias("check"),
                  F.concat(F.count_if(F.col("check") == "PASS").cast("string"), F.lit("/"), F.count("*").cast("string")).alias("detail"))
    return h.unionByName(total)


def table_health(spark: SparkSession, profile: DataFrame, expected: Sequence[str],
                 unreadable: Mapping[str, str] | None = None) -> DataFrame:
    """Q3: expected tables left-joined to the profile: PASS rows x cols / WARN missing / FAIL with the reason, for tables
    that the caller could not read."""
    reasons = dict(unreadable or {})
    exp = spark.createDataFrame([(t, reasons.get(t)) for t in expected], "table string, reason string")
    j = exp.join(profile, "table", "left")
    size = F.concat(F.col("rows").cast("string"), F.lit(" x "), F.col("cols").cast("string"))
    failed, missing = F.col("reason").isNotNull(), F.col("rows").isNull()
    return j.select("table", F.when(failed, F.lit("FAIL")).when(missing, F.lit("WARN")).otherwise(F.lit("PASS")).alias("check"),
                    F.when(failed, F.col("reason")).when(missing, F.lit("missing")).otherwise(size).alias("detail"))


def archive_plan(files: DataFrame, archive: DataFrame, section: str = "section",
                 name: str = "file_name", exts: Sequence[str] = (".xlsx", ".xls", ".csv")) -> DataFrame:
    """Q11: per landed file: ignore (not a data file) / move / duplicate (already archived),
    with the stripped name and the nested date-prefix depth (N20 + J9)."""
    from .joins import manifest_exists
    f = files.withColumn("clean_name", strip_date_prefixes(F.col(name))).withColumn(
        "depth", date_prefix_depth(F.col(name)))
    a = archive.select(F.col(section), strip_date_prefixes(F.col(name)).alias("clean_name"))
    f = manifest_exists(f, a, [section, "clean_name"], "archived")
    is_data = F.lit(False)
    for e in exts:
        is_data = is_data | F.lower(F.col(name)).endswith(e)
    return f.withColumn("action", F.when(~is_data | F.col(name).startswith("_"), F.lit("ignore"))
                        .when(F.col("archived"), F.lit("duplicate")).otherwise(F.lit("move")))


def archive_totals(plan: DataFrame) -> DataFrame:
    """Q11's totals: files, and those with nested date prefixes, of each action and of all ('(all)')."""
    return (plan.rollup("action").agg(F.count("*").alias("files"), F.count_if(F.col("depth") > 1).alias("nested"), F.max("depth").alias("deepest"))
            .withColumn("action", F.coalesce("action", F.lit("(all)"))))


def enrich_stats(enriched: DataFrame, key: str, hit_col: str = "risk_keywords") -> DataFrame:
    """Q8: distinct keys without a value (unmapped) and with one (ok)."""
    k = strip(F.col(key))
    d = enriched.filter(k.isNotNull() & (k != "")).groupBy(k.alias("k")).agg(
        F.max(F.col(hit_col).isNotNull() & (F.col(hit_col) != "")).alias("h"))
    return d.agg(F.count_if(~F.col("h")).alias("unmapped"), F.count_if(F.col("h")).alias("ok"))


def enrich_outcome(answers: DataFrame, known: DataFrame, key: str, value: str, error: str) -> DataFrame:
    """Q8 in full: distinct keys asked, answered and failed, the answered ones not known before, and the first error
    in key order."""
    per = answers.groupBy(key).agg(F.max(F.col(value)).alias("_v"), F.min(error).alias("_e"))
    old = known.select(F.col(key).alias("_k")).distinct().withColumn("_old", F.lit(True))
    j = per.join(old, F.col(key) == F.col("_k"), "left")
    ok = F.col("_v").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("keys"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"),
                 F.count_if(ok & F.col("_old").isNull()).alias("added"),
                 F.min_by("_e", F.when(F.col("_e").isNotNull(), F.col(key))).alias("first_error"))


def doc_progress(manifest: DataFrame, items: DataFrame, file_col: str = "pdf_filename") -> DataFrame:
    """Q10: per document, the number of extracted items (0 when not parsed yet)."""
    c = items.groupBy(file_col).agg(F.count(F.lit(1)).alias("items"))
    return manifest.join(c, file_col, "left").withColumn("items", F.coalesce("items", F.lit(0))) \
        .withColumn("parsed", F.col("items") > 0)


def diff_preview(new: DataFrame, stored: DataFrame, key: str, n: int = 200, order: Sequence[str] = ("_seq",)) -> DataFrame:
    """Q9: masked head of the load, by its order, tagged new / replace (J7 + Q4 + O2)."""
    from .joins import tag_new_or_replaced
    head = new.orderBy(*order).limit(n)
    return mask_for_display(tag_new_or_replaced(head, stored, key))


