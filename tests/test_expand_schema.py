"""Expansion, schema and masking goldens (FIXTURES.md §3)."""
import datetime as dt

from tidemark.operators.expand import expand_daily, split_periods
from tidemark.operators.quality import mask_for_display, risk_rules
from tidemark.operators.schema import (PERMIT_HEADER_CANDIDATES, drop_columns_by_token, map_headers,
                                       normalized_headers, plan_headers, to_new_schema)
from tidemark.operators.window import date_header_change, keep_latest_n

D = dt.date


def test_split_periods_golden(spark):
    ends = [D(2026, 1, 1), D(2026, 1, 2), D(2026, 1, 7), D(2026, 1, 8), D(2026, 1, 9), D(2026, 1, 15),
            D(2025, 12, 31)]
    df = spark.createDataFrame([(i, D(2026, 1, 1), e) for i, e in enumerate(ends)], "i int, visit_start date, visit_end date")
    got = {}
    for r in split_periods(df).collect():
        got.setdefault(r.i, []).append((r.period_start, r.period_end))
    s = D(2026, 1, 1)
    assert {k: sorted(v) for k, v in got.items()} == {
        0: [(s, s)], 1: [(s, D(2026, 1, 2))], 2: [(s, D(2026, 1, 7))], 3: [(s, D(2026, 1, 7))],
        4: [(s, D(2026, 1, 7)), (D(2026, 1, 8), D(2026, 1, 9))],
        5: [(s, D(2026, 1, 7)), (D(2026, 1, 8), D(2026, 1, 14))], 6: [(s, D(2025, 12, 31))]}


def test_expand_daily_golden(spark):
    T = dt.datetime
    data = [(0, T(2026, 6, 14, 8), T(2026, 6, 16, 13)), (1, T(2026, 6, 14, 8), None),
            (2, T(2026, 6, 14, 8), T(2026, 6, 12)), (3, None, T(2026, 6, 12))]
    df = spark.createDataFrame(data, "i int, STDATE timestamp_ntz, EDDATE timestamp_ntz")
    got = sorted((r.i, r.DATE) for r in expand_daily(df).collect())
    assert got == [(0, "26-06-14"), (0, "26-06-15"), (0, "26-06-16"), (1, "26-06-14"), (2, "26-06-14")]


def test_normalize_headers_golden():
    assert normalized_headers(["LS HFO(ton)", "A/B", "x\ny", "(unit)", "a", "a"]) == \
        ["LS_HFO", "AB", "x_y", "(unit)", "a", "a_2"]


def test_map_headers_golden(spark):
    cols = ["호선(선박)", "작업 시작일", "팀명", "작업\n위치", "팀장명"]
    plan = plan_headers(cols, PERMIT_HEADER_CANDIDATES)
    mapped = {k: v for k, v in plan.mapping.items() if v}
    assert mapped == {"PJT": "호선(선박)", "STDATE": "작업 시작일", "TEAMNM": "팀명", "AREA_DETAIL": "작업\n위치"}
    assert plan.unused(cols) == ["팀장명"]
    df = spark.createDataFrame([("2601", "x", "t", "a", "z")], ", ".join(f"`{c}` string" for c in cols))
    out = map_headers(df)
    assert out.columns == list(PERMIT_HEADER_CANDIDATES)
    assert out.collect()[0].PJT == "2601"


def test_drop_pii_tokens(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "SHIPNUM int, HNAME int, HOTEL int, Phone_no int")
    assert drop_columns_by_token(df).columns == ["SHIPNUM"]


def test_message_migration(spark):
    df = spark.createDataFrame([("2024-01-01", None, "hi", "", None)],
                               "date string, team string, message string, ref_type string, ref_path string")
    r = to_new_schema(df).collect()[0]
    assert tuple(r) == ("2024-01-01", "전체", "hi", "없음", "")


def test_mask_for_display(spark):
    df = spark.createDataFrame([("홍길동", "010-1234-5678", "x")], "Name string, phone string, other string")
    r = mask_for_display(df).collect()[0]
    assert tuple(r) == ("홍*동", "010-****-5678", "x")


def test_risk_rules_golden(spark):
    df = spark.createDataFrame([(-3.0, 5.0, 60.0, 15.0, 0.9), (None, None, None, None, None),
                                (0.0, 30.0, 30.0, 15.0, 1.0)],
                               "tmp_min double, tmp_max double, pop_max double, wsd_max double, wav_height double")
    out = risk_rules(df).collect()
    assert out[0].keyword == "동파위험, 미끄럼주의, 강풍"
    assert (out[1].keyword, out[1].warning) == (None, None)
    assert out[2].keyword == "동파위험, 온열질환, 미끄럼주의, 강풍, 수중작업금지"
    assert out[0].warning.startswith("최저기온 -3.0°C")


def test_keep_latest_and_headers(spark):
    T = dt.datetime
    files = spark.createDataFrame([("s", f"f{i}", T(2026, 1, 1 + i)) for i in range(10)],
                                  "section string, file_name string, modification_time timestamp_ntz")
    out = {r.file_name: r.action for r in keep_latest_n(files, "section", 7).collect()}
    assert [out[f"f{i}"] for i in range(10)] == ["delete"] * 3 + ["keep"] * 7
    msgs = spark.createDataFrame([("a", "d1", 1), ("a", "d1", 2), ("a", "d2", 3), ("b", "d1", 4)],
                                 "team string, date string, id int")
    flags = {r.id: r.is_first_of_date for r in date_header_change(msgs, "date", ["team"], tiebreak=["id"]).collect()}
    assert flags == {1: True, 2: False, 3: True, 4: True}
