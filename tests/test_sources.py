"""CSV files, table sets, guards and history."""

import pytest
from helpers import column

from soundrows.checks import USUAL_LIMITS, Checker
from soundrows.errors import CheckError
from soundrows.sources import tables as table_source
from soundrows.sources.csv import header_names, read_csv, stage_csv, survey
from soundrows.sources.history import History

DEPARTMENTS = """department_id,department_name,department_type,floor
1,Cardiology,Inpatient,2
2,Emergency,Emergency,1
3,Imaging,Diagnostic,1
"""
PROVIDERS = """provider_id,first_name,last_name,specialty,department_id,hire_date
1,Ann,Bell,Cardiology,1,2010-08-06
2,Bob,Cole,Imaging,3,2099-01-01
3,Cyd,Dean,Imaging,3,2016-03-28
4,Dan,East,Imaging,404,2019-06-25
5,Eve,Ford,Imaging,2,2019-06-25
6,Fay,Gray,,2,2018-07-10
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "departments.csv").write_text(DEPARTMENTS.replace("\n", "\r\n"))
    (tmp_path / "providers.csv").write_text(PROVIDERS)
    return str(tmp_path)


def cells(spark, tmp_path, text, **options):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    return [tuple(r) for r in read_csv(spark, str(path), **options).collect()]


def test_missing_words_and_kept_text(spark, tmp_path):
    words = ["N/A", "null", "None", "NULL", "nan", '""', "-", " x ", "na", "N/A "]
    rows = cells(spark, tmp_path, "a,b\n" + "\n".join(f"{w},1" for w in words) + "\n")
    assert [r[0] for r in rows] == [None] * 6 + ["-", " x ", "na", "N/A "]


def test_blank_lines_short_rows_and_quotes(spark, tmp_path):
    assert cells(spark, tmp_path, 'a,b\n1,2\n\n3\n"x ""y"", z",4\n') == [
        ("1", "2"), ("3", None), ('x "y", z', "4")]


def test_line_breaks_inside_quotes(spark, tmp_path):
    assert cells(spark, tmp_path, 'a,b\n"1\n2",3\n4,5\n') == [("1\n2", "3"), ("4", "5")]


def test_long_rows_are_rejected(spark, tmp_path):
    with pytest.raises(Exception, match="expected 2 fields, saw more"):
        cells(spark, tmp_path, "a,b\n1,2\n1,2,3\n")


def test_long_rows_fail_a_check_before_any_rule(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(DEPARTMENTS + "4,A,Inpatient,1,extra\n")
    with pytest.raises(CheckError, match="Could not parse CSV"):
        Checker(spark).check_csv(str(path))


def test_header_names(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_bytes("﻿ a ,b,b,\n1,2,3,4\n".encode())
    assert header_names(spark, str(path)) == [" a ", "b", "b.1", "Unnamed: 3"]
    assert read_csv(spark, str(path)).columns == ["a", "b", "b.1", "Unnamed: 3"]
    assert read_csv(spark, str(path), strip_header=False).columns[0] == " a "


def test_single_file_check(spark, folder):
    result = Checker(spark, as_of="2024-06-01").check_csv(f"{folder}/providers.csv")
    assert result["dataset"] == "providers" and result["auto_detected"]
    assert result["summary"]["errors"] == 2 and result["summary"]["rules_skipped"] == 1
    lines = {r["rule_id"]: [s["_line"] for s in r["sample"]]
             for r in result["results"] if r["failed"]}
    assert lines == {"providers.date.hire": [3], "providers.not_null.specialty": [7]}


def test_folder_audit_and_member(spark, folder):
    checker = Checker(spark, as_of="2024-06-01")
    result = checker.audit_folder(folder, variant="dirty")
    assert result["aggregate"]["errors"] == 3 and result["aggregate"]["rows"] == 9
    assert result["recognised"] == ["departments", "providers"]
    assert result["variant"] == "dirty" and result["source"] == "audit"
    member = checker.check_member(folder, "providers", "dirty")
    [link] = [r for r in member["results"] if r["rule_id"] == "providers.fk.dept"]
    assert [s["_line"] for s in link["sample"]] == [5] and member["variant"] == "dirty"
    with pytest.raises(CheckError, match="no profile"):
        checker.check_member(folder, "x")
    with pytest.raises(CheckError, match="No table"):
        checker.check_member(folder, "billing")


def test_lines_across_blocks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{i},{'x' if i != 4990 else ''}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        from helpers import evaluate
        from soundrows.operators.rules import NotNull

        table = read_csv(spark, str(path))
        assert table.rdd.getNumPartitions() > 4
        [row] = evaluate(table, NotNull("n", "t", "b")).samples().collect()
        assert row["_line"] == 4992
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_table_sets(spark, folder, tmp_path):
    names = ["providers", "departments", "billing"]
    assert table_source.list_tables(spark, folder) == ["departments", "providers"]
    assert table_source.list_tables(spark, f"{folder}/none") == []
    tables = table_source.load_csv_tables(spark, folder, names)
    assert list(tables) == ["providers", "departments"]
    tables["providers"].write.parquet(f"{folder}/providers.parquet")
    assert list(table_source.load_parquet_tables(spark, folder, names)) == ["providers"]
    tables["departments"].createOrReplaceTempView("departments")
    assert list(table_source.load_catalog_tables(spark, names)) == ["departments"]
    with pytest.raises(CheckError):
        table_source.load_table(spark, folder, "billing")


def test_guards(spark, folder):
    path = f"{folder}/providers.csv"
    with pytest.raises(CheckError, match="more than .* bytes"):
        Checker(spark, max_bytes=10).check_csv(path)
    with pytest.raises(CheckError, match="more than 5 rows"):
        Checker(spark, max_rows=5).check_csv(path)
    with pytest.raises(CheckError, match="more than .* rows"):
        Checker(spark, max_rows=8).audit_folder(folder)
    usual = Checker(spark, **USUAL_LIMITS)
    assert usual.check_csv(path)["row_count"] == 6
    table_source.check_rows([column(spark, ["1", "2"]), column(spark, ["3"])], 3)
    with pytest.raises(CheckError, match="has no rows"):
        table_source.check_not_empty(column(spark, []))


# -- history -----------------------------------------------------------------------
def report(score, dataset="patients", errors=0):
    return {"dataset": dataset, "row_count": 10, "results": [{"sample": [{"name": "x"}]}],
            "summary": {"score": score, "grade": "A", "errors": errors, "warnings": 1,
                        "rules_failed": 2}}


def test_history_round_trip(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), enabled=True)
    assert history.recent().count() == 0 and history.datasets().count() == 0
    for score in (90, 95, 99):
        assert history.save([report(score)], "upload") == 1
    assert history.save([report(50, "billing"), report(60, "billing")], "audit") == 2
    assert [r["score"] for r in history.trend("patients").collect()] == [90, 95, 99]
    assert [r["score"] for r in history.trend("patients", 2).collect()] == [95, 99]
    assert [r["score"] for r in history.recent(limit=2).collect()] == [60, 50]
    assert [r["score"] for r in history.recent("patients").collect()] == [99, 95, 90]
    assert history.recent(limit=0).count() == 1
    overview = history.overview()
    assert overview["enabled"] and overview["datasets"] == ["billing", "patients"]
    assert set(overview["records"][0]) == {
        "id", "created_at", "dataset", "source", "variant", "row_count", "score", "grade",
        "errors", "warnings", "rules_failed"}
    assert history.trend_points("patients")["count"] == 3
    history.clear()
    assert history.recent().count() == 0
    history.save([report(70)], "upload")
    assert history.recent().count() == 1


def test_history_switched_off(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SOUNDROWS_HISTORY", "off")
    history = History(spark, str(tmp_path / "h"))
    assert history.save([report(90)], "upload") == 0
    assert history.recent().count() == 0 and not (tmp_path / "h").exists()
    assert history.trend_points("patients") == {
        "dataset": "patients", "points": [], "enabled": False}


def test_failed_history_write_does_not_fail_a_check(spark, folder, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("not a folder")
    history = History(spark, str(blocked), enabled=True)
    result = Checker(spark, history=history).check_csv(f"{folder}/departments.csv")
    assert result["summary"]["errors"] == 0
    kept = History(spark, str(tmp_path / "kept"), enabled=True)
    Checker(spark, history=kept, as_of="2024-06-01").audit_folder(folder)
    assert {(r["dataset"], r["source"]) for r in kept.recent().collect()} == {
        ("departments", "audit"), ("providers", "audit")}


# -- CSV without loss ---------------------------------------------------------------
@pytest.mark.parametrize("row", ["3,4,,x", "5,6,", "5,6,,", '"a,b",2,"c"', "1,2,3"])
def test_surplus_cells_are_refused(spark, tmp_path, row):
    path = tmp_path / "x.csv"
    path.write_text(f"a,b\n1,2\n{row}\n7,8\n")
    with pytest.raises(CheckError, match="too many fields"):
        stage_csv(spark, str(path))


def test_short_rows_quotes_and_commas_are_whole_rows(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1\n"x,""y"",z",2\n,\n"",3\n"l\nm, n",4\n')
    rows = [tuple(r) for r in read_csv(spark, str(path)).collect()]
    assert rows == [("1", None), ('x,"y",z', "2"), (None, None), (None, "3"), ("l\nm, n", "4")]


def test_header_names_like_pandas(spark, tmp_path):
    import pandas

    for header in ("a,a,a.1", "a,a.1,a", "a,a,a", "x,,x,", "a,a,a.1,a.1,a.2", '"l\nm",b', '\ufeffa,b'):
        path = tmp_path / "h.csv"
        path.write_text(f"{header}\n" + ",".join("1" * (header.count(",") + 1)) + "\n")
        assert header_names(spark, str(path)) == list(pandas.read_csv(path, dtype=str).columns)
        assert len(read_csv(spark, str(path)).collect()) == 1


def test_folders_need_one_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n3,4\n")
    with pytest.raises(CheckError, match="different headers"):
        read_csv(spark, str(tmp_path))


def test_line_breaks_are_a_matter_of_each_file(spark, tmp_path):
    (tmp_path / "1.csv").write_text('a,b\n5" pipe,2\nx"y,"3"\n')
    (tmp_path / "2.csv").write_text('a,b\n"l\nm",4\n')
    assert [f.rsplit("/", 1)[1] for f in survey(spark, str(tmp_path)).broken] == ["2.csv"]
    rows = sorted(tuple(r) for r in read_csv(spark, str(tmp_path)).collect())
    assert rows == [('5" pipe', "2"), ("l\nm", "4"), ('x"y', "3")]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_history_times_are_utc(spark, tmp_path, monkeypatch, zone):
    import datetime as dt
    import time

    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        history = History(spark, str(tmp_path / "h"), enabled=True)
        history.save([{"dataset": "a"}], "x")
        summary = "'b' dataset, 1L row_count, 1.0D score, 'A' grade, 0L errors, 0L warnings, 0L rules_failed"
        history.append(spark.range(3).selectExpr(*summary.split(", ")), "y")
        history.save([{"dataset": "c"}], "x")
        rows = history.records().selectExpr("id", "dataset", "unix_timestamp(created_at) s").orderBy("id").collect()
        assert [r.dataset for r in rows] == ["a", "b", "b", "b", "c"] and len({r.id for r in rows}) == 5
        now = dt.datetime.now(dt.timezone.utc).timestamp()
        assert all(abs(r.s - now) < 120 for r in rows)
    finally:
        monkeypatch.undo()
        time.tzset()


def test_checks_leave_no_intermediates(spark, tmp_path, folder):
    from soundrows.session import checkpoint_dir

    def folders():
        import os

        root = checkpoint_dir(spark).removeprefix("file:")
        return {f for f in os.listdir(root) if f.startswith("soundrows-")}

    before = folders()
    Checker(spark).audit_folder(str(folder))
    Checker(spark).check_csv(f"{folder}/departments.csv")
    assert folders() == before


# -- records across block borders ---------------------------------------------------
def python_rows(path):
    import csv

    with open(path, newline="", encoding="utf-8-sig") as file:
        rows = [r for r in csv.reader(file) if r and (len(r) > 1 or r[0].strip())]
    return rows[0], sorted(tuple(c or None for c in r) for r in rows[1:])


@pytest.mark.parametrize("block, end", [(150, "\n"), (150, "\r\n"), (2500, "\n")])
def test_line_breaks_at_every_block_border(spark, tmp_path, end, block):
    """Cells longer than blocks, quotes at borders, blank lines inside and outside cells."""
    import random

    draw = random.Random(block)
    pieces = ["a", "b c", ",", '""', end, end * 2, '"",""', "long " * 60, "é", "1"]
    lines = ["\ufeffid,note,more"]
    for i in range(80):
        note = "".join(draw.choice(pieces) for _ in range(draw.randrange(6)))
        lines.append(f'{i},"{note}",' + draw.choice(["x", '"y"', f'"z{end}"', "", 'p"q']))
        if draw.random() < 0.1:
            lines.append("")
    path = tmp_path / "t.csv"
    path.write_bytes(end.join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        table = stage_csv(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    header, rows = python_rows(path)
    assert table.columns[:3] == header == ["id", "note", "more"]
    assert sorted(tuple(r)[:3] for r in table.collect()) == rows
    by_place = table.orderBy("_src_file", "_src_block", "_src_seq").collect()
    assert [int(r.id) for r in by_place] == list(range(80))


def test_headers_over_many_lines(spark, tmp_path):
    header = '"a' + "\n" * 250 + 'z",b'
    for name in ("1.csv", "2.csv"):
        (tmp_path / name).write_text(f'{header}\n1,"x\ny"\n')
    names = ["a" + "\n" * 250 + "z", "b"]
    assert header_names(spark, str(tmp_path)) == names
    assert read_csv(spark, str(tmp_path), strip_header=False, multi_line=True).columns == names
    assert [tuple(r) for r in read_csv(spark, str(tmp_path)).collect()] == [("1", "x\ny")] * 2
    (tmp_path / "2.csv").write_text(header.replace("z", "y") + "\n1,2\n")
    with pytest.raises(CheckError, match="different headers"):
        read_csv(spark, str(tmp_path))


def test_cells_that_are_never_closed_and_lone_carriage_returns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\n2,y\n')
    assert [tuple(r) for r in read_csv(spark, str(path)).collect()][0][1].startswith("x\n2,y")
    path.write_bytes(b'a,b\r1,"x\ry"\r2,z\r')
    assert sorted(tuple(r) for r in read_csv(spark, str(path)).collect()) == [("1", "x\ny"), ("2", "z")]


def test_surplus_cells_over_several_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\ny",3\n')
    with pytest.raises(Exception, match="expected 2 fields, saw more"):
        read_csv(spark, str(path)).collect()


def test_checks_in_threads_keep_their_own_intermediates(spark, tmp_path):
    """The check that ends first removes nothing of the other one."""
    import threading
    from concurrent.futures import ThreadPoolExecutor

    from soundrows.session import scratch_path, tidy

    (tmp_path / "departments.csv").write_text(DEPARTMENTS)
    begun, ended = threading.Event(), threading.Event()

    def slow():
        with tidy(spark):
            path = scratch_path(spark, "slow")
            spark.range(3).write.parquet(path)
            begun.set()
            ended.wait(120)
            return spark.read.parquet(path).count(), path

    def quick():
        begun.wait(120)
        result = Checker(spark).check_csv(str(tmp_path / "departments.csv"))
        ended.set()
        return result["row_count"]

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.submit(slow), pool.submit(quick)
        assert second.result() > 0
        count, path = first.result()
    assert count == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
