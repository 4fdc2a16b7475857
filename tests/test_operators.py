"""Operators against small brute-force versions, and plan checks."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cobaltmill.functions import vocab
from cobaltmill.operators import (
    charts, chunking, cleaning, fuzzy, headers, identities, payments, retrieval, tokens, usage,
)
from cobaltmill.operators.ordering import locf, occurrence_number
from cobaltmill.operators.profile import id_profile, name_hint
from cobaltmill.plans.analysis import UnknownColumn, find_column, run_spec
from cobaltmill.plans.clean import clean_table
from cobaltmill.session import fresh_path
from cobaltmill.sources import files, raw, sinks

BASE = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- order-dependent operators ------------------------------------------------------------------

@pytest.mark.parametrize("bits, levels", [(1, 2), (2, 2), (3, 3), (20, 2)])
def test_locf_does_not_depend_on_blocks(spark, bits, levels):
    rng = random.Random(bits)
    rows = [(i * 3, rng.choice([None, None, None, i]), rng.choice([None, f"t{i}"]), "hot" if i % 3 else "b")
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, n long, s string, g string").repartition(5)
    for keys in ([], ["g"]):
        seen, expected = defaultdict(lambda: [None, None]), {}
        for i, n, s, g in rows:
            last = seen[g if keys else 0]
            last[0] = n if n is not None else last[0]
            last[1] = s if s is not None else last[1]
            expected[i] = tuple(last)
        got = locf(df, "id", ["n", "s"], keys, bits, levels).collect()
        assert {r["id"]: (r["n"], r["s"]) for r in got} == expected


@pytest.mark.parametrize("bits, levels", [(1, 2), (3, 3), (20, 2)])
def test_occurrence_number(spark, bits, levels):
    rows = [(i * 2, "hot" if i % 3 else f"k{i % 5}") for i in range(150)]
    seen, expected = defaultdict(int), {}
    for i, k in rows:
        seen[k] += 1
        expected[i] = seen[k]
    df = spark.createDataFrame(rows, "id long, k string").repartition(4)
    got = occurrence_number(df, "id", ["k"], "n", bits, levels).collect()
    assert {r["id"]: r["n"] for r in got} == expected


def test_locf_moves_no_rows_to_one_task(spark):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 7 == 0, F.col("id")))
    text = plan(locf(df, "id", ["v"]))
    # The only single partition is the one under the top carry table.
    assert text.count("SinglePartition") == 1


def test_first_n_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    from cobaltmill.operators.ordering import first_n

    assert "WindowGroupLimit" in plan(first_n(df, ["k"], [F.col("id")], 3))


# --- headers, delimiters, catalogs --------------------------------------------------------------

def test_dedupe_headers(spark):
    names = ["Valor", "  ", "Valor", "nan", "Valor", "Total  neto"]
    rows = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file string, idx long, name string")
    got = [r["column"] for r in headers.dedupe_headers(rows).orderBy("idx").collect()]
    assert got == ["Valor", "col_2", "Valor_2", "col_4", "Valor_3", "Total neto"]
    names = ["a", "a", "a_2", "a", "a_2", "a_4"]
    rows = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file string, idx long, name string")
    got = [r["column"] for r in headers.dedupe_headers(rows).orderBy("idx").collect()]
    assert got == ["a", "a_3", "a_2", "a_5", "a_2_2", "a_4"]


def test_failed_dates_are_not_blanks(spark):
    df = spark.createDataFrame([("2024-01-02",), ("soon",), (" ",), (None,)], "d string")
    assert tuple(cleaning.date_failures(df, ["d"]).first()) == ("d", 2, 1)


def test_binaries_are_no_text(spark):
    rows = [("a.csv", b"MZ\x90\x00\x03"), ("b.txt", b"\x89PNG\r\n\x1a\n"), ("c.docx", b"PK\x03\x04 plain"), ("d.xlsx", b"PK\x03\x04 plain"),
            ("e.docx", b"PK\x03\x04 word/document.xml"), ("f.txt", b"\x00\x01\x02"), ("g.txt", "año".encode("latin-1")), ("h.csv", b"a,b\n1,2")]
    got = {r["path"]: r["mime_ok"] for r in files.upload_check(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.csv": False, "b.txt": False, "c.docx": False, "d.xlsx": True, "e.docx": True, "f.txt": False, "g.txt": True, "h.csv": True}


def test_delimiter_threshold(spark):
    rows = [(i, f"a{i}|b" if i < 60 else "x", f"a;{i}" if i < 59 else "x") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, yes string, no string")
    assert cleaning.shape(df, ["yes", "no"]).columns == ["row_id", "yes_p0", "yes_p1", "no"]


def test_split_header_names(spark):
    df = spark.createDataFrame([(i, "1|2") for i in range(4)], "row_id long, `peso|valor` string")
    assert cleaning.shape(df, ["peso|valor"]).columns == ["row_id", "peso", "valor"]
    clash = df.withColumn("valor", F.lit("x"))
    assert cleaning.shape(clash, ["peso|valor", "valor"]).columns == [
        "row_id", "peso|valor_p0", "peso|valor_p1", "valor"]


def test_name_hints():
    assert name_hint("unit price", ("nit",)) and not name_hint("unit price", ("nit",), "token")
    assert name_hint("NIT-cliente", ("nit",), "token") and name_hint("valor US$", ("us$",), "token")
    assert name_hint("Costos", ("costo",)) and not name_hint("Costos", ("costo",), "token")


def test_id_profile(spark):
    rows = [("900.123.456-7", "a")] * 7 + [("x", "b")] * 3
    found = id_profile(spark.createDataFrame(rows, "c string, d string"), ["c", "d"]).collect()
    assert {r["column"]: r["is_id"] for r in found} == {"c": True, "d": False}


@pytest.mark.parametrize("scorer", ["levenshtein", "ratio"])
def test_harmonize(spark, scorer):
    values = ["bogotá", "MEDELLlN", "Santa  Marta", "nada que ver", None, "BARRANQUILA", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, ciudad string")
    got = {r["id"]: r["ciudad"] for r in fuzzy.harmonize(df, "ciudad", "ciudades", scorer).collect()}
    assert got == {0: "BOGOTA", 1: "MEDELLIN", 2: "SANTA MARTA", 3: "nada que ver", 4: None, 5: "BARRANQUILLA", 6: ""}


def test_ratio_counts_letters_in_common_order(spark):
    def common(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            last = list(best)
            for j, y in enumerate(b):
                best[j + 1] = last[j] + 1 if x == y else max(best[j], last[j + 1])
        return best[-1]

    values = ["CLI", "IBAGE", "NEVA", "ILAC", "", "BUCARAMANGA", "x", "SANTAMARTA", "BARRANCABERMEJAAA", "éñ"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: (r["term"], r["score"]) for r in fuzzy.best_terms(rows, "v", "ciudades").collect()}
    for v in values:
        key = {"x": "X", "éñ": "EN"}.get(v, v)
        scores = [200 * common(key, t) // (len(key) + len(t)) for t in vocab.CATALOGS["ciudades"]]
        top = max(range(len(scores)), key=lambda i: (scores[i], -i))
        assert got[v] == ((vocab.CATALOGS["ciudades"][top], scores[top]) if v else (None, None))
    assert [got[v][1] for v in values[:3]] == [85, 90, 88] and got["ILAC"][1] < 85


def test_clean_table_from_files(spark):
    folder = fresh_path(spark, "messy")
    lines = [
        "DIAN reporte 900123456-7;;;;;", "Periodo 2024;;;;;", "Fecha;NIT;Ciudad;Valor COP;Flete;Valor COP",
        "05/03/2024;900.111.222-3;Bogotá;1.500;;9", ";;;;;", ";800.111.222-3;medelin;;20;8",
        'mal;800.111.222-1;"Cali; Valle";2.500,50;;', "06/03/2024;801.111.222-1;CALI;3.000;7;1",
    ]
    from pathlib import Path

    path = Path(folder.removeprefix("file:"))
    path.mkdir(parents=True)
    (path / "export.csv").write_bytes("\n".join(lines).encode("latin-1"))
    scanned = raw.raw_scan(spark, folder)
    assert {r["encoding"] for r in scanned.collect()} == {"iso-8859-1"}
    done = clean_table(scanned)
    assert (done.header_row, done.metadata_text) == (2, "DIAN reporte 900123456-7\nPeriodo 2024")
    assert done.columns == ["Fecha", "NIT", "Ciudad", "Valor COP", "Flete", "Valor COP_2"]
    rows = [tuple(r)[1:] for r in done.table.orderBy("row_id").collect()]
    day = dt.datetime(2024, 3, 5)
    assert rows == [
        (3, day, "900111222", "BOGOTA", 1500.0, 0.0, 9.0), (5, day, "800111222", "MEDELLIN", 1500.0, 20.0, 8.0),
        (6, day, "800111222", "Cali; Valle", 2500.5, 0.0, 8.0), (7, dt.datetime(2024, 3, 6), "801111222", "CALI", 3000.0, 7.0, 1.0),
    ]
    first = done.preview(1).first()
    assert first["document_metadata"]["nit_declarante"] == "900123456-7" and first["header_row"] == 2


def test_clean_files_with_their_own_headers(spark):
    from cobaltmill.plans.clean import clean_files

    rows = [("a", 0, ["Fecha", "NIT", "Valor"]), ("a", 1, ["01/02/2024", "900.111.222-3", "5"]), ("a", 2, [None, "900.111.222-3", None]),
            ("b", 0, ["informe DIAN", None, None]), ("b", 1, ["Fecha", "NIT", "Valor"]), ("b", 2, ["", "800.111.222-3", "7"]), ("b", 3, ["03/02/2024", "800.111.222-3", None]),
            ("c", 0, ["Ciudad", "Valor", "Valor"]), ("c", 1, ["cli", "1", "2"])]
    raw_rows = spark.createDataFrame(rows, "file string, row_id long, cells array<string>")
    done = clean_files(raw_rows)
    assert [d.columns for d in done] == [["Fecha", "NIT", "Valor"], ["Ciudad", "Valor", "Valor_2"]]
    day = dt.datetime(2024, 2, 1)
    assert [tuple(r) for r in done[0].table.orderBy("file", "row_id").collect()] == [
        ("a", 1, day, "900111222", 5.0), ("a", 2, day, "900111222", 5.0), ("b", 2, None, "800111222", 7.0),
        ("b", 3, dt.datetime(2024, 2, 3), "800111222", 7.0)]
    assert [tuple(r)[2:] for r in done[1].table.collect()] == [("CALI", 1.0, 2.0)]
    lead = clean_files(raw_rows, lead=2)[0]
    assert lead.typed.count() == 2 and lead.columns == done[0].columns
    shown = [c for c in done[0].preview(2).columns if c != "document_metadata"]
    assert lead.preview(2).select(shown).collect() == done[0].preview(2).select(shown).collect()
    assert {(r["file"], r["header_row"], r["metadata_text"]) for r in done[0].files.collect()} == {("a", 0, ""), ("b", 1, "informe DIAN")}
    with pytest.raises(ValueError, match="different headers"):
        clean_table(raw_rows)


def test_clean_table_without_data(spark):
    schema = "file string, row_id long, cells array<string>"
    empty = clean_table(spark.createDataFrame([], schema))
    assert empty.columns == [] and empty.table.count() == 0
    only_header = clean_table(spark.createDataFrame([("f", 0, ["Fecha", "NIT"])], schema))
    assert only_header.columns == [] and only_header.table.count() == 0


def _lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = list(best)
        for j, y in enumerate(b):
            best[j + 1] = last[j] + 1 if x == y else max(best[j], last[j + 1])
    return best[-1]


def _plain_ratio(a, b):
    return _lcs(a, b) * 200 / (len(a) + len(b))


def _plain_window(a, b):
    def one(short, long):
        n, m = len(short), len(long)
        return max(_plain_ratio(short, long[max(0, i):min(m, i + n)]) for i in range(1 - n, m))
    return max(one(a, b) if len(a) <= len(b) else 0, one(b, a) if len(a) >= len(b) else 0)


def _plain_weighted(a, b):
    x, y = set(a.split()), set(b.split())
    sorted_a, sorted_b = (" ".join(sorted(t.split())) for t in (a, b))
    both, own, other = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    if both and not (own and other):
        by_set = 100
    else:
        front = both + " " if both else ""
        by_set = 100 - (len(own) + len(other) - 2 * _lcs(own, other)) * 100 / (2 * len(front) + len(own) + len(other))
        if both:
            by_set = max(by_set, *(_plain_ratio(both, front + rest) for rest in (own, other)))
    short, long = sorted((len(a), len(b)))
    if long * 2 < short * 3:
        return max(_plain_ratio(a, b), 0.95 * max(_plain_ratio(sorted_a, sorted_b), by_set))
    scale = 0.9 if long <= short * 8 else 0.6
    by_words = 100 if both else max(_plain_window(sorted_a, sorted_b), _plain_window(own, other))
    return max(_plain_ratio(a, b), scale * _plain_window(a, b), 0.95 * scale * by_words)


@pytest.mark.parametrize("catalog", ["ciudades", "bancos"])
def test_weighted_scorer_equals_plain_ratios(spark, catalog):
    rng, terms = random.Random(7), vocab.CATALOGS[catalog]
    values = ["", " ", "A", "de", "D C BOGOTA", "BOGOTA BOGOTA", "CLI", "marta santa", "x" * 90]
    for term in terms:
        words = term.split()
        values += [" ".join(words[::-1]), "CIUDAD DE " + term.lower() + " (COLOMBIA)", term[:4], term[2:] + "  " + term[:2],
                   "".join(rng.choice("ABEOR ") for _ in range(rng.randrange(1, 30))), words[0] + " " + words[0]]
    values = sorted(set(values))
    got = fuzzy.best_terms(spark.createDataFrame([(v,) for v in values], "v string"), "v", catalog, "weighted").collect()
    assert len(got) == len(values)
    for r in got:
        key = r["v"].strip().upper()
        if not key:
            assert r["term"] is None
            continue
        scores = {t: _plain_weighted(key, t) for t in terms}
        top = max(scores.values())
        assert abs(r["score"] - top) < 1 + 1e-9 and r["score"] <= top + 1e-9, (key, r, top)
        assert scores[r["term"]] >= top - 1e-9, (key, r, top)


def test_weighted_scorer_takes_many_values_at_once(spark):
    import time

    values = spark.range(20_000).select(F.format_string("Customer#%09d", F.col("id") * 7).alias("v"))
    fuzzy.best_terms(values.limit(10), "v", "ciudades", "weighted").collect()
    started = time.monotonic()
    got = fuzzy.best_terms(values, "v", "ciudades", "weighted").collect()
    assert time.monotonic() - started < 25 and len(got) == 20_000  # minutes, window by window
    for r in got[:3]:
        top = max(_plain_weighted(r["v"].upper(), t) for t in vocab.CATALOGS["ciudades"])
        assert abs(r["score"] - top) < 1 + 1e-9 and abs(_plain_weighted(r["v"].upper(), r["term"]) - top) < 1e-9
    # other columns and a column that is scored in place
    rows = spark.createDataFrame([(1, "cali (CALI)"), (2, None), (3, "zzz"), (4, "")], "k int, v string")
    assert dict(fuzzy.harmonize(rows, "v", "ciudades", "weighted").collect()) == {1: "CALI", 2: None, 3: "zzz", 4: ""}


def test_separators_inside_quotes_do_not_decide(spark):
    from pathlib import Path

    path = Path(fresh_path(spark, "quoted").removeprefix("file:"))
    path.mkdir(parents=True)
    (path / "q.csv").write_text("a;b\n" + "".join(f'{i};"1,2,3,{i}"\n' for i in range(50)) + 'x;a"b\n')
    rows = {r["row_id"]: r["cells"] for r in raw.raw_scan(spark, str(path)).collect()}
    assert rows[0] == ["a", "b"] and rows[7] == ["6", "1,2,3,6"]


def test_raw_scan_of_many_files(spark):
    from pathlib import Path

    path = Path(fresh_path(spark, "mixed").removeprefix("file:"))
    path.mkdir(parents=True)
    (path / "a.csv").write_text('a,b,c\n1,"x,y",3\n')
    (path / "b.csv").write_text("p|q\nñ|2\n")
    got = {(r["file"][-5:], r["row_id"]): (r["cells"], r["encoding"]) for r in raw.raw_scan(spark, str(path)).collect()}
    assert got[("a.csv", 1)] == (["1", "x,y", "3"], "utf-8")
    assert got[("b.csv", 1)][0] == ["ñ", "2"]


def test_cells_of_a_line(spark):
    lines = {'a;"b;""c""";;d': ["a", 'b;"c"', None, "d"], ";x;": [None, "x", None], '""': [""], "": [None], '"a;b': ['"a', "b"],
             "|a|": ["|a|"], 'x"y;z': ['x"y', "z"]}
    for line, cells in lines.items():
        df = spark.createDataFrame([(line,)], "l string")
        assert df.select(raw.split_cells(F.col("l"), F.lit(";"))).first()[0] == cells, line
    wide = spark.createDataFrame([("," * 100_000,)], "l string")
    assert wide.select(F.size(raw.split_cells(F.col("l"), F.lit(",")))).first()[0] == 100_001


def test_records_over_lines_and_the_callers_encoding(spark):
    from pathlib import Path

    path = Path(fresh_path(spark, "broken").removeprefix("file:"))
    path.mkdir(parents=True)
    (path / "a.csv").write_text('k,v\n1,"two\nlines, ""and\n\nmore"\n2,x\n')
    (path / "b.csv").write_text('1,"y\nz"\n3,4\n')
    got = {(r["file"][-5:], r["row_id"]): r["cells"] for r in raw.raw_scan(spark, str(path), multiline=True).collect()}
    assert sorted(got.values()) == sorted([["k", "v"], ["1", 'two\nlines, "and\n\nmore'], ["2", "x"], ["1", "y\nz"], ["3", "4"]])
    plain = raw.raw_scan(spark, str(path)).count()
    assert plain == 9  # every line is a row, blank ones included
    (path / "c.csv").write_bytes("1,€\n".encode("cp1252"))
    found = raw.raw_scan(spark, str(path / "c.csv"), encoding="windows-1252").first()
    assert (found["cells"], found["encoding"]) == (["1", "€"], "windows-1252")


def test_stray_quote_costs_marked_lines(spark):
    from pathlib import Path

    path = Path(fresh_path(spark, "stray").removeprefix("file:"))
    path.mkdir(parents=True)
    body = ['k,v', '1,"two', 'lines"', '2,12" pipe'] + [f"{i},x" for i in range(3, 200)]
    (path / "a.csv").write_text("\n".join(body) + "\n")
    (path / "b.csv").write_text('5,"a\nb\nc"\n')
    found = raw.raw_scan(spark, str(path), multiline=True, longest=50).orderBy("file", "row_id").collect()
    cells = [(r["cells"], r["stray_quote"]) for r in found]
    assert cells[:3] == [(["k", "v"], False), (["1", "two\nlines"], False), (["2", '12" pipe'], True)]
    assert cells[3:-1] == [([str(i), "x"], True) for i in range(3, 200)]
    assert cells[-1] == (["5", "a\nb\nc"], False)
    whole = raw.raw_scan(spark, str(path), multiline=True).collect()
    assert len(whole) == 4 and not any(r["stray_quote"] for r in whole)


def test_files_and_text(spark):
    from pathlib import Path

    root = Path(fresh_path(spark, "tenants").removeprefix("file:"))
    for name, content in (("7/a.CSV", b"x"), ("7/.b.csv", b"y"), ("8/n.md", b"z"), ("8/t.txt", b"ok \xff")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    listing = files.list_files(spark, str(root))
    got = {r["tenant"]: (r["has_data"], r["n_data"], r["n_other"]) for r in files.file_inventory(listing).collect()}
    assert got == {"7": (True, 1, 0), "8": (True, 0, 1)}  # Spark does not list hidden files
    assert "content" not in plan(listing).split("ReadSchema")[-1]
    assert files.text_scan(spark, str(root / "8/t.txt")).first()["text"] == "ok �"


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_write_records(spark, fmt):
    df = spark.createDataFrame([(1, "a,b", 2.5), (2, None, None)], "i long, s string, d double")
    back = sinks.write_records(df, fresh_path(spark, "w"), fmt)
    assert sorted(map(tuple, back.collect())) == [(1, "a,b", 2.5), (2, None, None)]


# --- charts and specs ---------------------------------------------------------------------------

def test_month_sort(spark):
    def keys(labels):
        df = spark.createDataFrame([(x, 1.0) for x in labels], "label string, value double")
        return {r["label"]: r["sort_key"] for r in charts.bar(df, "label", "value").collect()}

    assert keys(["Marzo", "enero", ""]) == {"Marzo": 3, "enero": 1, "": 99}
    assert keys(["March", "january "]) == {"March": 3, "january ": 1}
    assert keys(["enero", "January", "x"]) == {"enero": None, "January": None, "x": None}


def test_null_groups(spark):
    from cobaltmill.operators.aggregates import group_by

    df = spark.createDataFrame([("a", None), ("b", 2.0), (None, 3.0)], "k string, v double")
    assert [tuple(r) for r in group_by(df, "k", "sum", "v").collect()] == [("a", 0.0), ("b", 2.0)]
    with pytest.raises(ValueError):
        group_by(df, "k", "mode", "v")


def test_corr_with_leading_nulls_and_an_offset(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") >= 1000, 1e9 + F.col("id") % 97).alias("a"), F.when(F.col("id") >= 1000, 2e9 + F.col("id") % 97).alias("b"),
        F.lit(1.0).alias("flat"), F.lit("x").alias("text"))
    got = {(r["row"], r["col"]): r["r"] for r in charts.corr_matrix(df).collect()}
    assert all(abs(got[p] - 1) < 1e-9 for p in (("a", "a"), ("a", "b"), ("b", "a")))
    assert got["flat", "flat"] is None and got["a", "flat"] is None and len(got) == 9
    assert charts.corr_matrix(df.select("text")).count() == 0


def test_corr_with_an_offset_where_the_other_is_null(spark):
    low = (F.col("id") % 101) / 101
    df = spark.range(3000).select(
        F.when(F.col("id") < 1500, low).otherwise(1e9 + F.col("id")).alias("a"),
        F.when(F.col("id") < 1500, low + (F.col("id") % 7) / 70).alias("b"))
    got = {(r["row"], r["col"]): r["r"] for r in charts.corr_matrix(df).collect()}
    pdf = df.dropna().toPandas()
    assert got["a", "b"] == pytest.approx(pdf["a"].corr(pdf["b"]), abs=1e-9) and got["a", "b"] > 0.9


def test_charts_with_many_labels(spark):
    df = spark.range(4500).select(F.format_string("r%04d", (F.col("id") % 1500).cast("int")).alias("r"),
                                  F.format_string("c%d", (F.col("id") % 3).cast("int")).alias("c"), F.col("id").alias("v"))
    cells = charts.heatmap(df, "r", "c", "v")
    assert cells.select("y").distinct().count() == 1500 and cells.agg(F.max("y")).first()[0] == 1499
    flat = charts.stacked(df.filter("id % 7 != 0"), "c", "r", "v")
    assert flat.count() == 4500 and flat.agg(F.sum("value")).first()[0] == df.filter("id % 7 != 0").agg(F.sum("v")).first()[0]


def test_text_values_count_as_zero(spark):
    df = spark.createDataFrame([("a", "3"), ("b", "n/d"), ("c", None)], "k string, v string")
    assert {r["label"]: r["value"] for r in charts.bar(df, "k", "v").collect()} == {"a": 3.0, "b": 0.0, "c": 0.0}


def test_option_in_calendar_order_and_in_blocks(spark):
    import json

    df = spark.createDataFrame([("marzo", 3), ("abril", 4), ("enero", 1), ("diciembre", 12)], "m string, v long")
    spec = json.loads(charts.option_json(charts.bar(df, "m", "v"), "bar", "t").first()["spec"])
    assert spec["xAxis"]["data"] == ["enero", "marzo", "abril", "diciembre"] and spec["series"][0]["data"] == [1, 3, 4, 12]
    many = spark.range(2500).select(F.format_string("%05d", F.col("id")).alias("label"), F.col("id").alias("value"))
    rows = charts.option_json(many, "bar", "t").orderBy("block").collect()
    assert [r["block"] for r in rows] == [0, 1, 2]
    assert sum((json.loads(r["spec"])["xAxis"]["data"] for r in rows), []) == [f"{i:05d}" for i in range(2500)]


def test_overlong_prefixes_stay_apart(spark):
    from cobaltmill.operators import prefix_batch

    rows = [("s", "4000000012345678"), ("s", "4000000099999999"), ("s", "400000001"), ("s", " 40000000 "), ("s", "40000000"), ("s", None)]
    read = prefix_batch.classify(prefix_batch.normalise(spark.createDataFrame(rows, "store_id string, prefix string")))
    got = sorted((r["prefix"] or "", r["overlong"], r["validation_level"]) for r in read.collect())
    assert got == [("", False, "LOW"), ("", True, "LOW"), ("", True, "LOW"), ("", True, "LOW"), ("40000000", False, got[-1][2])]
    assert got[-1][2] != "LOW"
    total = prefix_batch.store_summary(read).agg(F.sum("prefix_count")).first()[0]
    assert total == 4


def test_corr_does_not_depend_on_batches(spark):
    from cobaltmill.operators import comoments
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6))
    x[:, 1] += x[:, 0] * 2 + 1e8
    x[:, 2] = np.where(rng.random(700) < .5, x[:, 0] + 1e9, -x[:, 0])  # two far levels
    x[:, 3] = 0.1
    x[rng.random(x.shape) < .2] = np.nan
    x[:300, 4] = np.nan
    states = [comoments.batch_state(x[a:a + n]) for n in (700, 13, 1) for a in range(0, 700, n)]
    whole, cut, single = states[0], states[1:1 + 54], states[55:]
    pairs = {}
    for name, parts in (("whole", [whole]), ("cut", cut), ("single", single)):
        total = np.zeros_like(whole)
        for part in parts:
            total = comoments.merged(total, part)
        pairs[name] = total
    for i in range(6):
        for j in range(6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i] - x[both, i].mean(), x[both, j] - x[both, j].mean()
            for state in pairs.values():
                assert state[0, i, j] == both.sum()
                assert state[3, i, j] == pytest.approx(a @ b, rel=1e-6, abs=1e-20 + 1e-6 * np.sqrt((a @ a) * (b @ b)))
                assert state[2, i, j] == pytest.approx(a @ a, rel=1e-6, abs=1e-20)


def test_corr_of_200_columns(spark):
    cols = [(F.hash("id", F.lit(i // 2)) % 1000 + (F.hash("id", F.lit(1000 + i)) % 300)).cast("double").alias(f"c{i}") for i in range(200)]
    got = charts.corr_matrix(spark.range(0, 4000, 1, 300).select(*cols)).collect()  # 300 tasks: two levels of merging
    assert len(got) == 40_000
    by = {(r["row"], r["col"]): r["r"] for r in got}
    assert by["c4", "c4"] == pytest.approx(1) and by["c4", "c5"] > 0.8 and abs(by["c4", "c9"]) < 0.1
    assert all(by[b, a] == pytest.approx(v) for (a, b), v in by.items())


def test_premium_periods(spark):
    rng = random.Random(6)
    users = ["hot"] * 12 + ["a", "b", "never", None]
    changes = [(rng.choice(users[:-2] + [None]), BASE + dt.timedelta(minutes=10 * rng.randrange(500)), i, rng.random() < .5)
               for i in range(60)]
    events = [(i, rng.choice(users), BASE + dt.timedelta(minutes=5 * rng.randrange(-100, 1100))) for i in range(400)]
    events.append((1000, "hot", None))
    c = spark.createDataFrame(changes, "user_id string, ts timestamp, change_id long, active boolean")
    e = spark.createDataFrame(events, "event_id long, user_id string, ts timestamp")
    for bits in (33, 40, 28):
        got = {r["event_id"]: (r["is_premium"], r["since"]) for r in usage.premium_by_periods(e, c, bits).collect()}
        assert len(got) == len(events)
        for i, user, ts in events:
            past = [x for x in changes if x[0] == user and user is not None and ts is not None and x[1] <= ts]
            last = max(past, key=lambda x: (x[1], x[2]), default=None)
            assert got[i] == ((last[3], last[1]) if last else (False, None))
    assert len({x[1] for x in changes if x[0] == "hot"}) > 3


def test_corr_is_pairwise_complete(spark):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1.0, 2, None, 4, 5], "b": [2.0, 1, 4, None, 5], "c": [5.0, 3, 2, 2, 1]})
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    got = charts.corr_matrix(spark.createDataFrame(rows, "a double, b double, c double")).collect()
    for r in got:
        assert r["r"] == pytest.approx(pdf.corr().loc[r["row"], r["col"]])


def test_spec_columns():
    assert find_column("TOTAL", ["total", "n"]) == "total"
    replaced = {}
    assert find_column("Totl", ["total", "n"], replaced) == "total" and replaced == {"Totl": "total"}
    with pytest.raises(UnknownColumn, match="did you mean 'total'"):
        find_column("Totl", ["total", "n"])
    with pytest.raises(UnknownColumn, match="total, n"):
        find_column("weather", ["total", "n"], {})


def test_spec_joins_and_filters_after_grouping(spark):
    sales = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1), (4, None, 9), (5, "z", 2)], "id long, k string, v long")
    names = spark.createDataFrame([("a", "Ana"), ("b", "Bo")], "k string, name string")
    spec = {"source": "sales", "joins": [{"table": "names", "on": [["k", "k"]], "how": "left"}],
            "filters": [{"column": "name", "op": "is not null"}, {"column": "v", "op": "between", "value": [1, 8]}],
            "group_by": ["name"], "metrics": [{"column": "id", "agg": "distinct", "name": "n"}, {"column": "v", "agg": "median", "name": "m"}],
            "having": [{"column": "n", "op": ">=", "value": 2}]}
    assert [tuple(r) for r in run_spec({"sales": sales, "names": names}, spec).collect()] == [("Ana", 2, 6.0)]
    spec |= {"filters": [{"column": "name", "op": "is null"}], "group_by": ["k"], "having": []}
    assert [tuple(r) for r in run_spec({"sales": sales, "names": names}, spec).collect()] == [("z", 1, 2.0)]


def test_spec_filters(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v long")
    out = run_spec(df, {
        "derive": {"w": "v * 10"}, "filters": [{"column": "v", "op": ">", "value": 1}], "group_by": ["k"],
        "metrics": [{"column": "w", "agg": "sum", "name": "s"}], "order_by": [{"column": "s", "descending": True}], "limit": 1,
    })
    assert [tuple(r) for r in out.collect()] == [("b", 50)]


# --- text and vectors ---------------------------------------------------------------------------

@pytest.mark.parametrize("length, n", [(0, 0), (1300, 1), (1301, 2), (1500, 2), (1501, 2), (3000, 3)])
def test_chunk_counts(spark, length, n):
    df = spark.createDataFrame([(1, "x" * length)], "doc_id long, text string")
    assert chunking.chunk_text(df, "doc_id", "text").count() == n


def test_chunks_cover_the_text(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abc. \n") for _ in range(9000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "\n" + "y" * 1600)], "doc_id long, text string")
    chunks = chunking.chunk_text(df, "doc_id", "text").orderBy("doc_id", "chunk_index").collect()
    position = 0
    for r in (r for r in chunks if r["doc_id"] == 1):
        found = text.find(r["chunk"], max(0, position - 1600))
        assert found >= 0 and not text[position:found].strip()
        position = max(position, found + len(r["chunk"]))
    assert not text[position:].strip()
    assert not any(r["doc_id"] == 2 for r in chunks)


def plain_chunks(text, size=1500, overlap=200):
    """The rule, by hand: (chunk, is_tail) of the pieces that aren't blank."""
    text, at, covered, out = text.strip(), 0, 0, []
    while at < len(text):
        window, took = text[at:at + size + 1], size
        if len(text) - at > size:
            feed, stop = window.rfind("\n"), window.rfind(". ")
            took = feed + 1 if feed >= 0 else stop + 1 if stop >= 0 else size
        if text[at:at + took].strip():
            out.append((text[at:at + took].strip(), covered >= len(text)))
        covered = max(covered, at + took)
        at += took - overlap if took > overlap else took
    return out


@pytest.mark.parametrize("line", [1, 199, 200, 201, 202, 1299, 1300, 1301, 1499, 1500, 1501, 1502, 1503])
def test_no_end_is_lost(spark, line):
    rng = random.Random(line)
    texts = ["\n".join("x" * line for _ in range(max(3, 60000 // line))), ". ".join("yé" * (line // 2 + 1) for _ in range(60)),
             "".join(rng.choice(["z" * line, "\n", ". ", "\n" + "q" * 200, " " * 300]) for _ in range(80))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = chunking.chunk_text(df, "doc_id", "text").orderBy("doc_id", "chunk_index").collect()
    for i, text in enumerate(texts):
        own = [r for r in got if r["doc_id"] == i]
        assert [(r["chunk"], r["is_tail"]) for r in own] == plain_chunks(text)
        assert [r["chunk_index"] for r in own] == list(range(len(own)))


def test_small_windows_of_chunks(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab. \n") for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((10, 3), (7, 5), (25, 12)):
        got = chunking.chunk_text(df, "doc_id", "text", size, overlap).orderBy("doc_id", "chunk_index").collect()
        assert [(r["doc_id"], r["chunk"], r["is_tail"]) for r in got] == [
            (i, *c) for i, t in enumerate(texts) for c in plain_chunks(t, size, overlap)]


def test_chunks_of_a_long_text(spark):
    text = "".join("word " * 50 + ("\n" if i % 7 else ". ") for i in range(4000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = chunking.chunk_text(df, "doc_id", "text").orderBy("chunk_index").collect()
    assert len(text) > 1_000_000 and [(r["chunk"], r["is_tail"]) for r in got] == plain_chunks(text)


def test_messages_lose_nothing(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a" * 1999, "b" * 17, "\n", " " * 5000, "\n" * 30, "é" * 4200]) for _ in range(25)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = chunking.split_message(df, "doc_id", "text").orderBy("doc_id", "chunk_index").collect()
    size = vocab.MESSAGE_LIMIT
    for i, text in enumerate(texts):
        rest, want = text.strip(), []
        while rest:
            feed = rest[:size].rfind("\n") + 1
            took = len(rest) if len(rest) <= size else feed if feed > size // 2 + 1 else size
            want.append(rest[:took])
            rest = rest[took:].lstrip()
        assert [r["chunk"] for r in got if r["doc_id"] == i] == want


def test_split_message(spark):
    df = spark.createDataFrame([(1, "a" * 3000 + "\n" + "b" * 2000)], "doc_id long, text string")
    assert [len(r["chunk"]) for r in chunking.split_message(df, "doc_id", "text").orderBy("chunk_index").collect()] == [3001, 2000]


def test_cosine_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 30)
    monkeypatch.setattr(retrieval, "PART_ROWS", 40)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[10] = 0
    vectors[50:60] = vectors[49]
    index = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)],
                                  "vec_id long, embedding array<float>, tenant int").repartition(7)
    queries = spark.createDataFrame([(q, [float(x) for x in vectors[q]]) for q in (0, 10, 49, 70, 71)],
                                    "query_id long, vector array<double>")
    got = defaultdict(list)
    for r in retrieval.cosine_topk(index, queries, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    singles = vectors.astype(np.float32).astype(float)
    norms = np.linalg.norm(singles, axis=1)
    for q in (0, 10, 49, 70, 71):
        scores = [0.0 if norms[i] == 0 or norms[q] == 0 else
                  round(float(singles[i] @ vectors[q] / norms[i] / np.linalg.norm(vectors[q])), 9) for i in range(300)]
        assert got[q] == sorted(range(300), key=lambda i: (-scores[i], i))[:5]


def test_tenants_search_their_own_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 16)
    monkeypatch.setattr(retrieval, "PART_ROWS", 25)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        tenant = "hot" if i % 3 else [None, "a", "b", "never asks"][i // 3 % 4]
        vector = [float(x) for x in rng.integers(-2, 3, 3 if i % 5 else 4)]
        rows.append((i, tenant, [None, [], [float("nan"), 1.0, 1.0], [None, 1.0, 2.0]][i % 4] if i % 41 == 7 else vector))
    asked = [(1000 + i, t, v) for i, t, v in rows if t != "never asks" and i % 4 == 1]
    asked += [(1500, "nobody", [1.0, 2.0, 3.0]), (1501, "a", None)]
    got = retrieval.tenant_topk(
        spark.createDataFrame(rows, "vec_id long, tenant string, embedding array<float>").repartition(5),
        spark.createDataFrame(asked, "query_id long, tenant string, vector array<double>"), "tenant", 4)

    def sound(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v)

    expected = {}
    for q, tenant, vector in asked:
        scores = []
        for i, t, v in rows:
            if t is not None and t == tenant and sound(v) and sound(vector) and len(v) == len(vector):
                norm = np.linalg.norm(v) * np.linalg.norm(vector)
                scores.append((-round(float(np.dot(v, vector) / norm), 6) + 0.0 if norm else 0.0, i))
        for rank, (score, i) in enumerate(sorted(scores)[:4], 1):
            expected[q, rank] = (tenant, -score)
    found = got.collect()
    assert {(r["query_id"], r["rank"]): (r["tenant"], round(r["score"], 6)) for r in found} == expected
    assert len({(r["query_id"], r["vec_id"]) for r in found}) == len(found)


# --- quota, tokens, identities, payments --------------------------------------------------------

def _quota_rows(n=400):
    rng = random.Random(11)
    return [(i, 1 if rng.random() < 0.4 else rng.randrange(6), BASE + dt.timedelta(minutes=rng.randrange(6000))) for i in range(n)]


def _quota_expected(rows, paid, limit):
    used, out = defaultdict(int), {}
    for i, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        day = (ts - dt.timedelta(hours=5)).date()
        if user in paid and ts >= paid[user]:
            out[i] = "premium"
        elif used[user, day] < limit:
            used[user, day] += 1
            out[i] = "admitted"
        else:
            out[i] = "refused"
    return out


def test_daily_quota(spark):
    rows, paid = _quota_rows(), {2: BASE + dt.timedelta(days=2)}
    messages = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    since = usage.premium_since(spark.createDataFrame(list(paid.items()), "user_id long, ts timestamp_ntz"))
    got = {r["event_id"]: r["outcome"] for r in usage.daily_quota(messages, since, 4).collect()}
    assert got == _quota_expected(rows, paid, 4)


def test_identity_links(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(12), f" M{rng.randrange(10)}@X.co", BASE + dt.timedelta(minutes=i // 2), i) for i in range(200)]
    users = {}  # one user per key: [chat, email]
    for chat, email, _, i in rows:
        email = email.strip().lower()
        owner = next((u for u in users.values() if u[1] == email), None)
        mine = next((k for k, u in users.items() if u[0] == chat), None)
        if owner is not None:
            if owner[0] != chat:
                users = {k: u for k, u in users.items() if u[0] != chat or u is owner}
                owner[0] = chat
        elif mine is not None:
            users[mine][1] = email
        else:
            users[i] = [chat, email]
    df = spark.createDataFrame(rows, "chat_id long, email string, ts timestamp_ntz, event_id long")
    got = {(r["chat_id"], r["email"]) for r in usage.identity_links(df).collect()}
    assert got == {(c, e) for c, e in users.values()}


def test_get_or_create(spark):
    rng = random.Random(4)
    start = [(1, 10, "a@x.co"), (2, 20, None), (3, None, "c@x.co"), (4, None, "d@x.co"), (5, 50, None)]
    calls, chats = [], (list(range(10, 70, 5)) + [None] * 6) * 6 + [10] * 40
    rng.shuffle(chats)
    for i, chat in enumerate(chats):
        mail = rng.choice(["a@x.co", "C@x.co ", "d@x.co", "n@x.co", "m@x.co", None, "p@x.co", " ", f"u{i % 9}@x.co"])
        calls.append((i, chat, mail))
    users = {str(u): [c, e] for u, c, e in start}
    expected = {}
    for i, chat, mail in calls:
        mail = (mail or "").strip().lower() or None
        key = next((k for k, u in users.items() if chat is not None and u[0] == chat), None)
        how = "chat"
        if key is None and mail:
            key, how = next((k for k, u in users.items() if u[1] == mail), None), "email"
            if key is not None and chat is not None and users[key][0] is None:
                users[key][0] = chat
        if key is None and chat is None and mail is None:
            how = "rejected"
        elif key is None:
            key, how = (f"chat:{chat}" if chat is not None else f"mail:{mail}"), "created"
            users[key] = [chat, mail]
        elif mail and not users[key][1] and all(u[1] != mail for u in users.values()):
            users[key][1] = mail
        expected[i] = (how, key)
    resolved, after = identities.get_or_create(
        spark.createDataFrame(start, "user_id long, chat_id long, email string"),
        spark.createDataFrame(calls, "request_id long, chat_id long, email string"))
    assert {r["request_id"]: (r["resolution"], r["user_key"]) for r in resolved.collect()} == expected
    assert {r["user_key"]: [r["chat_id"], r["email"]] for r in after.collect()} == users
    assert {h for h, _ in expected.values()} == {"chat", "email", "created", "rejected"}


def test_users_made_by_a_batch_take_part(spark):
    def run(calls):
        resolved, after = identities.get_or_create(
            spark.createDataFrame([], "user_id long, chat_id long, email string"),
            spark.createDataFrame(calls, "request_id long, chat_id long, email string"))
        return ([r["user_key"] for r in resolved.orderBy("request_id").collect()],
                {(r["user_key"], r["chat_id"], r["email"]) for r in after.collect()})

    keys, users = run([(1, 1, None), (5, 2, "x"), (10, 1, "x")])
    assert keys == ["chat:1", "chat:2", "chat:1"] and users == {("chat:1", 1, None), ("chat:2", 2, "x")}
    keys, users = run([(5, None, "x"), (7, 2, "x")])
    assert keys == ["mail:x", "mail:x"] and users == {("mail:x", 2, "x")}


def _rounds(monkeypatch):
    """Counts the rounds that identity resolution takes from now on."""
    seen, judge = [], identities._judge
    monkeypatch.setattr(identities, "_judge", lambda open_: seen.append(1) or judge(open_))
    return seen


def _pairs_in_order(edges):
    taken, kept = set(), set()
    for request, chat, email in sorted(edges):
        if chat not in taken and email not in taken:
            taken |= {chat, email}
            kept.add(request)
    return kept


EDGES = "request_id long, chat_key string, email_key string"


def test_chain_of_requests_takes_few_rounds(spark, monkeypatch):
    edges = [(i, f"c{(i + 1) // 2}", f"m{i // 2}") for i in range(1000)]
    rounds = _rounds(monkeypatch)
    got = identities.ordered_pairs(spark.createDataFrame(edges, EDGES))
    assert {r["request_id"] for r in got.collect()} == _pairs_in_order(edges) == set(range(0, 1000, 2))
    assert len(rounds) <= 12


@pytest.mark.parametrize("chats, emails, n", [(40, 40, 300), (3, 200, 300), (150, 150, 200), (1, 1, 1)])
def test_pairs_by_the_order_of_requests(spark, chats, emails, n):
    rng = random.Random(n + chats)
    pairs = sorted({(rng.randrange(chats), rng.randrange(emails)) for _ in range(n)})
    rng.shuffle(pairs)
    edges = [(i * 5 - 700, f"c{c}", f"m{e}") for i, (c, e) in enumerate(pairs)]
    # A chain whose keys have several requests each.
    edges += [(10_000 + i, f"x{(i + 1) // 3}", f"y{i // 3}") for i in range(60)]
    got = identities.ordered_pairs(spark.createDataFrame(edges, EDGES).repartition(4))
    assert {r["request_id"] for r in got.collect()} == _pairs_in_order(edges)


def test_no_requests_and_no_users(spark):
    users = spark.createDataFrame([], "user_id long, chat_id long, email string")
    requests = spark.createDataFrame([(1, None, " ")], "request_id long, chat_id long, email string")
    resolved, after = identities.get_or_create(users, requests)
    assert [(r["resolution"], r["user_key"]) for r in resolved.collect()] == [("rejected", None)]
    assert after.count() == 0
    assert identities.get_or_create(users, requests.limit(0))[0].count() == 0


def test_download_gate(spark):
    rows = [("pdf", 1, 403), ("Excel", 1, 403), ("pdf", 2, 200), ("chart", 1, 200)]
    df = spark.createDataFrame([(r, u, BASE) for r, u, _ in rows], "resource_type string, user_id long, ts timestamp_ntz")
    since = spark.createDataFrame([(2, BASE)], "user_id long, premium_since timestamp_ntz")
    got = {(r["resource_type"], r["user_id"]): r["http_status"] for r in usage.entitlement_gate(df, since).collect()}
    assert got == {(r, u): s for r, u, s in rows}


PAYMENTS = [  # reference, minute, success, amount, chat, email
    ("dup", 0, True, 40000, 1, "a@x.co"), ("dup", 1, True, 40000, 2, "b@x.co"),
    ("fail_after", 0, True, 40000, 1, ""), ("fail_after", 1, False, 40000, 1, ""),
    ("late", 0, False, 30000, None, ""), ("late", 1, True, 40000, 3, "c@x.co"),
    ("again", 0, True, 1, 1, "x@x.co"), ("again", 1, False, 1, 1, ""), ("again", 2, True, 1, 5, "y@x.co"),
    ("never", 0, False, 7, None, ""),
]


@pytest.mark.parametrize("strict", [False, True])
def test_payment_fold(spark, strict):
    state = {}
    for i, (ref, minute, ok, amount, chat, mail) in enumerate(PAYMENTS):
        s = state.setdefault(ref, {"amount": amount, "status": None, "paid_at": None, "chat": None, "mail": None, "again": 0})
        if ok and s["status"] == "paid":
            s["again"] += 1
        elif ok:
            s.update(status="paid", paid_at=BASE + dt.timedelta(minutes=minute), chat=s["chat"] or chat, mail=s["mail"] or mail or None)
        elif strict or s["status"] != "paid":
            s.update(status="failed")
    df = spark.createDataFrame(
        [(r, BASE + dt.timedelta(minutes=m), i, ok, a, c, e) for i, (r, m, ok, a, c, e) in enumerate(PAYMENTS)],
        "reference string, ts timestamp_ntz, event_id long, is_success boolean, amount long, chat_id long, payer_email string")
    got = {r["reference"]: r for r in payments.payment_fold(df, strict).collect()}
    for ref, s in state.items():
        r = got[ref]
        assert (r["status"], r["amount"], r["paid_at"], r["payer_chat_id"], r["payer_email"], r["already_processed"]) == (
            s["status"], s["amount"], s["paid_at"], s["chat"], s["mail"], s["again"])
    assert (got["dup"]["payer_email"], got["dup"]["payer_chat_id"], got["dup"]["already_processed"]) == ("a@x.co", 1, 1)


def test_hot_user_does_not_sort_in_one_task(spark):
    messages = spark.createDataFrame(_quota_rows(), "event_id long, user_id long, ts timestamp_ntz")
    since = spark.createDataFrame([], "user_id long, premium_since timestamp_ntz")
    # The ranking is limited and stored before; what is left joins without any window.
    assert "Window" not in plan(usage.daily_quota(messages, since, 4))


# --- what the plans read ------------------------------------------------------------------------

def _read_columns(df):
    import re

    return [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<([^\n]*)>", plan(df))]


def test_scans_read_only_what_they_need(spark, sf):
    from cobaltmill.catalog import QUERIES

    assert _read_columns(QUERIES["group_count"](spark, sf)) == [["o_orderstatus"]]
    sales = [set(c) for c in _read_columns(QUERIES["analysis_spec"](spark, sf))]
    assert {"l_orderkey", "l_extendedprice", "l_discount"} in sales
    assert {"o_orderkey", "o_custkey"} in sales


def test_filters_reach_the_scan(spark, sf):
    from cobaltmill.session import table

    spec = {"filters": [{"column": "o_orderstatus", "op": "==", "value": "O"}], "metrics": [{"agg": "count", "name": "n"}]}
    assert "EqualTo(o_orderstatus,O)" in plan(run_spec(table(spark, sf, "orders"), spec))


def test_raw_scan_shuffles_no_lines(spark):
    folder = fresh_path(spark, "lines")
    spark.range(500).selectExpr("concat(id, ';x') AS value").write.text(folder)
    scanned = raw.raw_scan(spark, folder)
    assert "Exchange hashpartitioning" not in plan(scanned) and "BroadcastHashJoin" in plan(scanned)
    assert scanned.select("file", "row_id").distinct().count() == 500


@pytest.mark.parametrize("n, bins", [(1, 4), (37, 2), (100, 8), (5000, 8)])
def test_bounded_read(spark, n, bins):
    rng = random.Random(n)
    keys = rng.sample(range(-5000, 5000), 800) + rng.sample(range(10**9, 10**9 + 300), 200)
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k long, v string").repartition(6)
    got = raw.bounded_read(df, "k", n, bins).collect()
    assert [r["k"] for r in got] == sorted(keys)[:n]
    assert raw.bounded_read(df, "k").count() == 1000


def test_bounded_read_of_nothing(spark):
    assert raw.bounded_read(spark.createDataFrame([], "k long"), "k", 5).count() == 0


def test_first_n_of_many(spark):
    from cobaltmill.operators.ordering import first_n

    df = spark.range(6000).withColumn("k", F.col("id") % 2)
    got = first_n(df, ["k"], [F.col("id").desc()], 1500).collect()
    assert sorted(r["id"] for r in got) == list(range(3000, 6000))


def test_tenant_folders_are_pruned(spark, sf):
    from cobaltmill.session import table

    index = sinks.append_index(table(spark, sf, "embeddings"), fresh_path(spark, "index"), "label")
    queries = index.filter("label = 3").limit(1).selectExpr("vec_id AS query_id", "embedding AS vector")
    found = retrieval.tenant_search(index, "label", 3, queries)
    assert "PartitionFilters: [isnotnull(label" in plan(found)
    own = {r["vec_id"] for r in index.filter("label = 3").collect()}
    assert {r["vec_id"] for r in found.collect()} <= own and found.count() == 5


def test_hot_users_are_split_in_joins(spark):
    """With broadcasts off, a user with a third of the rows is split by the adaptive planner."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)))
        events = spark.range(0, 400_000, 1, 16).select(
            F.col("id").alias("event_id"), hot.alias("user_id"),
            F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 1000000).cast("timestamp_ntz").alias("ts"))
        since = usage.premium_since(events.filter("event_id % 101 = 0").select("user_id", "ts"))
        joined = usage.with_premium(events, since)
        assert joined.agg(F.count_if("is_premium")).collect()
        counted = joined.select(F.xxhash64("event_id", "is_premium").alias("h"))
        counted.collect()
        assert "skew=true" in plan(counted)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tenant_writes_are_rebalanced(spark, sf):
    from cobaltmill.session import table

    text = plan(sinks.by_tenant(table(spark, sf, "embeddings"), "label"))
    assert "REBALANCE_PARTITIONS_BY_COL" in text


def test_spec_charts(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0), ("b", "y", 3.0, None)], "k string, s string, v double, w double")
    base = {"group_by": ["k", "s"], "metrics": [{"column": "v", "agg": "sum", "name": "t"}]}
    stacked = {(r["label"], r["segment"]): r["value"] for r in run_spec(df, base | {"chart": "stacked"}).collect()}
    assert stacked == {("a", "x"): 1.0, ("a", "y"): 0.0, ("b", "x"): 0.0, ("b", "y"): 3.0}
    heat = {(r["x"], r["y"]): r["v"] for r in run_spec({"t": df}, base | {"chart": "heatmap", "source": "t"}).collect()}
    assert heat == {(0, 0): 1.0, (1, 1): 3.0}
    dots = run_spec(df, {"chart": "scatter", "x": "v", "y": "w"}).collect()
    assert sorted((r["x"], r["y"]) for r in dots) == [(1.0, 2.0), (3.0, 0.0)]
    with pytest.raises(ValueError, match="1 key"):
        run_spec(df, base | {"chart": "bar"})
    assert charts.auto_chart(df.filter("k = 'a'")) is None
    with pytest.raises(ValueError, match="radar"):
        run_spec(df, base | {"chart": "radar"})
