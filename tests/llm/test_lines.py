from collections import defaultdict

from cobaltmill.llm import lines


def brute(rows, min_sites):
    """rows (doc_id, text, site) with distinct ids; returns id -> cleaned text."""
    sites, first = defaultdict(set), {}
    for d, text, site in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            k = line.strip(" \t\r")
            sites[k].add(site)
            first.setdefault(k, (d, i))
    out = {}
    for d, text, _ in rows:
        if text is None:
            out[d] = None
            continue
        keep = []
        for i, line in enumerate(text.split("\n")):
            k = line.strip(" \t\r")
            if not (k and len(sites[k]) >= min_sites and first[k] != (d, i)):
                keep.append(line)
        out[d] = "\n".join(keep)
    return out


def test_spread_decides(spark):
    rows = []
    for i in range(400):
        parts = [f"line {j} of the corpus " for j in range(1, 40) if i % 40 < j] + [f"own {i}", "", "  \t"]
        rows.append((i, "\n".join(parts), None if i % 40 == 3 else f"site{i % 40}"))
    rows.append((1000, None, "site1"))
    rows.append((1001, "line 39 of the corpus\r\nline 39 of the corpus", "site1"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (2, 10, 30):
        done = lines.line_dedup(docs, min_sites=least)
        assert {r["doc_id"]: r["text"] for r in done.collect()} == brute(rows, least), least


def test_estimates_far_from_the_threshold_need_no_count(spark):
    rows = [(i, "everywhere\nonly here %d" % i, f"site{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    done = {r["doc_id"]: r for r in lines.line_dedup(docs, min_sites=1000).collect()}
    assert done[0]["text"] == rows[0][1] and done[0]["n_removed"] == 0
    assert all(done[i]["text"] == f"only here {i}" and done[i]["n_removed"] == 1 for i in range(1, 3000))


def test_odd_rows(clashing):
    done = lines.line_dedup(clashing, min_sites=2)
    assert sorted(done.columns) == sorted(clashing.columns)
    rows = done.collect()
    assert len(rows) == 16
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert of[2][0]["text"] is None and of[2][0]["n_lines"] == 0
    assert of[3][0]["text"] == "" and of[3][0]["n_lines"] == 1
    assert of[4][0]["text"] == " \t\n " and of[4][0]["n_removed"] == 0
    assert of[1][0]["n_removed"] == 0  # the first occurrence stays
    assert of[5][0]["text"] == "" and of[5][0]["n_removed"] == 1
    assert [r["text"] for r in of[6]] == ["", ""]
    assert {r["text"] for r in of[8]} >= {"another text under the same id as before it"}


def test_empty(no_docs):
    assert lines.line_dedup(no_docs).count() == 0


def test_plan_has_no_python(spark, odd_docs):
    plan = lines.line_dedup(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
