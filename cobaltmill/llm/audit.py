"""Audit how filters interact: what each removes in every order, and what each is worth by itself.

Every row gets a set of failed filters. What has been applied so far is a state, one of the 2^n subsets;
applying a filter is an edge from a state to a larger one, and an order of the filters is a path from
the empty state to the full one. Counting paths forwards (orders that reach a state) and backwards
(orders that leave it) gives the number of orders that use an edge, so that

- what a filter removes over all orders (its Shapley value times n!) is the sum of what its edges remove,
  each weighted by the paths into its start and out of its end;
- the steps of any order are read from the same edges.

Rows are only counted by part and set of failures; all else works on at most 2^n counts of a part.

Defined results:

- null text: like the empty text; null part: the empty string, one part with it;
- a row is a copy if an equal text has a smaller id anywhere in the table; rows that repeat the smallest
  id and rows without an id are none, and a row without an id makes none;
- a label row counts for every row of its id, several rows of one id count as one that holds what any of
  them holds; rows without an id have no labels;
- every part has rows for all orders and steps, zeros included; an empty table gives none;
- long texts are taken whole: the words of one text are held by one task at a time;
- other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobaltmill.session import materialise, table

#: One of the breaks between words.
BREAK = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 200
MARKS = "[#$%&*|]"
LETTERS = "ABCDE"
TALLIES = ("good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself, over the columns ``text`` and ``words``."""
    words = F.col("words")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 2,
        "D": F.regexp_like(text, F.lit(MARKS)),
    }


def _bits(failures: dict[str, Column], letters: str) -> Column:
    bits = [F.when(c, 1 << letters.index(name)).otherwise(0) for name, c in failures.items()]
    return sum(bits[1:], bits[0])


def failure_cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Rows by part and failed filters (bits of ``mask``): ``part, mask, n, good, toxic``.

    Equal rows are one before anything is shuffled; copies are told by the digest of their text.
    """
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    cut = named.select("*", F.array_remove(F.split("text", BREAK, -1), "").alias("words"))
    rows = materialise(cut.select(
        "doc_id", "part", _bits(text_failures(F.col("text")), LETTERS).alias("mask"),
        F.unhex(F.sha2("text", 256)).alias("digest")), "audit-rows")

    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
    named_rows = rows.filter("doc_id is not null").groupBy("doc_id", "part", "mask", "digest").agg(
        F.count(F.lit(1)).alias("n"))
    marked = named_rows.join(marks, "doc_id", "left").select(
        "doc_id", "part", "mask", "digest", "n",
        *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in TALLIES])
    marked = materialise(marked, "audit-marked")

    counts = ["n", *TALLIES]
    # the first rows of each text: one candidate for each part, so few rows meet in the window
    best = marked.groupBy("digest", "part").agg(F.min(F.struct("doc_id", "mask", *counts)).alias("best"))
    least = F.min("best.doc_id").over(Window.partitionBy("digest"))
    firsts = best.select("part", "best.*", least.alias("least")).filter("doc_id = least")
    copy = 1 << LETTERS.index("E")
    signed = [
        marked.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(*[F.sum(c).alias(c) for c in counts]),
        firsts.select("part", F.explode(F.array(
            F.struct(F.col("mask"), F.lit(1).alias("sign")),
            F.struct((F.col("mask") + copy).alias("mask"), F.lit(-1).alias("sign")))).alias("at"), *counts)
        .select("part", "at.mask", *[(F.col("at.sign") * F.col(c)).alias(c) for c in counts]),
        rows.filter("doc_id is null").groupBy("part", "mask").agg(
            F.count(F.lit(1)).alias("n"), *[F.lit(0).cast("long").alias(c) for c in TALLIES]),
    ]
    merged = signed[0].unionByName(signed[1]).unionByName(signed[2])
    return merged.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each state the number of orders of its filters, and of the filters that it lacks."""
    full = (1 << n) - 1
    into, out = [1] + [0] * full, [0] * full + [1]
    for state in range(1, full + 1):
        into[state] = sum(into[state ^ 1 << f] for f in range(n) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        out[state] = sum(out[state | 1 << f] for f in range(n) if not state >> f & 1)
    return into, out


def order_steps(letters: str) -> list[dict]:
    """Each step of each order as an edge: filter number, state before, state after."""
    steps = []
    for order in itertools.permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order):
            steps.append({"filter_order": "".join(letters[g] for g in order), "step": step + 1, "f": f,
                          "before": before, "after": before | 1 << f})
            before |= 1 << f
    return steps


def audit(cells: DataFrame, letters: str = LETTERS, tallies: tuple[str, ...] = TALLIES) -> DataFrame:
    """Every step of every order for each part, from counts by part and failure mask.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails, <tally>_lost..., shapley``.
    """
    n, states = len(letters), range(1 << len(letters))

    def total(count: str, holds: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("cells", lambda c: holds(c["mask"])), F.lit(0).cast("long"),
                           lambda t, c: t + c[count])

    def surviving(count: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(states) - 1)), lambda s: total(
            count, lambda mask: mask.bitwiseAND(s) == 0)).alias(f"{count}_at")

    bits = F.array(*[F.lit(1 << f) for f in range(n)])
    # a part has at most 2^n cells
    merged = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", *tallies)])
    parts = merged.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *tallies)).alias("cells"))
    parts = parts.select(
        "part", *[surviving(c) for c in ("n", *tallies)],
        F.transform(bits, lambda b: total("n", lambda mask: mask.bitwiseAND(b) != 0)).alias("failing"),
        F.transform(bits, lambda b: total("n", lambda mask: mask == b)).alias("alone"))
    parts = materialise(parts, "audit-parts")

    def lost(count: str, before: Column, after: Column) -> Column:
        at = F.col(f"{count}_at")
        return F.get(at, before) - F.get(at, after)

    into, out = path_counts(n)
    edges = [{"f": f, "before": s, "after": s | 1 << f, "paths": into[s] * out[s | 1 << f]}
             for f in range(n) for s in states if not s >> f & 1]
    lattice = F.from_json(F.lit(json.dumps(edges)), "array<struct<f:int,before:int,after:int,paths:long>>")

    def share(f: Column) -> Column:
        return F.aggregate(F.filter(lattice, lambda e: e["f"] == f), F.lit(0).cast("long"), lambda total, e:
                           total + e["paths"] * lost("n", e["before"], e["after"]))

    shares = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), share)
    kind = "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>"
    steps = F.from_json(F.lit(json.dumps(order_steps(letters))), kind)
    # an order has n steps, so the table of steps is a constant of n! * n entries
    walked = parts.select("*", shares.alias("shares")).select("*", F.explode(steps).alias("edge"))
    f, before, after = F.col("edge.f"), F.col("edge.before"), F.col("edge.after")
    removed = lost("n", before, after)
    return walked.select(
        "part", "edge.filter_order", "edge.step", F.get("n_at", after).alias("kept"), removed.alias("removed"),
        (F.get("failing", f) - removed).alias("redundant"), F.get("alone", f).alias("unique_fails"),
        *[lost(c, before, after).alias(f"{c}_lost") for c in tallies], F.get("shares", f).alias("shapley"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failure_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = rf"""
WITH whole AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM whole),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT c.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, [
    len(w) < {MIN_WORDS}, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(min(c.doc_id) OVER (PARTITION BY text) < c.doc_id, false)] AS fails
  FROM cut c LEFT JOIN marks m ON m.doc_id = c.doc_id),
cell AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
walked AS (
  SELECT part, o, step, o[step] AS x,
         len(list_filter(o[:step - 1], lambda g: fails[g])) > 0 AS gone, fails[o[step]] AS hit,
         len(list_filter(fails, lambda g: g)) = 1 AS single, n, good, toxic
  FROM cell, steps),
counted AS (
  SELECT part, o, step, x,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (single AND hit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost
  FROM walked GROUP BY part, o, step, x)
SELECT part, array_to_string(list_transform(o, lambda g: 'ABCDE'[g]), '') AS filter_order, step::INTEGER AS step,
  kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""
