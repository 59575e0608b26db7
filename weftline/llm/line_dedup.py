"""Line dedup with overlapping three-line windows.

Every run of three consecutive lines is hashed (two 64-bit hashes with different seeds). A window found more than once
in the corpus is kept where it comes first, by (doc_id, text hash, position), and every later occurrence covers its
three positions; covered positions of a document are merged and those lines are removed. The first occurrence of a line's
text is never covered, so no content is lost altogether.

Only hashes and positions are shuffled to find the windows. A window that very many documents share is counted with
map-side partial aggregates and joined as rows; its occurrences are never gathered in one place.

Cases: lines end at "\\n"; a document of fewer than three lines is unchanged; a null text stays null; an empty text is one
empty line. A null doc_id orders before others. Rows equal in doc_id and text are one document given twice: each
gets the answer of that document. Columns of the input that have a result's name are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given, hidden, named

WINDOW = 3
RESULTS = ("n_lines", "n_removed", "clean_text")


def _windows(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(id, th, pos, h1, h2): one row for each window of each distinct (id, text)."""
    lines = docs.select(
        named("doc_id").alias("id"), F.xxhash64(named(text)).alias("th"), F.split(named(text), "\n", -1).alias("ls")
    ).where(F.size("ls") >= window)
    spread = lines.select("id", "th", F.arrays_zip(*[F.slice("ls", F.lit(k + 1), F.size("ls") - (window - 1)).alias(f"l{k}") for k in range(window)]).alias("w"))
    one = spread.select("id", "th", F.posexplode("w").alias("pos", "w"))
    parts = [F.col(f"w.l{k}") for k in range(window)]
    return one.select("id", "th", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def covered_positions(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, starts): where later occurrences of repeated windows start, for the documents that have any."""
    w = _windows(docs, text, window)
    place = F.struct(F.col("id"), F.col("th"), F.col("pos"))
    first = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    later = w.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_lines, n_removed and clean_text."""
    i, h, starts, result = hidden("id"), hidden("th"), hidden("starts"), hidden("result")
    found = covered_positions(docs, text, window).withColumnsRenamed({"id": i, "th": h, "starts": starts})

    @F.pandas_udf("n_removed int, clean_text string")
    def rebuild(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        removed, clean = [], []
        for t, s in zip(texts, starts):
            if t is None or s is None:
                removed.append(0)
                clean.append(t)
                continue
            gone = {p + k for p in s.tolist() for k in range(window)}
            removed.append(len(gone))
            clean.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
        return pd.DataFrame({"n_removed": pd.Series(removed, dtype="int32"), "clean_text": pd.Series(clean, dtype=object)})

    t = named(text)
    joined = docs.join(found, named("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64(t) == F.col(h)), "left")
    lines = F.coalesce(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("int")
    done = joined.select(*given(docs, *RESULTS), lines.alias("n_lines"), rebuild(t, F.col(starts)).alias(result))
    return done.select(*given(docs, *RESULTS), "n_lines", F.col(result)["n_removed"].alias("n_removed"), F.col(result)["clean_text"].alias("clean_text"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS win
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM d WHERE len(ls) >= 3)
),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM later, (VALUES (0), (1), (2)) AS v(k)),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d),
clean AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS clean_text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS INT) AS n_lines, CAST(coalesce(c.n_removed, 0) AS INT) AS n_removed, c.clean_text
FROM d LEFT JOIN clean c ON c.doc_id = d.doc_id
"""
