"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Each line has a hash; a rolling hash over the last two line hashes decides where a chunk ends, so
boundaries move with the content and an insertion shifts only its own chunk. A long line is a chunk
of its own: chunks end before and after it, whatever stands there. Chunks of two lines or more, and
long lines, that occur more than once in the corpus are removed, all but the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A chunk ends where the rolling hash is 0 modulo this: the mean number of short lines.
MEAN_LINES = 2
MIN_LINES = 2
MIN_CHARS = 32
#: Lines of this many characters are chunks of their own.
LONG_CHARS = 80
NO_ID = -(2**63)
ADDED = ("n_lines", "n_removed_chunks", "n_removed_lines")

ROLL, MODULUS = 31, 1_000_003


def line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 6), 16, 10).cast("long"))


def chunk_ends(lines: Column, hashes: Column, mean_lines: int) -> Column:
    """Indexes of the last line of each chunk; the last line always ends one."""
    def end(h: Column, i: Column) -> Column:
        rolled = (F.coalesce(F.get(hashes, i - 1), F.lit(0)) * ROLL + h) % MODULUS
        longest = F.greatest(F.length(F.get(lines, i)), F.length(F.coalesce(F.get(lines, i + 1), F.lit(""))))
        return F.when((rolled % mean_lines == 0) | (longest >= LONG_CHARS) | (i == F.size(hashes) - 1), i)

    return F.filter(F.transform(hashes, end), lambda x: x.isNotNull())


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with ``c_doc, c_key``: doc_id and text hash; what is equal in both is chunked alike."""
    return docs.withColumns({"c_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "c_key": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def with_lines(rows: DataFrame, mean_lines: int) -> DataFrame:
    """rows with ``c_lines, c_ends``."""
    rows = rows.withColumn("c_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    rows = rows.withColumn("c_hashes", line_hashes(F.col("c_lines")))
    return rows.withColumn("c_ends", chunk_ends(F.col("c_lines"), F.col("c_hashes"), mean_lines)).drop("c_hashes")


def chunk_start(k: Column) -> Column:
    return F.coalesce(F.get(F.col("c_ends"), k - 1) + 1, F.lit(0))


def lines_between(first: Column, last: Column) -> Column:
    """The text of lines ``first`` to ``last``; time in proportion to their number, which slice() does not give."""
    return F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(F.col("c_lines"), i)), "\n")


def chunks(rows: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """A row for each chunk that is long enough: ``c_doc, c_key, k, chunk``."""
    # texts are put together before the rows multiply, so that no row carries its whole document
    spans = F.transform("c_ends", lambda e, k: F.struct(k.alias("k"), (e - chunk_start(k) + 1).alias("n"), lines_between(chunk_start(k), e).alias("chunk")))
    counted = F.filter(spans, lambda s: ((s["n"] >= min_lines) | (F.length(s["chunk"]) >= LONG_CHARS)) & (F.length(s["chunk"]) >= min_chars))
    return rows.select("c_doc", "c_key", F.explode(counted).alias("s")).select("c_doc", "c_key", F.col("s.k").alias("k"), F.col("s.chunk").alias("chunk"))


def remove_repeated_chunks(docs: DataFrame, mean_lines: int = MEAN_LINES, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with repeated chunks cut from ``text``, and ``n_lines, n_removed_chunks, n_removed_lines``.

    A chunk counts if it has ``min_lines`` lines or is a long line, and has ``min_chars`` characters.
    Of equal chunks the one of the smallest doc_id (null first) and then the first in its text stays.
    Chunks meet by hash and are compared byte by byte; where different chunks share a hash, none of
    them is removed. Null text stays null and has one empty line; a text that loses all chunks becomes
    empty. Rows that share doc_id and text are one document and lose the same chunks. An empty table
    gives an empty result; columns of docs named like the added ones are replaced.
    """
    names = [c for c in docs.columns if c not in ADDED]
    found = chunks(with_lines(with_keys(docs.select("doc_id", "text")), mean_lines), min_lines, min_chars).withColumn("hash", F.xxhash64("chunk"))
    # grouping by the text itself is the comparison of bytes
    equal = found.groupBy("hash", "chunk").agg(F.count("*").alias("n"), F.min("c_doc").alias("first_doc"))
    repeated = equal.select("hash", "n", "first_doc").groupBy("hash").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("first_doc").alias("first_doc")).where("texts = 1 AND n > 1")
    # nothing between the join and its next exchange needs a hash's rows together, so that a hot one can be split
    places = found.select("c_doc", "c_key", "k", "hash").join(repeated.select("hash", "first_doc"), "hash")
    own = places.groupBy("c_doc", "c_key").agg(F.array_sort(F.collect_set(F.struct("hash", "k", "first_doc"))).alias("c_own"))
    again = lambda x, i: F.coalesce(F.get(F.col("c_own"), i - 1)["hash"] == x["hash"], F.lit(False))
    extra = F.transform("c_own", lambda x, i: F.when((F.col("c_doc") > x["first_doc"]) | again(x, i), x["k"]))
    gone = own.select("c_doc", "c_key", F.array_compact(extra).alias("c_gone")).where(F.size("c_gone") > 0)

    rows = with_lines(with_keys(docs.select(*names)).join(gone, ["c_doc", "c_key"], "left"), mean_lines)
    cut = F.flatten(F.transform("c_gone", lambda k: F.sequence(chunk_start(k), F.get(F.col("c_ends"), k))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("c_lines") - 1), cut)
    rows = rows.withColumn("c_left", F.when(F.col("c_gone").isNotNull(), F.transform(kept, lambda i: F.get(F.col("c_lines"), i))))
    text = F.when(F.col("c_gone").isNull(), F.col("text")).otherwise(F.array_join("c_left", "\n"))
    n_lines = F.size("c_lines").cast("long")
    result = F.struct(
        text.alias("text"), n_lines.alias("n_lines"),
        F.when(F.col("c_gone").isNull(), 0).otherwise(F.size("c_gone")).cast("long").alias("n_removed_chunks"),
        F.when(F.col("c_gone").isNull(), 0).otherwise(n_lines - F.size("c_left")).cast("long").alias("n_removed_lines"),
    )
    # the generator keeps later filters on the results from being rewritten in terms of lines, once for each line
    rows = rows.select(*[c for c in names if c != "text"], F.explode(F.array(result)).alias("c_result"))
    return rows.select(*[F.col("c_result.text") if c == "text" else F.col(c) for c in names], *[F.col(f"c_result.{c}") for c in ADDED])


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), hashed AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM lines
), valued AS (
  SELECT *, ('0x' || md5(line)[1:6])::BIGINT AS h FROM hashed
), rolled AS (
  SELECT *, ((coalesce(lag(h, 1) OVER w, 0) * {ROLL} + h) % {MODULUS} % {MEAN_LINES} = 0 OR greatest(length(line), coalesce(length(lead(line, 1) OVER w), 0)) >= {LONG_CHARS} OR i = n)::INT AS is_end
  FROM valued WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(is_end) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM rolled
), chunked AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_in, count(*) >= {MIN_LINES} OR max(length(line)) >= {LONG_CHARS} AS counts FROM numbered GROUP BY doc_id, k
), ranked AS (
  SELECT *, counts AND length(chunk) >= {MIN_CHARS} AND row_number() OVER (PARTITION BY chunk, counts ORDER BY doc_id, k) > 1 AS gone FROM chunked
)
SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text, sum(n_in)::BIGINT AS n_lines,
  count(*) FILTER (gone) AS n_removed_chunks, coalesce(sum(n_in) FILTER (gone), 0)::BIGINT AS n_removed_lines
FROM ranked GROUP BY doc_id
"""
