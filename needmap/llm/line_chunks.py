"""Line deduplication by content-defined chunks of lines; built-in functions only.

The lines of a text are hashed, and a rolling hash over the last two line hashes decides where a chunk may end; it does where the
line before may not, and never so that a chunk is a single line (but for texts of one line). Boundaries depend on the few lines
around them alone, so an insertion or a removal shifts none further away. Chunks that stand at more than one place are removed from
all but the first (lowest ``doc_id``, then lowest position). Chunks are grouped by digest and by their bytes; a digest that stood
for two different texts would remove nothing.

Defined cases: lines end at each line feed; an empty line is a line. NULL texts stay NULL, empty texts have one empty line. Rows
without ``doc_id`` count as one document after all others. Rows with the same ``doc_id`` and text are one document and lose the
same chunks; between different texts of one ``doc_id`` nothing is removed. Rows and other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

#: One line in so many may end a chunk; chunks have about twice as many lines.
DIVISOR = 2
_LAST = (1 << 63) - 1


def line_hash(line: Column) -> Column:
    """32 bits of the line's md5 digest."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def with_chunks(df: DataFrame, text: str, lines: str, chunks: str, divisor: int = DIVISOR) -> DataFrame:
    """Adds the lines of the text and its chunks, an array of (from, to), line numbers from 0, both inclusive."""
    hashes, ends = fresh(df, "hashes_of_lines", "ends_of_chunks")
    out = df.withColumn(lines, F.split(text_of(text), "\n", -1))
    out = out.withColumn(hashes, F.transform(lines, line_hash))
    n = F.size(hashes)
    rolling = lambda i: F.get(hashes, i) * 31 + F.when(i > 0, F.get(hashes, i - 1)).otherwise(0)
    may = lambda i: rolling(i) % divisor == 0
    out = out.withColumn(ends, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | ((i > 0) & (i < n - 2) & may(i) & ~may(i - 1))))
    begin = lambda j: F.when(j > 0, F.get(ends, j - 1) + 1).otherwise(0)
    return out.withColumn(chunks, F.transform(ends, lambda e, j: F.struct(begin(j).alias("from"), e.alias("to")))).drop(hashes, ends)


def body(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["from"] + 1, chunk["to"] - chunk["from"] + 1), "\n")


def removals(df: DataFrame, text: str = "text", key: str = "doc_id", divisor: int = DIVISOR) -> DataFrame:
    """(doc, part, gone): the numbers of the chunks that each text loses; ``part`` tells the texts of one ``doc`` apart."""
    source = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text_of(text)).alias("part"), text_of(text).alias("text"))
    cut_up = with_chunks(source, "text", "lines", "chunks", divisor)
    multi = F.filter(F.transform("chunks", lambda c, j: F.struct(c["from"], c["to"], j.alias("number"))), lambda c: c["to"] > c["from"])
    texts = F.transform(multi, lambda c: F.struct(c["number"].alias("number"), body(F.col("lines"), c).alias("body")))
    bodies = cut_up.select("doc", "part", texts.alias("own"))
    bodies = bodies.select("doc", "part", "own", F.transform("own", lambda c: F.md5(c["body"].cast("binary"))).alias("digests"))
    # An outer explode: for a plain one, a filter on the whole chain of expressions would be put below it and repeat them in its loops.
    single = bodies.select("doc", "part", "digests", F.posexplode_outer("own").alias("at", "chunk")).where("chunk IS NOT NULL").select(
        "doc", "part", F.col("chunk.number").alias("number"), F.col("chunk.body").alias("body"), F.get("digests", F.col("at")).alias("digest"),
        (F.array_position("digests", F.get("digests", F.col("at"))) <= F.col("at")).alias("again"),
    )
    # The bytes are part of the group, so equal chunks are combined before the shuffle and different ones never meet.
    same = single.groupBy("digest", "body").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("again").alias("twice"))
    repeated = (
        same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("twice").alias("twice"))
        .where((F.col("texts") == 1) & ((F.col("first") != F.col("last")) | F.col("twice"))).select("digest", "first")
    )
    later = single.select("doc", "part", "number", "digest", "again").join(repeated, "digest").where((F.col("doc") != F.col("first")) | F.col("again"))
    return later.groupBy("doc", "part").agg(F.collect_set("number").alias("gone"))


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", divisor: int = DIVISOR, removed: str | None = None) -> DataFrame:
    """All rows and columns of ``df``, the repeated chunks taken out of ``text``; ``removed``, if named, is the number of lines taken."""
    doc, part, gone, lines, chunks = fresh(df, "doc_of_row", "part_of_row", "gone_chunks", "lines_of_row", "chunks_of_row")
    lost = removals(df, text, key, divisor).select(F.col("doc").alias(doc), F.col("part").alias(part), F.col("gone").alias(gone))
    keyed = df.withColumns({doc: F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)), part: F.xxhash64(text_of(text))})
    joined = with_chunks(keyed.join(lost, [doc, part], "left"), text, lines, chunks, divisor)
    left = F.filter(F.transform(chunks, lambda c, j: F.struct(c["from"], c["to"], j.alias("number"))), lambda c: ~F.array_contains(gone, c["number"]))
    kept = F.array_join(F.flatten(F.transform(left, lambda c: F.slice(lines, c["from"] + 1, c["to"] - c["from"] + 1))), "\n")
    out = {c: F.col(f"`{c}`") if c != text else F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(kept) for c in df.columns}
    columns = [c.alias(name) for name, c in out.items()]
    if removed:
        taken = F.aggregate(F.filter(F.transform(chunks, lambda c, j: F.struct(c["from"], c["to"], j.alias("number"))), lambda c: F.array_contains(gone, c["number"])), F.lit(0), lambda a, c: a + c["to"] - c["from"] + 1)
        columns.append(F.coalesce(F.when(F.col(gone).isNull(), F.lit(0)).otherwise(taken), F.lit(0)).cast("long").alias(removed))
    return joined.select(*columns)


#: The same result in SQL, for tables without NULL ids whose ids are unique.
SQL = f"""
WITH line AS (
  SELECT doc_id, i, l, CAST('0x' || substr(md5(l), 1, 8) AS BIGINT) AS h
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), may AS (
  SELECT *, (h * 31 + coalesce(lag(h) OVER d, 0)) % {DIVISOR} = 0 AS may, count(*) OVER (PARTITION BY doc_id) AS lines FROM line WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), ended AS (
  SELECT *, CASE WHEN i > 1 AND i < lines - 1 AND may AND NOT lag(may) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS ends FROM may
), numbered AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ended
), chunk AS (
  SELECT doc_id, chunk, string_agg(l, chr(10) ORDER BY i) AS body, count(*) AS n FROM numbered GROUP BY doc_id, chunk
), judged AS (
  SELECT doc_id, chunk, n > 1 AND row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS gone, n FROM chunk
), kept AS (
  SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed_lines,
    coalesce(string_agg(CASE WHEN NOT gone THEN l END, chr(10) ORDER BY i), '') AS text
  FROM numbered JOIN judged USING (doc_id, chunk) GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed_lines, length(text) AS n_chars, md5(text) AS text_md5 FROM kept
"""
