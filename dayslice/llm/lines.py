"""Line de-duplication: lines found in many documents leave all of them. DataFrame functions only.

Lines are counted by a 128-bit hash of their key. Each document gives each of its keys once, and
the counting is split by (key, document) before it is summed by key, so a line that a third of all documents
share lands in no single task. The few keys with a large share of all lines are then found by a bounded broadcast.
Only hashes and places travel for counting; a text moves once, to be rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text

LEAST_CHARS = 1
LEAST_DOCUMENTS = 10
#: Keys with so large a share of all (document, key) pairs are joined by a broadcast: at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z, all else as it is; a text of ASCII alone takes the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashed(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc, mark, place, h1, h2) of every line whose key is long enough."""
    lines = docs.select("doc", "mark", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_chars)
    return keyed.select("doc", "mark", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def drop_common_lines(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    least_documents: int = LEAST_DOCUMENTS,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """`docs` with `text` rebuilt from the lines that stay, and new columns n_lines and n_dropped.

    A key of at least `least_chars` code points found in at least `least_documents` distinct documents loses all its
    lines. A null text is one empty line. Rows of one id count as one document; rows with a null id count
    as one document, too. A repeated row comes out as often as it came in. Other columns are kept; own
    columns called n_lines or n_dropped are replaced. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # Rows with one id and one text lose the same lines, so the two together name a row well enough.
    packed = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"),
        F.xxhash64(whole_text(text)).alias("mark"),
        whole_text(text).alias("text"),
        F.struct(*(c for c in names if c != text)).alias("row"),
    )
    hashed = _hashed(packed.select("doc", "mark", "text"), least_chars)
    seen = Observation()
    counted = hashed.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("documents"))
    counted = counted.observe(seen, F.coalesce(F.sum("documents"), F.lit(0)).alias("pairs"))
    common = materialize(counted.where(F.col("documents") >= least_documents), "common")
    # A key in a thousandth of all (document, key) pairs or more: there are at most a thousand of them.
    often = F.col("documents") >= max(least_documents, seen.get["pairs"] * HOT_SHARE)
    hot = common.where(often).select(F.col("h1").alias("_a"), F.col("h2").alias("_b"))
    rest = common.where(~often).select(F.col("h1").alias("_c"), F.col("h2").alias("_d"))
    # Lines of those keys are found where they are; for the join with the other keys they spread evenly.
    flagged = hashed.join(F.broadcast(hot), (F.col("h1") == F.col("_a")) & (F.col("h2") == F.col("_b")), "left")
    spread = flagged.withColumn("h1", F.when(F.col("_a").isNull(), F.col("h1")).otherwise(F.xxhash64("doc", "mark", "place")))
    matched = spread.join(rest, (F.col("h1") == F.col("_c")) & (F.col("h2") == F.col("_d")), "left")
    gone_lines = matched.where(F.col("_a").isNotNull() | F.col("_c").isNotNull())
    dropped = gone_lines.groupBy("doc", "mark").agg(F.collect_set("place").alias("places"))
    lines = F.split("text", "\n", -1)
    marked = packed.join(dropped, ["doc", "mark"], "left").withColumn("lines", lines)
    gone = F.coalesce("places", F.array().cast("array<int>"))
    # The places that stay, by a hash of those that go, so a text of many lines costs no more for each.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    rebuilt = F.when(F.size(gone) == 0, F.col("text")).otherwise(kept)
    columns = [rebuilt.alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    return marked.select(*columns, F.size("lines").cast("bigint").alias("n_lines"), F.size(gone).cast("bigint").alias("n_dropped"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left of each text."""
    kept = drop_common_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, rn, list_position, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT doc_id, rn, unnest(parts) AS line, unnest(range(len(parts))) AS list_position
    FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
),
common AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
),
marked AS (
  SELECT l.*, c.key IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id,
       count(*) AS n_lines,
       count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY list_position) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked
GROUP BY rn, doc_id
"""
