"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line is dropped if it first occurs earlier (document id, then line number),
or if it has ``min_bytes`` or more and a line that does is within ``threshold``
edits of it; distances count UTF-8 bytes.  Blank lines stay.

1. Occurrences of equal lines combine to distinct lines, with their first
   occurrence (one decimal that orders by document, tie, line number).
2. A distinct line is cut into ``threshold + 1`` segments; of two lines within
   the threshold one has at least one segment of the other unchanged.  Index
   rows hash (length, segment number, segment); probe rows hash the substrings
   that stand where such a segment of a line of the same length or up to
   ``threshold`` bytes less can lie, at the starts that the multi-match-aware
   rule leaves.
3. Hashes that one line alone has go at once; the others give candidate pairs.
4. Candidates are verified by a banded bit-parallel edit distance: the
   diagonals within reach are bits of one word for each number of edits.
5. Documents get the numbers of their dropped lines back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

THRESHOLD = 2
#: Shorter lines (bytes, without outer white space) go only as exact repeats: two edits make most of them another line.
MIN_BYTES = 25
#: A line of more than 1 / HOT of all occurrences is joined by broadcast: fewer than HOT lines.
HOT = 2000
#: Up to so many line numbers (16 bytes each) are broadcast to fetch candidates' bytes; more are joined by shuffle.
BROADCAST_ROWS = 500_000

_TRIM = " \t\x0b\f\r"
_LAST_ID = (1 << 63) - 1


def _windows(threshold: int) -> list[tuple[int, int, int]]:
    """(bytes less, segment from 1, start shift) of the probes, multi-match-aware."""
    out = []
    for less in range(threshold + 1):
        for seg in range(1, threshold + 2):
            low = max(1 - seg, less - (threshold + 1 - seg))
            high = min(seg - 1, less + (threshold + 1 - seg))
            out += [(less, seg, shift) for shift in range(low, high + 1)]
    return out


def _segment_rows(threshold: int) -> Column:
    """All index and probe rows (key, indexed) of a line ``bytes`` of ``size`` bytes."""
    size, parts, rows = F.col("size"), threshold + 1, []
    for less, seg, shift in _windows(threshold):
        length = size - less
        start = F.floor(length * (seg - 1) / parts).cast("int")
        width = F.floor(length * seg / parts).cast("int") - start
        at = start + 1 + shift
        key = F.xxhash64(F.substring("bytes", at, width), length, F.lit(seg))
        valid = (at >= 1) & (at + width - 1 <= size) & (width > 0)
        rows.append(F.when(valid, F.struct(key.alias("key"), F.lit(less == 0 and shift == 0).alias("indexed"))))
    return F.array_compact(F.array(*rows))


def _common(a: Column, b: Column, most: Column, at_end: bool) -> Column:
    """Bytes, at most ``most``, that two binaries share at their start or end: halving steps over
    built-in comparisons.  Beyond 2**21 bytes the rest is left to the caller."""

    def longer(p: Column, s: Column) -> Column:
        first = (lambda x: F.octet_length(x) - p - s + 1) if at_end else (lambda x: p + 1)
        return F.when((p + s <= most) & (F.substring(a, first(a), s) == F.substring(b, first(b), s)), p + s).otherwise(p)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(20, -1, -1))), F.lit(0), longer)


def trimmed(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with binary columns ``a`` and ``b`` without their common start and end, which no
    optimal alignment edits."""
    short = F.least(F.octet_length(a), F.octet_length(b))
    df = df.withColumn("__head", _common(F.col(a), F.col(b), short, False))
    df = df.withColumn("__tail", _common(F.col(a), F.col(b), short - F.col("__head"), True))
    cut = lambda c: F.substring(F.col(c), F.col("__head") + 1, F.octet_length(c) - F.col("__head") - F.col("__tail"))
    return df.withColumns({a: cut(a), b: cut(b)}).drop("__head", "__tail")


def within_edits(a: str, b: str, threshold: int) -> Column:
    """Whether binary columns ``a`` and ``b`` are at most ``threshold`` edits apart.

    After j bytes of b, bit i of word e says that the first j + i - threshold
    bytes of a are at most e edits from them.  A column takes matches (and with
    the match mask), replacements (as is), insertions (shift right) and
    deletions (shift left) of the word of one edit less.  Once no bit is left
    the other columns are passed over.
    """
    k = threshold
    band = (1 << (2 * k + 1)) - 1
    long_ = lambda x: F.lit(x).cast("long")
    m, n = F.octet_length(a), F.octet_length(b)

    def step(state: Column, j: Column) -> Column:
        byte = F.substring(F.col(b), j, F.lit(1))
        match = long_(0)
        for i in range(2 * k + 1):
            at = j + F.lit(i - k)
            same = (at >= 1) & (at <= m) & (F.substring(F.col(a), at, F.lit(1)) == byte)
            match = match.bitwiseOR(F.when(same, long_(1 << i)).otherwise(long_(0)))
        old = [state[f"e{e}"] for e in range(k + 1)]
        # each word is an element of the array that the inner fold builds, so none is computed twice
        def more(done: Column, e: Column) -> Column:
            above = F.element_at(done, -1)
            own = F.get(F.array(*old), e)
            less = F.get(F.array(*old), e - 1)
            taken = own.bitwiseAND(done[0]).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(above, 1)).bitwiseAND(long_(band))
            return F.concat(done, F.array(taken))

        first = F.array(match)
        seeded = F.transform(first, lambda x: F.array(x, x.bitwiseAND(old[0])))[0]
        words = F.aggregate(F.sequence(F.lit(1), F.lit(k)), seeded, more) if k else seeded
        return F.transform(F.array(words), lambda w: F.struct(*(F.get(w, F.lit(e + 1)).alias(f"e{e}") for e in range(k + 1))))[0]

    start = F.struct(*(long_(sum(1 << i for i in range(k, k + e + 1))).alias(f"e{e}") for e in range(k + 1)))
    columns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    fold = F.aggregate(columns, start, lambda s, j: F.when(s[f"e{k}"] == 0, s).otherwise(step(s, j)), lambda s: s[f"e{k}"])
    corner = (m - n + F.lit(k)).cast("int")
    return (F.abs(m - n) <= k) & (F.call_function("shiftright", fold, corner).bitwiseAND(long_(1)) == 1)


def _keys(df: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """The order key (id, tie) of a row.  tie is 0 unless ids repeat in the table."""
    unique = df.groupBy(F.col(doc_id).alias("doc_id")).count().where("count > 1").isEmpty()
    tie = F.lit(0) if unique else F.hash(text).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST_ID)), tie.cast("int")


def _position() -> Column:
    number = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    row = (F.col("id").cast("decimal(20,0)") + number(1 << 63)).cast("decimal(20,0)") * number(1 << 62)
    low = F.shiftleft(F.col("tie").cast("long"), 31) + F.col("line_no")
    return (row.cast("decimal(38,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def _lines(texts: DataFrame, min_bytes: int) -> DataFrame:
    """(id, tie, line_no, line) of the lines that are long enough."""
    lines = texts.select("id", "tie", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(_TRIM))).where(F.octet_length("line") >= min_bytes)


def _near(distinct: DataFrame, threshold: int) -> DataFrame:
    """(lid) of the distinct lines that have an earlier line within the threshold."""
    rows = distinct.select("lid", F.col("line").cast("binary").alias("bytes")).withColumn("size", F.octet_length("bytes"))
    rows = rows.select("lid", F.inline(_segment_rows(threshold)))
    group = Window.partitionBy("key")
    shared = rows.select("key", "lid", "indexed", F.min("lid").over(group).alias("low"), F.max("lid").over(group).alias("high"))
    shared = materialise(shared.where("low != high").select("key", "lid", "indexed"), "segments")
    index = shared.where("indexed").select("key", F.col("lid").alias("a")).distinct()
    probe = shared.select("key", F.col("lid").alias("b")).distinct()
    pairs = index.join(probe, "key").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialise(pairs, "line-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    lines = materialise(distinct.join(needed, "lid", "left_semi").select("lid", "first", F.col("line").cast("binary").alias("bytes")), "line-candidates")
    left = lines.select(F.col("lid").alias("a"), F.col("first").alias("first_a"), F.col("bytes").alias("bytes_a"))
    right = lines.select(F.col("lid").alias("b"), F.col("first").alias("first_b"), F.col("bytes").alias("bytes_b"))
    both = pairs.join(left, "a").join(right, "b").where(F.abs(F.octet_length("bytes_a") - F.octet_length("bytes_b")) <= threshold)
    # few bytes but much work a pair: spread over all tasks, which adaptive coalescing would not;
    # written first, so that the distance reads trimmed bytes and doesn't trim anew at each use
    both = both.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    near = materialise(trimmed(both, "bytes_a", "bytes_b"), "trimmed-pairs")
    near = near.where(within_edits("bytes_a", "bytes_b", threshold))
    return near.select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("lid")).distinct()


def _dropped(texts: DataFrame, threshold: int, min_bytes: int) -> DataFrame:
    """(id, tie, dropped): the line numbers that each document loses, with documents that lose some only."""
    lines = _lines(texts, 1)
    distinct = lines.groupBy("line").agg(F.min(_position()).alias("first"), F.count("*").alias("n"))
    distinct = materialise(distinct.withColumn("lid", F.monotonically_increasing_id()), "lines")
    near = _near(distinct.where(F.octet_length("line") >= min_bytes), threshold).withColumn("near", F.lit(True))
    name = F.unhex(F.md5("line"))
    marked = distinct.select("lid", name.alias("name"), "first", "n").join(near, "lid", "left")
    marked = materialise(marked.where("near OR n > 1").select("name", "first", "n", F.coalesce("near", F.lit(False)).alias("near")), "repeated-lines")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = marked.where(F.col("n") * HOT > total)  # fewer than HOT rows
    cold = marked.where(F.col("n") * HOT <= total)
    every = lines.select("id", "tie", "line_no", name.alias("name")).join(F.broadcast(hot), "name", "left")
    columns = ["id", "tie", "line_no", "first", "near"]
    rest = every.where("n IS NULL").select("id", "tie", "line_no", "name").join(cold, "name").select(*columns)
    gone = every.where("n IS NOT NULL").select(*columns).unionByName(rest).where(F.col("near") | (_position() != F.col("first")))
    return gone.groupBy("id", "tie").agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))


def dropped_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per row of ``df``: doc_id, n_lines, n_dropped, dropped (line numbers from 0, ascending).

    Lines end at a line feed; outer white space doesn't count.  Null text has no
    line, empty text one empty line.  A null doc_id comes after all others.
    Rows that share an id but not their text are ordered by a hash of the text;
    rows repeated whole count as one document and get the same result.  Other
    columns are ignored; an empty table gives no row.
    """
    id_, tie = _keys(df, doc_id, text)
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), id_.alias("id"), tie.alias("tie"), F.col(text).alias("text"))
    out = texts.select("doc_id", "id", "tie", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    out = out.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).join(_dropped(texts, threshold, min_bytes), ["id", "tie"], "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(dropped).alias("n_dropped"), dropped.alias("dropped"))


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of ``df`` with all their columns and ``text`` without its dropped lines.
    A row that loses no line keeps its text as it is, null too; one that loses all has an empty text."""
    id_, tie = _keys(df, doc_id, text)
    texts = df.select(id_.alias("id"), tie.alias("tie"), F.col(text).alias("text"))
    gone = _dropped(texts, threshold, min_bytes).withColumnsRenamed({"id": "__id", "tie": "__tie", "dropped": "__dropped"})
    keyed = df.withColumns({"__row": id_, "__row_tie": tie})
    joined = keyed.join(gone, (F.col("__row") == F.col("__id")) & (F.col("__row_tie") == F.col("__tie")), "left")
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return joined.withColumn(text, F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(kept)).select(*df.columns)


SQL = rf"""
WITH l AS (
  SELECT doc_id, line_no - 1 AS line_no, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
), e AS (SELECT * FROM l WHERE strlen(line) >= 1
), d AS (SELECT line, min((doc_id, line_no)) AS first, strlen(line) AS size FROM e GROUP BY line
), near AS (
  SELECT DISTINCT b.line FROM d a JOIN d b
  ON a.size >= {MIN_BYTES} AND b.size >= {MIN_BYTES} AND b.size BETWEEN a.size - {THRESHOLD} AND a.size + {THRESHOLD} AND a.first < b.first AND levenshtein(a.line, b.line) <= {THRESHOLD}
), gone AS (
  SELECT e.doc_id, e.line_no FROM e JOIN d USING (line) LEFT JOIN near USING (line)
  WHERE near.line IS NOT NULL OR (e.doc_id, e.line_no) <> d.first
), g AS (SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS dropped FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(string_split(t.text, chr(10))) AS INTEGER) AS n_lines, CAST(coalesce(g.n, 0) AS INTEGER) AS n_dropped, coalesce(g.dropped, '') AS dropped
FROM documents t LEFT JOIN g USING (doc_id)
"""
