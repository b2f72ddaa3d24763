"""Quality rules with thresholds that adapt to each language and source.

Each document gives a few whole-number statistics.  For each (language, source) they are summed up in a quantile sketch: a
count for each cell of a log-linear scale, so that sketches of parts, sources or languages merge by adding their counts.
Thresholds are read from the sketches, joined back to the documents and decide together with the fixed base rules.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, chunks, flat_utf8, map_arrow, mix64, seeded_words, text_of, written
from tidemark.llm.words import BLANKS, numbered_words

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Text worked on at once in a task.
SLICE_BYTES = 1 << 20
_PLACES = seeded_words(81, WINDOW)
_BLANK = np.isin(np.arange(256), list(BLANKS))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: Statistics that the sketches hold: name, its whole-number value, the least spread its fences assume, and whether low values
#: are faults too.
STATISTICS = (
    ("word_length", "1000 * word_chars div n_words", 100, True),
    ("symbols", "10000 * n_symbols div word_chars", 100, False),
    ("repeats", "1000 * n_repeat_words div n_words", 50, False),
    ("dup_lines", "1000 * n_dup_lines div n_words", 20, False),
)
#: Fences stand this many spreads outside the quartiles.
REACH = 3
#: A group of fewer documents uses its language's sketch, a language of fewer that of all.
LEAST_DOCS = 200
#: Leading bits of a value that its sketch cell keeps: cells are less than 1/128 of their value wide.
BITS = 8
#: Parts that the documents of each group are joined in, so that a group of any share is spread.
SALTS = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, how many of its words lie in a window of WINDOW words that occurs twice or more in the text."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(offsets) - 1, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])
    key = owner[at].astype(np.uint64)
    for k in range(WINDOW):
        key = mix64(key + (ids[at + k] + 1).astype(np.uint64) * _PLACES[k])
    by = np.argsort(key, kind="stable")
    a, b = at[by[:-1]], at[by[1:]]
    same = (key[by[:-1]] == key[by[1:]]) & (owner[a] == owner[b])
    a, b = a[same], b[same]
    for k in range(WINDOW):  # the words themselves decide, not the key
        same = ids[a + k] == ids[b + k]
        a, b = a[same], b[same]
    edge = np.zeros(len(ids) + 1, np.int64)
    start = np.unique(np.concatenate([a, b]))
    edge[start] += 1
    edge[start + WINDOW] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return covered[offsets[1:]] - covered[offsets[:-1]]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every document, in whole numbers.

    n_words; word_chars (code points in words); n_symbols (characters of ``#*$%&|<>``); n_dup_lines (lines, parted by line
    feeds, that hold a word and equal an earlier line of the text); n_repeat_words (words in windows of five words that occur
    twice or more in the text, the first included).  Null and empty texts count 0 throughout; null ids, languages and sources
    stay null, as where the column is missing; repeated rows are kept, one result a row; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE_BYTES):
            texts = batch.column("text")
            data, bytes_at = flat_utf8(texts)
            _, ids, offsets = numbered_words(texts)
            lines = []
            for text in texts.cast(pa.large_binary()).to_pylist():
                own = [line for line in (text or b"").split(b"\n") if line.strip(BLANKS)]
                lines.append(len(own) - len(set(own)))
            counts = [np.diff(offsets), _per_text(((data & 0xC0) != 0x80) & ~_BLANK[data], bytes_at), _per_text(_SYMBOL[data], bytes_at),
                      np.array(lines), repeated_words(ids, offsets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in counts)],
                                             ["doc_id", "lang", "source", *COUNTS])

    of = lambda c: (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of("lang"), of("source"), text_of().alias("text"))
    return map_arrow(rows, run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    """Fewer than 10 words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def cell(value: str) -> str:
    """SQL of a sketch cell: the value with all but its leading BITS bits cleared, the cell's least value."""
    shift = f"greatest(length(bin({value})) - {BITS}, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def sketches(counts: DataFrame, by: list[str]) -> DataFrame:
    """The quantile sketches of the documents that pass the base rules: (*by, stat, cell, n).

    Each is a table of counts by cell, at most some thousand rows however many documents it sums up; counts of equal cells
    add up, so sketches merge exactly and in any order.
    """
    stats = ", ".join([f"named_struct('stat', '{name}', 'value', {value})" for name, value, _, _ in STATISTICS]
                      + ["named_struct('stat', 'n_words', 'value', n_words)"])
    values = counts.where(~base_failed()).select(*by, F.expr(f"inline(array({stats}))"))
    return values.select(*by, "stat", F.expr(cell("value")).alias("cell")).groupBy(*by, "stat", "cell").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of fewer columns from those of more, by adding counts."""
    return sketch.groupBy(*by, "stat", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(*by, docs, and q25, q50, q75 of each statistic): the least cell that a quarter, half, ... of the documents reach."""
    group = Window.partitionBy(*by, "stat")
    placed = sketch.select("*", F.sum("n").over(group.orderBy("cell")).alias("upto"), F.sum("n").over(group).alias("docs"))
    names = [name for name, _, _, _ in STATISTICS] + ["n_words"]
    facts = [F.min(F.when((F.col("stat") == name) & (100 * F.col("upto") >= q * F.col("docs")), F.col("cell"))).alias(f"{name}_q{q}")
             for name in names for q in (25, 50, 75)]
    return placed.groupBy(*by).agg(F.max("docs").alias("docs"), *facts)


def thresholds(counts: DataFrame) -> DataFrame:
    """One row per (lang, source) that holds documents passing the base rules: its quartiles, or those of its language or of
    all documents where the group, or the language, has fewer than LEAST_DOCS of them."""
    own = written(sketches(counts, ["lang", "source"]), "sketches")
    group, language, whole = (quartiles(s, by) for s, by in (
        (own, ["lang", "source"]), (merged(own, ["lang"]), ["lang"]), (merged(own, []), [])))
    facts = [c for c in group.columns if c not in ("lang", "source")]
    as_row = lambda df, name: df.select(*[c for c in df.columns if c not in facts], F.struct(*facts).alias(name))
    # a language has one row, all documents have one: both sides are bounded by the groups, not by the documents
    joined = (as_row(group, "a").join(as_row(language, "b").withColumnRenamed("lang", "b_lang"), F.col("lang").eqNullSafe(F.col("b_lang")), "left")
              .join(F.broadcast(as_row(whole, "c")), F.lit(True), "left"))
    chosen = F.when(F.col("a.docs") >= LEAST_DOCS, F.col("a")).when(F.col("b.docs") >= LEAST_DOCS, F.col("b")).otherwise(F.col("c"))
    return joined.select("lang", "source", chosen.alias("t"))


def within_fences() -> Column:
    """Whether every statistic lies within its group's fences.

    A fence stands REACH spreads (quartile range, at least the statistic's least spread) outside the quartiles.  Averages over
    few words scatter more, so for texts shorter than the group's median the distance allowed grows by the root of the ratio.
    """
    tests = []
    for name, value, least, both in STATISTICS:
        # in floating point, exact here below 2^53: no product of a giant word's length can overflow
        bound = f"power({REACH} * greatest(t.{name}_q75 - t.{name}_q25, {least}), 2) * greatest(n_words, t.n_words_q50)"
        tests.append(f"power(greatest({value} - t.{name}_q75, 0), 2) * n_words <= {bound}")
        if both:
            tests.append(f"power(greatest(t.{name}_q25 - {value}, 0), 2) * n_words <= {bound}")
    return F.expr(" AND ".join(tests))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The counts of :func:`document_counts`, ``base_failed`` and ``kept`` for every document.

    A document is kept if it passes the base rules and lies within the fences of its language and source (null languages and
    sources are groups like any other).  Texts without words fail the base rules; ties need no rule, as cells are compared by
    value; an empty table gives an empty result.
    """
    counts = written(document_counts(docs), "counts")
    t = (thresholds(counts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
         .withColumnsRenamed({"lang": "t_lang", "source": "t_source"}))
    salted = counts.withColumn("part", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)).cast("int"))
    joined = salted.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
                         & (F.col("part") == F.col("salt")), "left")
    kept = F.when(base_failed(), False).otherwise(F.coalesce(within_fences(), F.lit(False)))
    return joined.select("doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), kept.alias("kept"))


def _sql() -> str:
    """The same rules for DuckDB, which reads ``div`` as ``//``."""
    div = lambda e: e.replace(" div ", " // ")
    names = [(name, div(value)) for name, value, _, _ in STATISTICS] + [("n_words", "n_words")]
    values = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS stat, {value} AS value FROM passed" for name, value in names)
    facts = ", ".join(f"min(CASE WHEN stat = '{name}' AND 100 * upto >= {q} * docs THEN cell END) AS {name}_q{q}"
                      for name, _ in names for q in (25, 50, 75))
    quart = lambda table, by: (
        f"SELECT {by} max(docs) AS docs, {facts} FROM (SELECT *, sum(n) OVER (PARTITION BY {by} stat ORDER BY cell) AS upto, "
        f"sum(n) OVER (PARTITION BY {by} stat) AS docs FROM {table}) GROUP BY ALL")
    add = lambda by: f"SELECT {by} stat, cell, sum(n) AS n FROM own GROUP BY ALL"
    tests = []
    for name, value, least, both in STATISTICS:
        bound = f"pow({REACH} * greatest(q('{name}_q75') - q('{name}_q25'), {least}), 2) * greatest(n_words, q('n_words_q50'))"
        tests.append(f"pow(greatest({div(value)} - q('{name}_q75'), 0), 2) * n_words <= {bound}")
        if both:
            tests.append(f"pow(greatest(q('{name}_q25') - ({div(value)}), 0), 2) * n_words <= {bound}")
    pick = lambda m: (f"(CASE WHEN a.docs >= {LEAST_DOCS} THEN a.{m[1]} WHEN b.docs >= {LEAST_DOCS} THEN b.{m[1]} ELSE w.{m[1]} END)")
    verdict = re.sub(r"q\('(\w+)'\)", pick, " AND ".join(tests))
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN words USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
passed AS (SELECT * FROM judged WHERE NOT base_failed),
stats AS ({values}),
own AS (SELECT lang, source, stat, (value >> s) << s AS cell, count(*) AS n
        FROM (SELECT *, greatest(length(bin(value)) - {BITS}, 0) AS s FROM stats) GROUP BY ALL),
by_lang AS ({add("lang,")}), by_all AS ({add("")}),
a AS ({quart("own", "lang, source,")}), b AS ({quart("by_lang", "lang,")}), w AS ({quart("by_all", "")})
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE coalesce({verdict}, false) END AS kept
FROM judged j LEFT JOIN a ON j.lang IS NOT DISTINCT FROM a.lang AND j.source IS NOT DISTINCT FROM a.source
LEFT JOIN b ON j.lang IS NOT DISTINCT FROM b.lang CROSS JOIN w"""


QUALITY_RULES_SQL = _sql()
