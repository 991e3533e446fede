"""Quality rules, lines first, in DataFrame functions only.

Each line that has a word is tested on its own for punctuation, navigation, boilerplate and repetition; lines that fail are
removed, and a document goes if its removed lines hold more than a given share of its characters. Counts that a document
as a whole must pass (words, words in repeated windows) come beside that. All of it happens within the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that separates words; signs counted as symbols; lower-case phrases of boilerplate lines.
BLANKS = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = r"(all rights reserved|privacy policy|terms of (use|service)|accept (all )?cookies|uses cookies|enable javascript|click here|subscribe to|sign up for|read more|lorem ipsum)"
#: A line may end with these, or with one of them and closing signs.
TERMINAL = r"[.!?:;…。！？»”\"')\]][ \t-\r]*$"


def line_fails(line: str = "l", words: str = "n") -> dict[str, str]:
    """The rules for one line, by name, as SQL conditions that Spark and DuckDB read alike (but for ``regexp_like``'s name).

    ``bars``, ``marks`` and ``shouts`` are counts of ``|``, other symbols and ``!!`` in the line.
    """
    return {
        "navigation": f"(bars >= 3 AND bars * 5 >= {words})",
        "symbols": f"(marks >= 3 AND marks * 5 >= {words})",
        "shouting": f"(shouts >= 3 AND shouts * 5 >= {words})",
        "punctuation": "NOT ends_well",
        "boilerplate": "boiler",
    }


def with_counts(df: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """``df`` with the base counts: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    Windows are compared by 64-bit hashes within one document.
    """
    text = f"coalesce(CAST(`{text_col}` AS STRING), '')"
    a = df.withColumn("_q_text", F.expr(text))
    a = a.withColumn("_q_words", F.expr(rf"filter(split(_q_text, '{_java(BLANKS)}+'), x -> x <> '')"))
    a = a.withColumn("_q_lines", F.expr(rf"filter(split(_q_text, '\\n'), x -> x rlike '{_java('[^ \\t-\\r]')}')"))
    a = a.withColumn("_q_hashes", F.expr(f"CASE WHEN size(_q_words) < {window} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(1, size(_q_words) - {window - 1}), i -> xxhash64(slice(_q_words, i, {window}))) END"))
    a = a.withColumn("_q_distinct", F.expr("size(array_distinct(_q_hashes))"))
    # only documents with a repeated window sort theirs
    a = a.withColumn("_q_sorted", F.expr("CASE WHEN _q_distinct < size(_q_hashes) THEN sort_array(transform(_q_hashes, (h, i) -> named_struct('h', h, 'i', i))) ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END"))
    a = a.withColumn(
        "_q_starts",
        F.expr("sort_array(array_distinct(flatten(zip_with(slice(_q_sorted, 1, greatest(size(_q_sorted) - 1, 0)), slice(_q_sorted, 2, greatest(size(_q_sorted) - 1, 0)), (x, y) -> CASE WHEN x.h = y.h THEN array(x.i, y.i) ELSE CAST(array() AS array<int>) END))))"),
    )
    covered = f"aggregate(zip_with(slice(_q_starts, 1, greatest(size(_q_starts) - 1, 0)), slice(_q_starts, 2, greatest(size(_q_starts) - 1, 0)), (x, y) -> least({window}, y - x)), CASE WHEN size(_q_starts) > 0 THEN {window} ELSE 0 END, (s, x) -> s + x)"
    a = a.withColumns(
        {
            "n_words": F.expr("CAST(size(_q_words) AS BIGINT)"),
            "word_chars": F.expr("CAST(length(array_join(_q_words, '')) AS BIGINT)"),
            "n_symbols": F.expr(f"CAST(regexp_count(_q_text, '{_java(SYMBOLS)}') AS BIGINT)"),
            "n_dup_lines": F.expr("CAST(size(_q_lines) - size(array_distinct(_q_lines)) AS BIGINT)"),
            "n_repeat_words": F.expr(f"CAST({covered} AS BIGINT)"),
        }
    )
    return a.drop("_q_words", "_q_hashes", "_q_distinct", "_q_sorted", "_q_starts")


def quality_rules(df: DataFrame, text_col: str = "text", max_lost_percent: int = 50, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """``df`` with the counts of :func:`with_counts`, ``n_lines``, ``n_removed_lines``, ``lost_chars``, ``cleaned``, ``base_failed`` and ``kept``.

    A null text has no words, so it is not kept; the same holds for empty texts. Rows are judged one by one: ties and
    repeated rows change nothing, an empty table stays empty; a very long text takes memory for its words and lines. Columns of ``df`` that carry a result's name are replaced;
    all others are passed on (names that start with ``_q_`` are the operator's own).
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed_lines", "lost_chars", "cleaned", "base_failed", "kept")
    own = F.col(f"`{text_col}`")
    a = with_counts(df.withColumn("_q_in", own).drop(*(c for c in df.columns if c.lower() in names)), "_q_in").drop("_q_in")
    tests = " OR ".join(line_fails("x.l", "x.n").values()).replace("bars", "x.bars").replace("marks", "x.marks").replace("shouts", "x.shouts").replace("ends_well", "x.ends_well").replace("boiler", "x.boiler")
    facts = rf"""named_struct('l', l, 'n', regexp_count(l, '{_java(WORD)}'), 'bars', length(l) - length(replace(l, '|', '')),
        'marks', regexp_count(l, '[#*$%&<>]'), 'shouts', (length(l) - length(replace(l, '!!', ''))) DIV 2,
        'ends_well', l rlike '{_java(TERMINAL)}', 'boiler', lower(l) rlike '{BOILERPLATE}')"""
    a = a.withColumn("_q_facts", F.expr(f"transform(_q_lines, l -> {facts})"))
    a = a.withColumn("_q_good", F.expr(f"transform(filter(_q_facts, x -> NOT ({tests})), x -> x.l)"))
    a = a.withColumn("_q_kept", F.expr("array_distinct(_q_good)"))  # a line that equals an earlier one goes too
    a = a.withColumns({"_q_all": F.expr("length(array_join(_q_lines, ''))"), "_q_left": F.expr("length(array_join(_q_kept, ''))")})
    a = a.withColumns(
        {
            "n_lines": F.expr("CAST(size(_q_lines) AS BIGINT)"),
            "n_removed_lines": F.expr("CAST(size(_q_lines) - size(_q_kept) AS BIGINT)"),
            "lost_chars": F.expr("CAST(_q_all - _q_left AS BIGINT)"),
            "cleaned": F.expr("array_join(_q_kept, '\n')"),
            "base_failed": F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words"),
        }
    )
    a = a.withColumn("kept", F.expr(f"NOT base_failed AND 100 * lost_chars <= {max_lost_percent} * _q_all"))
    return settled(a.drop("_q_text", "_q_lines", "_q_facts", "_q_good", "_q_kept", "_q_all", "_q_left"), names)


def settled(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` with the named columns behind a generator of one row: filters on them stay above it.

    Pushed below, a filter would repeat what it reads of nested expressions, over and over.
    """
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names), F.inline(F.array(F.struct(*names))))


def _java(pattern: str) -> str:
    """A pattern inside a SQL string literal."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``doc_id`` and the counts, ``n_lines``, ``n_removed_lines``, ``lost_chars``, ``base_failed`` and ``kept``."""
    duck = {"punctuation": TERMINAL.replace("'", "''"), "boilerplate": BOILERPLATE}
    tests = " OR ".join(line_fails("l", "n").values())
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w WHERE len(w) >= 8),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS l FROM w),
facts AS (SELECT doc_id, k, l, len(regexp_extract_all(l, '{WORD}')) AS n, length(l) - length(replace(l, '|', '')) AS bars,
  len(regexp_extract_all(l, '[#*$%&<>]')) AS marks, (length(l) - length(replace(l, '!!', ''))) // 2 AS shouts,
  regexp_matches(l, '{duck["punctuation"]}') AS ends_well, regexp_matches(lower(l), '{duck["boilerplate"]}') AS boiler,
  row_number() OVER (PARTITION BY doc_id, l ORDER BY k) AS again FROM ln),
judged AS (SELECT *, {tests} OR again > 1 AS gone FROM facts),
doc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines, coalesce(sum(length(l)) FILTER (gone), 0) AS lost, sum(length(l)) AS chars, count(*) FILTER (again > 1) AS dup FROM judged GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, coalesce(chars, 0) AS chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN doc USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed_lines, lost_chars,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 50 * chars AS kept FROM base"""
