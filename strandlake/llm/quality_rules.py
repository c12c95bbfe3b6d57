"""Line-first cleaning, with built-in column functions only.

Every line with a word is tested by itself:

- punctuation: its last character ends no sentence (``ENDINGS``);
- navigation: at least ``MIN_SEPARATORS`` of ``|`` and ``>``, one for every ten words or more;
- symbols: over ``MAX_SYMBOLS`` per cent of its characters are of ``#*$%&|<>``;
- shouting: at least ten capital letters A-Z and no small one;
- boilerplate: it holds a phrase of ``PHRASES`` and has ``MAX_PHRASE_WORDS`` words at most.

Lines that fail are removed.  A document is rejected if it loses over ``MAX_LOSS`` per cent of
its words, or fails the base rules: under ``MIN_WORDS`` words, or over ``MAX_REPEAT`` per cent
of them in 8-word windows that occur twice or more in the text.

Windows are compared by 64-bit hashes within one text.  Everything is row-local: no shuffle,
so no key can be hot, and a lost executor repeats its own rows only.

Defined results: a null or empty text has no word, fails the base rules and becomes the empty
text; equal rows get equal results; a null id is kept; further columns are ignored by the
query and kept by ``clean``.  A text is one row however long it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import documents, fresh, without

ENDINGS = ".!?…\"”»)':;"
MIN_SEPARATORS, MAX_SYMBOLS, MAX_PHRASE_WORDS = 3, 10, 40
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "privacy policy", "terms of use", "terms of service",
    "cookie", "javascript", "click here", "subscribe", "sign up", "log in", "powered by", "copyright ©",
)
MIN_WORDS, MAX_REPEAT, MAX_LOSS, WINDOW = 20, 30, 50, 8
#: The white space of the words: U+0020 and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_BLANK_RUN = "[\\x20\\x09-\\x0D]+"
_SYMBOL = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK_RUN), lambda w: w != "")


def _lost_chars(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _line(line: Column, w: Column) -> Column:
    """What the rules need to know of a line and its words."""
    return F.struct(
        line.alias("line"),
        F.size(w).alias("n_words"),
        F.length(F.concat_ws("", w)).alias("chars"),
        _lost_chars(line, _SYMBOL).alias("symbols"),
    )


def _fails(x: Column) -> Column:
    trimmed = F.rtrim(x["line"], F.lit(BLANKS))
    punctuation = ~F.substring(trimmed, -1, 1).isin(*ENDINGS)
    separators = _lost_chars(x["line"], "[|>]")  # both are symbols: most lines have none to count
    navigation = F.when(x["symbols"] >= MIN_SEPARATORS, separators >= F.greatest(F.lit(MIN_SEPARATORS), F.ceil(x["n_words"] / 10))).otherwise(False)
    symbols = 100 * x["symbols"] > MAX_SYMBOLS * x["chars"]
    shouting = ~x["line"].rlike("[a-z]") & (F.length(F.regexp_replace(x["line"], "[^A-Z]", "")) >= 10)
    phrase = F.lower(x["line"]).rlike("|".join(map(re.escape, PHRASES)))
    return punctuation | navigation | symbols | shouting | ((x["n_words"] <= MAX_PHRASE_WORDS) & phrase)


def repeat_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Add ``out``: words of ``words_col`` that lie in a window found twice or more in the row.

    Window hashes are sorted with their places only in rows that have an equal pair.
    """
    n = F.size(words_col)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(words_col), i, F.lit(WINDOW)))))
    df = df.withColumn("_h", hashes)
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(pairs)))
    m = F.size("_s")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    df = df.withColumn("_around", F.zip_with(F.concat(none, F.slice("_s", F.lit(1), m - 1)), F.concat(F.slice("_s", F.lit(2), m - 1), none), lambda a, b: F.struct(a["h"].alias("p"), b["h"].alias("q"))))
    twice = F.zip_with("_s", "_around", lambda x, y: F.when(x["h"].eqNullSafe(y["p"]) | x["h"].eqNullSafe(y["q"]), x["i"]))
    df = df.withColumn("_at", F.array_sort(F.filter(twice, lambda i: i.isNotNull())))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_at", start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_s", "_around", "_at")


#: Columns of the result; input columns of these names are replaced.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_kept_words", "clean_text", "n_repeat_words", "base_failed", "kept")


def assess(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, both verdicts and the cleaned text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    passed = without(docs.columns, *COUNTS)
    # what passes travels in one struct, so that no name can clash
    df = docs.select(F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in passed]).alias("_in"), F.split(text, "\n").alias("_split"))
    df = df.withColumn("_words", F.transform("_split", words))  # a line feed parts words, so these are the text's, too
    df = df.withColumn("_w", F.flatten("_words")).withColumn("_lines", F.filter(F.zip_with("_split", "_words", _line), lambda x: x["n_words"] > 0))
    df = df.withColumn("_good", F.filter("_lines", lambda x: ~_fails(x)))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.concat_ws("", "_w")).cast("long"),
        "n_symbols": F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + x["symbols"]),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct(F.transform("_lines", lambda x: x["line"])))).cast("long"),
        "n_kept_words": F.aggregate("_good", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]),
        "clean_text": F.array_join(F.transform("_good", lambda x: x["line"]), "\n"),
    })
    df = repeat_words(df, "_w", "n_repeat_words").drop("_split", "_words", "_w", "_lines", "_good")
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("n_kept_words")) <= MAX_LOSS * F.col("n_words")))
    return df.select(*[F.col("_in").getField(c).alias(c) for c in passed], *COUNTS)


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the lines that failed removed from their text."""
    own = [c for c in docs.columns if c.lower() in COUNTS]
    moved = dict(zip(own, fresh([*docs.columns, *COUNTS], *[f"_{c}" for c in own])))
    found = assess(docs.withColumnsRenamed(moved), moved.get(text_col, text_col)).where("kept").withColumn(moved.get(text_col, text_col), F.col("clean_text")).drop(*COUNTS)
    return found.withColumnsRenamed({b: a for a, b in moved.items()}).select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, line,
        len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n,
        length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
        length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
        length(line) - length(regexp_replace(line, '[|>]', '', 'g')) AS seps,
        length(regexp_replace(line, '[^A-Z]', '', 'g')) AS caps,
        regexp_matches(line, '[a-z]') AS small,
        right(regexp_replace(line, '[\\x20\\x09-\\x0D]+$', ''), 1) AS last,
        lower(line) AS low FROM l),
p AS (SELECT *, contains({_sql_text(ENDINGS)}, last) AND NOT (seps >= {MIN_SEPARATORS} AND 10 * seps >= n)
          AND NOT 100 * symbols > {MAX_SYMBOLS} * chars AND NOT (NOT small AND caps >= 10)
          AND NOT (n <= {MAX_PHRASE_WORDS} AND ({" OR ".join(f"contains(low, {_sql_text(x)})" for x in PHRASES)})) AS good
      FROM m WHERE n > 0),
lines AS (SELECT doc_id, CAST(sum(symbols) AS BIGINT) AS n_symbols, count(*) - count(DISTINCT line) AS n_dup_lines,
            CAST(coalesce(sum(n) FILTER (good), 0) AS BIGINT) AS n_kept_words FROM p GROUP BY doc_id),
windows AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS v FROM d, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM windows) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({WINDOW}) AS r(k) GROUP BY doc_id),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        coalesce(n_symbols, 0) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_kept_words, 0) AS n_kept_words
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - n_kept_words) <= {MAX_LOSS} * n_words AS kept, n_kept_words FROM b
"""
