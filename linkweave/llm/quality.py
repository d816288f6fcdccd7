"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Defined cases: a null text has no words and is rejected, like an empty one; a very long text is judged whole, its words
held at once; repeated rows are judged alike; an empty table gives no rows; columns of the input whose names clash with
ours don't matter, as only the named text column is read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.runtime import beside, let, pick

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
BREAK = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages served.
STOP_WORDS = (
    "a and by for in is of on or that the to was with "
    "de des et la le les que qui un une "
    "das der die ein ist und von zu "
    "con del el en las los por y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` leaves [low, high].

    It's judged only where it has ``from_words`` words at least, and ``most_bytes`` bytes for each character at most.
    """

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    most_bytes: float | None = None


#: Lengths, symbols, stop words and lines. Ratios are per word or per line with a word. The stop words are those of
#: languages in Latin letters, so texts mostly in other letters (two bytes or more each) aren't judged by them.
RULES = (
    Rule("word length", "mean_word_chars", 2.0, 16.0),
    Rule("symbols per word", "symbol_ratio", None, 0.3),
    Rule("stop words per word", "stop_ratio", 0.005, None, from_words=200, most_bytes=1.3),
    Rule("repeated lines", "dup_line_ratio", None, 0.5),
    Rule("marks of shouting per word", "shout_ratio", None, 0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``words``.

    Windows are compared by 64-bit hash. Only where one repeats are they sorted, with their places, to find which.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def places(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(
            by_hash,
            lambda s: F.transform(
                F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
                lambda x: x["i"],
            ),
        )
        steps = let(
            F.sort_array(repeated),
            lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(places(h)))
    return F.when(F.size(words) < 3, 0).otherwise(found).cast("long")


def measures(text: Column) -> Column:
    """A struct of every count that rules use, of the whole text."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.trim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    def all_of(w: Column, ln: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            without(SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            without("!").cast("long").alias("n_shouts"),
            F.length(text).cast("long").alias("n_chars"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        )

    return let(words, lambda w: let(lines, lambda ln: all_of(w, ln)))


def ratios(m: Column) -> dict[str, Column]:
    """The measures that rules may name, from the struct of ``measures``."""
    counts = {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_stop")}

    def per(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(m[a].cast("double"), m[b].cast("double")), F.lit(0.0))

    return counts | {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "shout_ratio": per("n_shouts", "n_words"),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def failures(m: Column, rules=RULES) -> list[Column]:
    """One boolean column for each rule of the table."""
    values = ratios(m)
    out = []
    for rule in rules:
        bad = [values[rule.measure] < rule.low] if rule.low is not None else []
        bad += [values[rule.measure] > rule.high] if rule.high is not None else []
        failed = reduce(Column.__or__, bad, F.lit(False))
        if rule.from_words:
            failed = failed & (m["n_words"] >= rule.from_words)
        if rule.most_bytes is not None:
            failed = failed & (m["n_bytes"] <= rule.most_bytes * m["n_chars"])
        out.append(failed)
    return out


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: the id, all counts, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    rows = pick(df, doc_id=id_col, text=text_col).select("doc_id", measures(F.col("text")).alias("m"))
    m = F.col("m")
    named = F.array_compact(F.array(*[F.when(bad, F.lit(rule.name)) for rule, bad in zip(rules, failures(m, rules), strict=True)]))
    return rows.select(
        "doc_id",
        "m.*",
        base_failed(m).alias("base_failed"),
        named.alias("failed_rules"),
        (~reduce(Column.__or__, failures(m, rules), base_failed(m))).alias("kept"),
    )


def keep_good(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df`` that pass, with their columns as they were."""
    plain, at = beside(df)
    judged = plain.withColumn("m", measures(at[text_col]))
    m = F.col("m")
    return judged.filter(~reduce(Column.__or__, failures(m, rules), base_failed(m))).drop("m").toDF(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_shouts", "n_stop")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ln
  FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT r, count(DISTINCT i + k) AS n
      FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g), (VALUES (0), (1), (2)) AS v(k)
      WHERE c > 1 GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words,
         length(t) - length(regexp_replace(t, '[^ \t\n\x0B\f\r]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ln) - len(list_distinct(ln)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         len(ln) AS n_lines,
         length(t) - length(replace(t, '!', '')) AS n_shouts,
         len(list_filter(w, lambda x: list_contains([{stop}], lower(x)))) AS n_stop,
         length(t) AS n_chars, strlen(t) AS n_bytes
  FROM d LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars < 2.0 * n_words OR word_chars > 16.0 * n_words
            OR n_symbols > 0.3 * n_words
            OR (n_words >= 200 AND n_bytes <= 1.3 * n_chars AND n_stop < 0.005 * n_words)
            OR (n_lines > 0 AND n_dup_lines > 0.5 * n_lines)
            OR n_shouts > 0.5 * n_words) AS kept,
       n_lines, n_shouts, n_stop
FROM b
""".replace("{stop}", ", ".join(f"'{w}'" for w in STOP_WORDS))
