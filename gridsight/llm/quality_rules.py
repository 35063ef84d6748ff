"""Quality rules: a table of thresholds compiled into one Spark projection.

Measures are Spark expressions over the words and lines of a text, and a rule is a
measure with a lowest and a highest value. All rules become columns of one projection, so
a text is read once, no row is shuffled and no user function runs.

Defined results: a null text counts as empty; an empty or very short text fails the word
count and has ratios of 0; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsight.llm.registry import SPACE, bind, query, read

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as are this was by or from "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch für "
    "le la les et en un une du dans que est pour qui sur pas au avec "
    "el los las y por con no se lo para su como más o").split()


@dataclass(frozen=True)
class Rule:
    """`measure` must lie in [low, high]; a bound of None is open."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Bounds are wide: a rule is to catch junk, not to judge style.
RULES = (
    Rule("too_few_words", "n_words", low=20),
    Rule("word_length", "mean_word_length", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.15),
    Rule("letters", "letter_word_ratio", low=0.6),
    Rule("capitals", "capital_ratio", high=0.6),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("repeated_words", "repeat_word_ratio", high=0.3),
)


def repeat_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more, the first one included.

    Windows are hashed. Only if two hashes agree are they sorted with their places; the
    places that share a hash, in order, then cover min(8, gap to the next) words each.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        shared = bind(placed, lambda s: F.filter(s, lambda x, i: (
            F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))))
        places = F.sort_array(F.transform(shared, lambda x: x["i"]))
        widths = bind(places, lambda p: F.transform(p, lambda x, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda total, x: total + x)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
                           lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def count(w: Column) -> Column:
        return F.when(F.size(w) > WINDOW, bind(hashes(w), lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0)

    return bind(words, count).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...ratios)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col), text.alias("_text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
        .alias("_lines"))
    counted = split.select(
        id_col, F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stops"),
        F.size(F.filter("_words", lambda w: F.lower(w) != F.upper(w))).alias("_with_letter"),
        F.size(F.filter("_words", lambda w: (F.upper(w) == w) & (F.lower(w) != w)
                        & (F.char_length(w) > 1))).alias("_capitals"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return counted.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("_with_letter", "n_words").alias("letter_word_ratio"),
        share("_capitals", "n_words").alias("capital_ratio"),
        share("_stops", "n_words").alias("stop_word_ratio"),
        share("n_dup_lines", "_n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_word_ratio"))


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of `measures` breaks, in table order."""
    broken = []
    for rule in rules:
        low = F.col(rule.measure) < rule.low if rule.low is not None else F.lit(False)
        high = F.col(rule.measure) > rule.high if rule.high is not None else F.lit(False)
        broken.append(F.when(low | high, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def _broken_sql(rule: Rule) -> str:
    bounds = [f"{rule.measure} < {rule.low}"] if rule.low is not None else []
    bounds += [f"{rule.measure} > {rule.high}"] if rule.high is not None else []
    return f"CASE WHEN {' OR '.join(bounds)} THEN '{rule.name}' END"


_IN_STOP_WORDS = "lower(x) IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
ORACLE = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS words
  FROM split, unnest(range(1, len(words) - {WINDOW - 2})) u(i) WHERE len(words) >= {WINDOW}),
twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) r(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: {_IN_STOP_WORDS})) AS stops,
    len(list_filter(words, lambda x: lower(x) <> upper(x))) AS letters,
    len(list_filter(words, lambda x: upper(x) = x AND lower(x) <> x AND len(x) > 1)) AS capitals
  FROM split LEFT JOIN covered USING (doc_id)),
measured AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length,
    coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
    coalesce(letters / nullif(n_words, 0), 0) AS letter_word_ratio,
    coalesce(capitals / nullif(n_words, 0), 0) AS capital_ratio,
    coalesce(stops / nullif(n_words, 0), 0) AS stop_word_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counted),
judged AS (
  SELECT *, list_filter([{', '.join(map(_broken_sql, RULES))}], lambda x: x IS NOT NULL) AS broken
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS failed_rules
FROM judged
"""


@query("op8_quality_rules", ORACLE)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every document."""
    found = measures(read(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("failed_rules", failures()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size("failed_rules") == 0)).alias("kept"),
        F.array_join("failed_rules", ",").alias("failed_rules"))
