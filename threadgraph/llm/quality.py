"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over the text of one row: no shuffle, no user
function, no state beyond the row. Rules are data (name, measure, comparison, bound), so
a caller can pass another table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadgraph.llm import query
from threadgraph.llm.common import SPACE, table

#: Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it with as was on be this by from at are or an have "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et en un une du que est pour qui dans sur au pas par plus avec ne se ce il sont "
    "el los las y que por con para su al lo como más pero sus se no del una"
).split()
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: (rule, measure, comparison that rejects, bound); a rule without a value (empty denominator) does not reject.
RULES: tuple[tuple[str, str, str, float], ...] = (
    ("short_words", "mean_word_chars", "<", 2.0),
    ("long_words", "mean_word_chars", ">", 20.0),
    ("symbols", "symbols_per_word", ">", 0.1),
    ("few_stop_words", "stop_word_ratio", "<", 0.02),
    ("repeated_lines", "dup_line_ratio", ">", 0.5),
    ("bullet_lines", "bullet_line_ratio", ">", 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", ">", 0.5),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measures added; a null text counts as empty.

    Words are runs of other characters than blank and tab to return. Columns with the
    names of measures are replaced. Memory: a few arrays of the words of one row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    step = docs.withColumns({"_w": words, "_l": F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("_w")
    part = lambda k: F.slice("_w", k, n - 2)
    windows = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.sequence(F.lit(1), n - 2).alias("i"))
    step = step.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "n_bullets": F.size(F.filter("_l", lambda s: s.rlike(r"^[\x20\t]*[•*\-–] "))).cast("long"),
        "n_ellipses": F.size(F.filter("_l", lambda s: s.rlike(r"(\.\.\.|…)[\x20\t\r]*$"))).cast("long"),
        # windows sorted by their words: equal ones become neighbours
        "_s": F.when(n >= 3, F.sort_array(windows)),
    })
    last = F.size("_s") - 1
    same = lambda x, y: (x["c"] == y["c"]) & (x["b"] == y["b"]) & (x["a"] == y["a"])
    near = lambda x, k: ((k > 0) & same(x, F.element_at("_s", k))) | ((k < last) & same(x, F.element_at("_s", k + 2)))
    twice = lambda x, k: F.when(near(x, k), x["i"])
    step = step.withColumn("_d", F.array_compact(F.transform("_s", twice)))
    covered = F.array_distinct(F.flatten(F.transform("_d", lambda i: F.array(i, i + 1, i + 2))))
    step = step.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
    step = step.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0)))
    by = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return step.drop("_w", "_l", "_s", "_d").withColumns({
        "mean_word_chars": by("word_chars", "n_words"), "symbols_per_word": by("n_symbols", "n_words"),
        "stop_word_ratio": by("n_stop_words", "n_words"), "dup_line_ratio": by("n_dup_lines", "n_lines"),
        "bullet_line_ratio": by("n_bullets", "n_lines"), "ellipsis_line_ratio": by("n_ellipses", "n_lines"),
    })


def rejected_by(rules: Sequence[tuple[str, str, str, float]]) -> Column:
    """Names of the rules that reject a row, from the measures beside it."""
    compare = {"<": lambda m, b: m < b, ">": lambda m, b: m > b}
    hits = [F.when(compare[op](F.col(m), F.lit(bound)), F.lit(name)) for name, m, op, bound in rules]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: Sequence[tuple[str, str, str, float]] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``rejected_by`` and ``kept``.

    A null or empty text has no words, so it fails the base rule. Repeated rows are
    judged alike; an empty table gives an empty table; other columns pass through.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measures(docs, text).withColumns({"base_failed": failed, "rejected_by": rejected_by(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


_STOP_SQL = ",".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL_BODY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text,'') AS t FROM {{docs}}),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \\t-\\r]+', '', 'g') <> '') AS ls FROM d),
p AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM p) WHERE c > 1),
z AS (SELECT r, count(DISTINCT i + j) AS n FROM q, (SELECT unnest([0,1,2]) AS j) GROUP BY r),
m AS (SELECT w.doc_id, w.t, w.ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(z.n, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS stops,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*[•*\\-–] '))) AS bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*$'))) AS dots
  FROM w LEFT JOIN z USING (r)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
v AS (SELECT *, NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.02
  AND n_dup_lines / len(ls) <= 0.5 AND bullets / len(ls) <= 0.9 AND dots / len(ls) <= 0.5 AS kept FROM f)
"""
CHECK = SQL_BODY.format(docs="documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(kept, false) AS kept FROM v"


@query("op3_quality_rules", CHECK)
def quality_q(spark, sf_dir):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*cols)

