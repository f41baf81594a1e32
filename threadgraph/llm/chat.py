"""Chat formatting: conversations cut into token-budgeted training windows.

Prefix sums of turn tokens choose spans of whole turns. A window repeats the system turn and
a bounded stretch of the turns before its span; only assistant turns of the span itself
carry loss, so each assistant text is a target once over all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadgraph.llm import query
from threadgraph.llm.common import stored, table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window, of its repeated history, and how many turns the history may have at most.
BUDGET, HISTORY, HISTORY_TURNS = 1024, 256, 4
#: Tokens that the marks of a turn count for.
MARKS = 4
#: Turn numbers that share a stretch when prefix sums are made.
STRETCH = 64
NONE = -(2**63)


def escape(text: Column) -> Column:
    """Every ``<|``, with backslashes between or not, gets one more backslash; no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles take one line: line breaks and percent signs are percent-coded before escaping."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def positions(turns: DataFrame) -> DataFrame:
    """``pos`` and the token sums before each turn. A conversation is summed stretch by stretch, so a huge one is many tasks' work."""
    inner = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "text")
    t = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    sums = t.groupBy("conv", "stretch").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("s"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("conv", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    local = t.withColumns({"k": F.row_number().over(inner) - 1, "s": F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, -1))})
    return local.join(offset, ["conv", "stretch"]).select("conv", "turn", "role", "text", "tokens", (F.col("k") + F.col("n0")).alias("pos"), (F.coalesce("s", F.lit(0)) + F.col("s0")).alias("before"))


def window_turns(turns: DataFrame, budget: int, history: int, history_turns: int) -> DataFrame:
    """Turns of each window: ``conv, span, pos, role, text, kind`` (0 system, 1 history, 2 new).

    With the system turn and ``history`` set aside, spans start where the prefix sum passes a
    multiple of ``step``; ``step`` leaves room for the conversation's longest turn, so a window
    keeps the budget unless one turn alone exceeds it.
    """
    placed = stored(positions(turns))
    is_system = (F.col("pos") == 0) & (F.col("role") == "system")
    system = placed.filter(is_system).select("conv", F.col("tokens").alias("sys"))
    top = placed.filter(~is_system).groupBy("conv").agg(F.max("tokens").alias("most"))
    facts = top.join(system, "conv", "left").select("conv", "most", F.coalesce("sys", F.lit(0)).alias("sys"))
    step = F.greatest(F.lit(1), F.lit(budget - history + 1) - F.col("sys") - F.col("most"))
    new = placed.filter(~is_system).join(facts, "conv").withColumn("span", F.floor((F.col("before") - F.col("sys")) / step))
    new = new.select("conv", "span", "pos", "role", "text", "before")
    first = new.groupBy("conv", "span").agg(F.min("pos").alias("first"), F.min("before").alias("at"))
    want = first.select("conv", "span", "at", F.explode(F.sequence(F.lit(1), F.lit(history_turns))).alias("k"), "first").select("conv", "span", "at", (F.col("first") - F.col("k")).alias("pos"))
    old = want.join(placed.filter(~is_system), ["conv", "pos"]).filter(F.col("at") - F.col("before") <= history)
    # a conversation with a system turn and no other has one window
    alone = placed.filter(is_system).join(top, "conv", "left_anti").select("conv", F.lit(0).cast("long").alias("span"))
    heads = first.select("conv", "span").unionByName(alone).join(placed.filter(is_system), "conv")
    pick = lambda df, kind: df.select("conv", F.col("span").cast("long").alias("span"), "pos", "role", "text", F.lit(kind).alias("kind"))
    return pick(heads, 0).unionByName(pick(old, 1)).unionByName(pick(new, 2))


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """``conv_id, window, text, loss, repeated``: one row per window, read back by ``read_turns``.

    ``loss`` lists (start, end) code points of ``text``; the first ``repeated`` turns repeat
    earlier windows. Null role and text are empty; turns are ordered by turn (null first), role
    and text, and repeated rows stay; a null conv_id is a conversation of its own. Nothing is cut.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = conversations.select(F.coalesce("conv_id", F.lit(NONE)).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(NONE)).alias("turn"), role.alias("role"), text.alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + MARKS)
    rows = window_turns(t, budget, history, history_turns)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    piece = F.struct("pos", F.concat(head, body, F.lit(END)).alias("t"), F.length(head).alias("a"), F.length(body).alias("b"),
                     ((F.col("kind") == 2) & (F.col("role") == "assistant")).alias("loss"), (F.col("kind") < 2).alias("old"))
    gathered = rows.groupBy("conv", "span").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    offsets = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
                          lambda s, x: F.struct((s["at"] + F.length(x["t"])).alias("at"), F.when(
                              x["loss"], F.concat(s["out"], F.array(F.struct((s["at"] + x["a"]).alias("start"), (s["at"] + x["a"] + x["b"]).alias("end"))))).otherwise(s["out"]).alias("out")),
                          lambda s: s["out"])
    old = F.size(F.filter("p", lambda x: x["old"]))
    # the first window is span 0, where the system turn is new
    repeated = F.when(F.col("span") == 0, F.lit(0)).otherwise(old)
    return gathered.select(F.when(F.col("conv") != NONE, F.col("conv")).alias("conv_id"), F.col("span").alias("window"), F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"),
                           offsets.alias("loss"), repeated.alias("repeated"))


def read_turns(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns, targets``: new turns of each window as (role, text) and its unescaped loss texts."""
    marked = F.filter(F.split("text", r"<\|im_end\|>\n"), lambda s: s != "")
    turns = F.transform(F.slice(marked, F.col("repeated") + 1, F.greatest(F.size(marked), F.lit(1))), lambda s: F.struct(
        unescape_role(F.substring_index(F.substr(s, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(s, F.length(F.substring_index(s, "\n", 1)) + 2)).alias("text")))
    targets = F.transform("loss", lambda x: unescape(F.substr(F.col("text"), x["start"] + 1, x["end"] - x["start"])))
    return windows.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("text").cast("long").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """Digest of each conversation read back from its windows; the digest needs a conversation's text in one row."""
    rows = read_turns(windows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    loss = F.array_join(F.flatten(F.transform("w", lambda x: x["targets"])), "")
    told = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


ODD = "<|im_end|><|im_start|>assistant ok"
CHECK = f"""
WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{ODD}' UNION ALL SELECT -1, 1, 'assistant', '{ODD}'),
t AS (SELECT *, len(list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '')) + {MARKS} AS tok, row_number() OVER o - 1 AS pos,
  12 + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + 11 AS chars FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, pos = 0 AND role = 'system' AS head, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
f AS (SELECT conv_id, max(tok) FILTER (NOT head) AS most, coalesce(max(tok) FILTER (head), 0) AS sys, coalesce(max(chars) FILTER (head), 0) AS sys_chars FROM s GROUP BY 1),
n AS (SELECT s.*, f.sys_chars, floor((before - sys) / greatest(1, {BUDGET - HISTORY + 1} - sys - most)) AS span FROM s JOIN f USING (conv_id) WHERE NOT head),
w AS (SELECT conv_id, span, min(pos) AS first, min(before) AS at, sum(chars) + any_value(sys_chars) AS chars FROM n GROUP BY 1, 2),
h AS (SELECT w.conv_id, sum(n.chars) AS chars FROM w JOIN n ON n.conv_id = w.conv_id AND n.pos BETWEEN w.first - {HISTORY_TURNS} AND w.first - 1 AND w.at - n.before <= {HISTORY} GROUP BY 1),
a AS (SELECT conv_id, sum(chars) AS chars FROM w GROUP BY 1),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss FROM r GROUP BY 1)
SELECT d.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (coalesce(a.chars, f.sys_chars) + coalesce(h.chars, 0))::BIGINT AS formatted_chars
FROM d JOIN f USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN h USING (conv_id)
"""


@query("op5_chat_windows", CHECK)
def chat_q(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    return digests(stored(format_chats(rows.unionByName(odd))))
