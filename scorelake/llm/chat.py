"""Chat formatting with budgeted windows (native).

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a turn
belongs to the window in which the tokens before it fall. Each window opens with
the conversation's leading system turn, repeats up to ``history`` tokens of the
turns before it, and then holds its own turns. The loss mask covers the
assistant texts of a window's own turns only, so each is a target once.

Template: ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and texts a backslash
goes before each backslash and into each control string after its first
character; removing one backslash before each character gives the text back.

Defined results: null roles and texts are empty; turns of equal number are
ordered by role and text; a null conversation id is one conversation of its own;
a turn longer than the budget is a window by itself, never cut; extra columns
are ignored; an empty table gives no windows. One conversation is one row of
turns: that bound is the conversation's own length, as its digest needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import text_of

TURN, END = "<|turn|>", "<|end|>"
#: Strings that other templates take as marks are escaped along with this one's own.
CONTROL = r"<\||</s>|<s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
BUDGET, HISTORY = 512, 128


def escape(text: Column) -> Column:
    """A backslash before each backslash and after the first character of each control string."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"(?=(?:{CONTROL}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """An escaped role keeps its line breaks off the header's end."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def windows(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """``conv_id window formatted loss n_lead``.

    loss: array of (start, end), code points of ``formatted``. The first
    ``n_lead`` turns of a window are repeats; the rest are its own. ``history``
    is at most ``budget``, so that repeats come from the window just before.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must lie between 0 and the budget")
    t = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")
    )
    t = t.select("*", F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.concat(F.lit(TURN), _role(F.col("role")), F.lit("\n"))
    t = t.select(
        "conv_id", F.row_number().over(order).alias("ord"), "role", before.alias("before"),
        F.floor(before / budget).alias("window"), head.alias("head"), escape(F.col("text")).alias("body"),
    )
    opens = (F.col("ord") == 1) & (F.col("role") == "system")
    upto = Window.partitionBy("conv_id").orderBy("ord")
    following = Window.partitionBy("conv_id").orderBy("window").rangeBetween(1, 1)
    end = F.lit(END + "\n")
    t = t.select(
        "*", F.first(F.when(opens, F.concat("head", "body", end))).over(upto).alias("system"),
        F.min("before").over(following).alias("next"),
    )
    in_next = F.col("before") >= F.col("next") - history
    item = lambda again: F.struct("ord", F.lit(again).alias("again"), "role", "head", "body")
    t = t.select(
        "conv_id", F.when((F.col("ord") > 1) | ~opens, F.col("system")).alias("system"),
        opens.alias("opens"),
        F.explode(
            F.filter(
                F.array(
                    F.struct("window", item(False).alias("x")),
                    F.when(in_next & ~opens, F.struct((F.col("window") + 1).alias("window"), item(True).alias("x"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("e"),
    )
    own_system = F.max(F.col("opens") & ~F.col("e.x.again"))
    each = t.groupBy("conv_id", F.col("e.window").alias("window")).agg(
        F.array_sort(F.collect_list("e.x")).alias("all"),
        F.first("system", ignorenulls=True).alias("system"), own_system.alias("own_system"),
    )
    lead = F.when(F.col("own_system"), F.lit("")).otherwise(F.coalesce("system", F.lit("")))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END) + 1
    # running ends of the turns, by one fold
    fold = F.aggregate(
        "all",
        F.struct(F.length(lead).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.when(
                (x["role"] == "assistant") & ~x["again"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["head"])).alias("start"),
                            (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    repeats = F.size(F.filter("all", lambda x: x["again"])) + (F.length(lead) > 0).cast("int")
    return each.select(
        "conv_id", "window",
        F.concat(lead, F.array_join(F.transform("all", lambda x: F.concat(x["head"], x["body"], end)), "")).alias("formatted"),
        fold["spans"].alias("loss"), repeats.alias("n_lead"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted window, unescaped: array of (role, text)."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    head = r"(?s)^((?:[^\\\n]|\\.)*)\n"

    def one(x: Column) -> Column:
        raw = F.regexp_extract(x, head, 1)
        body = F.substr(x, F.length(raw) + 2, F.length(x) - F.length(raw) - 1 - len(END) - 1)
        return F.struct(unescape(raw).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id turns loss_text formatted_chars``, from what the windows hold alone."""
    own = F.slice(parse(F.col("formatted")), F.col("n_lead") + 1, 1 << 30)
    loss = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    rows = formatted.select(
        "conv_id", F.struct("window", own.alias("own"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("w")
    )
    back = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w"), lambda a, b: (a["window"] - b["window"]).cast("int")).alias("ws"))
    return back.select(
        "conv_id",
        F.flatten(F.transform("ws", lambda w: w["own"])).alias("turns"),
        F.array_join(F.flatten(F.transform("ws", lambda w: w["loss"])), "").alias("loss_text"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda acc, w: acc + w["chars"]).alias("formatted_chars"),
    )


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one, -7, whose texts are control strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": F.when(F.col("id") == 0, "user").otherwise("assistant"), "text": F.lit(odd)}
    more = spark.range(2).select(*(c.cast(turns.schema[name].dataType).alias(name) for name, c in rows.items()))
    back = read_back(windows(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESCAPED = r"(length({0}) + length(regexp_replace({0}, '[^\\]', '', 'g')) + len(regexp_extract_all({0}, '<\||</s>|<s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]')))"
#: A window's characters are those of its turns, of the turns it repeats, and of the system turn where that isn't among its own.
OP6_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
  SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\t-\r ]')) AS tokens,
    {len(TURN) + len(END) + 2} + {_ESCAPED.format("role")} + length(regexp_replace(role, '[^\n]', '', 'g')) + {_ESCAPED.format("text")} AS chars
  FROM t
), b AS (
  SELECT *, row_number() OVER w AS ord, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), n AS (
  SELECT *, CAST(before // {BUDGET} AS BIGINT) AS win, ord = 1 AND role = 'system' AS opens FROM b
), r AS (
  SELECT *, before >= min(before) OVER (PARTITION BY conv_id ORDER BY win RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) - {HISTORY} AND NOT opens AS again FROM n
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + coalesce(sum(chars) FILTER (again), 0) + coalesce(sum(chars) FILTER (opens), 0) * (count(DISTINCT win) - 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""
