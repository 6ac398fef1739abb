"""Chat formatting with a grammar round trip.

Grammar: ``formatted := turn*`` and
``turn := <|im_start|> role \\n text <|im_end|> \\n``.  ``parse`` is a
deterministic parser of it, written with DataFrame functions.  A conversation
is rendered as it is, parsed again and compared with its source; turns that do
not come back are escaped and it is rendered again, until both are identical.

Escape: one backslash goes into each ``<|`` (``<\\|`` gets a second one, and so
on); the parser takes one out of each ``<\\...|``.  Roles are percent-encoded
for ``%``, line feed and ``|``.

Defined results: rows are ordered by turn, then role, then text (null turns
first), so ties are stable and repeated rows stay; a null text or role is the
empty string; a null conv_id is one conversation of its own; an empty table
gives no rows; other columns are ignored.  A conversation is one output value,
so all of its turns meet in one row; different conversations never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
START_PATTERN = r"<\|im_start\|>"
ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("|", "%7C"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def encode_role(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def decode_role(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def head(role: Column) -> Column:
    return F.concat(F.lit(START), encode_role(role), F.lit("\n"))


def render(turns: Column) -> Column:
    """turns: array of (role, text), text as it shall stand in the output."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END + "\n"))))


def parse(formatted: Column) -> Column:
    """Array of (role, text) that the grammar reads; null if the text isn't of the grammar."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2)
        text = F.substring_index(body, END, 1)
        rest = F.substr(body, F.length(text) + 1)
        return F.when(rest == END + "\n", F.struct(decode_role(role).alias("role"), unescape(text).alias("text")))

    parts = F.split(formatted, START_PATTERN, -1)
    turns = F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)
    return F.when((F.element_at(parts, 1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def conversations_of(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return rows.groupBy("conv_id").agg(ordered.alias("rows")).select(
        "conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of (start, end): code points of ``formatted``, end exclusive)."""

    def again(turns: Column, alone: bool) -> Column:
        def one(t: Column) -> Column:
            back = parse(render(F.array(t)))
            text = F.when(back.eqNullSafe(F.array(t)), t["text"]).otherwise(escape(t["text"])) if alone else escape(t["text"])
            return F.struct(t["role"].alias("role"), text.alias("text"))

        return F.transform(turns, one)

    df = conversations_of(rows).withColumn("out", F.col("turns"))
    for alone in (True, False):
        same = parse(render(F.col("out"))).eqNullSafe(F.col("turns"))
        df = df.withColumn("out", F.when(same, F.col("out")).otherwise(again(F.col("turns"), alone)))
    formatted = render(F.col("out"))
    df = df.withColumn("formatted", formatted)
    same = parse(F.col("formatted")).eqNullSafe(F.col("turns"))
    df = df.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))))
    pieces = F.transform("out", lambda t: F.struct((t["role"] == loss_role).alias("on"), F.length(head(t["role"])).alias("before"), F.length(t["text"]).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + p["before"]
        last = first + p["own"]
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct((last + len(END) + 1).alias("at"), F.when(p["on"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(pieces, start, step, lambda acc: acc["spans"])
    return df.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss mask hold."""
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    df = formatted.withColumn("back", parse(F.col("formatted"))).withColumn("loss", F.concat_ws("", masked))
    told = F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return df.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
