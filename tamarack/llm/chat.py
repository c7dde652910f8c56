"""Chat formatting by event sourcing, with DataFrame functions only.

A log holds events of conversations. Within a conversation events are ordered by `seq`, ties by kind,
role and text. Each event names a message by `message` and is one of

- `delta`: its text is appended to the message, which begins if it is new,
- `edit`: its text replaces the message's text so far,
- `regenerate`: the message's text so far is discarded, and its deltas start anew.

The log is partitioned by conversation once; messages are folded and put in order where they are, in time linear in
the events but for sorting. A message's role is the last one that an event gave; messages stand in the order of their
first events, ties by role and text. An event of another kind raises an error. The output is a string in which every turn is `<|im_start|>role\\ntext<|im_end|>\\n`.

Escapes keep control strings inside texts from acting, reversibly: `<\\` becomes `<\\\\`, then `<|` becomes
`<\\|`; in roles a line feed also becomes `<\\n`. `loss` lists the offsets, in code points of the output, of the
assistant texts. Null texts and roles count as empty; an empty log gives no conversation; a null
conversation id is a conversation of its own. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, text_of

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("<\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    if role:
        out = F.replace(out, F.lit("<\\n"), F.lit("\n"))
    return F.replace(out, F.lit("<\\\\"), F.lit("<\\"))


def fold(log: DataFrame) -> DataFrame:
    """Events (conv_id, seq, message, kind, role, text) to messages (conv_id, first_seq, message, role, text)."""
    require(log, "conv_id", "seq", "message", "kind", "role", "text")
    known = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("kind is "), F.coalesce("kind", F.lit("null")))))
    events = log.repartition("conv_id").select("conv_id", "seq", F.col("message").cast("string").alias("message"), known.alias("kind"), "role", text_of().alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), "text")))
    grouped = events.groupBy("conv_id", "message").agg(ordered.alias("events"))
    # Only what follows the last edit or regeneration is left; that event itself counts if it is an edit.
    last = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"] == "delta", F.lit(-1)).otherwise(i)))
    roles = F.filter("events", lambda e: e["role"] != "")
    return grouped.withColumn("last", last).select(
        "conv_id",
        F.col("events")[0]["seq"].alias("first_seq"),
        "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(F.filter("events", lambda e, i: (i >= F.col("last")) & (e["kind"] != "regenerate")), lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """Messages to conversations: conv_id, formatted, loss (array of start, end)."""
    turn = messages.withColumns({"shown_role": escape(F.col("role"), role=True), "shown": escape(F.col("text"))})
    head = len(START) + 1 + F.char_length("shown_role")
    own = Window.partitionBy("conv_id").orderBy("first_seq", "role", "text", "message")
    size = (head + F.char_length("shown") + len(END)).cast("long")
    placed = turn.select("conv_id", F.row_number().over(own).alias("place"), F.col("shown_role").alias("role"), F.col("shown").alias("text"), head.cast("long").alias("head"), (F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("at"))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text", "head", "at"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct((t["at"] + t["head"]).alias("start"), (t["at"] + t["head"] + F.char_length(t["text"])).alias("end")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    return turns.select("conv_id", text.alias("formatted"), spans.alias("loss"))


def format_log(log: DataFrame) -> DataFrame:
    return render(fold(log))


def parse(formatted: Column) -> Column:
    """The output read back: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"\Q" + START + r"\E"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1), role=True).alias("role"),
            unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.char_length(p) - F.instr(p, F.lit("\n")) - len(END))).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


#: How far apart the numbers of a turn's events are from those of the next, less than which a turn's last event comes late.
STEP = 8


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """The log that a table (conv_id, turn, role, text) could come from; rows of the same turn are messages of their own.

    Each text comes in three deltas, of which the last arrives amid the next turn's. By hash, some messages begin with a draft that is discarded when
    they are generated again, and some with words out of place that an edit replaces. Turns are under 2**59; a null turn comes first.
    """
    require(conversations, "conv_id", "turn", "role", "text")
    own = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 59))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"), F.monotonically_increasing_id().alias("message"))
    third = F.ceil(F.char_length("text") / 3).cast("int")
    part = lambda i: F.substring("text", i * third + 1, third)
    event = lambda k, kind, text: F.struct((F.col("turn") * STEP + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    rest = [event(3, "delta", part(1)), event(STEP + 4, "delta", part(2))]
    plain = F.array(event(0, "delta", part(0)), *rest)
    again = F.array(event(0, "delta", part(2)), event(1, "regenerate", F.lit("")), event(2, "delta", part(0)), *rest)
    edited = F.array(event(0, "delta", part(1)), event(1, "delta", F.lit("?")), event(2, "edit", part(0)), *rest)
    draw = F.pmod(F.xxhash64("conv_id", "turn", "role"), F.lit(4))
    events = F.when(draw == 0, again).when(draw == 1, edited).otherwise(plain)
    return own.select("conv_id", "message", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "message", "e.kind", "role", "e.text")


def digest(formatted: DataFrame) -> DataFrame:
    """What the output holds, read back from it."""
    rows = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
