"""Chat formatting: event-sourced reconstruction of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, first_seq, role, text): the final messages that a log (conv_id, seq, kind, message, role, text) adds up to.

    Events of a conversation apply in the order of seq (ties: by kind, then text). For a message:
    ``message`` begins it, anew and in a new place if it is there already, ``delta`` appends to it, ``edit``
    replaces its text, ``regenerate`` empties it so that later deltas build another version. ``edit`` and
    ``regenerate`` also take back every message that was begun after that message and before the event; its
    number may be used again. The role is the last one stated. Rows that are equal throughout are one event, delivered twice. Rows with a null
    conversation, seq or message are dropped; other kinds, and null ones, are ignored; null texts are empty.
    """
    # partitioned by conversation once; what follows keeps that partitioning
    clean = (
        events.select("conv_id", "seq", "kind", "message", "role", F.coalesce("text", F.lit("")).alias("text"))
        .where("conv_id is not null and seq is not null and message is not null and kind in ('message', 'delta', 'edit', 'regenerate')")
        .repartition("conv_id")
        .distinct()
    )
    reset = F.col("kind").isin("message", "edit", "regenerate")
    rewind = F.col("kind").isin("edit", "regenerate")
    so_far = Window.partitionBy("conv_id", "message").orderBy("seq", "kind", "text").rowsBetween(Window.unboundedPreceding, 0)
    lives = clean.withColumn("life", F.coalesce(F.max(F.when(F.col("kind") == "message", F.col("seq"))).over(so_far), F.min("seq").over(so_far)))
    folded = lives.groupBy("conv_id", "message", "life").agg(
        F.min("seq").alias("first_seq"),
        F.max(F.when(reset, F.struct("seq", "kind", "text"))).alias("reset"),
        F.max(F.when(rewind, F.col("seq"))).alias("rewound"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "text"))).alias("role"),
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"),
    )
    # array_sort puts the events in order; those before the last reset no longer count, nor does a regenerate's text
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e > F.col("reset")) | (e == F.col("reset")))
    parts = F.transform(live, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
    messages = folded.select("conv_id", "message", "life", "first_seq", "rewound", "role", F.array_join(parts, "").alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("first_seq", "message").rowsBetween(Window.unboundedPreceding, -1)
    stands = F.coalesce(F.max("rewound").over(earlier) <= F.col("first_seq"), F.lit(True))
    last = F.col("life") == F.max("life").over(Window.partitionBy("conv_id", "message"))
    return messages.withColumn("stands", stands & last).where("stands").select("conv_id", "message", "first_seq", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, text): each conversation in one text, its messages in order between control marks.

    A control mark within a text loses its bars, so that a message can't end itself. Null roles are ``user``.
    """
    safe = F.replace(F.replace(F.col("text"), F.lit(OPEN), F.lit("<im_start>")), F.lit(CLOSE), F.lit("<im_end>"))
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("user")), F.lit("\n"), safe, F.lit(f"{CLOSE}\n"))
    listed = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "message", line.alias("line")))).alias("all"))
    return listed.select("conv_id", F.size("all").cast("long").alias("n_messages"), F.array_join(F.transform("all", lambda m: m["line"]), "").alias("text"))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log that a client streaming these turns (conv_id, turn, role, text) could have left.

    Rows of a conversation are its messages 1, 2, ... in the order of turn, role and text (nulls first), so rows of one turn
    are several messages. A message is begun, and comes as a delta for each line. By its number the log also holds what
    was taken back: every third message is first drafted in capitals and regenerated; for every fifth a draft of the
    message is begun, then the message before it is edited to the text that it has, which takes the draft back, and
    the message is begun again. Rows without a conversation or turn are left out.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    text = F.coalesce("text", F.lit(""))
    numbered = turns.where("conv_id is not null and turn is not null").select(
        "conv_id", "role", text.alias("text"), F.row_number().over(by_turn).cast("long").alias("message"), F.lag(text).over(by_turn).alias("before")
    )
    event = lambda kind, message, piece: F.struct(F.lit(kind).alias("kind"), message.alias("message"), piece.alias("piece"))
    at, none = F.col("message"), F.lit("")
    deltas = F.transform(F.split("text", "\n"), lambda x, i: event("delta", at, F.when(i == 0, x).otherwise(F.concat(F.lit("\n"), x))))
    drafted = F.array(event("delta", at, F.upper("text")))
    events = (
        F.when((at % 5 == 0) & (at > 1), F.concat(F.array(event("message", at, none)), drafted, F.array(event("edit", at - 1, F.col("before")), event("message", at, none)), deltas))
        .when(at % 3 == 0, F.concat(F.array(event("message", at, none)), drafted, F.array(event("regenerate", at, none)), deltas))
        .otherwise(F.concat(F.array(event("message", at, none)), deltas))
    )
    flat = numbered.select("conv_id", "message", "role", F.posexplode(events).alias("nth", "e"))
    role = F.when(F.col("e.kind") == "message", F.col("role")).alias("role")
    return flat.select("conv_id", (F.shiftleft("message", 31) + F.col("nth")).alias("seq"), F.col("e.kind").alias("kind"), F.col("e.message").alias("message"), role, F.col("e.piece").alias("text"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    return render(fold(events_of_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = f"""select conv_id, count(*)::bigint as n_messages, string_agg('{OPEN}' || coalesce(role, 'user') || chr(10) || replace(replace(coalesce(text, ''), '{OPEN}', '<im_start>'), '{CLOSE}', '<im_end>') || '{CLOSE}' || chr(10), '' order by turn) as text
from conversations where conv_id is not null and turn is not null group by conv_id"""
