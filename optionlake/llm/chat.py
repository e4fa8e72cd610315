"""Chat formatting from event logs, with DataFrame functions only.

A log has one row per event: conv_id, message (its place in the conversation), seq, kind, role and
text. Events of a message, in order of seq, fold into its final text:

- ``open`` starts the message with a role and no text; a later one starts it anew;
- ``delta`` appends streamed text;
- ``edit`` replaces the text; later deltas append to the new one;
- ``regenerate`` drops the text; the deltas of the new answer follow;
- ``retract`` removes the message, unless it is opened again later.

The fold needs no walk over growing strings: what counts are the events from the last reset on.
A repeated event (all columns equal) counts once, as logs deliver at least once; events of one
seq are taken in order of kind, then text. A message never opened has an empty role. Other kinds
are ignored. Logs are dealt by conversation; messages are folded before they are joined up.

``formatted`` writes the messages of a conversation in order as ``### role: text</turn>`` lines.
In texts and roles a backslash is doubled, neighbouring ``#`` are parted by one backslash and
``</turn>`` becomes ``<\\/turn>``; in roles ``:`` becomes ``\\:`` as well. So control strings occur only
where the template writes them, and ``read_back`` recovers every text. The loss mask holds one span
of code points (start, end) for each turn, null where the turn is not learnt.

Null texts and roles are empty; a null conv_id is a conversation of its own. Extra columns are
ignored. An empty log gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "</turn>\n"


@dataclass(frozen=True)
class ChatSettings:
    """Texts of these roles are under the loss mask."""

    learnt: tuple[str, ...] = ("assistant",)


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, "#(?=#)", r"#\\"), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    joined = F.regexp_replace(F.replace(text, F.lit("<\\/turn>"), F.lit("</turn>")), r"#\\(?=#)", "#")
    return F.replace(joined, F.lit("\\\\"), F.lit("\\"))


def events_of(rows: DataFrame, delta_chars: int = 256) -> DataFrame:
    """The log that streaming ``rows`` (conv_id, turn, role, text) as a chat would leave.

    Messages are the rows in order of turn, role and text. Texts arrive in deltas of
    ``delta_chars`` code points. An assistant's first delta is dropped by a regeneration before the
    answer is streamed whole; in other turns it is a draft that an edit replaces.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    plain = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"),
                        F.col("text").cast("string").alias("text"))
    numbered = plain.select("conv_id", F.row_number().over(order).alias("message"), "role", F.expr(
        f"regexp_extract_all(coalesce(text, ''), '(?s).{{1,{int(delta_chars)}}}', 0)").alias("parts"))
    event = "named_struct('kind', {}, 'text', {})"
    first = "coalesce(get(parts, 0), '')"
    streamed = f"transform(parts, p -> {event.format("'delta'", 'p')})"
    answer = f"concat(array({event.format("'delta'", first)}, " \
             f"{event.format("'regenerate'", 'cast(null as string)')}), {streamed})"
    draft = f"concat(array({event.format("'delta'", "concat(substring(" + first + ", 1, 8), '...')")}, " \
            f"{event.format("'edit'", first)}), {streamed.replace('parts', 'slice(parts, 2, size(parts))')})"
    log = F.expr(f"concat(array({event.format("'open'", 'cast(null as string)')}), "
                 f"if(role = 'assistant', {answer}, {draft}))")
    return numbered.select("conv_id", "message", "role", F.posexplode(log).alias("seq", "event")).select(
        "conv_id", F.col("message").cast("long").alias("message"), F.col("seq").cast("long").alias("seq"),
        "event.kind", F.when(F.col("event.kind") == "open", F.col("role")).alias("role"), "event.text")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final state of every message that is left."""
    log = events.select("conv_id", "message", "seq", "kind", "role",
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = F.array_sort(F.collect_set(F.struct("seq", "kind", "text", "role")))
    # a first pass over the sorted events finds the last reset; texts are joined from there
    state = log.groupBy("conv_id", "message").agg(whole.alias("log")).select(
        "conv_id", "message", "log", F.expr(
            "array_max(transform(log, (e, i) -> if(e.kind in ('open', 'edit', 'regenerate', 'retract'), "
            "i, -1)))").alias("reset"),
        F.expr("array_max(transform(log, (e, i) -> if(e.kind = 'open', i, -1)))").alias("opened"),
        F.expr("array_max(transform(log, (e, i) -> if(e.kind = 'retract', i, -1)))").alias("gone"))
    text = F.expr("array_join(transform(filter(slice(log, greatest(reset, 0) + 1, size(log)), "
                  "e -> e.kind in ('edit', 'delta')), e -> e.text), '')")
    return state.filter("gone < 0 or gone < opened").select(
        "conv_id", "message", F.expr("coalesce(get(log, opened).role, '')").alias("role"),
        text.alias("text"))


def formatted(folded: DataFrame, settings: ChatSettings = ChatSettings()) -> DataFrame:
    """(conv_id, n_turns, formatted, loss): one training text per conversation and its mask."""
    head = F.concat(F.lit("### "), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")),
                    F.lit(": "))
    turns = folded.select("conv_id", "message", "role", head.alias("head"),
                          escaped(F.col("text")).alias("body")).withColumn(
        "size", F.length("head") + F.length("body") + len(END))
    before = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role").isin(*settings.learnt), F.struct(
        F.col("start"), (F.col("start") + F.length("body")).alias("end")))
    placed = turns.withColumn("start", start).select(
        "conv_id", F.struct("message", F.concat("head", "body", F.lit(END)).alias("line"),
                            span.alias("span")).alias("turn"))
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.line"), "").alias("formatted"), F.col("turns.span").alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, at, role, text, learnt, size): the turns in a formatted text and their lengths
    there; ``learnt`` is what the loss mask covers of a turn, unescaped, null if nothing."""
    lines = F.expr(r"slice(split(formatted, '</turn>\\n', -1), 1, size(loss))")
    parts = chats.select("conv_id", F.posexplode(F.arrays_zip(
        lines.alias("line"), F.col("loss").alias("span"))).alias("at", "part"))
    before = W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    header = r"'(?s)^### ([^\\\\:]*+(?:\\\\.[^\\\\:]*+)*+): '"
    sized = parts.select("conv_id", "at", "part.line", "part.span", F.expr(
        f"regexp_extract(part.line, {header}, 0)").alias("head"), F.expr(
        f"regexp_extract(part.line, {header}, 1)").alias("role"),
        (F.length("part.line") + len(END)).alias("size")).withColumn(
        "start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    under = F.when(F.col("span").isNotNull(), unescaped(F.substring(
        F.col("line"), (F.col("span.start") - F.col("start") + 1).cast("int"),
        (F.col("span.end") - F.col("span.start")).cast("int"))))
    return sized.select(
        "conv_id", "at", unescaped(F.replace("role", F.lit("\\:"), F.lit(":"))).alias("role"),
        unescaped(F.substring(F.col("line"), F.length("head") + 1, F.length("line"))).alias("text"),
        under.alias("learnt"), "size")


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation, digests of what is read back from its formatted text."""
    turns = read_back(chats).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text", "learnt"))).alias("turns"),
        F.sum("size").cast("long").alias("formatted_chars"))
    said = F.expr("array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.expr("array_join(transform(turns, t -> t.learnt), '')").alias("learnt"),
        "formatted_chars").select(
            "conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"),
            F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")
