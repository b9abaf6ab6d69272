"""Chat formatting: event-sourced reconstruction of conversations, then rendering.

An event log holds one row for each event of a conversation::

    conv_id, seq, kind, msg, role, text, and optionally part

``kind`` is one of

* ``open``: message ``msg`` begins, with its role; ``text`` is not used;
* ``delta``: ``text`` is appended to message ``msg``;
* ``edit``: ``text`` replaces what message ``msg`` holds so far;
* ``regenerate``: message ``msg`` is emptied (``text`` starts it anew), later deltas fill it;
* ``message`` (or null): a whole message by itself; ``msg`` is not used.

The log is dealt by conversation, once. Within a conversation the events of a message are sorted by seq,
then by part (the place within an event that was cut up), and folded: the last ``edit``, ``regenerate``
or ``message`` and what follows it. A message stands where its first event stands; a running sum of
lengths over the messages gives the byte span of each body within the rendered text.

Defined cases: null text is empty text; null role is an empty role (a message has the first role that one
of its events names); null ``conv_id`` is a conversation of its own; events without ``seq`` come last;
events that tie in seq and part are ordered by kind, role and text, messages that tie by role, text and
name; repeated whole messages are all kept, one after the other; an empty log gives no rows; other
columns are ignored, whatever their names. A conversation is one output row, so it has to fit Spark's
limit of 2 GB for a row; within that, any number of turns and any length of text takes linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlode.llm.common import let

#: Control strings of the template.
OPEN, ROLE_END, CLOSE = "### ", ":\n", "</turn>\n"
#: Places inside a text where a backslash goes in: before a backslash, and inside a control string.
_BREAK = r"\\|(?<=<)/(?=turn>)|(?<=#)#(?=#)|(?<=:)\n"
_RESETS = ("edit", "message", "regenerate")
#: Code points of a delta that a written turn is cut into.
DELTA = 4096


def escape(text: Column) -> Column:
    """Break up every control string (and double every backslash) so that none can occur in a text."""
    return F.regexp_replace(text, _BREAK, r"\\$0")


def unescape(text: Column) -> Column:
    """The exact inverse of :func:`escape`: each backslash gives way to the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """The event log of written turns (conv_id, turn, role, text): each opens a message and streams its text."""
    pieces = F.transform(
        F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)),
        lambda t, i: F.struct(F.lit("delta").alias("kind"), (i + 1).alias("part"), F.lit(None).cast("string").alias("role"), t.alias("text")),
    )
    opened = F.struct(F.lit("open").alias("kind"), F.lit(0).alias("part"), F.col("role").alias("role"), F.lit(None).cast("string").alias("text"))
    named = turns.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().cast("string").alias("msg"), "role", "text")
    return named.select("conv_id", "seq", "msg", F.explode(F.concat(F.array(opened), pieces)).alias("e")).select("conv_id", "seq", "msg", "e.*")


def fold_events(log: DataFrame) -> DataFrame:
    """One row for each final message: conv_id, order (struct), role, text; dealt by conv_id."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    part = F.col("part") if "part" in log.columns else F.lit(0)
    name = F.when(kind == "message", F.concat(F.lit("="), F.monotonically_increasing_id())).otherwise(F.concat(F.lit("/"), F.coalesce(F.col("msg").cast("string"), F.lit(""))))
    event = F.struct(
        F.col("seq").isNull().alias("late"),
        F.col("seq").cast("long").alias("seq"),
        part.cast("long").alias("part"),
        kind.alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.when(kind == "open", F.lit("")).otherwise(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
    # one exchange: what is grouped by conversation and message is already dealt by conversation
    dealt = log.select("conv_id", name.alias("msg"), event.alias("e")).repartition("conv_id")
    ev = F.col("ev")
    last_reset = F.array_max(F.transform(ev, lambda e, i: F.when(e["kind"].isin(*_RESETS), i).otherwise(F.lit(0))))
    body = F.array_join(F.transform(F.slice(ev, last_reset + 1, F.size(ev)), lambda e: e["text"]), "")
    named = F.filter(ev, lambda e: e["role"] != "")
    folded = dealt.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list("e")).alias("ev"))
    folded = folded.select("conv_id", "msg", ev[0]["late"].alias("late"), ev[0]["seq"].alias("seq"), F.coalesce(F.get(named, F.lit(0))["role"], F.lit("")).alias("role"), body.alias("text"))
    return folded.select("conv_id", F.struct("late", "seq", "role", "text", "msg").alias("order"), "role", "text")


def format_chats(log: DataFrame, trained: str = "assistant") -> DataFrame:
    """Fold the log and render each conversation.

    Returns conv_id, ``formatted`` (the training text) and ``spans``, an array of struct(start, bytes):
    the parts of ``formatted``, in bytes of its UTF-8 form from 0, that are trained on.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    pieces = fold_events(log).select("conv_id", "order", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained).alias("loss"))
    piece = F.concat("head", "body", F.lit(CLOSE))
    before = F.sum(F.octet_length("head") + F.octet_length("body") + len(CLOSE)).over(Window.partitionBy("conv_id").orderBy("order"))
    placed = pieces.withColumn("end", before.cast("long"))
    span = F.struct((F.col("end") - len(CLOSE) - F.octet_length("body")).alias("start"), F.octet_length("body").cast("long").alias("bytes"))
    turns = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("end", piece.alias("piece")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), span))).alias("spans"),
    )
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), "spans")


def parse_chats(formatted: Column) -> Column:
    """Turns read back from a rendered text: array of struct(role, text)."""
    parts = F.split(formatted, CLOSE.replace("\n", "\\n"))

    def turn(part: Column) -> Column:
        at = F.instr(part, ROLE_END)
        return F.struct(
            unescape(F.substring(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(part, at + len(ROLE_END), F.length(part))).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask: cut out of the rendered text by their spans, unescaped."""
    return let(F.encode(formatted, "UTF-8"), lambda b: F.transform(spans, lambda s: unescape(F.decode(F.substring(b, (s["start"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8"))))


def chat_digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of rendered conversations, all read back from ``formatted`` and its mask."""
    read = chats.select("conv_id", "formatted", parse_chats(F.col("formatted")).alias("turns"), F.array_join(masked_texts(F.col("formatted"), F.col("spans")), "").alias("loss_text"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
