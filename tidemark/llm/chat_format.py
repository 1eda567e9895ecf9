"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut at turns into windows of at most ``budget`` tokens. Prefix
sums of the turns' tokens choose the spans: with room B for new turns, a turn that
starts in cell k (from k * B on) and ends in it belongs to that cell's window; one
that runs over the cell's end is the window after it. So spans follow from sums
alone, no window of a conversation has to be known to find the next one, and a
conversation of any length is spread over tasks.

A window repeats the system turn and as many of the turns before it as fit
``history`` tokens. Repeated turns are context: the loss mask covers the text of
assistant turns only where they are new, so each is a target once.

Template: a window is ``<s>``, then for each turn ``[INST]`` role ``[/INST]`` text
``</s>``. In roles and texts a backslash becomes ``\\e``, and the first character of
a control string ``\\l`` (for ``<``) or ``\\s`` (for ``[``), so control strings stand
only where the template put them, and ``unescaped`` gives the text back.

Defined cases: NULL texts and roles are empty; NULL ids are one conversation; turns
of equal (or NULL, first) number follow a digest of role and text, repeated rows
are each a turn; only a first turn is a system turn to repeat; a turn over the room
is alone in its window, which then exceeds the budget rather than lose text, as
does a system turn over it; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ordering import ordered, running
from tidemark.runtime import stage

OPEN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Tokens of the template around a turn.
AROUND = 4
_CONTROL = r"<(/?s>)"
_BRACKET = r"\[(/?INST\])"
#: A system turn is handed out once for so many turns of its conversation.
STRETCH = 256


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return F.regexp_replace(F.regexp_replace(out, _CONTROL, r"\\l$1"), _BRACKET, r"\\s$1")


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and marks; single other signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{M}\p{N}]"))


def _numbered(turns: DataFrame) -> DataFrame:
    """c, pos, turns, role, text, tokens, start (tokens before), total (of the conversation), system_tokens."""
    text, role = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("text", "role"))
    rows = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"same": F.substring(F.sha2(F.concat_ws("\n", "role", "text"), 256), 1, 16), "tokens": (tokens(F.col("text")) + AROUND).cast("long")})
    placed = ordered(rows, ["c", "turn", "same"], "turns")
    # the first row of a conversation is the one of the least place
    place = F.shiftleft(F.col("__part").cast("long"), 33) + F.col("__row")
    first = F.struct((-place).alias("at"), (F.col("role") == "system").alias("system"), "tokens")
    places = running(placed, "c", {"pos": F.lit(1), "start": F.col("tokens")}, {"first": first})
    system = F.when(F.col("__first.system") & (F.col("__total_pos") > 1), F.col("__first.tokens"))
    return places.select("c", F.col("__pos").alias("pos"), F.col("__total_pos").alias("turns"), "role", "text", "tokens", F.col("__start").alias("start"), F.col("__total_start").alias("total"), system.alias("system_tokens"))


def windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """Windows (conv_id, window, formatted, tokens, repeated, targets) of turns (conv_id, turn, role, text).

    ``repeated`` counts the context turns at the window's start; ``targets`` holds
    (start, length) in characters of ``formatted`` of what the loss mask covers.
    """
    if not 0 <= history < budget:
        raise ValueError("history takes less than the budget")
    numbered = _numbered(turns)
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0)))
    cell = F.floor(F.col("start") / F.col("room"))
    over = F.col("start") + F.col("tokens") > (cell + 1) * F.col("room")
    own = numbered.withColumn("room", room).withColumn("window", 2 * cell + F.when(over, 1).otherwise(0))
    own = stage(own.withColumn("several", F.col("total") > F.col("room")).drop("room", "total"), "windowed-turns")
    # a system turn is dealt over stretches of its conversation, so a long one is no hot key of the join
    dealt = own.filter((F.col("pos") == 0) & F.col("system_tokens").isNotNull() & F.col("several"))
    dealt = dealt.select(F.col("c").alias("sc"), F.col("text").alias("system_text"), "system_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("turns") - 1) / STRETCH))).alias("s"))

    many = own.filter("several")
    spans = many.groupBy("c", "window").agg(F.min("start").alias("from"), F.min("pos").alias("first"))
    later = spans.filter(F.col("first") > 0)
    repeated = later.join(dealt, F.col("c").eqNullSafe(F.col("sc")) & (F.floor(F.col("first") / STRETCH) == F.col("s")))
    part = lambda rank, context: F.struct(F.lit(rank).alias("rank"), F.col("pos"), F.col("role"), F.col("text"), F.col("tokens"), F.lit(context).alias("context")).alias("part")
    parts = own.select("c", "window", part(2, False))
    parts = parts.unionByName(
        repeated.select("c", "window", F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.col("system_text").alias("text"), F.col("system_tokens").alias("tokens")).select("c", "window", part(0, True))
    )
    if history:
        # turns that start at most ``history`` tokens before a window: met by equal cells of that width
        wide = F.sequence(F.floor(F.greatest(F.lit(0), F.col("from") - history) / history), F.floor((F.col("from") - 1) / history))
        reach = later.select(F.col("c").alias("wc"), F.col("window").alias("to"), "from", "first", F.explode(wide).alias("w"))
        met = many.join(reach, F.col("c").eqNullSafe(F.col("wc")) & (F.floor(F.col("start") / history) == F.col("w")) & (F.col("pos") < F.col("first")) & (F.col("start") >= F.col("from") - history))
        # the system turn stands there already
        met = met.filter(~((F.col("pos") == 0) & (F.col("role") == "system")))
        parts = parts.unionByName(met.select("c", F.col("to").alias("window"), part(1, True)))

    turn = lambda x: F.concat(F.lit(ROLE), escaped(x["role"]), F.lit(TEXT), escaped(x["text"]), F.lit(END))
    whole = parts.groupBy("c", "window").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = whole.withColumn("turns", F.transform("parts", lambda x: F.struct(turn(x).alias("text"), F.length(escaped(x["text"])).alias("inner"), x["role"].alias("role"), x["context"].alias("context"))))
    # running place of each turn in the formatted text, then the spans of the mask
    begin = F.struct(F.lit(len(OPEN)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    is_target = lambda x: (x["role"] == "assistant") & ~x["context"]

    def step(acc, x):
        end = acc["at"] + F.length(x["text"])
        span = F.struct((end - len(END) - x["inner"]).alias("start"), x["inner"].alias("length"))
        return F.struct(end.alias("at"), F.when(is_target(x), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return whole.select(
        F.col("c").alias("conv_id"),
        "window",
        F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda x: x["text"]), "")).alias("formatted"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]).alias("tokens"),
        F.size(F.filter("parts", lambda x: x["context"])).alias("repeated"),
        F.aggregate("turns", begin, step)["spans"].alias("targets"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted window holds, in order."""
    body = F.substring(formatted, len(OPEN) + 1, 2**31 - 1)
    pieces = F.split(body, r"</s>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last end is empty

    def parse(x):
        inner = F.split(F.substring(x, len(ROLE) + 1, 2**31 - 1), r"\[/INST\]", -1)
        return F.struct(unescaped(inner[0]).alias("role"), unescaped(inner[1]).alias("text"))

    return F.transform(pieces, parse)


def targets_of(formatted: Column, targets: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(targets, lambda x: unescaped(F.substring(formatted, x["start"] + 1, x["length"])))
