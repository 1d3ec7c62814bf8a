"""Chat formatting in Spark expressions only: collected turns, merged runs, one string, a loss mask.

The template, for runs of turns of one role::

    <s>[INST]question[/INST]</s><s>[ANS]answer</s>        user, assistant
    <s>[SYS]rules</s><s>[ROLE]tool[TEXT]result</s>        system, any other role
    <s>[NONE]text</s>                                     null role

Turns merged into one run are parted by ``[NEXT]``. Inside texts and role names a backslash is put
after the first character of whatever reads like a control string, also of one already so marked,
which one backslash less undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
MARKS = {"user": "[INST]", "assistant": "[ANS]", "system": "[SYS]"}
OPEN, CLOSE, USER_END, NEXT, OTHER, OTHER_END, NO_ROLE = "<s>", "</s>", "[/INST]", "[NEXT]", "[ROLE]", "[TEXT]", "[NONE]"
_CONTROL = r"(?:/?s>|/?INST\]|ANS\]|SYS\]|NEXT\]|ROLE\]|TEXT\]|NONE\])"
ESCAPE_PATTERN = rf"([<\[])(\\*{_CONTROL})"
UNESCAPE_PATTERN = rf"([<\[])\\(\\*{_CONTROL})"

_TURN = "struct<turn:bigint,role:string,text:string>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE_PATTERN), F.lit(r"$1\\$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE_PATTERN), F.lit("$1$2"))


def _mark(role: Column) -> Column:
    mark = F.when(role.isNull(), F.lit(NO_ROLE))
    for name, text in MARKS.items():
        mark = mark.when(role == name, F.lit(text))
    return mark.otherwise(F.concat(F.lit(OTHER), escaped(role), F.lit(OTHER_END)))


def merged_runs(turns: Column) -> Column:
    """Adjacent turns of the same role as one run of several texts: the places where a role begins part the array into slices."""
    places = F.transform(turns, lambda turn, i: i)
    begins = F.filter(places, lambda i: (i == 0) | ~turns[i]["role"].eqNullSafe(turns[F.greatest(i - 1, F.lit(0))]["role"]))
    ends = F.concat(F.slice(begins, 2, F.size(turns)), F.array(F.size(turns)))
    return F.zip_with(begins, ends, lambda a, b: F.struct(turns[a]["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda turn: turn["text"]).alias("texts")))


def run_segments(run: Column) -> Column:
    """What a run adds to the output: pieces of text, each with whether the loss counts it."""
    spoken = run["role"].eqNullSafe(F.lit("assistant"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    texts = F.flatten(
        F.transform(
            run["texts"],
            lambda text, i: F.when(i > 0, F.array(piece(F.lit(NEXT), F.lit(False)), piece(escaped(text), spoken))).otherwise(F.array(piece(escaped(text), spoken))),
        )
    )
    end = F.when(run["role"].eqNullSafe(F.lit("user")), F.lit(USER_END + CLOSE)).otherwise(F.lit(CLOSE))
    return F.concat(F.array(piece(F.concat(F.lit(OPEN), _mark(run["role"])), F.lit(False))), texts, F.array(piece(end, F.lit(False))))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One formatted string for each conversation.

    Returns ``conv_id``, ``formatted`` and ``segments``: the pieces that make up the string, in
    order, each with ``loss``, true exactly for assistants' texts. Turns are sorted by turn, then
    role, then text, nulls first; a null text counts as empty; repeated rows are turns of their own;
    turns of a null ``conv_id`` form one conversation. Other columns are left out, and an empty table
    gives an empty result. A conversation becomes one string, so its turns meet in one task; partial
    collection before the shuffle sends them there once.
    """
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn.cast(_TURN))).alias("turns"))
    runs = turns.select("conv_id", merged_runs(F.col("turns")).alias("runs"))
    segments = runs.select("conv_id", F.flatten(F.transform("runs", run_segments)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parsed_turns(formatted: Column) -> Column:
    """The turns, as array of role and text, read back from a formatted string."""

    def block(text: Column) -> Column:
        body = F.substring(text, len(OPEN) + 1, 2**31 - 1)
        role, rest = F.lit(None).cast("string"), F.substring(body, len(NO_ROLE) + 1, 2**31 - 1)
        other = body.startswith(OTHER)
        role = F.when(other, unescaped(F.substring_index(F.substring(body, len(OTHER) + 1, 2**31 - 1), OTHER_END, 1))).otherwise(role)
        rest = F.when(other, F.substring(body, F.length(F.substring_index(body, OTHER_END, 1)) + len(OTHER_END) + 1, F.lit(2**31 - 1))).otherwise(rest)
        for name, mark in MARKS.items():
            role = F.when(body.startswith(mark), F.lit(name)).otherwise(role)
            tail = F.substring(body, len(mark) + 1, 2**31 - 1)
            if name == "user":
                tail = F.substring(body, F.lit(len(mark) + 1), F.length(body) - len(mark) - len(USER_END))
            rest = F.when(body.startswith(mark), tail).otherwise(rest)
        return F.transform(F.split(rest, r"\[NEXT\]"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.split(formatted, CLOSE)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a formatted table says: turns from the string, loss text from the mask."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    line = lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))
    return (
        formatted.select("conv_id", parsed_turns(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", line), "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
