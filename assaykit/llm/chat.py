"""Chat formatting: conversations as one text each, with a loss mask, by Spark expressions only.

A template in the ChatML style. Turns are collected as structs, sorted, and adjacent turns of one role are cut out of the array as
one message; a mark stands between the texts that it merges, so reading back gives every turn again:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Control strings begin with `<|`. In texts and roles each `<`, any number of backslashes, `|` gets one backslash more, so `<|` is never
left in them, and taking one away gives the text back. A line end in a role is the mark `<|nl|>`.

The loss mask is a flag for each text between marks, in order: true for those of an assistant. `spans` has the same mask in code points.

Defined for odd rows: a null text or role is empty; turns are ordered by turn (nulls first), then role, then text, so ties and repeated
rows stay, in a fixed order; rows without conv_id belong to no conversation, each is one of its own under a null id; other columns
don't matter, whatever their names; an empty table gives none. A conversation is one cell in the result, so it is put together in one
task; all work on it is linear, and partial lists are made before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import runs, scan
from ..functions.patents import let

START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
ASSISTANT = "assistant"
_SEP, _END = r"<\|im_sep\|>", "<\\|im_end\\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _messages(turns: Column) -> Column:
    """The array of turns cut where the role changes."""
    return runs(turns, lambda x, i: F.get(x, i)["role"] != F.get(x, i - 1)["role"])


def _message(turns: Column) -> Column:
    """Adjacent turns of one role as text."""
    role = F.replace(escape(F.get(turns, F.lit(0))["role"]), F.lit("\n"), F.lit(LINE))
    texts = F.array_join(F.transform(turns, lambda t: escape(t["text"])), SEP)
    return F.concat(F.lit(START), role, F.lit("\n"), texts, F.lit(END))


def chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted and loss (an array of flags) of each conversation."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    named = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = named.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    return turns.select("conv_id", F.array_join(F.transform(_messages(F.col("turns")), _message), "").alias("formatted"), F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text: an array of role and text, escapes undone."""

    def turns(message: Column) -> Column:
        role = unescape(F.replace(F.substring(F.get(message, F.lit(0)), len(START) + 1, 1 << 30), F.lit(LINE), F.lit("\n")))
        return F.transform(F.split(F.get(message, F.lit(1)), _SEP, -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, _END, -1), lambda m: m != ""), lambda m: let(F.split(m, "\n", 2), turns)))


def loss_texts(turns: Column, loss: Column) -> Column:
    """The texts under the mask, of turns read back."""
    return F.transform(F.filter(F.arrays_zip(turns.alias("turn"), loss.alias("loss")), lambda z: z["loss"]), lambda z: z["turn"]["text"])


def spans(formatted: Column, loss: Column) -> Column:
    """The loss mask in code points: start and end of each masked text within the formatted one."""
    mark = "(?:<\\|im_end\\|>\n)?<\\|im_start\\|>[^\n]*\n|<\\|im_sep\\|>|<\\|im_end\\|>\n"

    def walk(marks: Column, texts: Column) -> Column:
        # marks[k] stands before texts[k]
        both = F.arrays_zip(marks.alias("mark"), texts.alias("text"), loss.alias("loss"))
        ends = scan(both, F.lit(0), "bigint", lambda at, z: at + F.length(z["mark"]) + F.length(z["text"]))
        every = let(ends, lambda e: F.transform(both, lambda z, i: F.struct((F.get(e, i) - F.length(z["text"])).alias("start"), F.get(e, i).alias("end"), z["loss"].alias("loss"))))
        return F.transform(F.filter(every, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"]))

    texts = let(F.split(formatted, mark, -1), lambda x: F.slice(x, 2, F.greatest(F.size(x) - 2, F.lit(0))))
    marks = let(F.regexp_extract_all(formatted, F.lit(mark), F.lit(0)), lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
    return walk(marks, texts)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the rows of `chats`: turns and the text under the loss mask, as digests."""
    back = formatted.select("conv_id", "formatted", let(turns_of(F.col("formatted")), lambda t: F.struct(t.alias("turns"), F.array_join(loss_texts(t, F.col("loss")), "").alias("loss"))).alias("back"))
    whole = F.array_join(F.transform("back.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back.turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("back.loss").cast("long").alias("loss_chars"), F.sha2("back.loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
