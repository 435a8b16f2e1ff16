"""Chat formatting: every assistant turn becomes an example of its own.

An example is the formatted text of all turns up to and with one assistant
turn; only that reply's text carries loss.  Turns after the last assistant
turn (or of a conversation without one) form one more example without loss, so
that nothing is left out.  Column functions only.

Template.  Assistant turns are `[OUT]text</s>`; any other turn is
`[INST]role:text[/INST]`; an assistant turn whose role is spelled otherwise
than "assistant" does not exist.  In role and text, `%`, `[`, `<` and `:`
(roles only) are written %25, %5B, %3C, %3A, so no control string can occur
inside a turn, and unescaping gives back every text exactly.

Cases: null text or role is empty; a null turn comes first; rows that repeat
the same turn are all kept, ordered by (turn, role, text); an empty table
gives no rows; other columns are ignored; a null conv_id is one conversation.
A conversation's own turns are gathered into one row, since its examples hold
them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
# Control strings of the template and the escapes of their first characters.
OUT, END, INST, INST_END = "[OUT]", "</s>", "[INST]", "[/INST]"
ESCAPES = (("%", "%25"), ("[", "%5B"), ("<", "%3C"))
ROLE_ESCAPES = (*ESCAPES, (":", "%3A"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for raw, coded in pairs:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for raw, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def _formatted(turn: Column) -> Column:
    text = escape(turn["text"])
    own = F.concat(F.lit(OUT), text, F.lit(END))
    other = F.concat(F.lit(INST), escape(turn["role"], ROLE_ESCAPES), F.lit(":"), text, F.lit(INST_END))
    return F.when(turn["role"] == ASSISTANT, own).otherwise(other)


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_length): offsets in code points of text.

    conversations: conv_id, turn, role, text, one row a turn.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.select("conv_id", "turns", F.transform("turns", _formatted).alias("parts"))
    last = F.size("turns")
    ends = F.filter(
        F.transform("turns", lambda t, i: F.when((t["role"] == ASSISTANT) | (i == last - 1), i + 1)), lambda i: i.isNotNull()
    )
    examples = whole.select("conv_id", "turns", "parts", F.posexplode(ends).alias("example", "n_turns"))
    reply = F.element_at("turns", F.col("n_turns"))
    target = F.element_at("parts", F.col("n_turns"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("n_turns") - 1), "")
    trained = reply["role"] == ASSISTANT
    shaped = examples.select("conv_id", "example", "n_turns", context.alias("context"), target.alias("target"), trained.alias("trained"))
    own = F.length("target") - F.lit(len(OUT) + len(END))
    return shaped.select(
        "conv_id", "example", "n_turns", F.concat("context", "target").alias("text"),
        F.when(F.col("trained"), F.length("context") + len(OUT)).otherwise(F.length("context") + F.length("target")).alias("loss_start"),
        F.when(F.col("trained"), own).otherwise(0).alias("loss_length"),
    )


def loss_text(text: Column, start: Column, length: Column) -> Column:
    """The unescaped text under an example's loss mask."""
    return unescape(F.substring(text, start + 1, length))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    pattern = r"(?s)\[OUT\][^\[<]*</s>|\[INST\][^\[<]*\[/INST\]"

    def parse(part: Column) -> Column:
        own = F.startswith(part, F.lit(OUT))
        inner = F.when(own, F.substring(part, F.lit(len(OUT) + 1), F.length(part) - len(OUT) - len(END))).otherwise(
            F.substring(part, F.lit(len(INST) + 1), F.length(part) - len(INST) - len(INST_END))
        )
        colon = F.instr(inner, ":")
        role = F.when(own, F.lit(ASSISTANT)).otherwise(unescape(F.substring(inner, F.lit(1), colon - 1), ROLE_ESCAPES))
        body = F.when(own, inner).otherwise(F.substring(inner, colon + 1, F.length(inner)))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parse)


def digest(examples: DataFrame) -> DataFrame:
    """One row a conversation, computed from the examples' formatted text alone."""
    rows = examples.select(
        "conv_id", "example", "n_turns", F.length("text").alias("chars"),
        F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss")).alias("under"), "text",
    )
    per = rows.groupBy("conv_id").agg(
        F.max(F.struct("n_turns", "text")).alias("longest"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("under")).alias("under")
    )
    per = per.select(
        "conv_id", "formatted_chars", read_turns(F.col("longest.text")).alias("turns"),
        F.array_join(F.transform("under", lambda u: u["loss"]), "").alias("loss"),
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"),
    )
