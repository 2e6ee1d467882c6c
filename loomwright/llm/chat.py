"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the formatted turns
before it are context, and only its text is under the loss mask. A
conversation that doesn't end with an assistant turn gets one more
example without a target, so no turn is lost.

A turn is formatted as `<|role|>` newline text `</s>` newline. Control
strings of this and other common templates cannot occur in a formatted
role or text: a backslash goes inside each, and backslashes double, which
unescape() undoes exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings: `<|`, `|>`, `<s>`, `</s>`, `<<SYS>>`, `<</SYS>>`, `[INST]`, `[/INST]`; each is cut after its first character.
CONTROL = (r"(<)(\||/?s>|</?SYS>>)", r"(\[)(/?INST\])", r"(\|)(>)")
TURN_END = "</s>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for pattern in CONTROL:
        text = F.regexp_replace(text, pattern, r"$1\\$2")
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per example: conv, example (from 1), last (the conversation's last example), formatted, loss_start and loss_end.

    The loss mask covers formatted[loss_start:loss_end) in code points; both
    are null in the example without a target. Turns are ordered by turn,
    then role, then text, so ties and repeated rows have one order; a null
    turn comes first. Null roles and texts count as empty. Rows with a
    null conversation id are one conversation. Other columns are ignored,
    an empty table has no examples. An example holds its whole context,
    so output grows with the square of a conversation's turns by nature;
    conversations are spread over tasks by id.
    """
    part = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = df.select(F.col(conv_col).alias("conv"), part.alias("t"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # head and body of each turn; lengths give the places of the loss mask
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == target_role).alias("target")))
    said = whole.select("conv", parts.alias("parts"))
    n = F.size("parts")
    wanted = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["target"] | (i == n))
    examples = said.select("conv", "parts", F.size(wanted).alias("examples"), F.posexplode(wanted).alias("at", "upto"))
    used = F.slice("parts", 1, F.col("upto"))
    final = F.element_at("parts", F.col("upto"))
    formatted = F.array_join(F.transform(used, lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "")
    out = examples.select("conv", (F.col("at") + 1).alias("example"), (F.col("at") + 1 == F.col("examples")).alias("last"), formatted.alias("formatted"), final["target"].alias("target"), F.length(final["body"]).alias("size"))
    end = F.when(F.col("target"), F.length("formatted") - len(TURN_END))
    return out.select("conv", "example", "last", "formatted", (end - F.col("size")).alias("loss_start"), end.alias("loss_end"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text), unescaped."""
    turns = F.split(formatted, TURN_END)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    return F.transform(turns, lambda t: F.struct(unescape(F.substring(t, F.lit(3), F.instr(t, "|>") - 3)).alias("role"), unescape(F.substring(t, F.instr(t, "|>") + 3, F.length(t))).alias("text")))


def masked(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped; empty if there is none."""
    return F.coalesce(unescape(F.substring(formatted, start + 1, end - start)), F.lit(""))
