"""Conversations as training text that provably reads back to what it was made from.

A conversation is rendered by a grammar with marked turns, `<|im_start|>role\\ntext<|im_end|>\\n`. A deterministic parser reads
the rendered string back, and its turns are compared with the source. Conversations that hold nothing of the grammar read back
as they are and stay untouched. In the others all conflicting content (control strings of this grammar and of other common
templates, so that no reader takes them for its own) is escaped, and they are read again. If even then the reading differs,
the query fails rather than lose a character.

An escape is ESC and a letter in place of the control string's first character (or of ESC itself); reading undoes it.
All of it is DataFrame functions on one row a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>\n"
ESC = "␛"
#: Control strings of common chat templates, fixed values. All begin with one of the characters of _LETTERS.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_LETTERS = {"<": "l", "[": "b"}


def escape(text: Column) -> Column:
    """ESC becomes ESC e; the first character of each control string becomes ESC and its letter."""
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "e"))
    for first, letter in _LETTERS.items():
        heads = "|".join("\\Q" + c[1:] + "\\E" for c in sorted(CONTROLS, key=len, reverse=True) if c[0] == first)
        out = F.regexp_replace(out, F.lit("\\Q" + first + "\\E(?=" + heads + ")"), F.lit(ESC + letter))
    return out


def unescape(text: Column) -> Column:
    out = text
    for first, letter in _LETTERS.items():
        out = F.replace(out, F.lit(ESC + letter), F.lit(first))
    return F.replace(out, F.lit(ESC + "e"), F.lit(ESC))


def render(turns: Column, escaped: bool) -> Column:
    """turns: array of (role, text), neither null. A newline in an escaped role is ESC n."""
    safe = escape if escaped else (lambda c: c)
    name = (lambda c: F.replace(escape(c), F.lit("\n"), F.lit(ESC + "n"))) if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), name(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(STOP))), "")


def parse(formatted: Column) -> Column:
    """Array of (role, text, n_raw, n_role): the turns of a rendered string, unescaped, and the lengths they have in it. What
    is not of the grammar becomes a turn with a null role, unlike any source."""
    pieces = F.filter(F.split(formatted, "\\Q" + STOP + "\\E", -1), lambda p: F.length(p) > 0)

    def turn(p: Column) -> Column:
        body = F.substring(p, len(START) + 1, 1 << 30)
        role = F.substring_index(body, "\n", 1)
        text = body.substr(F.length(role) + 2, F.lit(1 << 30))
        good = F.startswith(p, F.lit(START)) & F.contains(body, F.lit("\n")) & ~F.contains(body, F.lit(START))
        name = unescape(F.replace(role, F.lit(ESC + "n"), F.lit("\n")))
        read = F.struct(name.alias("role"), unescape(text).alias("text"), F.length(text).alias("n_raw"), F.length(role).alias("n_role"))
        return F.when(good, read).otherwise(F.struct(F.lit(None).cast("string").alias("role"), p.alias("text"), F.lit(0).alias("n_raw"), F.lit(0).alias("n_role")))

    return F.transform(pieces, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, source (array of role, text), formatted, level (0 untouched, 1 escaped), read (turns read back), loss
    (array of begin, end: code points of the formatted string under the loss mask, end exclusive).

    rows: conv_id, turn, role, text; other columns are ignored. Turns stand in the order of turn (null first), ties by role
    and text; repeated rows are turns of their own. A null role or text is an empty one; null conv_id is one conversation.
    The assistant's texts are under the mask, without their marks. No rows, no result.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    source = clean.groupBy("conv_id").agg(turns.alias("source"))
    read_back = lambda s: F.transform(parse(s), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = source.withColumn("plain", render(F.col("source"), False)).withColumn("escaped", render(F.col("source"), True))
    level = F.when((F.col("plain") == F.col("escaped")) & (read_back(F.col("plain")) == F.col("source")), 0).otherwise(1)
    chosen = plain.withColumn("level", level).withColumn("formatted", F.when(F.col("level") == 0, F.col("plain")).otherwise(F.col("escaped"))).drop("plain", "escaped")
    read = chosen.withColumn("parsed", parse(F.col("formatted")))
    same = F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = read.withColumn("read", F.when(same == F.col("source"), same).otherwise(F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def span(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(START) + t["n_role"] + 1
        end = begin + t["n_raw"]
        spans = F.when(t["role"] == "assistant", F.array_append(acc["spans"], F.struct(begin.alias("begin"), end.alias("end")))).otherwise(acc["spans"])
        return F.struct((end + len(STOP)).alias("at"), spans.alias("spans"))

    return checked.withColumn("loss", F.aggregate("parsed", zero, span)["spans"]).select("conv_id", "source", "formatted", "level", "read", "loss")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted string and its mask."""
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["begin"] + 1, s["end"] - s["begin"]))), "")
    out = formatted.withColumn("said", said).withColumn("learned", learned)
    return out.select(
        "conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(F.col("said"), 256).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.col("learned"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
