"""Chat formatting with a grammar round trip, by DataFrame functions alone.

Grammar (all other control strings are ordinary text):

    conversation := "<s>" turn*
    turn         := "[INST" mark "] " body " [/INST]"          role user
                  | "[OUT" mark "] " body "</s>"               role assistant
                  | "[ROLE" mark " " name "] " body " [/ROLE]" any other role; name is always escaped
    mark         := "" (body as it is) | "\\" (body escaped)

A turn is rendered as it is and read back by the parser; where what comes back isn't the turn, its body is escaped
and read back again. Escaping replaces ``\\ [ ] <`` by ``\\e \\o \\c \\l``, so an escaped body has no bracket and can't
hold or begin a control string: the second reading always gives the turn. The first terminator after a turn's head
ends it, whatever follows, so turns that survive alone survive side by side; the whole text is read back once more
all the same and a conversation that differs raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the template.
START, END = "<s>", "</s>"
HEAD_USER, TAIL_USER = "[INST", " [/INST]"
HEAD_OUT, TAIL_OUT = "[OUT", "</s>"
HEAD_ROLE, TAIL_ROLE = "[ROLE", " [/ROLE]"
MARK = "\\"
_TURN = r"(?s)\[INST\\?\] .*? \[/INST\]|\[OUT\\?\] .*?</s>|\[ROLE\\? [^\]]*\] .*? \[/ROLE\]"


def escape(c: Column) -> Column:
    for plain, code in (("\\", "\\e"), ("[", "\\o"), ("]", "\\c"), ("<", "\\l")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in (("<", "\\l"), ("]", "\\c"), ("[", "\\o"), ("\\", "\\e")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    mark, body = F.lit(MARK if escaped else ""), escape(text) if escaped else text
    return (
        F.when(role == "user", F.concat(F.lit(HEAD_USER), mark, F.lit("] "), body, F.lit(TAIL_USER)))
        .when(role == "assistant", F.concat(F.lit(HEAD_OUT), mark, F.lit("] "), body, F.lit(TAIL_OUT)))
        .otherwise(F.concat(F.lit(HEAD_ROLE), mark, F.lit(" "), escape(role), F.lit("] "), body, F.lit(TAIL_ROLE)))
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as structs of role, text and raw (the turn's part of the text)."""

    def turn(raw: Column) -> Column:
        head = F.substring_index(raw, "]", 1)  # without the bracket that ends it
        marked = F.substr(head, F.when(raw.startswith(HEAD_ROLE), F.instr(head, " ") - 1).otherwise(F.length(head)), F.lit(1)) == MARK
        tail = F.when(raw.startswith(HEAD_USER), F.lit(len(TAIL_USER))).when(raw.startswith(HEAD_OUT), F.lit(len(TAIL_OUT))).otherwise(F.lit(len(TAIL_ROLE)))
        body = F.substr(raw, F.length(head) + 3, F.length(raw) - F.length(head) - 2 - tail)
        role = F.when(raw.startswith(HEAD_USER), F.lit("user")).when(raw.startswith(HEAD_OUT), F.lit("assistant")).otherwise(unescape(F.substr(head, F.instr(head, " ") + 1)))
        return F.struct(role.alias("role"), F.when(marked, unescape(body)).otherwise(body).alias("text"), raw.alias("raw"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def format_chats(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    segments is an array of (text, loss): joined they are ``formatted``, and loss marks the bodies of assistant turns.
    read_back() gives the turns and what is under the mask from these two columns.

    Turns are ordered by turn, nulls first; ties by role, then text; repeated rows are repeated turns. A null text or
    role is empty. Rows with a null conversation id form one conversation. Extra columns are left out. A role named
    user or assistant takes that template, any other string (the empty one too) the general one.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    plain = render_turn(F.col("role"), F.col("text"), False)
    turns = turns.withColumn("plain", plain).withColumn("back", parse(F.col("plain")))
    same = (F.size("back") == 1) & (F.col("back")[0]["raw"] == F.col("plain")) & (F.col("back")[0]["role"] == F.col("role")) & (F.col("back")[0]["text"] == F.col("text"))
    turns = turns.select("conv_id", "turn", "role", "text", F.when(same, F.col("plain")).otherwise(render_turn(F.col("role"), F.col("text"), True)).alias("raw"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "raw"))).alias("turns"))

    def cells(t: Column) -> Column:
        start, end = F.instr(t["raw"], "]") + 1, F.length(t["raw"]) - len(TAIL_OUT)
        whole = F.array(F.struct(t["raw"].alias("text"), F.lit(False).alias("loss")))
        split = F.array(
            F.struct(F.substr(t["raw"], F.lit(1), start).alias("text"), F.lit(False).alias("loss")),
            F.struct(F.substr(t["raw"], start + 1, end - start).alias("text"), F.lit(True).alias("loss")),
            F.struct(F.lit(TAIL_OUT).alias("text"), F.lit(False).alias("loss")),
        )
        return F.when(t["role"] == "assistant", split).otherwise(whole)

    formatted = F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: t["raw"]), ""))
    opening = F.array(F.struct(F.lit(START).alias("text"), F.lit(False).alias("loss")))
    chats = chats.select("conv_id", "turns", formatted.alias("formatted"), F.concat(opening, F.flatten(F.transform("turns", cells))).alias("segments"))
    bare = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    differs = F.raise_error(F.concat(F.lit("conversation can't be read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    checked = F.when(bare(parse(F.col("formatted"))) == bare(F.col("turns")), F.col("formatted")).otherwise(differs)
    return chats.select("conv_id", checked.alias("formatted"), "segments")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) as parsed from formatted, and loss_text: unescaped text under the mask, joined."""
    marked = F.transform("segments", lambda s: F.struct(s["text"].alias("text"), s["loss"].alias("loss")))
    # The head before a masked body says if that is escaped.
    at = F.filter(F.sequence(F.lit(1), F.size("segments")), lambda i: F.element_at("segments", i)["loss"])
    body = F.transform(at, lambda i: F.when(F.element_at("segments", i - 1)["text"] == F.lit(HEAD_OUT + MARK + "] "), unescape(F.element_at("segments", i)["text"])).otherwise(F.element_at("segments", i)["text"]))
    turns = F.transform(parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return chats.withColumn("segments", marked).select("conv_id", "formatted", turns.alias("turns"), F.array_join(body, "").alias("loss_text"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = read_back(format_chats(rows))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: A turn is escaped where its body holds the string that ends it.
ORACLE_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE role WHEN 'user' THEN contains(text, ' [/INST]') WHEN 'assistant' THEN contains(text, '</s>') ELSE contains(text, ' [/ROLE]') END AS esc,
         length(text) - length(translate(text, '\[]<', '')) AS odd, length(role) + length(role) - length(translate(role, '\[]<', '')) AS named FROM r
), f AS (
  SELECT *, length(text) + CASE WHEN esc THEN odd + 1 ELSE 0 END + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 16 + named END AS n FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
