"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is an opening mark, its text and a closing mark.  A turn is first rendered as it is, parsed again by
the grammar and compared; if the parser does not recover exactly that turn, control strings in its text are
escaped, and if that is still not enough, every character that could begin one.  The last form contains no
such character, so the parser recovers every turn.  A turn that comes back alone comes back in a conversation:
the parser works from mark to mark, and its first closing mark is the turn's own.

Escapes: a backslash is written \\0, a less-than sign \\1 and a left bracket \\2; the parser always reverts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around the turns of each role; {role} marks a turn of any other role. All begin with < or [."""

    user: tuple[str, str] = ("[INST] ", " [/INST]")
    assistant: tuple[str, str] = ("<s>", "</s>")
    system: tuple[str, str] = ("<<SYS>>", "<</SYS>>")
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<<END>>")

    @property
    def known(self) -> dict[str, tuple[str, str]]:
        return {"user": self.user, "assistant": self.assistant, "system": self.system}

    @property
    def pattern(self) -> str:
        """Groups 1-3: texts of user, assistant and system turns; 4 and 5: role and text of other turns."""
        parts = [f"{quote(a)}(.*?){quote(b)}" for a, b in self.known.values()]
        a, b, c = map(quote, self.other)
        return "(?s)" + "|".join([*parts, f"{a}(.*?){b}(.*?){c}"])

    @property
    def controls(self) -> str:
        """Where a control string begins; marks count without their outer blanks."""
        marks = sorted({m.strip() for pair in [*self.known.values(), self.other] for m in pair}, key=len, reverse=True)
        return "(?=" + "|".join(map(quote, marks)) + ")"


def quote(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " <>/" else c for c in s)


def escape(text: Column, template: Template, everything: bool) -> Column:
    safe = F.replace(text, F.lit("\\"), F.lit("\\0"))
    if everything:
        return F.replace(F.replace(safe, F.lit("<"), F.lit("\\1")), F.lit("["), F.lit("\\2"))
    for char, code in (("<", "1"), ("\\[", "2")):
        safe = F.regexp_replace(safe, template.controls + char, "\\\\" + code)
    return safe


def unescape(text: Column) -> Column:
    for code, char in (("\\2", "["), ("\\1", "<"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def parse(formatted: Column, template: Template) -> Column:
    """Turns of a formatted text: array<struct<role, text, rendered>>."""
    found = [F.regexp_extract_all(formatted, F.lit(template.pattern), F.lit(k)) for k in range(6)]
    names = ["rendered", "user", "assistant", "system", "role", "other"]
    zipped = F.arrays_zip(*[f.alias(n) for f, n in zip(found, names, strict=True)])

    def turn(z: Column) -> Column:
        role, text = unescape(z["role"]), z["other"]
        for name, (open_, _) in reversed(template.known.items()):
            mine = z["rendered"].startswith(open_)
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, z[name]).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"), z["rendered"].alias("rendered"))

    return F.transform(zipped, turn)


def _render(role: Column, coded: Column, template: Template) -> Column:
    a, b, c = template.other
    out = F.concat(F.lit(a), escape(role, template, True), F.lit(b), coded, F.lit(c))
    for name, (open_, close) in template.known.items():
        out = F.when(role == name, F.concat(F.lit(open_), coded, F.lit(close))).otherwise(out)
    return out


def format_turns(df: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: conv_id, turn, role, text, escaping (0-2), rendered, lead (characters of its opening mark)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    turns = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))

    def survives(coded: Column) -> Column:
        """The parser finds one turn in this rendering, and it is the source's."""
        rendered = _render(F.col("role"), coded, template)
        back = parse(rendered, template)
        return (F.size(back) == 1) & (back[0]["rendered"] == rendered) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))

    # texts without any character of a control string or escape can't conflict: the parser need not see them
    plain = ~(F.col("text").contains("<") | F.col("text").contains("[") | F.col("text").contains("\\"))
    level = F.when(plain, F.lit(0)).when(survives(F.col("text")), F.lit(0)).when(survives(escape(F.col("text"), template, False)), F.lit(1)).otherwise(F.lit(2))
    coded = F.when(F.col("escaping") == 0, F.col("text")).when(F.col("escaping") == 1, escape(F.col("text"), template, False)).otherwise(escape(F.col("text"), template, True))
    lead = F.length(F.concat(F.lit(template.other[0]), escape(F.col("role"), template, True), F.lit(template.other[1])))
    for name, (open_, _) in template.known.items():
        lead = F.when(F.col("role") == name, F.lit(len(open_))).otherwise(lead)
    coded_turns = turns.withColumn("escaping", level).withColumn("coded", coded)
    return coded_turns.withColumns({"rendered": _render(F.col("role"), F.col("coded"), template), "lead": lead.cast("long"), "n": F.length("coded").cast("long")}).drop("coded")


def format_conversations(df: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Renders conversations, turns in order of (turn, role, text).

    Returns conv_id, formatted, loss array<boolean> (by turn: the assistant's), loss_spans
    array<struct<start,length>> (characters of the formatted text that count), escaped_turns.  A null text or
    role is empty; repeated rows are turns of their own; turns without a conv_id are the conversation null; an
    empty table gives an empty table; other columns are not carried.  A conversation is one value, so it is
    gathered in one task; nothing else is.
    """
    turns = format_turns(df, template, conv_col, turn_col, role_col, text_col)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0)) + F.col("lead"))
    packed = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "rendered", (F.col("role") == "assistant").alias("loss"), "n"))).alias("t"),
        F.sum((F.col("escaping") > 0).cast("long")).alias("escaped_turns"),
    )
    return packed.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"),
        F.transform("t", lambda x: x["loss"]).alias("loss"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("length"))).alias("loss_spans"),
        "escaped_turns",
    )


def read_back(df: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds ``turns`` (what the parser recovers) and ``loss_text`` (texts under the loss mask) to formatted rows."""
    return df.withColumn("turns", parse(F.col("formatted"), template)).withColumn(
        "loss_text",
        F.array_join(F.transform(F.filter(F.arrays_zip("turns", "loss"), lambda z: z["loss"]), lambda z: z["turns"]["text"]), ""),
    )
