"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything is DataFrame functions; no Python runs on executors.

``Template`` names the role order (states and transitions), the strings around a
turn and the roles that bear loss. Characters that control strings are made of
are replaced in texts by two-character codes, so a control string cannot occur
inside a text and the output can be read back exactly.

Defined results
- null text or role: empty. A role outside the template is formatted, bears no
  loss and makes the conversation invalid.
- turns are ordered by (turn, role, text), nulls first; repeated rows are
  formatted as often as they occur.
- a null conv_id is a conversation of its own.
- a conversation that breaks the role order is formatted whole; ``valid`` is
  false and ``bad_turn`` the position of its first wrong turn (the number of
  turns if only its end is wrong).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``codes`` maps characters to what stands for them; its first entry is the
    escape character, and every code starts with it."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    codes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
    role_codes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    finals: tuple[str, ...] = ("assistant",)
    transitions: tuple[tuple[str, str, str], ...] = field(default=(
        ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
        ("user", "assistant", "assistant"), ("assistant", "user", "user"),
    ))

    def __post_init__(self) -> None:
        escaped = {c for c, _ in self.codes}
        if not (set(self.open[:1]) | set(self.close[:1])) <= escaped:
            raise ValueError("the first character of every control string must have a code")
        if self.after_role[:1] not in {c for c, _ in self.role_codes}:
            raise ValueError("the first character after a role must have a role code")


DEFAULT = Template()


def _swap(value: Column, pairs) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(text: Column, t: Template = DEFAULT) -> Column:
    return _swap(text, t.codes)


def unescape(text: Column, t: Template = DEFAULT) -> Column:
    return _swap(text, [(new, old) for old, new in reversed(t.codes)])


def _escape_role(role: Column, t: Template) -> Column:
    return _swap(escape(role, t), t.role_codes)


def _unescape_role(role: Column, t: Template) -> Column:
    return unescape(_swap(role, [(new, old) for old, new in reversed(t.role_codes)]), t)


def _next_state(state: Column, role: Column, t: Template) -> Column:
    step = None
    for source, symbol, target in t.transitions:
        hit = (state == source) & (role == symbol)
        step = F.when(hit, F.lit(target)) if step is None else step.when(hit, F.lit(target))
    return step.otherwise(F.lit("error"))


def format_conversations(rows: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, bad_turn, segments, formatted``.

    ``segments`` is an array of (text, loss) in output order; ``formatted`` is the
    segments' texts joined. Only the texts of the loss roles bear loss.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(acc: Column, x: Column) -> Column:
        state = _next_state(acc["state"], x["role"], t)
        bad = F.when((acc["bad"] < 0) & (state == "error"), acc["at"]).otherwise(acc["bad"])
        return F.struct(state.alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def pieces(x: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(t.open), _escape_role(x["role"], t), F.lit(t.after_role))
        return F.array(
            piece(head, F.lit(False)),
            piece(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
            piece(F.lit(t.close), F.lit(False)),
        )

    ended = F.aggregate("turns", begin, run)
    return (
        talks.withColumn("end", ended)
        .withColumn("segments", F.flatten(F.transform("turns", pieces)))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.col("end.state").isin(*t.finals).alias("valid"),
            F.when(F.col("end.state").isin(*t.finals), F.lit(None))
            .when(F.col("end.bad") >= 0, F.col("end.bad")).otherwise(F.col("end.at")).cast("int").alias("bad_turn"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def read_turns(formatted: Column, t: Template = DEFAULT) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.filter(F.split(formatted, _literal(t.close)), lambda p: p != "")

    def turn(part: Column) -> Column:
        cut = F.instr(part, t.after_role)
        role = F.substring(part, F.lit(len(t.open) + 1), cut - F.lit(len(t.open) + 1))
        text = F.substring(part, cut + F.lit(len(t.after_role)), F.length(part))
        return F.struct(_unescape_role(role, t).alias("role"), unescape(text, t).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, t: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""), t)


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
