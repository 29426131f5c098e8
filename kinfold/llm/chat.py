"""Chat formatting by a declarative template and a finite-state machine over roles.

The template names the marks around a turn, the roles that are trained on, and
the transitions of the machine.  A conversation becomes an array of segments
(text, loss flag), whose concatenation is the formatted text.  Texts and roles
are escaped so that no mark can occur inside them, and :func:`parse` gives the
turns back from the formatted text alone.  DataFrame functions only.

A conversation is one output value (its digests run over all its turns in
order), so its turns meet in one row; conversations are spread by id.

Cases: null texts and roles are empty; a null conversation id is a conversation
of its own; turns are ordered by number, then role, then text, nulls first, so
repeated rows keep a defined order; a conversation that the machine refuses is
formatted all the same and flagged ``valid = false``; an empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``{role}`` in ``opening`` is the turn's role; both marks begin with ``<``, which escaped text never contains."""

    opening: str = "<turn {role}>\n"
    closing: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })


DEFAULT = Template()
#: Control characters and what stands for them; the first is the escape itself.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_conversations(df: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: ``conv_id``, ``segments`` (array of text and loss flag), ``formatted``, ``final_state`` and ``valid``."""
    rows = df.select(df[conv_col].alias("conv_id"), F.struct(df[turn_col].alias("turn"), F.coalesce(df[role_col], F.lit("")).alias("role"), F.coalesce(df[text_col], F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("turns"))
    before, _, after = template.opening.partition("{role}")

    def segments(t: Column) -> Column:
        trained = t["role"].isin(*template.trained)
        head = F.concat(F.lit(before), escape(t["role"]), F.lit(after))
        return F.array(*(F.struct(text.alias("text"), flag.alias("loss")) for text, flag in ((head, F.lit(False)), (escape(t["text"]), trained), (F.lit(template.closing), F.lit(False)))))

    step = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\n{role}", to)])
    state = F.aggregate("turns", F.lit(template.start), lambda s, t: F.coalesce(F.try_element_at(step, F.concat(s, F.lit("\n"), t["role"])), F.lit("refused")))
    shaped = turns.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), state.alias("final_state"))
    return shaped.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "final_state", F.col("final_state").isin(*template.accepting).alias("valid"))


def _by_turn(a: Column, b: Column) -> Column:
    """Order by turn, role and text, nulls first."""
    less = lambda x, y: F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)
    by_turn, by_role = less(a["turn"], b["turn"]), less(a["role"], b["role"])
    return F.when(by_turn != 0, by_turn).when(by_role != 0, by_role).otherwise(less(a["text"], b["text"]))


def parse(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted text."""
    before, _, after = template.opening.partition("{role}")
    parts = F.filter(F.split(formatted, F.lit(_quoted(template.closing))), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(before) + 1), F.length(p))
    role_end = lambda p: F.instr(body(p), F.lit(after))
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring(body(p), F.lit(1), role_end(p) - 1)).alias("role"),
        unescape(F.substring(body(p), role_end(p) + len(after), F.length(p))).alias("text"),
    ))


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What a reader gets back from :func:`format_conversations`: counts and digests by conversation."""
    read = formatted.select("conv_id", "segments", "formatted", "valid", parse(F.col("formatted"), template).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    done = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    return done.select("conv_id", "n_turns", F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid")


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(text) + length(text) - length(translate(text, '\<>', '')) AS escaped, length(role) + length(role) - length(translate(role, '\<>', '')) AS escaped_role FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + escaped_role + length('<turn >') + 1 + length('</turn>') + 1)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END)
    AND max_by(role, k) = 'assistant' AS valid
FROM numbered GROUP BY conv_id
"""
