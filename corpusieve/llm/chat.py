"""Operator 7: chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over roles reads the turns of each conversation in order and says whether
their order is allowed. The formatted conversation is a list of segments, each with a flag that says
whether training loss falls on it: the marks around a turn never, its text if the role learns.

Inside texts and roles the template's control characters are escaped, so no text can make a mark:
every mark begins with "<", which escaped text never contains. `&` is escaped first and restored
last, which makes the escape reversible for all texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.runtime import table


@dataclass(frozen=True)
class Template:
    """Marks, who learns, and the machine: state -> {role: next state}.

    ``start`` is the first state; a conversation is well formed if every turn has a transition and
    the last state is in ``final``.
    """

    before_role: str = "<turn:"
    after_role: str = ">"
    close: str = "</turn>"
    learns: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def __post_init__(self) -> None:
        for mark in (self.before_role, self.close):
            if not mark.startswith("<") or "<" in mark[1:]:
                raise ValueError("a mark begins with < and has no other")
        if self.after_role != ">" or ">" in self.before_role:
            raise ValueError("a role is ended by > alone")
        if self.before_role.startswith(self.close) or self.close.startswith(self.before_role):
            raise ValueError("marks must differ")


def _quoted(s: str) -> str:
    """``s`` as a pattern that matches just itself."""
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in s)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&gt;"), F.lit(">")))


def _ordered_turns(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, text): by turn, null turns last, ties by role and
    text. Null roles and texts are empty."""
    turn = F.struct(F.col("turn").isNull().alias("late"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conv_id of rows(conv_id, turn, role, text): conv_id, state (where the
    machine stopped; null once a turn was not allowed), well_formed, segments (array of text and
    loss) and formatted, the segments' texts in a row. Null conv_id is a conversation of its own;
    badly ordered conversations are formatted too."""
    t = template or Template()
    moves = [(f"{state}\0{role}", to) for state, own in t.moves.items() for role, to in own.items()]
    step = F.create_map(*[F.lit(x) for pair in moves for x in pair])
    state = F.aggregate("turns", F.lit(t.start), lambda at, x: F.try_element_at(step, F.concat(at, F.lit("\0"), x["role"])))

    def parts(x: Column) -> Column:
        loss = x["role"].isin(*t.learns)
        opened = F.concat(F.lit(t.before_role), _escape_role(x["role"]), F.lit(t.after_role))
        return F.array(*[F.struct(text.alias("text"), flag.alias("loss")) for text, flag in ((opened, F.lit(False)), (escape(x["text"]), loss), (F.lit(t.close), F.lit(False)))])

    own = _ordered_turns(rows).select("conv_id", state.alias("state"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return own.select("conv_id", "state", F.coalesce(F.col("state").isin(*t.final), F.lit(False)).alias("well_formed"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turns (array of role and text) parsed from ``formatted`` alone, and learned, the
    unescaped texts under the loss flag, of what ``format_conversations`` made; its formatted, state
    and well_formed stay."""
    t = template or Template()
    pattern = _quoted(t.before_role) + "([^>]*)" + _quoted(t.after_role) + "([^<]*)" + _quoted(t.close)
    found = F.arrays_zip(F.regexp_extract_all("formatted", F.lit(pattern), 1).alias("role"), F.regexp_extract_all("formatted", F.lit(pattern), 2).alias("text"))
    turns = F.transform(found, lambda x: F.struct(_unescape_role(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", turns.alias("turns"), learned.alias("learned"), "formatted", "state", "well_formed")


def digest(back: DataFrame) -> DataFrame:
    every = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "well_formed",
    )


#: A conversation whose texts look like marks and escapes.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digest(read_back(format_conversations(rows)))


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn ASC NULLS LAST, role, text) AS every,
         coalesce(string_agg(text, '' ORDER BY turn ASC NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('<turn:' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>')
             + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('</turn>')) AS chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn ASC NULLS LAST, role, text) AS roles
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars,
       CASE WHEN roles = 's' THEN 'ready' WHEN regexp_full_match(roles, 's?(ua)*u') THEN 'asked' WHEN regexp_full_match(roles, 's?(ua)+') THEN 'answered' END AS state,
       regexp_full_match(roles, 's?(ua)+') AS well_formed
FROM joined
"""
