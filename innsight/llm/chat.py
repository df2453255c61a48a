"""Chat formatting with a grammar round trip. Native expressions only.

Template: ``<s>`` begins a conversation; a turn is

    user       [INST] text [/INST]
    system     [SYS] text [/SYS]
    assistant  [ANS] text </s>
    other      [ROLE] role [MSG] text [/ROLE]

A control string is one of these marks. Inside texts and role names a mark can be written with
backslashes after its first character (``[\\/INST]``): the parser takes one backslash away from every
such string, the writer adds one. So writing is reversible for every text, also for texts that
hold escaped marks already.

The writer proves its output: a text is first written as it is, the turn is parsed by the
deterministic grammar and compared with its source; where they differ the content is escaped, until
parsed and source are identical. The whole conversation is then parsed again and compared;
a difference raises an error. What is returned besides the text comes from that parse.

A conversation is one training example and one string, so its turns meet in one row, sorted by turn;
they are dealt by conversation key with one shuffle and no other row of the input meets them.

Defined results: null text or role = ''. A null conversation id is a conversation like any other. Turns of
equal number are ordered by role, then text; repeated rows stay. Turns without a number come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.common import quoted

# Fixed values: (role, opening mark, closing mark); a role not listed is written by name.
TEMPLATE = (("user", "[INST] ", " [/INST]"), ("system", "[SYS] ", " [/SYS]"), ("assistant", "[ANS] ", " </s>"))
NAMED_OPEN, NAMED_TEXT, NAMED_CLOSE = "[ROLE] ", " [MSG] ", " [/ROLE]"
BEGIN = "<s>"
LEARNT = "assistant"  # whose texts are under the loss mask
NAMES = "(?:/?(?:s>|INST\\]|SYS\\]|ANS\\]|ROLE\\]|MSG\\]))"
MARK = f"([<\\[])(\\\\*)({NAMES})"          # a mark with any number of backslashes
UNESCAPED = f"[<\\[]{NAMES}"
ESCAPED = f"([<\\[])\\\\(\\\\*)({NAMES})"   # with one or more


def escape(x: Column) -> Column:
    return F.regexp_replace(x, MARK, "$1\\\\$2$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, ESCAPED, "$1$2$3")


def _literal(mark: str) -> str:
    return "".join("\\" + c if c in "[]/" else c for c in mark)


def _turn_pattern() -> str:
    """One turn; the lazy text ends at the first closing mark, which no escaped text holds."""
    fixed = [f"{_literal(a)}.*?{_literal(b)}" for _, a, b in TEMPLATE]
    named = f"{_literal(NAMED_OPEN)}.*?{_literal(NAMED_TEXT)}.*?{_literal(NAMED_CLOSE)}"
    return "(?s)(?:" + "|".join([*fixed, named]) + ")"


TURN = _turn_pattern()


def write_turn(role: Column, text: Column) -> Column:
    """The turn with ``role`` and ``text`` written as they are."""
    out = F.concat(F.lit(NAMED_OPEN), role, F.lit(NAMED_TEXT), text, F.lit(NAMED_CLOSE))
    for name, a, b in TEMPLATE:
        out = F.when(role == name, F.concat(F.lit(a), text, F.lit(b))).otherwise(out)
    return out


def read_turn(turn: Column) -> Column:
    """struct(role, text) of one written turn, unescaped."""
    inner = F.substring(turn, F.lit(len(NAMED_OPEN) + 1), F.char_length(turn) - len(NAMED_OPEN) - len(NAMED_CLOSE))
    out = F.struct(unescape(F.substring_index(inner, NAMED_TEXT, 1)).alias("role"),
                   unescape(F.regexp_replace(inner, f"(?s)\\A.*?{_literal(NAMED_TEXT)}", "")).alias("text"))
    for name, a, b in TEMPLATE:
        text = F.substring(turn, F.lit(len(a) + 1), F.char_length(turn) - len(a) - len(b))
        out = F.when(turn.startswith(a), F.struct(F.lit(name).alias("role"), unescape(text).alias("text"))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; null if it is not a sentence of the grammar: its turns fill
    it, and it has no other unescaped mark than theirs."""
    turns = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    named = F.size(F.filter(turns, lambda x: x.startswith(NAMED_OPEN)))
    marks = F.regexp_count(formatted, F.lit(UNESCAPED)) == 1 + 2 * F.size(turns) + named
    whole = F.concat(F.lit(BEGIN), F.array_join(turns, "")) == formatted
    return F.when(whole & marks, F.transform(turns, read_turn))


def _parses_to(turn: Column, role: Column, text: Column) -> Column:
    """The written turn is exactly one turn of the grammar and gives back its source."""
    again = parse(F.concat(F.lit(BEGIN), turn))
    return F.coalesce((F.size(again) == 1) & (again[0]["role"] == role) & (again[0]["text"] == text), F.lit(False))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv, formatted, turns, loss_spans) per conversation: ``turns`` array of (role, text) as parsed from
    ``formatted``; ``loss_spans`` array of (start, length) of the assistants' written texts in it, code points from 0."""
    rows = df.select(quoted(conv).alias("conv"), quoted(turn).alias("turn"),
                     F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(quoted(text), F.lit("")).alias("text"))
    rows = rows.withColumn("plain", write_turn(F.col("role"), F.col("text")))
    # escape where the parse of the plain form differs from the source
    rows = rows.withColumn("written", F.when(
        _parses_to(F.col("plain"), F.col("role"), F.col("text")), F.col("plain")).otherwise(
        write_turn(F.when(F.col("role").isin([n for n, *_ in TEMPLATE]), F.col("role")).otherwise(escape(F.col("role"))),
                   escape(F.col("text"))))).drop("plain")
    # where the turn begins in the formatted text: running lengths in turn order, within the same partitioning
    size = F.char_length("written")
    before = F.sum(size).over(Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - size
    rows = rows.withColumn("at", before + len(BEGIN))
    chats = rows.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "written", "at"))).alias("t"))
    chats = chats.withColumn("formatted", F.concat(F.lit(BEGIN), F.array_join(F.col("t")["written"], "")))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    chats = chats.withColumn("turns", F.when(F.col("turns") == source, F.col("turns")).otherwise(
        F.raise_error(F.concat(F.lit("conversation not recovered: "), F.coalesce(F.col("conv").cast("string"), F.lit("null"))))))
    learnt, opening, closing = next(x for x in TEMPLATE if x[0] == LEARNT)
    spans = F.transform(F.filter("t", lambda x: x["role"] == learnt), lambda x: F.struct(
        (x["at"] + len(opening)).alias("start"),
        (F.char_length(x["written"]) - len(opening) - len(closing)).cast("long").alias("length")))
    return chats.select(F.col("conv").alias(conv), "formatted", "turns", spans.alias("loss_spans"))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, as it is read from the formatted conversation by the mask's spans."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, unescaped: the assistants' texts in order."""
    return F.array_join(F.transform(F.filter(turns, lambda x: x["role"] == LEARNT), lambda x: x["text"]), "")


def duckdb_sql(source: str) -> str:
    """The registered question for DuckDB over the rows of ``source`` (conv_id, turn, role, text)."""
    def marks(x: str) -> str:
        return f"len(regexp_extract_all({x}, '{MARK}'))"
    fixed = " ".join(f"WHEN '{n}' THEN {len(a) + len(b)}" for n, a, b in TEMPLATE)
    named = len(NAMED_OPEN + NAMED_TEXT + NAMED_CLOSE)
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({source})),
     w AS (SELECT *, CASE role {fixed} ELSE {named} + length(role) + {marks('role')} END
                     + length(text) + {marks('text')} AS written FROM r),
     g AS (SELECT conv_id, count(*) AS n_turns, sum(written) + {len(BEGIN)} AS chars,
                  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                           FILTER (WHERE role = '{LEARNT}'), '') AS loss
           FROM w GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars FROM g
"""
