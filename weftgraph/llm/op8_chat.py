"""Chat formatting: a finite-state machine over roles and a declarative template.

Each turn becomes three segments: its mark, its text with control strings escaped, and the end mark. Only
the texts of roles that the template names carry the loss flag. The escape is reversible: a backslash is
doubled, and a control string gets one before it.

Conversations are shuffled by id, sorted in their partition and streamed, so one that holds a third of all
rows takes no more memory than another; nothing gathers a conversation. A turn is read back by one pass that
never goes back, so a very long text takes a few times its own size.

Defined results: a null text is empty; a null role is the empty role; rows with the same turn are kept,
ordered by role and text; null conversation ids form one conversation; roles or orders that the machine
doesn't know are formatted all the same, and ``valid`` is false; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import small_batches, table


@dataclass(frozen=True)
class ChatTemplate:
    mark: str = "### "
    after: str = ": "
    end: str = " </turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    #: What may follow a role; "" is the beginning.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: Strings that texts hold only behind a backslash.
    control: tuple[str, ...] = ("###", "</turn>")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.control:
            text = text.replace(c, "\\" + c)
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\|" + "|".join(map(re.escape, self.control)) + ")", r"\1", text)

    def label(self, role: str) -> str:
        """Roles without a label show as a question mark and the hex of their name."""
        return self.labels.get(role) or "?" + role.encode().hex()

    def role(self, label: str) -> str:
        return bytes.fromhex(label[1:]).decode() if label.startswith("?") else {v: k for k, v in self.labels.items()}[label]

    def turn(self) -> re.Pattern:
        """One whole turn of formatted text: its label and its escaped text."""
        control, end = "|".join(map(re.escape, self.control)), re.escape(self.end)
        # Runs of plain signs, escapes, and signs that could begin a control string or the end but don't; each is
        # taken for good, so nothing is kept for going back.
        first = "".join({re.escape(c[0]) for c in (*self.control, self.end)})
        body = rf"((?:[^\\{first}]++|\\(?:\\|{control})|(?!{control}|{end})[{first}])*+)"
        return re.compile(re.escape(self.mark) + r"(\?[0-9a-f]*|" + "|".join(map(re.escape, self.labels.values())) + ")" + re.escape(self.after) + body + end, re.DOTALL)


SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, valid boolean"


def _formatting(template: ChatTemplate) -> Callable:
    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        now, state, n, begun = None, "", 0, False
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if not begun or conv != now:
                    now, state, n, begun = conv, "", 0, True
                role = role or ""
                valid = role in template.follows.get(state, ())
                rows += [
                    (conv, n, 0, template.mark + template.label(role) + template.after, False, valid),
                    (conv, n, 1, template.escape(text or ""), role in template.loss, valid),
                    (conv, n, 2, template.end, False, valid),
                ]
                state, n = role, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names)

    return run


def format_chat(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """The segments of each conversation, in order within the partitions; a conversation is in one."""
    rows = small_batches(conversations).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatting(template or ChatTemplate()), SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _reading(template: ChatTemplate) -> Callable:
    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in DIGESTS.split(", ")]
        turn, now, done = template.turn(), None, []
        state: dict = {}

        def close():
            if state:
                if state["waiting"]:
                    raise ValueError(f"conversation {now}: formatted text isn't made of whole turns")
                done.append((now, state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["valid"]))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c) if c else pa.array(c, pa.string()) for c in zip(*done)], names)
            done.clear()
            return out

        for batch in batches:
            for conv, text, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid"))):
                if not state or conv != now:
                    close()
                    now, state = conv, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "valid": True, "waiting": ""}
                state["chars"] += len(text)
                state["valid"] &= valid
                if loss:
                    plain = template.unescape(text)
                    state["loss_chars"] += len(plain)
                    state["loss"].update(plain.encode())
                state["waiting"] += text
                if text == template.end and (m := turn.fullmatch(state["waiting"])):
                    state["turns"] += 1
                    state["all"].update(f"{template.role(m[1])}\n{template.unescape(m[2])}\n".encode())
                    state["waiting"] = ""
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    return run


def read_chat(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Parses the formatted text of ``format_chat`` again, with digests of the turns and the loss text."""
    return segments.mapInArrow(_reading(template or ChatTemplate()), DIGESTS)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_chat(format_chat(rows))


QUERIES = {"op8_chat": op8_chat}
_TRICKY = r"'\### Assistant: </turn> ok'"
_ESCAPED = "replace(replace(replace(t, chr(92), repeat(chr(92), 2)), '###', chr(92) || '###'), '</turn>', chr(92) || '</turn>')"
ORACLES = {
    "op8_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_TRICKY} UNION ALL SELECT -7, 1, 'assistant', {_TRICKY}
), ordered AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) AS before FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED}) + CASE role WHEN 'system' THEN 21 WHEN 'user' THEN 19 WHEN 'assistant' THEN 24 ELSE 16 + 2 * strlen(role) END) AS BIGINT) AS formatted_chars,
  bool_and((before = '' AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant')) AS valid
FROM ordered GROUP BY conv_id"""
}
