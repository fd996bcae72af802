"""Chat formatting: spans of turns found by incremental black-box rendering.

A template is any function from a list of messages to a string.  :func:`spans` renders the prefixes of 0, 1, 2, ...
turns and compares consecutive outputs: what the output with turn k has after the common
beginning is the span of turn k.  A template is *append-only* at a turn if the whole earlier
output is that beginning; else it rewrote history there (it dropped an earlier thought, moved the system text,
closed with a footer ...), and the span starts where the outputs part.  Nothing is known of a
template but what it returns.

Defined results: turns are ordered by (turn, role, text), nulls first; a null role is ``user``, a
null text empty; rows that are repeated are turns of their own; rows with a null conv_id are left out; an
empty table gives an empty result; texts and conversations of any length are rendered whole; other columns are not
looked at.  Positions are in code points; ``content_start`` is null where the turn's text is not in its span.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import read

Template = Callable[[list[dict]], str]
#: stands in for a turn's text to see where the template puts it
PROBE = "\ue000\ue001\ue000"


def marked(messages: list[dict]) -> str:
    """Each turn between marks."""
    return "".join(f"<|start|>{m['role']}\n{m['content']}<|end|>\n" for m in messages)


def bracketed(messages: list[dict]) -> str:
    """Instructions in brackets; the system text goes into the first instruction."""
    out, system = "", ""
    for m in messages:
        if m["role"] == "system":
            system += f"<<SYS>>\n{m['content']}\n<</SYS>>\n\n"
        elif m["role"] == "user":
            out += f"[INST] {system}{m['content']} [/INST]"
            system = ""
        else:
            out += f" {m['content']} </s>"
    return out


def last_only(messages: list[dict]) -> str:
    """Earlier assistant turns are cut to their first line, so that each new turn may rewrite history."""
    parts = []
    for i, m in enumerate(messages):
        text = m["content"]
        if m["role"] == "assistant" and i < len(messages) - 1:
            text = text.split("\n", 1)[0]
        parts.append(f"{m['role']}: {text}\n\n")
    return "".join(parts)


TEMPLATES: dict[str, Template] = {"marked": marked, "bracketed": bracketed, "last_only": last_only}


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def spans(template: Template, messages: list[dict]) -> list[dict]:
    """For each turn: start and end of its span, its text's place, whether history was rewritten and from where."""
    out, before = [], template([])
    for k in range(1, len(messages) + 1):
        now = template(messages[:k])
        start = common_prefix(before, now)
        text = messages[k - 1]["content"]
        at = template([*messages[: k - 1], {**messages[k - 1], "content": PROBE}]).find(PROBE) if text else -1
        out.append({"start": start, "end": len(now), "content_start": at if at >= 0 and now.startswith(text, at) else None, "rewrites": start < len(before), "rewritten_chars": len(before) - start})
        before = now
    return out


SCHEMA = "conv_id long, template string, turn_index long, role string, start long, end long, content_start long, content_length long, rewrites boolean, rewritten_chars long, append_only boolean"


def turn_spans(conversations: DataFrame, templates: dict[str, Template] | None = None) -> DataFrame:
    """A row for each turn and template; append_only says that the template rewrote nothing in this conversation."""
    templates = templates or TEMPLATES
    c = conversations
    own = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit("user")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))
    own = own.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        for pdf in batches:
            rows = []
            for conv, turns in zip(pdf["conv_id"], pdf["turns"]):
                messages = [{"role": t["role"], "content": t["text"]} for t in turns]
                for name, template in templates.items():
                    got = spans(template, messages)
                    clean = not any(s["rewrites"] for s in got)
                    rows += [(conv, name, k, m["role"], s["start"], s["end"], s["content_start"], len(m["content"]), s["rewrites"], s["rewritten_chars"], clean) for k, (m, s) in enumerate(zip(messages, got))]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield out.astype({"content_start": "Int64"})

    return own.mapInPandas(run, SCHEMA)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_spans(read(spark, sf_dir, "conversations"))


#: the same from the templates' definitions: lengths of what each turn adds
OP3_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT conv_id, 'marked' AS template, k, role, text, length(role) + 10 AS head,
         length(role) + length(text) + 18 AS added
  FROM t
), g AS (
  SELECT *, sum(CASE WHEN role = 'system' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS said,
         sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked
  FROM t
), h AS (
  SELECT *, sum(CASE WHEN role = 'system' THEN length(text) + 19 ELSE 0 END) OVER (PARTITION BY conv_id, coalesce(asked, 0) ORDER BY k) AS held
  FROM g
), b AS (
  SELECT conv_id, 'bracketed' AS template, k, role, text,
         CASE role WHEN 'user' THEN 7 + held ELSE 1 END AS head,
         CASE role WHEN 'system' THEN 0 WHEN 'user' THEN length(text) + held + 15 ELSE length(text) + 6 END AS added
  FROM h
), two AS (
  SELECT *, sum(added) OVER (PARTITION BY template, conv_id ORDER BY k) AS stop FROM (SELECT * FROM m UNION ALL SELECT * FROM b)
), l AS (
  SELECT conv_id, k, role, text, length(role) + 2 AS head,
         length(role) + length(text) + 4 AS whole,
         CASE WHEN role = 'assistant' THEN length(role) + length(split_part(text, chr(10), 1)) + 4 ELSE length(role) + length(text) + 4 END AS short,
         role = 'assistant' AND contains(text, chr(10)) AS cuts,
         starts_with(split_part(text, chr(10), 1) || repeat(chr(10), 2), text) AS whole_stays,
         length(split_part(text, chr(10), 1)) AS line,
         substr(text, length(split_part(text, chr(10), 1)) + 1) AS tail
  FROM t
), p AS (
  SELECT *, coalesce(sum(short) OVER w, 0) AS past, lag(cuts) OVER o AS cut, lag(whole) OVER o AS was, lag(short) OVER o AS now_is, lag(head) OVER o AS was_head, lag(line) OVER o AS was_line,
         lag(tail) OVER o AS was_tail
  FROM l
  WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY conv_id ORDER BY k)
), r AS (
  SELECT *, CASE WHEN coalesce(cut, FALSE) THEN past - now_is + was_head + was_line
                 + CASE WHEN starts_with(was_tail, chr(10) || chr(10)) THEN 2 ELSE 1 END ELSE past END AS begin_at,
         CASE WHEN coalesce(cut, FALSE) THEN past - now_is + was ELSE past END AS before
  FROM p
)
SELECT conv_id, template, k AS turn_index, role, (stop - added)::BIGINT AS start, stop::BIGINT AS "end",
       CASE WHEN text = '' OR (template = 'bracketed' AND role = 'system') THEN NULL ELSE (stop - added + head)::BIGINT END AS content_start,
       length(text) AS content_length, FALSE AS rewrites, 0::BIGINT AS rewritten_chars, TRUE AS append_only
FROM two
UNION ALL
SELECT conv_id, 'last_only', k, role, begin_at::BIGINT, (past + whole)::BIGINT, CASE WHEN text = '' THEN NULL ELSE (past + head)::BIGINT END,
       length(text), begin_at < before, (before - begin_at)::BIGINT, NOT bool_or(begin_at < before) OVER (PARTITION BY conv_id)
FROM r
"""
