import duckdb
import pytest

from wordloom.llm import chat as C

ROWS = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "One\nTwo"), (1, 3, "user", "More"), (1, 4, "assistant", "\n\nEnd"), (1, 5, "user", ""), (2, 0, "user", None), (2, 1, "assistant", "a\n\nb"), (2, 2, "system", "late"), (2, 3, "assistant", "é\n"), (2, 4, "user", "x"), (3, None, None, "q"), (3, 0, "user", "r"), (3, 0, "user", "r"), (None, 0, "user", "z")]


def literal(template, messages):
    """By comparing one character at a time."""
    out, before = [], template([])
    for k in range(1, len(messages) + 1):
        now, n = template(messages[:k]), 0
        while n < min(len(before), len(now)) and before[n] == now[n]:
            n += 1
        out.append((n, len(now), n < len(before), len(before) - n))
        before = now
    return out


def test_spans_cover_the_output_and_hold_the_text(spark):
    got = C.turn_spans(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS template", "2 AS turns")).collect()
    convs = {c: [{"role": r or "user", "content": t or ""} for i, k, r, t in sorted((x for x in ROWS if x[0] == c), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "user", x[3] or ""))] for c in (1, 2, 3)}
    for name, template in C.TEMPLATES.items():
        for c, messages in convs.items():
            rows = sorted((r for r in got if r.conv_id == c and r.template == name), key=lambda r: r.turn_index)
            assert [(r.start, r.end, r.rewrites, r.rewritten_chars) for r in rows] == literal(template, messages)
            for k, r in enumerate(rows):
                now = template(messages[: k + 1])
                if r.content_start is not None:
                    assert now[r.content_start : r.content_start + r.content_length] == messages[k]["content"]
    assert not any(r.rewrites for r in got if r.template != "last_only") and any(r.rewrites for r in got if r.template == "last_only")


def test_black_box_footer_and_length(spark):
    footer = lambda m: C.marked(m) + f"({len(m)} turns)"
    df = spark.createDataFrame([(1, k, "user", "x" * (10**6 if k == 1 else 3)) for k in range(3)], "conv_id long, turn long, role string, text string")
    got = C.turn_spans(df, {"footer": footer}).collect()
    assert all(r.rewrites for r in got) and not any(r.append_only for r in got)
    assert C.turn_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    want = con.execute(C.OP3_SQL).fetchall()
    got = [tuple(r) for r in C.op3_chat_formatting(spark, f"/root/testdata/{sf}").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
