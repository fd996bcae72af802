import base64
import random

import pytest
import tiktoken

from wordloom.llm import bpe

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def voc():
    return bpe.Vocabulary(bpe.RANKS)


@pytest.fixture(scope="module")
def public(voc):
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "Hello world's end", "  spaces \n\n and\ttabs  ", "naïve café über ñandú", "日本語 текст 🙂🙃", "a" * 3000, "x1y2 3.14 !!??", "  wide", "'tis they'll", "zq" * 200, "\x00\x01"]


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_public_encoder(voc, public, text):
    assert voc.encode(text) == public.encode_ordinary(text)
    assert voc.decode(voc.encode(text)) == text.encode()


def test_random_words(voc, public):
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["th", "ing", "é", " ", "qu", "x", "ß", "zz", "er", "'", "9"]) for _ in range(r.randint(1, 60)))
        assert voc.encode(text) == public.encode_ordinary(text)


def test_appends_and_edits_are_exact(voc):
    r = random.Random(2)
    raw = bytes(r.choice(b"abcdefgthing") for _ in range(400))
    table = bpe.PrefixTable(voc)
    for b in raw:
        table.append(bytes([b]))
    assert table.encode() == bpe.PrefixTable(voc, raw).encode()
    for _ in range(40):
        at, cut, new = r.randrange(len(table.raw)), r.randrange(4), bytes(r.choice(b"thingxyz") for _ in range(r.randrange(5)))
        worked = table.worked
        cut = min(cut, len(table.raw) - at)
        table.edit(at, cut, new)
        assert table.last == bpe.PrefixTable(voc, table.raw).last
        assert table.worked - worked <= 400
    for n in range(1, 60):
        assert table.encode(n) == bpe.PrefixTable(voc, table.raw[:n]).encode()


def test_round_trip_of_a_table(spark):
    rows = [*enumerate(TEXTS), (0, "again"), (50, None), (None, "no id"), (51, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS token_ids", "2 AS n_tokens")
    got = bpe.encode(df)
    assert got.filter("NOT round_trip").count() == 0 and got.count() == len(rows)
    null = got.filter("doc_id = 50").first()
    assert null.token_ids is None and null.n_tokens is None and null.round_trip is None
    back = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in bpe.decode(got).collect()))
    assert back == sorted((i is None, i or 0, t or "") for i, t in rows)
    assert bpe.encode(df.limit(0)).count() == 0
