import base64
import hashlib
import random
import string

from wordloom.llm import secret_scan as S

r = random.Random(3)
AL = string.ascii_letters + string.digits


def pick(n, alphabet=AL):
    return "".join(r.choice(alphabet) for _ in range(n))


def with_crc(head, n=30):
    body = pick(n)
    return head + body + S.base62_crc(body)


def luhn_card():
    while True:
        c = "4" + pick(15, string.digits)
        if S.luhn(c):
            return c


SECRETS = {
    "github_token": [with_crc("ghp_"), with_crc("gho_")],
    "npm_token": [with_crc("npm_")],
    "aws_access_key": ["AKIA" + "Q2W3E4R5T6Y7U2P3"],
    "slack_token": ["xoxb-" + pick(40)],
    "gitlab_token": ["glpat-" + pick(20)],
    "jwt": ["eyJ" + pick(30) + ".eyJ" + pick(40) + "." + pick(43)],
}


def test_every_rule_is_found_and_bad_checksums_are_not():
    for rule, secrets in SECRETS.items():
        for s in secrets:
            assert S.find(f"see {s}, ok") == [(4, 4 + len(s), rule)]
    bad = SECRETS["github_token"][0]
    bad = bad[:-1] + ("a" if bad[-1] != "a" else "b")
    assert S.find(f"x {bad} y") == []
    c = luhn_card()
    assert [x[2] for x in S.find(f"card: {c}.")] == ["card"] and S.find(f"card: {c[:-1]}{(int(c[-1]) + 1) % 10}.") == []
    assert [x[2] for x in S.find("IBAN: DE89370400440532013000")] == ["iban"] and S.find("IBAN: DE89370400440532013001") == []
    h = hashlib.sha1(b"q").hexdigest()
    assert [x[2] for x in S.find(f'token = "{h}"')] == ["assigned_secret"] and S.find('token = "aaaaaaaaaaaaaaaaaaaaaaaa"') == []
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.b64encode(b"k" * 300).decode() + "\n-----END RSA PRIVATE KEY-----"
    assert S.find("a " + key) == [(2, 2 + len(key), "private_key")]


def brute(text):
    """Every pattern at every position, without the automaton."""
    _, patterns = S._automaton()
    found = []
    for k, (p, rule) in enumerate(zip(patterns, S.RULES)):
        for at in range(len(text)):
            if any(text[at:].lower().startswith(w) for w in rule[1]):
                m = p.match(text, at)
                if m and rule[5](m["s"]):
                    found.append((m.start("s"), m.end("s"), k))
    found.sort(key=lambda f: (f[0], -f[1], f[2]))
    out, end = [], -1
    for s, e, k in found:
        if s >= end:
            out.append((s, e, S.RULES[k][0]))
            end = e
    return out


def test_like_brute_force():
    every = [s for x in SECRETS.values() for s in x]
    for _ in range(40):
        text = " ".join(r.choice([pick(6), "token", "ghp_", "secret: 'abc'", "İ", f"api_key = '{pick(24)}'", r.choice(every), "card 4111 1111 1111 1111"]) for _ in range(30))
        assert S.find(text) == brute(text)


def test_tables(spark):
    s = SECRETS["github_token"][0]
    rows = [(1, f"a {s} b"), (1, f"a {s} b"), (2, None), (3, ""), (None, s), (4, "x " * 300_000 + s), (5, "clean token text"), (6, f"{s}{s}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rule", "2 AS start", "'q' AS sha256")
    got = sorted((x.doc_id or 0, x.start, x.length) for x in S.scan(df).collect())
    assert got == [(0, 0, 40), (1, 2, 40), (1, 2, 40), (4, 600_000, 40)]
    left = {x.doc_id: x.t for x in df.select("doc_id", S.redacted(df["text"]).alias("t")).collect()}
    assert left[1] == "a [SECRET:github_token] b" and left[2] is None and left[5] == "clean token text"
    assert S.scan(df.limit(0)).count() == 0


def test_secrets_of_any_length_are_whole():
    jwt = "eyJ" + pick(3000) + ".eyJ" + pick(9000) + "." + pick(2000)
    assert S.find(f"a {jwt} b") == [(2, 2 + len(jwt), "jwt")]
    slack, stripe = "xoxb-" + pick(900), "sk_live_" + pick(300)
    assert S.find(f"{slack} {stripe}.") == [(0, 905, "slack_token"), (906, 1214, "stripe_key")]
    value = pick(5000)
    assert S.find(f"secret_of_the_production_database =        '{value}'") == [(44, 5044, "assigned_secret")]
    for head in ("", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"):
        body = "\n".join(pick(64) for _ in range(200))
        key = f"-----BEGIN RSA PRIVATE KEY-----\n{head}{body}\n-----END RSA PRIVATE KEY-----"
        assert S.redact(f"a {key} b") == "a [SECRET:private_key] b"
        cut = key[: key.index("\n-----END")]
        assert S.redact(f"{cut}\nThe end. {key}") == "[SECRET:private_key]\nThe end. [SECRET:private_key]"
        escaped = key.replace("\n", "\\n")
        assert S.redact(f'"{escaped}"') == '"[SECRET:private_key]"'


def test_many_hits_in_one_run_are_read_once():
    import time

    start = time.monotonic()
    for unit in ("xoxb-", "token", "eyJ", "-----BEGIN PRIVATE KEY-----", "iban ", "sk_live_", "token='", "secret:  "):
        S.find(unit * 30_000)
    assert S.find("xoxb-" * 20_000 + pick(100_000))[0][2] == "slack_token"
    assert time.monotonic() - start < 30


def test_numbers_followed_by_others():
    def found(text):
        return [(text[s:e], rule) for s, e, rule in S.find(text)]

    for number, after in (("4111111111111111", " 12/26"), ("4111 1111 1111 1111", " 123"), ("378282246310005", " 04 27"), ("5555-5555-5555-4444", " 7"), ("4222222222222", " 123456")):
        assert found(f"card {number}{after}") == [(number, "card")]
        assert found(f"card {number[:-1]}{(int(number[-1]) + 1) % 10} x") == []
    for number, after in (("DE89370400440532013000", " 2024 paid"), ("GB29 NWBK 6016 1331 9268 19", " BIC NWBKGB2L"), ("NO93 8601 1117 947", " 5 EUR")):
        assert found(f"IBAN: {number}{after}") == [(number, "iban")]


def test_cards_without_a_word_before_them():
    for c in ("4845168114407329", "4111 1111 1111 1111", "5555555555554444", "2223003122003222", "378282246310005", "30569309025904", "6011111111111117", "3530111333300000"):
        assert S.find(f"que {c} eai") == [(4, 4 + len(c), "card")]
        assert S.find(f"7536784127813051 {c}.") == [(17, 17 + len(c), "card")]
        assert S.find(f"no {c[:-1]}{(int(c[-1]) + 1) % 10} x") == [] and S.find(f"id a{c} {c}b") == []
    assert S.find("7536784127813050") == [] and S.find("4 4 4 4 " * 50_000 + "end") == []


def independent(text):
    """Spans of some kinds of secrets by plain loops and the public definitions of the formats, without the module's rules."""
    import zlib

    word = set(AL)
    out = []
    for head in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"):
        for i in range(len(text)):
            body = text[i + 4 : i + 40]
            if text[i : i + 4] == head and len(body) == 36 and set(body) <= word and (i == 0 or text[i - 1] not in word) and text[i + 40 : i + 41] not in word:
                n, crc = zlib.crc32(body[:30].encode()), ""
                while n:
                    n, d = divmod(n, 62)
                    crc = (string.digits + string.ascii_uppercase + string.ascii_lowercase)[d] + crc
                if body[30:] == crc.rjust(6, "0"):
                    out.append((i, i + 40, "npm_token" if head == "npm_" else "github_token"))
    i = text.find("-----BEGIN ")
    while i >= 0:
        line = text[i : text.find("-----", i + 11) + 5]
        end = text.find("-----END ", i)
        if line.endswith("PRIVATE KEY-----") and end >= 0:
            out.append((i, text.find("-----", end + 9) + 5, "private_key"))
        i = text.find("-----BEGIN ", i + 1)
    url = word | set("-_")
    for i in range(len(text)):
        if text[i : i + 3] == "eyJ" and (i == 0 or text[i - 1] not in url):
            parts, j = [], i
            for k in range(3):
                begin = j
                while j < len(text) and text[j] in url:
                    j += 1
                parts.append(text[begin:j])
                if k < 2:
                    if text[j : j + 1] != ".":
                        break
                    j += 1
            if len(parts) == 3 and parts[1].startswith("eyJ") and all(len(x) >= 8 for x in parts):
                out.append((i, j, "jwt"))
    return sorted(out)


def test_against_definitions_without_the_rules():
    pem = lambda n, head="": f"-----BEGIN RSA PRIVATE KEY-----\n{head}" + "\n".join(pick(64) for _ in range(n)) + "\n-----END RSA PRIVATE KEY-----"
    good = [with_crc("ghp_"), with_crc("npm_"), with_crc("ghs_"), pem(10), pem(300), pem(24, "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,00FF\n\n"), "eyJ" + pick(20) + ".eyJ" + pick(4097) + "." + pick(43), "eyJ" + pick(3000) + ".eyJ" + pick(90) + "." + pick(2000)]
    bad = [with_crc("ghp_")[:-1] + "_", "ghp_" + pick(36), "eyJ" + pick(9) + ".eyJ" + pick(3), "-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----", "x" + with_crc("npm_"), "plain words of a text"]
    for seed in range(30):
        rr = random.Random(seed)
        own = [rr.choice(good + bad) for _ in range(8)]
        text = "".join(x + rr.choice([" ", "\n", ", ", " | "]) for x in own)
        got = [x for x in S.find(text) if x[2] in ("github_token", "npm_token", "private_key", "jwt")]
        assert got == independent(text)
        left = S.redact(text)
        assert not any(x in left for x in own if x in good)


def test_runs_of_any_length():
    for text, size in ((f'token = "{pick(513)}"', 513), ("xoxb-" + pick(300), 305), ("sk_live_" + pick(150), 158)):
        (s, e, _), *more = S.find(text)
        assert e - s == size and not more
