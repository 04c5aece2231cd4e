import hashlib
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from bitloom.llm import secret_scan as SS
from bitloom.llm.secret_scan import base_spans, lexed_spans, name_score, redact, scan_secrets, value_score

ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ORDER = {"assign": 0, "access": 1, "hex": 2}


def brute(text):
    s = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(s) if len(m[1]) >= 8] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 32]
    found.sort(key=lambda x: (x[1], ORDER[x[0]]))
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (*(sum(f[0] == k for f in found) for k in ORDER), hashlib.sha256(text.encode()).hexdigest()), [x for x in text.split(",") if x]


def agrees(r):
    counts, spans = brute(r.text)
    listed = r.spans.split(",") if r.spans else []
    return (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == counts and [s for s in listed if not s.startswith("lexed")] == spans


def test_whole_table(spark):
    rows = scan_secrets(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert all(map(agrees, rows)) and sum(r.n_assign for r in rows) > 0


def test_odd_rows(odd_docs, no_docs):
    rows = scan_secrets(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(map(agrees, rows))
    assert scan_secrets(no_docs).count() == 0


def test_lexing():
    cases = {
        'A = "s3cr3tV4lue9x"\npassword = A': ["s3cr3tV4lue9x"],
        '{"password": "hunter2Xy", "user": "bob"}': ["hunter2Xy"],
        'api_key: str = "abc123DEF456ghij"': ["abc123DEF456ghij"],
        'const apiKey = "ab12" + "cd34ef56"': ["ab12", "cd34ef56"],
        "export DB_PWD=ab12cd34ef": ["ab12cd34ef"],
        "<clientSecret>abc123def456</clientSecret>": ["abc123def456"],
        'if password == "s3cretPass99": pass': ["s3cretPass99"],
        'connect(host="h", password="p4ssw0rdX!")': ["p4ssw0rdX!"],
        "the password: something was said": [], 'password_url = "https://x.example/reset12"': [], 'pwd="<changeme>"': [], "secret of the token": [], 'title = "abc123def456"': [], "": [],
    }
    for text, want in cases.items():
        assert [text[a:b] for a, b in lexed_spans(text)] == want, text


def test_redaction_merges_overlaps():
    assert redact("abcdefghij", [("assign", 1, 5), ("lexed", 3, 7), ("hex", 8, 9)]) == "a[SECRET]h[SECRET]j"
    assert redact("abc", []) == "abc"


def test_stray_quotes():
    cases = {
        "don't commit: db_pwd = 'hunter22x'": ["hunter22x"],
        "it's db_pwd = 'hunter22x'": ["hunter22x"],
        "# l'accès d'hier, où l'auth: passphrase = 'abc123def456'": ["abc123def456"],
        "the boys' db_pwd = 'hunter22x'; it's fine": ["hunter22x"],
        "'tis here: db_pwd = 'hunter22x'": ["hunter22x"],
        "'tis here: db_pwd = '!hunter22x'": ["!hunter22x"],
        "'tis {'db_pwd': 'hunter22x'}": ["hunter22x"],
        '5" disk: db_pwd = "hunter22x"': ["hunter22x"],
        "it's 'quoted' and accessKey = 'ab12cd34ef'\nprivate_key = 'zz98yy76xx'": ["ab12cd34ef", "zz98yy76xx"],
        "sh -c 'export DB_PWD=\"ab12cd34ef\"'": ["ab12cd34ef"],
        "'tis db_pwd = \"hunter22x\" (of the boys')": ["hunter22x"],
        "db_pwd = 'it\\'s4secret9'": ["it\\'s4secret9"],
        "x = b'k=' ; db_pwd = 'hunter22x'": ["hunter22x"],
        'log("db_pwd = ", cfg1.get(x9), "end of it")': [], "it's the pwd: don't tell": [], "print('pwd: ' + name + ' of 12 users')": [],
    }
    for text, want in cases.items():
        assert [text[a:b] for a, b in lexed_spans(text)] == want, text
        assert all(v not in redact(text, [("lexed", *s) for s in lexed_spans(text)]) for v in want)


def test_many_quotes_stay_linear():
    text = "it's pwd: 'a=" * 40_000
    assert lexed_spans(text) == []


def test_more_syntax():
    cases = {
        'password = """s3cr3tV4lue9x"""': ["s3cr3tV4lue9x"],
        "db_pwd = '''ab12\ncd34ef56'''": ["ab12\ncd34ef56"],
        "Authorization: Bearer ab12CD34ef56GH78": ["ab12CD34ef56GH78"],
        'headers = {"Authorization": "Bearer ab12CD34ef56GH78"}': ["ab12CD34ef56GH78"],
        "curl -H 'Authorization: Basic dXNlcjpwYXNzMTIz' https://x.example": ["dXNlcjpwYXNzMTIz"],
        "Authorization: required by the manager": [], "Authorization: Bearer token required": [], '""" about the password: nothing here """': [],
        'def a():\n    K = "ab12cd34ef"\n    return 1\n\ndef b(K):\n    db_pwd = K\n': [],
        'def a():\n    K = "ab12cd34ef"\n    db_pwd = K\n': ["ab12cd34ef"],
        'K = "ab12cd34ef"\ndef b():\n    db_pwd = K\n': ["ab12cd34ef"],
        'function a() { K = "ab12cd34ef"; }\nfunction b(K) { db_pwd = K; }': [],
        'K = "ab12cd34ef";\nfunction b() { if (x) { db_pwd = K; } }': ["ab12cd34ef"],
        'A = "ab12cd"\nB = A + "34ef56"\ndb_pwd = B + B': ["ab12cd", "34ef56"],
    }
    for text, want in cases.items():
        assert [text[a:b] for a, b in lexed_spans(text)] == want, text


@pytest.mark.parametrize("text", [
    'token = 1 "' + '\\"a' * 330_000,
    "token = 1 '" + "\\'a" * 330_000 + "'x",
    "token='\"`" * 120_000,
    "password=" * 110_000,
    "a=" * 500_000 + "token",
    'K0 = "ab12cd34"\n' + "".join(f"K{i + 1} = K{i} + K{i}\n" for i in range(40_000)) + "db_pwd = K40000",
    'K0 = "ab12cd34"\n' + "".join(f"db_pwd = K{i} = K0\nK{i + 1} = K{i} + 'x'\n" for i in range(20_000)),
    'A = "' + "x1" * 250_000 + '"\n' + "db_pwd = A\n" * 40_000,
    "{" * 500_000 + 'token: "a"' + "}" * 500_000,
    '"""' * 330_000 + " token=",
    "<token>" * 140_000,
    "pwd=\"" + "a='b:" * 200_000,
    "token=%a=" * 110_000,
    "pwd=x1 + " * 100_000,
    'K0 = "' + "".join(map(chr, range(0x4E00, 0x9000))) + '"\n' + "".join(f"K{i + 1} = K{i} + 'x'\n" for i in range(15_000)) + "".join(f"db_pwd = K{i}\n" for i in range(15_000, 0, -1)),
    'pwd = "' + "k=v1 " * 200_000 + '"',
    "pwd = f(" * 120_000 + ")" * 120_000,
], ids=range(17))
def test_hostile_texts_take_linear_time(text):
    start = time.process_time()
    lexed_spans(text)
    base_spans(text)
    assert time.process_time() - start < 15


def test_a_chain_of_constants_leads_to_its_literals():
    text = 'K0 = "ab12cd34"\n' + "".join(f"K{i + 1} = K{i} + K{i}\n" for i in range(200)) + "db_pwd = K200"
    assert [text[a:b] for a, b in lexed_spans(text)] == ["ab12cd34"]


def test_values_are_judged_whole():
    rest = "Zx9kk22PPqqZx9kk22PPqq"
    for name in ("db_credential", "service_auth", "n" * 600 + "_pwd"):
        for value in ("a" * 512 + rest, rest + "a" * 512, "a" * 700 + rest * 40):
            text = f'{name} = "{value}"'
            # what is random may stand anywhere in the value
            assert bool(lexed_spans(text)) == (name_score(name) + value_score(value, True) >= 4), (name, value)
    text = f'{{"{"k" * 600}_passphrase": "{rest}"}}'
    assert [text[a:b] for a, b in lexed_spans(text)] == [rest]


alphabet = st.sampled_from(["aaaa", "x", "Zx9", "%", "<", ">", "é", "\u4e00\u4e8c", ".", "*", "X", "your", "-", "42"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(alphabet, min_size=1, max_size=30).map("".join), min_size=1, max_size=4), st.booleans(), st.integers(1, 200))
def test_long_scores(parts, quoted, times):
    """Joined values and values that end in one run are scored as their whole text is."""
    whole = [p * times for p in parts]
    values = [SS.Value(w, len(w), quoted, ((0, 1),), (w, 0, len(w))) for w in whole]
    joined = values[0]
    for v in values[1:]:
        joined = joined.joined(v)
    assert joined.judged() == value_score("".join(whole), quoted)
    run = SS.Run("".join(whole), 0, sum(map(len, whole)))
    for a in (0, 1, len(run.source) // 3, len(run.source) - 1):
        v = run.source[a:]
        assert SS.Value(v, len(v), quoted, ((0, 1),), (run, a, run.end)).judged() == value_score(v, quoted)


def test_more_places():
    v = "Zx9kk22PPqq"
    cases = {
        f'cfg["pwd"]="{v}"': [v], f"os.environ['DB_PWD'] = '{v}'": [v], f'db_pwd =\n    "{v}"': [v], f'db_pwd = \\\n    "{v}"': [v],
        f'x = "{{\\"db_pwd\\": \\"{v}\\"}}"': [v], f"pwd = f'{v}{{n}}'": [v + "{n}"], f'pwd = os.getenv("X") or "{v}"': [v], f'pwd = env("A_B") || "{v}"': [v], 'pwd = os.getenv("DB_PWD")': [],
        "pwd = read_password_file9(x)": [],
    }
    for text, want in cases.items():
        assert [text[a:b] for a, b in lexed_spans(text)] == want, text
