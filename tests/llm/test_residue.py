import pytest

from lorekeep.llm import residue as R


@pytest.mark.parametrize("text", ["Dear {{ name }}, hi", "Owner: XXXX", "by {0} on time", "Release #{tag} ok", "to ${owner}.", "<%= team %> is", "at %(due)s now", "%FIRST_NAME% is", "__TITLE__ here", "@@LINK@@ here", "See [[summary]] for", "[INSERT NAME HERE]", "[Your Title]", "[title goes here]", "[TBD: first name]", "<VERSION> it", "<your name>", "<<owner>> it", "# ____________ (summary)", "{% block x %}"])
def test_placeholders(text):
    assert R.has_placeholder(R._prose(text))


@pytest.mark.parametrize("text", ["The expression `{{ x }}` is filled", "```\nname: {{ x }}\n```\ntext", "    ${x}\ntext", "A page said “Dear {{ name }}” to all", "see [the page](a/b.md) and [1, 20]", "- [ ] task\n- [x] done", "text\n______\ntext", "Vec<String> and a < b > c", '{"error": 1}', "5 % of 3%", ""])
def test_no_placeholders(text):
    assert not R.has_placeholder(R._prose(text))


@pytest.fixture
def judge(spark):
    """filler, page of each text, by trusted labels and what spreads among the texts."""

    def run(*texts, company=()):
        rows = list(enumerate([*texts, *company]))
        out = {r.doc_id: r for r in R.labelled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        return [out[i] for i in range(len(texts))]

    return run


def test_trusted_filler(judge):
    texts = ["Lorem ipsum dolor amet consectetur adipiscing.", "This is filler. This is filler.", "Caption 1: dummy value\nCaption 2: some text", "asdf asdf asdf asdf asdf asdf", "Your content here. Replace this text with your own.", "# T\n\nTexto de relleno: aquí."]
    assert all(r.filler and not r.page and not r.spread for r in judge(*texts))


def test_no_filler(judge):
    texts = ["The design review found lorem ipsum in one column; the team replaced it.", "We tested the text of the box.", "it was very very good", "", None]
    assert not any(r.filler or r.page for r in judge(*texts))


def test_pretended_latin_is_learned(judge):
    import random

    rnd = random.Random(3)
    invented = "lorem ipsum dolor amet zugra fobilla mentrox sardim plovia kresta".split()
    known = [" ".join(rnd.choices(invented, k=9)).capitalize() + "." for _ in range(60)]
    texts = ["Real words stand here.\n\nZugra fobilla mentrox sardim plovia kresta zugra.", "Unknown quilmo traspen vordik lanu besto."]
    got = judge(*texts, company=known)
    assert [(r.filler, r.spread) for r in got] == [(True, True), (False, False)]


def test_filler_by_company(judge):
    odd = "This box only keeps its place."
    beside = [f"Sample text goes here. {odd} Number {i} follows in the list of it." for i in range(3)]
    got = judge(f"{odd}", "The box keeps a place for everything else that comes.", company=beside)
    assert [(r.filler, r.spread) for r in got] == [(True, True), (False, False)]


@pytest.mark.parametrize("text", ["Please enable JavaScript to view this page.", "Menu  Home  Boards  Docs  Sign in\nAccess denied\nYou have no permission to open x.\n© X", '{"error":{"code":404}}', "404 Not Found\n\nThe address /a is not on this server.\nReference ab12", "Loading…\n\nIf nothing happens, switch scripts on.", "Traceback: relay failed while rendering template a/b.go: internal error, request 2f", "HTTP 502\n" + "Access denied\n" * 60])
def test_error_pages(judge, text):
    (got,) = judge(text)
    assert got.page and not got.spread


@pytest.mark.parametrize("text", ["The page handler returns 404 Not Found when it is empty, and a test covers it.", "We dropped the notice that asked people to enable JavaScript.", 'The message "access denied" confused them.', "Access denied\n\nThis report explains why the login failed on Monday.", "", "© X", "Loading…"])
def test_no_error_pages(judge, text):
    assert not judge(text)[0].page


def test_tables(spark):
    rows = [(1, "Access denied", "x"), (2, None, "x"), (3, "", "x"), (4, " ​\n", "x"), (5, "Dear {{ x }}", None), (6, "a note", "x"), (6, "a note", "x"), (7, "real words " * 30_000, "x"), (8, "T\n\nAccess denied", "x"), (9, "words " * 9, "x"), (None, "Access denied", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, code string")
    got = [(r.doc_id, r.placeholder, r.filler, r.page) for r in R.labelled(df).collect()]
    assert len(got) == len(rows)
    assert {i for i, *f in got if any(f)} == {None, 1, 5, 8, 9}  # nine times one word is filler
    assert R.labelled(df.limit(0)).count() == 0


def test_labels_spread_through_near_duplicates(judge):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}panel" for i in range(35)]
    page = "We cannot load this board with " + " ".join(words) + "."
    near = "They cannot load this board with " + " ".join(words) + "."
    farther = "They cannot load this board with " + " ".join(words) + " now."
    other = "They cannot load this board with " + " ".join(words[:8]) + " but all others " + " ".join(w + "s" for w in words[8:]) + "."
    got = judge(page, near, farther, other, "nothing alike at all here")
    assert [(r.page, r.spread) for r in got] == [(True, False), (True, True), (True, True), (False, False), (False, False)]


def test_recall_of_near_wordings_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    known = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(14, 60))] for _ in range(120)]
    rows = []
    for ws in known:
        for _ in range(3):
            edited = list(ws)
            for _ in range(rnd.randrange(1, 3)):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            rows.append(edited)
    docs = spark.createDataFrame(list(enumerate(" ".join(w) for w in known + rows)), "doc_id bigint, text string")
    units = R.read_documents(docs).selectExpr("doc_id", "posexplode(units) as (at, u)").selectExpr("doc_id", "at", "u.code", "u.sim", "u.size - 4 as shingled")
    found = {r.code for r in R.near_wordings(units, units.where(f"doc_id < {len(known)}").selectExpr("*", "2 as kind"), docs).collect()}
    code = {r.doc_id: r.code for r in units.collect()}
    sets = [{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in known + rows]
    true = {code[j] for j in range(len(known), len(sets)) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(len(known)))}
    new = {code[j] for j in range(len(known), len(sets))}
    assert found & new <= true
    assert len(true) > 50 and len(found & true) >= 0.9 * len(true)
