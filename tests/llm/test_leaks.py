import random

from lorekeep.llm import leaks as L

ITEMS = "item_id bigint, suite string, split string, lang string, text string, answer string, doc_id bigint"
DOCS = "doc_id bigint, text string, item_id bigint, verbatim string"
ITEM = "which panel did Soskiond retry in board service after 42 seconds of hashing the quota remotely"


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, "s", split, "en", t, "a", 1) for i, split, t in items], ITEMS)
    return {(r.doc_id, r.item_id): (r.verbatim, r.consistent, r.slots) for r in L.leaks(d, e, **more).collect()}


def test_verbatim_runs(spark):
    words = ITEM.split()
    docs = [(1, f"Before. {ITEM.upper()}! After."), (2, "x " + " ".join(words[:12]) + " y"), (3, "x " + " ".join(words[:11]) + " y"), (4, None), (5, ""), (6, "—".join(words)), (7, " ".join(words[:6]) + " other " + " ".join(words[6:]))]
    got = run(spark, docs, [(10, "test", ITEM), (11, "train", ITEM), (12, "Dev", ITEM), (13, "test", None), (14, "test", "short one")])
    assert {k for k, v in got.items() if v[0] >= 12} == {(d, i) for d in (1, 2, 6) for i in (10, 12)}
    assert got[1, 10][0] == len(words) and got[2, 10][0] == 12


def test_other_fillings(spark):
    swapped = ITEM.replace("Soskiond", "Briolras").replace("42", "17").replace("seconds", "weeks")
    got = run(spark, [(1, swapped), (2, ITEM.replace("quota", "ledger").replace("after", "before"))], [(10, "test", ITEM)])
    assert got[1, 10][0] < 12 and got[1, 10][1] == len(ITEM.split()) and got[1, 10][2] == 3
    assert (2, 10) not in got


def test_slots_must_agree(spark):
    item = "compare Soskiond with Soskiond and then merge the two panels of Soskiond into one shared board"
    one = item.replace("Soskiond", "Briolras")
    two = item.replace("Soskiond", "Briolras", 1).replace("Soskiond", "Wapla", 1)
    got = run(spark, [(1, one), (2, two)], [(10, "dev", item)])
    assert got[1, 10][1:] == (len(item.split()), 1)
    assert got.get((2, 10), (0, 0, 0))[1] < len(item.split())


def test_long_texts_and_repeats(spark):
    many = [(i, "test", f"{ITEM} number{i} " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(30)]
    docs = [(1, "filler text " * 40_000 + many[17][2]), (1, many[17][2])]
    d = run(spark, docs, many)
    assert d[1, 17][0] == len(many[17][2].split())
    assert run(spark, [], many) == {} and run(spark, docs, []) == {}


def test_names_only_windows(spark):
    names = " ".join(f"Nam{c}o" for c in "abcdefghijklmn")
    assert run(spark, [(1, names), (2, names.replace("Nam", "Zim"))], [(10, "test", names)]).keys() == {(1, 10)}


def test_run_goes_on_behind_a_slot_filled_otherwise(spark):
    item = "take value 5 from the shared panel then add 5 more panels of the board and close the old quota".split()
    doc = [*item]
    doc[2], doc[9] = "7", "8"
    got = run(spark, [(1, " ".join(doc))], [(10, "test", " ".join(item))])
    assert got[1, 10][1:] == (len(item) - 3, 1)


def test_longest_run_by_brute_force():
    rng, kind = random.Random(7), lambda w: int(w.isdigit())
    for _ in range(300):
        item = [rng.choice("a b c 1 2 3".split()) for _ in range(30)]
        doc = [rng.choice("1 2 3".split()) if w.isdigit() else "z" if rng.random() < 0.03 else w for w in item]
        best = (0, 0)
        for i in range(30):
            for j in range(i + 1, 31):
                pairs = {(d, t) for d, t in zip(doc[i:j], item[i:j])}
                if len({d for d, _ in pairs}) == len({t for _, t in pairs}) == len(pairs) and all(d == t or kind(d) and kind(t) for d, t in pairs):
                    best = max(best, (j - i, -sum(d != t for d, t in pairs)))
        assert L._compare(doc, item, 0, list(range(19)), kind)[1:] == (best[0], -best[1])


def test_re_parameterised_leaks_against_brute_force(spark):
    rng = random.Random(9)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    items, docs, planted = [], [], set()
    for i in range(12):
        item = [f"Nam{rng.choice('abc')}" if rng.random() < 0.15 else str(rng.randrange(9)) if rng.random() < 0.1 else rng.choice(plain) for _ in range(26)]
        items.append((i, "test", " ".join(item)))
        for _ in range(2):
            names, numbers = {c: f"Zim{c}{rng.randrange(9)}x" for c in "abc"}, rng.sample(range(10, 99), 9)
            other = [f"Zim{w[3]}olo" if w.startswith("Nam") else str(numbers[int(w)]) if w.isdigit() else w for w in item]
            docs.append((len(docs), " ".join([*rng.choices(plain, k=8), *other[2:24], *rng.choices(plain, k=8)])))
            planted.add((len(docs) - 1, i))
    got = run(spark, docs, items)
    bits = L._bitmap(spark.createDataFrame([(L._hash(w) - (1 << 64) if L._hash(w) >= 1 << 63 else L._hash(w),) for _, _, t in items for w in L.plain_words(t)], "hash bigint"), L.WORD_BITS)
    kind = L._Codes(bits).kind
    true = set()
    for d, text in docs:
        for i, _, item in items:
            a, b = L.words(text), L.words(item)
            runs = [L._compare(a, b, s, list(range(max(0, s), min(len(a), len(b) + s) - L.WINDOW + 1)), kind) for s in range(-len(b) + L.WINDOW, len(a) - L.WINDOW + 1)]
            if max(max(r[0], r[1]) for r in runs) >= L.WINDOW:
                true.add((d, i))
    assert planted <= true and set(got) <= true
    assert len(set(got) & true) >= 0.95 * len(true)
