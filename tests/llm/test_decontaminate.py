"""Template decontamination on planted leaks and against plain sets of windows."""

import random

from pyspark.sql import functions as F

from keepsake.llm import decontaminate

QUESTION = "A train leaves Paris at 9 hours and travels 120 km towards Lyon while another train leaves the city of Lyon at 11 hours going towards Paris again"


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item", "1 as window", "2 as doc")
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_slots_and_consistency(spark):
    filler = "plain filler words that say nothing at all about the benchmark "
    other = QUESTION.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "3,500.5").replace("9 ", "7 ").replace("11 ", "8 ")
    wrong = QUESTION.replace("towards Lyon", "towards Madrid", 1).replace("Paris", "Rome")
    docs = [(1, filler + QUESTION + ". " + filler), (2, filler + other + ". " + filler), (3, filler + wrong + "."), (4, filler * 9), (5, None), (6, ""), (7, QUESTION), (7, QUESTION), (8, "⟨num⟩ " * 40), (None, QUESTION)]
    got = leaks(spark, docs, [(10, QUESTION), (10, QUESTION), (11, "too short"), (12, None)])
    assert got == {(1, 10): "exact", (2, 10): "reparameterised", (7, 10): "exact"}


def test_half_an_item_is_enough(spark):
    words = QUESTION.split()
    docs = [(1, "so " + " ".join(words[:20])), (2, "so " + " ".join(words[:9]))]
    assert set(leaks(spark, docs, [(10, QUESTION)])) == {(1, 10)}


def test_against_sets_of_windows(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 40)))) for i in range(15)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            source = rng.choice(items)[1].split()
            w += source[rng.randint(0, 5) : rng.randint(6, 40)]
        docs.append((d, " ".join(w)))
    windows = lambda t: {tuple(t.split()[i : i + 8]) for i in range(len(t.split()) - 7)}
    want = {(d, i) for d, t in docs for i, b in items if windows(b) and len(windows(b) & windows(t)) >= max(1, -(-len(windows(b)) // 2))}
    want |= {(d, i) for d, t in docs for i, b in items if not windows(b) and f" {b} " in f" {t} "}
    assert want and set(leaks(spark, docs, items)) == want


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, QUESTION)]) == {}
    assert leaks(spark, [(1, QUESTION)], []) == {}


LONG = "Every morning the old baker fills 9 trays with small round loaves and carries them slowly down the narrow stairs to the shop where his daughter sells them until 11 when the market closes for the day"


def test_verbatim_copies_outrank_slots(spark):
    twice = LONG.replace(" 9 ", " 11 ")
    reused = LONG + " and the baker counts 11 coins"
    docs = [(1, "so " + twice), (2, "so " + reused.replace("until 11", "until 12"))]
    assert leaks(spark, docs, [(10, LONG), (11, reused)]) == {(1, 10): "exact", (1, 11): "exact", (2, 10): "reparameterised", (2, 11): "exact"}


def test_every_shift_is_judged(spark):
    wrong = QUESTION.replace("towards Lyon", "towards Madrid", 1).replace("Paris", "Rome")
    right = QUESTION.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "350").replace("9 ", "7 ").replace("11 ", "8 ")
    assert leaks(spark, [(1, f"so {wrong}. And so {right}."), (2, f"so {right}. And so {wrong}."), (3, f"so {wrong}. And so {wrong}.")], [(10, QUESTION)]) == {(1, 10): "reparameterised", (2, 10): "reparameterised"}


def test_items_without_a_window(spark):
    names = "Paris London Rome Berlin Madrid Vienna Prague Oslo Dublin Athens"
    items = [(10, "what is the capital"), (11, "12 + 7 - 3 = 16, 16 km + 4 km = 20 km, 5 + 5 = 10"), (12, names), (13, ""), (14, "-- !")]
    docs = [(1, "He asked: What is the capital? Nobody knew"), (2, "see 12 + 7 - 3 = 16, 16 km + 4 km = 20 km, 5 + 5 = 10."), (3, f"the cities {names}"), (4, "what is a capital"), (5, "see 12 + 7 - 3 = 17, 17 km + 4 km = 21 km, 5 + 5 = 10."), (6, None)]
    assert leaks(spark, docs, items) == {(1, 10): "exact", (2, 11): "exact", (3, 12): "exact"}


def test_versions_of_one_question_are_one_item(spark):
    def version(a, b, c, d):
        return QUESTION.replace("Paris", a).replace("Lyon", b).replace("9 ", f"{c} ").replace("11 ", f"{d} ")

    names = ["Rome", "Milan", "Oslo", "Bern", "Cadiz", "Porto", "Turin", "Genoa"]
    items = [(i, version(names[i % 8], names[(i + 3) % 8], i + 20, i + 400)) for i in range(30, 60)] + [(70, version("Rome", "Milan", 5, 5))]
    docs = [(d, f"so {version(names[d % 8], names[(d + 1) % 8], d + 200, d + 300)}.") for d in range(20)] + [(50, f"so {items[17][1]}."), (51, f"so {version('Bern', 'Oslo', 6, 6)}.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.kind, r.n_items) for r in rows}
    assert len(rows) == len(got)
    assert got == {(d, 30): ("reparameterised", 30) for d in range(20)} | {(50, 30): ("exact", 30), (51, 70): ("reparameterised", 1)}
    classes = decontaminate.item_classes(spark.createDataFrame(items, "item_id long, text string")).select("item", "member").collect()
    assert {(r.item, r.member) for r in classes} == {(30, i) for i in range(30, 60)} | {(70, 70)}


def test_numbers_as_words_units_of_four_languages_and_long_names(spark):
    texts = {
        "it took Twenty-five hours and 3.5 km": "it took ⟨num⟩ ⟨unit⟩ and ⟨num⟩ ⟨unit⟩",
        "two hundred trains, sixteen km, tenfold": "⟨num⟩ trains ⟨num⟩ ⟨unit⟩ tenfold",
        "il y a douze heures et deux mille personnes": "il y a ⟨num⟩ ⟨unit⟩ et ⟨num⟩ personnes",
        "es sind fünf Stunden bis Bad Homburg, 20 Uhr": "es sind ⟨num⟩ ⟨unit⟩ bis ⟨name⟩ ⟨num⟩ ⟨unit⟩",
        "hay veintidós días y 7 años en San José de Costa": "hay ⟨num⟩ ⟨unit⟩ y ⟨num⟩ ⟨unit⟩ en ⟨name⟩ de ⟨name⟩",
        "we left New York City for Rome. The Paris train": "we left ⟨name⟩ for ⟨name⟩ the ⟨name⟩ train",
        "a one b $5 and 10% of 12oz": "a ⟨num⟩ b ⟨unit⟩ ⟨num⟩ and ⟨num⟩ ⟨unit⟩ of ⟨num⟩ ⟨unit⟩",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: " ".join(r.w) for r in df.select("t", decontaminate.words_of(decontaminate.marked(F.col("t")), False).alias("w")).collect()}
    assert got == texts
    values = df.select(decontaminate.words_of(decontaminate.marked(F.lit("we left New York City at twenty-five")), True).alias("w")).first().w
    assert values == ["we", "left", "⟨name⟩new·york·city", "at", "⟨num⟩twenty·five"]


def test_a_copy_with_numbers_as_words_is_found(spark):
    item = "a bus carries 12 passengers from Berlin over the old bridge towards the market and 5 of them leave before the driver turns left"
    copies = [item.replace("12", "thirty").replace("5", "eight"), item.replace("12", "77").replace("Berlin", "New York"), item.replace("12", "seven").replace("5", "seven"), "plain words that say nothing at all about any bus or its passengers"]
    assert leaks(spark, list(enumerate(copies)), [(10, item)]) == {(0, 10): "reparameterised", (1, 10): "reparameterised"}


def test_long_runs_of_names_and_number_words(spark):
    # such a run overflowed the stack of a task, which ends the executor: here, the JVM of the tests
    runs = {"Paris ": 5_000, "one ": 5_000, "Twenty-": 5_000, "Paris one ": 2_500}
    docs = [(k, f"so {run * n}and then {QUESTION}.") for k, (run, n) in enumerate(runs.items())]
    assert leaks(spark, [*docs, (9, "so " + "Paris " * 5_000)], [(10, QUESTION)]) == {(k, 10): "exact" for k in range(4)}
    texts = spark.createDataFrame([("so " + run * 20_000,) for run in ("one ", "Twenty-")], "t string")
    assert [r.w for r in texts.select(decontaminate.words_of(decontaminate.marked(F.col("t")), False).alias("w")).collect()] == [["so", "⟨num⟩"]] * 2


def plain_judge(doc, item, size=8):
    """The kind of leak by plain loops over template words and values; None if there is none. Texts of slots <num> and plain words."""
    template = lambda words: [("#" if w.isdigit() else w) for w in words]
    d, b = doc.split(), item.split()
    td, tb = template(d), template(b)
    solid = [i for i in range(len(b) - size + 1) if 2 * tb[i : i + size].count("#") <= size]
    windows = {tuple(tb[i : i + size]) for i in solid}
    need = max(1, -(-len(windows) // 2))
    here = {tuple(td[i : i + size]) for i in range(len(d) - size + 1)}
    matched = windows & here
    if not windows or len(matched) < need:
        return None
    pairs = [(i, j) for i in solid for j in range(len(d) - size + 1) if td[j : j + size] == tb[i : i + size]]
    exact = {tuple(tb[i : i + size]) for i, j in pairs if d[j : j + size] == b[i : i + size]}
    shifts = {}
    for i, j in pairs:
        shifts.setdefault(j - i, []).append(i)
    most = max(map(len, shifts.values()))
    for shift, starts in shifts.items():
        if len({tuple(tb[i : i + size]) for i in starts}) < need and len(starts) < most:
            continue
        slots = {(b[k], d[k + shift]) for i in starts for k in range(i, i + size) if tb[k] == "#"}
        if len({x for x, _ in slots}) == len(slots) == len({y for _, y in slots}):
            return "exact" if len(exact) >= len(matched) else "reparameterised"
    return "exact" if len(exact) >= need else None


def test_slots_of_random_twins(spark):
    rng = random.Random(31)
    word = lambda: rng.choice("kra lso mte nui por sati".split())
    number = lambda: str(rng.choice([3, 4, 5, 66, 77]))
    items = [(k, " ".join(["q" + "abcdefghijkl"[k], *(number() if rng.random() < 0.3 else word() for _ in range(rng.randint(14, 30)))])) for k in range(12)]
    docs = []
    for d in range(150):
        words = rng.choice(items)[1].split()
        swap = {str(n): number() for n in (3, 4, 5, 66, 77)} if rng.random() < 0.7 else {}
        words = [swap.get(w, w) if rng.random() < 0.95 else number() if w.isdigit() else w for w in words]
        at = rng.randint(0, 4)
        docs.append((d, " ".join([*(word() for _ in range(rng.randint(0, 5))), *words[at : rng.randint(10, 40)], *(word() for _ in range(rng.randint(0, 5)))])))
    # items of one class are one; here each has a word of its own, so each is alone in its class
    want = {(d, k): kind for d, t in docs for k, b in items if (kind := plain_judge(t, b))}
    assert len(want) > 30 and len(set(want.values())) == 2
    assert leaks(spark, docs, items) == want
