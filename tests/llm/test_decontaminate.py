import random

import pytest

from gleaner.llm import decontaminate

ITEM = "A farmer named Anna has 12 cows and buys 5 more cows for 300 dollars, how many cows has Anna then on her farm in spring"
OTHER = "A farmer named Berta has 44 cows and buys 7 more cows for 910 dollars, how many cows has Berta then on her farm in spring"
MIXED = "A farmer named Berta has 44 cows and buys 7 more cows for 910 dollars, how many cows has Clara then on her farm in spring"


def frames(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(n))
    plain = noise(20)
    docs = [(1, f"{noise(30)}. {ITEM}. {noise(20)}"), (2, f"{noise(9)}. {OTHER}. {noise(5)}"), (3, f"{noise(9)}. {MIXED}. {noise(9)}"), (4, noise(60)), (5, None), (6, ""), (None, ITEM), (7, f"{noise(5)} {plain} {noise(5)}"), (8, noise(10) + " tiny little item here " + noise(4)), (1, f"{ITEM}."), (9, plain[: len(plain) // 4] + " " + noise(30))]
    items = [(10, ITEM), (11, OTHER), (12, plain), (13, None), (14, ""), (15, "1 2 3 4 5 6 7 8 9 10"), (None, noise(20)), (16, "tiny little item here"), (12, plain)]
    return (spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3), spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int"))


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_finds_items_asked_again_with_other_values(spark, most):
    docs, items = frames(spark)
    got = decontaminate.find_leaks(docs, items, max_windows=most).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 10), (1, 10), (1, 10), (2, 10), (7, 12), (8, 16)]
    kept = decontaminate.without_leaks(docs, items, max_windows=most)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 9]


def test_templates():
    code, kind = decontaminate.template("We met Anna. Then 5 kg or 7km, twenty Euros".split())
    assert kind.tolist() == [0, 0, 3, 0, 1, 2, 0, 1, 1, 2]
    other, _ = decontaminate.template("We met Berta. Then 61 g or 9m, ten dollars".split())
    assert (code == other).all()


def test_long_texts_and_empty_tables(spark):
    docs, items = frames(spark)
    long = spark.createDataFrame([(99, "word " * 50_000 + ITEM, 0)], docs.schema)
    assert [r.item_id for r in decontaminate.find_leaks(long, items).collect()] == [10]
    assert decontaminate.find_leaks(docs.limit(0), items).collect() == []
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == docs.count()


def found(spark, docs, items):
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted((r.doc_id, r.item_id) for r in got)


def test_items_with_other_equal_slots_are_looked_for_each(spark):
    ask = "a farmer has {} cows and buys {} more cows at the next market in spring, so how many cows are there then".format
    other = "the quick brown fox jumps over a lazy dog near the old river bank while it rains"
    docs = [(1, ask(12, 5)), (2, ask(12, 12)), (3, ask(4, 4)), (4, other)]
    assert found(spark, docs, [(1, ask(9, 9)), (2, ask(12, 5))]) == [(1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    # Two texts of one id.
    assert found(spark, docs, [(1, ask(9, 9)), (1, ask(12, 5)), (1, other)]) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_items_are_found_in_company_as_they_are_alone(spark):
    """A class of items stands for those only that match the same documents, and names them all."""
    numbers, more = "3 1 4 15 9 26 5 35 8 97 93", "2 7 18 28 45 90 4 52 35 36 28.5"
    opened, other = "Anna keeps 12 brown cows in the barn and then Anna sells them all", "Anna keeps 12 brown cows in the barn and then Bob sells them all"
    ask = "a farmer has {} cows and buys {} more cows at the next market in spring, so how many cows are there then".format
    items = [(1, numbers), (2, more), (3, opened), (4, other), (5, ask(12, 5)), (6, ask(9, 4)), (7, ask(9, 4)), (7, more), (8, ask(3, 3))]
    docs = [(10, f"so {numbers} it is"), (11, f"so {more} it is"), (12, f"here {other.replace('Anna', 'Carl').replace('Bob', 'Dora')} today"), (13, f"here {opened.replace('Anna', 'Carl')} today"), (14, f"now {ask(77, 6)} he asks"), (15, f"{more} and {ask(1, 2)}"), (16, f"{ask(8, 8)}")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    table = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    together = decontaminate.find_leaks(docs, table(items)).collect()
    assert all(r.item_ids == sorted(set(r.item_ids)) and r.item_ids[0] == r.item_id for r in together)
    alone = {(r.doc_id, i) for i in {i for i, _ in items} for r in decontaminate.find_leaks(docs, table([x for x in items if x[0] == i])).collect()}
    assert {(r.doc_id, i) for r in together for i in r.item_ids} == alone
    assert {(10, 1), (11, 2), (11, 7), (12, 4), (13, 3), (14, 5), (14, 6), (14, 7), (15, 2), (16, 8)} <= alone


def test_a_share_that_is_met_exactly(spark):
    item = " ".join(f"w{chr(97 + i)}" if i < 26 else f"x{i}" for i in range(32))  # 25 windows, of which the first 14 words hold 7
    docs = spark.createDataFrame([(1, " ".join(item.split()[:14]))], "doc_id long, text string")
    assert [r.covered for r in decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), share=0.28).collect()] == [7]


def test_copies_of_items_that_are_mostly_placeholders(spark):
    numbers, titles = "1 1 2 3 5 8 13 21 34 55 89", "see The Old Man And The Sea By Ernest Hemingway Today"
    docs = [(1, f"some words before it {numbers} and some after"), (2, "1 1 2 3 5 8 13 21 34 56 90 144"), (3, f"we {titles} again"), (4, "2 3 4 5 6 7 8 9 10 11 12")]
    assert found(spark, docs, [(1, numbers), (2, titles)]) == [(1, 1), (2, 1), (3, 2)]
    # The few literal windows of an item do not decide for it.
    mixed = "the sum of these numbers is what we need " + " ".join(map(str, range(100, 130)))
    assert found(spark, [(1, mixed), (2, "the sum of these numbers is what we need " + " ".join(map(str, range(500, 530))))], [(1, mixed)]) == [(1, 1)]


def test_names_that_open_sentences(spark):
    ask = "{} has 12 cows. {} has {} cows. {} has 3 cows. How many cows are there in all?".format
    docs = [(1, "A text. " + ask("Dora", "Emil", 8, "Fritz")), (2, "some heading Emil walked home in the rain"), (3, "now " + ask("Anna", "Bob", 5, "Carl")), (4, ask("Dora", "Emil", 8, "Dora")), (5, "so the old farmer sells his cows today")]
    items = [(1, ask("Anna", "Bob", 5, "Carl")), (2, "Emil walked home in the rain"), (3, "The old farmer sells his cows today and goes"), (4, "The old farmer sells his cows today")]
    assert found(spark, docs, items) == [(1, 1), (2, 2), (3, 1), (5, 4)]


def test_clashing_columns(spark):
    item = "which of these seven rivers runs past the old stone mill at the foot of the hill"
    docs = spark.createDataFrame([(1, f"so {item} then", 77, 78), (2, "quite another text about nothing at all in here", 77, 78)], "doc_id long, text string, _doc int, _hash int")
    left = decontaminate.without_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert left.columns == docs.columns and [(r.doc_id, r._doc, r._hash) for r in left.collect()] == [(2, 77, 78)]


def test_recall_of_questions_asked_again(spark):
    """Of questions asked again with other numbers, units and names nine in ten are found, and no others."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(3, 8)))
    names, units = ["Anna", "Bob", "Carla", "Dieter", "Émile", "Félix", "Gloria"], ["km", "Stunden", "mètres", "semanas", "dollars"]
    spelt = ["zwölf", "quinze", "ocho", "twenty", "2.5"]

    def question(shape):
        """Each variable gets a value of its own, the same wherever it stands."""
        value = {}
        for kind, some in (("#", [*spelt, *(str(n) for n in rng.sample(range(2, 999), 40))]), ("N", names), ("U", units)):
            chosen = rng.sample(some, len(some))
            value.update((f"{kind}{i}", v) for i, v in enumerate(chosen))
        return " ".join(value.get(w, w) for w in shape)

    slot = lambda: rng.choice([f"#{rng.randrange(6)}", f"#{rng.randrange(6)}", f"N{rng.randrange(3)}", f"U{rng.randrange(2)}"])
    shapes = [[word(), *(word() if rng.random() > 0.25 else slot() for _ in range(rng.randint(12, 40)))] for _ in range(60)]
    items = [(i, question(s)) for i, s in enumerate(shapes)]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{noise(20)} {question(s)} {noise(20)}") for i, s in enumerate(shapes)] + [(100 + i, question([word() if rng.random() > 0.25 else slot() for _ in range(60)])) for i in range(60)]
    got = found(spark, docs, items)
    assert sum((i, i) in got for i in range(60)) >= 54 and all(d == i for d, i in got)


def test_a_large_benchmark_is_sifted(spark):
    import numpy as np

    docs, items = frames(spark)
    windows = spark.createDataFrame([(int(w),) for w in np.random.default_rng(1).integers(-(2**62), 2**62, 500)], "window long")
    table = decontaminate._sieve(windows)
    places = [r.window & (1 << 27) - 1 for r in windows.collect()]
    assert all(table[p >> 3] >> (p & 7) & 1 for p in places) and np.unpackbits(table).sum() == len(set(places))


def test_plain_words_have_the_codes_that_the_patterns_give():
    words = decontaminate._Words()
    for word in ["Anna", "anna", "Anna.", "ANNA", "vier", "Zwölf,", "km", "Km;", "a", "A", "A!", "ªb", "écrit:", ".", ",", "x.", "McNeil", "12", "7km", "é", "ß", "ǅ", "中文", "don't", '"Anna', "word?!", "I", "I.", "-a", "²", "a²"]:
        assert words[word] == words.by_patterns(word), word


def test_windows_at_places():
    import numpy as np

    from gleaner.llm.shingles import windows, windows_at

    words = np.random.default_rng(3).integers(0, 2**63, 50).astype(np.uint64)
    at = np.array([0, 7, 42])
    assert (windows_at(words, at, 8) == windows(words, 8)[at]).all() and len(set(windows(words, 8).tolist())) == 43
