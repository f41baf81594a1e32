import random

from helpers import TEXTS, docs

from threadgraph.llm import decontaminate as D

ITEM = "A train leaves Boston at 40 miles per hour and meets Alice Smith after 3 hours. How far did Alice Smith travel if she walks 5 km more than the train did?"


def leaks(spark, texts, items):
    b = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, h int, at string")
    rows = D.find_leaks(docs(spark, texts), b).collect()
    return {(r["doc_id"], r["item_id"], r["verbatim"]) for r in rows}


def test_templates(spark):
    changed = ITEM.replace("Boston", "Denver").replace("40", "75").replace("Alice Smith", "Bob").replace(" 3 ", " 9 ")
    mixed = ITEM.replace("meets Alice Smith", "meets Bob").replace("did Alice Smith", "did Carol Jones")
    texts = list(TEXTS) + [(10, "Well. " + ITEM + " So it goes."), (11, "before it " + changed), (12, mixed), (13, ITEM.lower()), (14, "A train leaves town and nothing else happens here at all today."), (10, "Well. " + ITEM + " So it goes.")]
    got = leaks(spark, texts, [(1, ITEM), (2, None), (3, ""), (4, "short item here"), (5, "!!! ...")])
    assert (10, 1, True) in got and (11, 1, False) in got and (13, 1, True) in got
    assert not {d for d, _, _ in got} & {12, 14, 1, 2, 3, 4, None}
    assert leaks(spark, [], [(1, ITEM)]) == set() and leaks(spark, [(1, ITEM)], []) == set()


def test_like_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, words(rng.randint(5, 40))) for i in range(12)]
    texts = []
    for d in range(60):
        w = words(rng.randint(0, 60))
        if d % 3 == 0:
            _, item = rng.choice(items)
            lo = rng.randint(0, max(0, len(item) - 13))
            w += item[lo:lo + rng.randint(9, 30)] + words(10)
        texts.append((d, w))
    want = set()
    for d, w in texts:
        for i, item in items:
            n = min(13, len(item))
            grams = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)}
            if any(tuple(w[k:k + n]) in grams for k in range(len(w) - n + 1)):
                want.add((d, i))
    got = {(d, i) for d, i, _ in leaks(spark, [(d, " ".join(w)) for d, w in texts], [(i, " ".join(w)) for i, w in items])}
    assert got == want and want


def test_many_numbers(spark):
    sand = "Add 12 kg, 15 kg and 40 kg of sand"
    fruit = "If there are 3 apples in the red basket and then someone adds another 4 pears to it"
    sort = "Please sort the numbers 5 1 9 7 3 8 2 6 4 0 in ascending order now"
    texts = [(1, "so add 13 kg, 17 kg and 60 kg of sand"), (2, fruit.replace("3", "5").replace("4", "5")), (3, sort.replace("5 1 9 7 3 8 2 6 4 0", "6 2 8 5 4 9 3 1 7 0")), (5, " ".join(map(str, range(300))))]
    got = {(d, i) for d, i, _ in leaks(spark, texts, [(1, sand), (2, fruit), (3, sort)])}
    assert got == {(1, 1), (2, 2), (3, 3)}
