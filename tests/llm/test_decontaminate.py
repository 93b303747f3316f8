"""Benchmark decontamination against SQL and by hand."""

from __future__ import annotations

import random
from collections import Counter

from conftest import SMALL, duck_rows, rows
from helpers import documents, empty, odd, words

from visitcast.llm import decontaminate as d

ITEM = "A train leaves the old station at 60 km/h with Alice on board and after 3 hours Alice meets Bob near the river bank"


def _bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_equal_to_sql(spark, duck):
    assert rows(d.op7_benchmark_decontamination(spark, SMALL)) == duck_rows(duck, d.ORACLE_SQL)


def _typed(text):
    """(low, type) of each token, by a loop."""
    out, before = [], ""
    for w in text.split():
        w = "".join(c for c in w if c.isalnum())
        if w:
            low = w.lower()
            kind = "n" if w[0].isdigit() else "u" if low in d.UNITS and before[:1].isdigit() else "p" if len(w) > 1 and w[0].isupper() and w[1:].islower() else ""
            out.append((low, kind))
            before = w
    return out


def _brute(docs: dict, items: dict, window=d.WINDOW, cover=d.COVER, slots_ok=d.SLOTS_OK) -> set:
    """(doc, item) pairs that match, by trying every alignment of every pair."""

    def views(text):
        toks = _typed(text)
        return [[x for i, x in enumerate(toks) if not (x[1] == "p" and i and toks[i - 1][1] == "p")], [(w, "" if k == "p" else k) for w, k in toks]]

    def same(x, y):
        if any(k != m or (not k and w != v) for (w, k), (v, m) in zip(x, y, strict=True)):
            return False
        return not all(k for _, k in x) or [w for w, _ in x] == [w for w, _ in y]

    found = set()
    for a, doc in docs.items():
        for b, item in items.items():
            for x, y in zip(views(doc), views(item), strict=True):
                span = min(window, len(y))
                places = len(y) - span + 1
                hits = [(i, j) for j in range(places) for i in range(len(x) - span + 1) if y and same(x[i : i + span], y[j : j + span])]
                wide = max(2, -(-places // 4))
                for group in (lambda o: o, lambda o: ("a", o // wide), lambda o: ("b", (o + wide // 2) // wide)):
                    for g in {group(i - j) for i, j in hits}:
                        own = [(i, j) for i, j in hits if group(i - j) == g]
                        slots = {(i + k, j + k, y[j + k][0], x[i + k][0]) for i, j in own for k in range(span) if y[j + k][1]}
                        best = sum(max(Counter(s[w] for s in slots if s[v] == z).values()) for v, w in ((2, 3), (3, 2)) for z in {s[v] for s in slots})
                        if 100 * len({j for _, j in own}) >= cover * places and 100 * best >= slots_ok * 2 * len(slots):
                            found.add((a, b))
    return found


EGGS = "On Monday the farmer Maria Lopez sells 12 eggs to Peter Stone for 3 dollars and then buys 4 hens from Maria Lopez again"


def _copy(k: int) -> str:
    return EGGS.replace("12", str(30 + k)).replace("3 d", f"{50 + k} d").replace("4 h", f"{70 + k} h").replace("Maria Lopez", f"Ann{'abcdefgh'[k]} Weber").replace("Peter Stone", f"Tom{'abcdefgh'[k]} Klein")


def test_tokens(spark):
    t = d.tokens(spark.createDataFrame([("He paid 3,000 dollars to Mary Ann,\nat 60km/h. É Élan",)], "text string"), []).first()
    assert t.low == ["he", "paid", "3000", "dollars", "to", "mary", "ann", "at", "60kmh", "é", "élan"]
    assert t.kind == [d.NAM, d.WORD, d.NUM, d.UNIT, d.WORD, d.NAM, d.NAM, d.WORD, d.NUM, d.WORD, d.NAM]


def test_reparameterised(spark):
    r = random.Random(4)
    other = ITEM.replace("60", "85").replace("3 hours", "7 hours").replace("Alice", "Carol").replace("Bob", "Dave")
    docs = documents(spark, [f"{words(r, 40)}. {other} {words(r, 40)}", f"{ITEM}", words(r, 100), " ".join(ITEM.split()[:7]), f"x {ITEM.upper()}", ITEM.replace(" ", " \n "), ITEM.replace("old", "new")])
    got = {r._k: r for r in d.leaks(docs, _bench(spark, ITEM)).collect()}
    assert set(got) == {0, 1, 4, 5, 6}
    assert got[0].n_slots_ok == got[0].n_slots > 0 and got[1].n_found == got[1].n_windows
    assert {r.doc_id for r in d.clean(docs, _bench(spark, ITEM)).collect()} == {2, 3}


def test_copies_beside_the_item(spark):
    """An item with six re-parameterised copies, the copies alone, one copy with two-word names, and a sentence that begins with a name."""
    r = random.Random(9)
    copies = ". ".join(_copy(k) for k in range(6))
    first, renamed = "Maria buys 5 apples. Peter eats 2 of them and gives 3 to the neighbour next door", "Hans buys 8 apples. Otto eats 4 of them and gives 6 to the neighbour next door"
    docs = {0: f"{EGGS}. {copies}", 1: copies, 2: f"{words(r, 50)} {_copy(3)} {words(r, 50)}", 3: renamed, 4: words(r, 300), 5: "the farmer sells 9 eggs to no one at all"}
    items = {0: EGGS, 1: first}
    got = {(x._k, x.item_id) for x in d.leaks(documents(spark, list(docs.values())), _bench(spark, EGGS, first)).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (3, 1)} == _brute(docs, items)


def test_numbers_alone_match_by_value(spark):
    docs = {0: "we had 17 of them here", 1: "it was 42 in the end", 2: "1 2 3 4 5 6", 3: "6 5 4 3 2 1"}
    items = {0: "42", 1: "1 2 3 4 5 6"}
    got = {(x._k, x.item_id) for x in d.leaks(documents(spark, list(docs.values())), _bench(spark, *items.values())).collect()}
    assert got == {(1, 0), (2, 1)} == _brute(docs, items)


def test_equal_to_brute_force(spark):
    """Texts of few words, names and numbers, so that many windows recur, against a matcher that tries every alignment."""
    r = random.Random(12)
    word = lambda: r.choice(["the", "of", "km", "Anna", "Bert", "and", "3", "14", "cat"])
    items = {i: " ".join(word() for _ in range(r.choice([1, 3, 5, 9, 14]))) for i in range(12)}
    docs = {}
    for i in range(40):
        part = items[r.randrange(12)].split() if i % 2 else []
        for _ in range(r.choice([0, 0, 1, 2])):
            if part:
                part[r.randrange(len(part))] = word()
        docs[i] = " ".join([word() for _ in range(r.randrange(12))] + part + [word() for _ in range(r.randrange(12))])
    want = _brute(docs, items)
    for rows_ in (0, 1000):
        assert {(x._k, x.item_id) for x in d.leaks(documents(spark, list(docs.values())), _bench(spark, *items.values()), rows=rows_).collect()} == want
    assert 20 < len(want) < 300


def test_slots_must_agree(spark):
    item = "for every x take 1 and 2 then 1 and 2 then 1 and 2 then 1 and 2 to the very end"
    same, mixed = item.replace("1", "5").replace("2", "6"), "for every x take 5 and 6 then 7 and 8 then 9 and 10 then 11 and 12 to the very end"
    assert {r._k for r in d.leaks(documents(spark, [same, mixed]), _bench(spark, item)).collect()} == {0}


def test_one_occurrence_is_enough(spark):
    r = random.Random(6)
    other = ITEM.replace("60", "85").replace("3 hours", "7 hours").replace("Alice", "Carol").replace("Bob", "Dave")
    third = ITEM.replace("60", "95").replace("3 hours", "9 hours").replace("Alice", "Erin").replace("Bob", "Frank")
    longer = ITEM.replace("near the river", "near the wide river")
    docs = documents(spark, [f"{ITEM}. {other}. {third}", f"{words(r, 30)}. {other}\n{third} {words(r, 30)}. {ITEM}", f"{longer}. {other}. {third}", words(r, 200)])
    got = {r._k: r for r in d.leaks(docs, _bench(spark, ITEM)).collect()}
    assert set(got) == {0, 1, 2}
    assert all(100 * x.n_slots_ok >= 80 * x.n_slots > 0 for x in got.values())


def test_item_of_repeated_templates(spark):
    counted = "we count 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20 and stop here"
    item = " ".join(f"take {i} and {i + 1} then" for i in range(1, 9)) + " rest"
    docs = documents(spark, [f"before {item} after", f"first {counted} last", "only 8 9 10 11 12 13 14 15 17 18 here"])
    assert {(r._k, r.item_id) for r in d.leaks(docs, _bench(spark, item, counted)).collect()} == {(0, 0), (1, 1)}


def test_short_items_and_shuffles(spark):
    docs = documents(spark, ["xx yy zz", "aa xx yy zz bb cc dd ee", "yy zz xx", ""])
    bench = _bench(spark, "xx yy zz", None, "", "one two three four five six seven")
    assert {r._k for r in d.leaks(docs, bench, rows=0).collect()} == {0, 1}


def test_odd_rows(spark):
    bench = _bench(spark, "no id here at all", "no id here at all", "first text of eight")
    got = d.leaks(odd(spark), bench)
    assert sorted((r._k, r.item_id) for r in got.collect()) == [(8, 2), (d.NO_ID, 0), (d.NO_ID, 1)]
    left = d.clean(odd(spark), bench)
    assert left.columns == odd(spark).columns and left.count() == 10
    assert d.leaks(empty(spark), bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert d.clean(odd(spark), nothing).count() == 12
