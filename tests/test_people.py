"""Identities and labels against plain loops."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from colloquy.operators import evaluation, graphs, identity


def least_reachable(links):
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(root)}


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1070)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "u long, v long")
    assert {r["node"]: r["component"] for r in graphs.connected_components(df, "u", "v").collect()} == least_reachable(links)
    assert graphs.connected_components(df.limit(0), "u", "v").count() == 0


def people(handles, contacts, known):
    """The rule of ``resolve_people`` for dictionaries."""
    links = [(("contact", c), ("known", known[v])) for c, values in contacts.items() for v in values if v in known]
    order = {n: (n[0] == "contact", n[1]) for link in links for n in link}
    groups = least_reachable([(order[a], order[b]) for a, b in links])
    out = {}
    for i, v in handles:
        owners = [c for c, values in contacts.items() if v in values]
        if v in known:
            out[i] = (known[v], None)
        elif len(owners) == 1 and (True, owners[0]) in groups:
            out[i] = (groups[True, owners[0]][1], None)
        else:
            out[i] = (None, f"contact:{owners[0]}" if len(owners) == 1 else f"handle:email:{v}")
    return out


def test_two_handles_of_a_contact_are_one_person(spark):
    rnd = random.Random(3)
    values = [f"u{i}@x.org" for i in range(40)]
    contacts = {f"c{i:02}": set(rnd.sample(values, rnd.randrange(1, 4))) for i in range(15)} | {"both": {"one@x.org", "two@x.org"}}
    known = {v: rnd.randrange(6) for v in rnd.sample(values, 10)}
    handles = [(i, v) for i, v in enumerate([*values, "one@x.org", "two@x.org"])]
    want = people(handles, contacts, known)
    assert want[40] == want[41] == (None, "contact:both")
    for seed in range(2):
        mixed = [(c, v) for c, own in contacts.items() for v in own] + [("nobody", None)]
        random.Random(seed).shuffle(mixed)
        raw = [(i, f" {v.upper()} ") for i, v in handles]
        random.Random(seed).shuffle(raw)
        got = identity.resolve_people(
            spark.createDataFrame(raw, "source_handle_id long, raw_value string"), spark.createDataFrame(mixed, "contact string, normalized_value string"), spark.createDataFrame(list(known.items()), "normalized_value string, person_id long")
        ).collect()
        assert {r["source_handle_id"]: (r["person_id"], r["new_person"]) for r in got} == want and len(got) == len(want)
    none = identity.resolve_people(spark.createDataFrame(raw, "source_handle_id long, raw_value string"), spark.createDataFrame([], "contact string, normalized_value string"), spark.createDataFrame([], "normalized_value string, person_id long"))
    assert none.where(F.col("new_person").startswith("handle:email:")).count() == len(handles)


def test_labels_follow_their_messages(spark):
    labels = spark.createDataFrame([("q", "g1", 1), ("q", "g2", 2), ("q", "gone", 2), ("q", None, 1), ("r", "g3", 1)], "query_id string, anchor_guid string, grade int")
    messages = spark.createDataFrame([(1, "g1"), (2, "g2"), (3, "g3"), (4, None)], "message_id long, source_guid string")
    members = spark.createDataFrame([(1, "s"), (2, "s"), (4, "s")], "message_id long, segment_id string")  # the third is in no segment
    grades, counts = evaluation.resolve_labels(labels, messages, members)
    assert [tuple(r) for r in grades.collect()] == [("q", "s", 2)]
    assert {tuple(r) for r in counts.collect()} == {("q", 4, 2), ("r", 1, 1)}


def test_people_like_many_queries(spark):
    """The bounds lose nothing: the best of each query are those of a comparison with everyone."""
    from difflib import SequenceMatcher

    rnd = random.Random(5)
    make = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.randrange(1, 9)))
    folk = [(i, make(), rnd.choice([None, make().upper()])) for i in range(120)]
    asked = [(i, make()) for i in range(30)] + [(90, None), (91, "")]
    want = {}
    for q, text in asked:
        if text is None:
            continue
        scores = [(max(SequenceMatcher(None, text.lower(), n.lower()).ratio() for n in (s, d) if n is not None), s, i) for i, s, d in folk]
        want[q] = [(i, score) for score, s, i in sorted((x for x in scores if x[0] >= 0.5), key=lambda x: (-x[0], x[1], x[2]))[:5]]
    people = spark.createDataFrame(folk, "person_id long, short_name string, display_name string").repartition(3)
    got = {q: [] for q in want}
    for r in identity.most_similar_people(people, spark.createDataFrame(asked, "query_id long, query string")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["person_id"], r["score"]))
    assert got == want
    assert identity.most_similar_people(people, spark.createDataFrame([], "query_id long, query string")).count() == 0


def test_people_of_the_same_letters(spark, monkeypatch):
    """Names of the same letters are bounded once, common subsequences tell them apart, and few are compared letter by letter."""
    monkeypatch.setattr(identity, "NAMES_AT_ONCE", 700)
    monkeypatch.setattr(identity, "QUERIES_AT_ONCE", 7)
    names = [f"Customer#{i:09d}" for i in range(2000)]
    own = identity._Names(list(range(2000)), [n.lower().replace("#", "-") for n in names], [n.lower().replace("#", "-") for n in names], [n.lower() for n in names])
    assert len(own.kinds) < 1000
    compared = []

    class Counted(SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    monkeypatch.setattr(identity, "SequenceMatcher", Counted)
    asked = [(i, names[i].replace("to", "")) for i in range(0, 2000, 131)] + [(5, "x" * 70 + "customer"), (6, "customer#")]
    want = {}
    for q, text in asked:
        scores = [(max(SequenceMatcher(None, text.lower(), n).ratio() for n in (a.lower(), a.lower().replace("#", "-"))), i) for i, a in enumerate(names)]
        want[q] = [i for score, i in sorted((x for x in scores if x[0] >= 0.5), key=lambda x: (-x[0], x[1]))[:5]]
    assert {q: [i for _, i in own.best(t.lower(), 5, 0.5)] for q, t in asked} == want
    assert len(compared) < 2000 * 2 * len(asked) / 5
    people = spark.createDataFrame([(i, n.lower().replace("#", "-"), n) for i, n in enumerate(names)], "person_id long, short_name string, display_name string")
    got = {q: [] for q, _ in asked}
    for r in identity.most_similar_people(people, spark.createDataFrame(asked, "query_id long, query string")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["person_id"])
    assert got == want


def test_people_by_a_tree_of_names(spark, monkeypatch):
    """Few names are reached of many, and floors, copies of names, odd sizes and several groups lose nothing."""
    rnd = random.Random(8)
    own = identity._Names(list(range(20_000)), *([f"customer-{i:09d}" for i in range(20_000)] for _ in range(2)), [f"customer#{i:09d}" for i in range(20_000)])
    reached = []
    go = identity._Names._reached

    def counted(self, codes, least):
        out = go(self, codes, least)
        reached.append(len(out[0]))
        return out

    monkeypatch.setattr(identity._Names, "_reached", counted)
    asked = [f"cusmer#{i:09d}" for i in range(0, 20_000, 4001)]
    found = own.bests(asked, [None] * len(asked), 5, 0.5)
    assert found == [own.best(q, 5, 0.5) for q in asked]
    assert sum(reached) < 40_000 * len(asked) / 20
    assert own.bests(asked, [x[-1][0] for x in found], 5, 0.5) == found

    monkeypatch.setattr(identity, "NAMES_AT_ONCE", 40)
    monkeypatch.setattr(identity, "QUERIES_TOGETHER", 7)
    monkeypatch.setattr(identity, "PLACES_AT_ONCE", 50)
    make = lambda n: "".join(rnd.choice("abcä😀") for _ in range(rnd.randrange(n)))
    folk = [(i, make(7), rnd.choice([None, make(9), "ab" * 64, "ab" * 64 + "c", "ab" * 80])) for i in range(150)]
    folk += [(200 + i, *folk[i % 10][1:]) for i in range(90)] + [(300, "", ""), (301, None, None), (302, None, "abc")]
    texts = [make(8) for _ in range(25)] + ["", "ab" * 31, "ab" * 32, "ab" * 70, "zz"]
    want = {}
    for q, text in enumerate([*texts, texts[0]]):
        scores = [(max((SequenceMatcher(None, text, n).ratio() for n in (s, d) if n is not None), default=0.0), s, i) for i, s, d in folk]
        want[q] = [(i, s, score) for score, s, i in sorted((x for x in scores if x[0] >= 0.5), key=lambda x: (-x[0], x[1] is not None, x[1] or "", x[2]))[:5]]
    people = spark.createDataFrame(folk, "person_id long, short_name string, display_name string").repartition(3)
    got = {q: [] for q in want}
    for r in identity.most_similar_people(people, spark.createDataFrame(list(enumerate([*texts, texts[0]])), "query_id long, query string")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["person_id"], r["short_name"], r["score"]))
    assert got == want
