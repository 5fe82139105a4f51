"""People: handles, resolution, merging."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.functions.text import normalize_handle, slug
from colloquy.operators.graphs import connected_components
from colloquy.session import batch_function, ship_package

MOST_CANDIDATES, LEAST_RATIO = 5, 0.5


def unique_match(keys: DataFrame, contacts: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)`` where exactly one distinct contact has the key."""
    one = contacts.groupBy(key).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")
    return keys.select(key).distinct().join(one, key)


@batch_function("double")
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp similarity; not an edit distance. Null if either is."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in pairs], pa.float64())


def resolve_person(people: DataFrame, query: str) -> tuple[str, DataFrame]:
    """``(outcome, rows)``: the person found, or up to five candidates; a likely one is never taken by itself.

    A short name decides, then a display name that one person has, then
    similarity only suggests.
    """
    wanted = query.strip()
    if not wanted:
        raise ValueError("an empty name")
    exact = people.where(F.col("short_name") == wanted).limit(1)
    if not exact.isEmpty():
        return "found", exact
    same = people.where(F.col("display_name") == wanted).orderBy("short_name").limit(MOST_CANDIDATES)
    n = same.count()
    if n:
        return ("found" if n == 1 else "ambiguous"), same
    near = similar_people(people, F.lit(wanted)).orderBy(F.col("score").desc(), "short_name").limit(MOST_CANDIDATES)
    return ("not_found" if near.isEmpty() else "ambiguous"), near


def ratio_bound(a: Column, b: Column) -> Column:
    """What ``ratio`` cannot exceed: no more can match than the shorter text has."""
    return F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b))


def similar_people(people: DataFrame, query: Column) -> DataFrame:
    """People whose short or display name is similar enough; names whose lengths exclude that do not reach Python."""
    low = F.lower(query)
    names = [F.lower("short_name"), F.lower("display_name")]
    scores = [F.when(ratio_bound(low, n) >= LEAST_RATIO, ratio(low, n)) for n in names]
    return people.withColumn("score", F.greatest(*scores)).where(F.col("score") >= LEAST_RATIO)


#: Names and queries that are compared in one group at most, and queries in the least group that is worth a task.
NAMES_AT_ONCE, QUERIES_AT_ONCE, QUERIES_AT_LEAST = 100_000, 50_000, 500
#: Queries that go down the tree of names together, and places in it that they are expanded from at once.
QUERIES_TOGETHER, PLACES_AT_ONCE = 500, 1 << 18
#: Scores from which a query is tried, one after the other, until no name can be better than what is found.
TRIED = (0.875, 0.8, 0.7, 0.6)
#: Letters are dealt into so many classes; the longest name that is compared with a query by common subsequences, and the longest such query.
CLASSES, LONGEST_NAME, LONGEST_QUERY = 64, 128, 63


class _Names:
    """Names of people, in a tree by their letters, and grouped by how often they have each letter."""

    def __init__(self, ids: list, short: list, a: list, b: list):
        self.own = [[n for n in pair if n is not None] for pair in zip(a, b, strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (short[i] is not None, short[i] or "", ids[i]))
        self.rank = np.empty(len(ids), dtype=np.int64)
        self.rank[order] = np.arange(len(ids))
        texts = [(t, i) for i, names in enumerate(self.own) for t in dict.fromkeys(names)]
        self.person = np.array([i for _, i in texts], dtype=np.int64)
        self.size = np.array([len(t) for t, _ in texts], dtype=np.int64)
        signs = np.frombuffer("".join(t for t, _ in texts).encode("utf-32-le", "surrogatepass"), "<u4")
        known = np.zeros(int(signs.max(initial=0)) + 1, dtype=bool)
        known[signs] = True
        self.letters = np.flatnonzero(known)
        code = (np.cumsum(known) - 1)[signs]
        owner = np.repeat(np.arange(len(texts)), self.size)
        self.texts = [t for t, _ in texts]
        self._letters = owner * CLASSES + code % CLASSES
        # The letters of the shorter names, place by place; beyond their ends there is none.
        place = np.arange(len(signs)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        near = place < LONGEST_NAME
        self.code = np.full((min(LONGEST_NAME, int(self.size.max(initial=0))), len(texts)), len(self.letters), dtype=np.int32)
        self.code[place[near], owner[near]] = code[near]

    @cached_property
    def _kinds(self) -> tuple[np.ndarray, ...]:
        many = np.bincount(self._letters, minlength=len(self.size) * CLASSES).reshape(-1, CLASSES).astype(np.int32)
        kinds, kind = np.unique(many, axis=0, return_inverse=True)
        edge = np.concatenate([[0], np.cumsum(np.bincount(kind.ravel(), minlength=len(kinds)))])
        return kinds, np.argsort(kind.ravel(), kind="stable"), edge, kinds.sum(axis=1)

    kinds = property(lambda self: self._kinds[0])
    by_kind = property(lambda self: self._kinds[1])
    edge = property(lambda self: self._kinds[2])
    kind_size = property(lambda self: self._kinds[3])

    @cached_property
    def _tree(self) -> tuple[np.ndarray, list[dict]]:
        """The texts in order, and for each place the prefixes that end there: their letters, the sizes and texts below them, and which go on from them."""
        order = np.array(sorted(range(len(self.texts)), key=self.texts.__getitem__), dtype=np.int64)
        size, code = self.size[order], self.code[:, order]
        shared = np.full(len(order), -1)  # letters in common with the text before
        if len(order) > 1:
            apart = np.concatenate([code[:, 1:] != code[:, :-1], np.ones((1, len(order) - 1), bool)])
            shared[1:] = apart.argmax(axis=0)
        levels: list[dict] = []
        for d in range(len(code)):
            edge = np.flatnonzero(shared <= d)
            end = np.append(edge[1:], len(order))
            own = size[edge] > d
            low, high = np.minimum.reduceat(size, edge), np.maximum.reduceat(size, edge)
            first, end = edge[own], end[own]
            done = (end - first) if d + 1 == LONGEST_NAME else np.add.reduceat((size == d + 1).astype(np.int64), edge)[own]
            levels.append({"first": first, "end": end, "letter": code[d, first], "low": low[own], "high": high[own], "done": done})
        for level, below in zip(levels, levels[1:], strict=False):
            level["from"], level["to"] = (np.searchsorted(below["first"], level[x]) for x in ("first", "end"))
        return order, levels

    def _reached(self, codes: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, text, limit)``: the texts that common subsequences don't exclude from the least score of each query, and what they can score.

        All queries go down the tree together, letter by letter, and leave it where
        no text below can have enough in common with them.
        """
        order, levels = self._tree
        size = np.array([len(c) for c in codes], dtype=np.int64)
        mask = np.zeros((len(codes), len(self.letters) + 1), dtype=np.uint64)
        for q, c in enumerate(codes):
            for i, x in enumerate(c.tolist()):
                if x >= 0:
                    mask[q, x] |= np.uint64(1 << i)
        whole = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        top = len(levels[0]["first"]) if levels else 0
        todo = [(0, np.repeat(np.arange(len(codes)), top), np.tile(np.arange(top), len(codes)), np.full(len(codes) * top, 2**64 - 1, dtype=np.uint64))]
        while todo:
            d, query, place, left = todo.pop()
            if len(query) > PLACES_AT_ONCE:
                todo += [(d, query[a : a + PLACES_AT_ONCE], place[a : a + PLACES_AT_ONCE], left[a : a + PLACES_AT_ONCE]) for a in range(0, len(query), PLACES_AT_ONCE)]
                continue
            if not len(query):
                continue
            level, own = levels[d], size[query]
            met = left & mask[query, level["letter"][place]]
            left = (left + met) | (left - met)
            common = own - np.bitwise_count(left & whole[query])
            # The size below that could score most: where all that is left of the query just finds room.
            fit = np.clip(own - common + d + 1, level["low"][place], level["high"][place])
            good = self._ratio(np.minimum(own, common + fit - d - 1), fit, own) >= least[query]
            query, place, left, common = query[good], place[good], left[good], common[good]
            many = level["done"][place]
            q, c = np.repeat(query, many), np.repeat(common, many)
            t = order[np.repeat(level["first"][place] - np.cumsum(many) + many, many) + np.arange(len(q))]
            limit = self._ratio(np.minimum(size[q], c + np.maximum(self.size[t] - d - 1, 0)), self.size[t], size[q])
            enough = limit >= least[q]
            out.append((q[enough], t[enough], limit[enough]))
            if d + 1 < len(levels):
                low, many = level["from"][place], (level["to"] - level["from"])[place]
                below = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                todo.append((d + 1, np.repeat(query, many), below, np.repeat(left, many)))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def bests(self, queries: list[str], floors: list[float | None], most: int, least: float) -> list[list[tuple[float, int]]]:
        """``best`` of each query, but for what is below its floor: other names are known to fill the places from there."""
        out: list[list[tuple[float, int]]] = [[] for _ in queries]
        coded = []
        for i, query in enumerate(queries):
            if 0 < len(query) <= LONGEST_QUERY and least > 0 and len(self.texts):
                signs = np.frombuffer(query.encode("utf-32-le", "surrogatepass"), "<u4")
                at = np.minimum(np.searchsorted(self.letters, signs), max(len(self.letters) - 1, 0))
                coded.append((i, np.where(self.letters[at] == signs, at, -1) if len(self.letters) else np.full(len(signs), -1)))
            else:
                out[i] = self.best(query, most, least)
        for a in range(0, len(coded), QUERIES_TOGETHER):
            todo = [(i, code, max(least, floors[i] or 0.0, TRIED[0])) for i, code in coded[a : a + QUERIES_TOGETHER]]
            while todo:
                q, text, limit = self._reached([c for _, c, _ in todo], np.array([x for _, _, x in todo]))
                rank = self.rank[self.person[text]]
                order = np.lexsort((rank, -limit, q))
                edge = np.searchsorted(q[order], np.arange(len(todo) + 1))
                again = []
                for j, (i, code, tried) in enumerate(todo):
                    own = order[edge[j] : edge[j + 1]]
                    out[i] = self._scored(queries[i], text[own].tolist(), limit[own].tolist(), rank[own].tolist(), most, least)
                    last = max(least, floors[i] or 0.0, out[i][-1][0] if len(out[i]) == most else 0.0)
                    if tried > last:
                        again.append((i, code, last if len(out[i]) == most else max(last, *(x for x in (*TRIED, 0.0) if x < tried))))
                todo = again
        return out

    def _scored(self, query: str, texts: list, limits: list, ranks: list, most: int, least: float) -> list[tuple[float, int]]:
        """``(score, person)`` of the best of some texts, which come by what they can score and by rank."""
        found: list[tuple[float, int, int]] = []
        seen: set[int] = set()
        matcher = SequenceMatcher(None)
        for text, limit, rank in zip(texts, limits, ranks, strict=True):
            if len(found) == most and (-limit, rank) > (-found[-1][0], found[-1][1]):
                break
            person = int(self.person[text])
            if person in seen:
                continue
            seen.add(person)
            score = 0.0
            # The person's other name can score no more than the one that came first.
            for n in (self.texts[text], *(n for n in self.own[person] if n != self.texts[text])):
                if score < limit:
                    matcher.set_seqs(query, n)
                    score = max(score, matcher.ratio())
            if score >= least:
                found = sorted([*found, (score, rank, person)], key=lambda x: (-x[0], x[1]))[:most]
        return [(score, person) for score, _, person in found]

    def common(self, query: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence of a query of ``LONGEST_QUERY`` letters at most with each of some names."""
        mask = np.zeros(len(self.letters) + 1, dtype=np.uint64)
        for i, c in enumerate(query.tolist()):
            if c >= 0:
                mask[c] |= np.uint64(1 << i)
        left = np.full(len(which), 2**64 - 1, dtype=np.uint64)
        for row in self.code[: int(self.size[which].max(initial=0))]:
            met = left & mask[row[which]]
            left = (left + met) | (left - met)
        return len(query) - np.bitwise_count(left & np.uint64((1 << len(query)) - 1)).astype(np.int64)

    def best(self, query: str, most: int, least: float) -> list[tuple[float, int]]:
        """``(score, person)`` of the best, equal ones by rank."""
        signs = np.frombuffer(query.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.letters, signs), max(len(self.letters) - 1, 0))
        code = np.where(self.letters[at] == signs, at, -1) if len(self.letters) else np.full(len(signs), -1)
        has = np.bincount(code[code >= 0] % CLASSES, minlength=CLASSES)
        bound = self._ratio(np.minimum(self.kinds, has).sum(axis=1), self.kind_size, len(query))
        found: list[tuple[float, int, int]] = []
        seen: set[int] = set()
        matcher = SequenceMatcher(None)
        for top in np.unique(bound[bound >= least])[::-1].tolist():
            if len(found) == most and top < found[-1][0]:
                break
            which = np.concatenate([self.by_kind[self.edge[k] : self.edge[k + 1]] for k in np.flatnonzero(bound == top).tolist()])
            limit = np.full(len(which), top)
            if len(query) <= LONGEST_QUERY:
                near = np.flatnonzero(self.size[which] <= LONGEST_NAME)
                limit[near] = np.minimum(top, self._ratio(self.common(code, which[near]), self.size[which[near]], len(query)))
            rank = self.rank[self.person[which]]
            for i in np.lexsort((rank, -limit)).tolist():
                if limit[i] < least or len(found) == most and (-limit[i], rank[i]) > (-found[-1][0], found[-1][1]):
                    break
                person = int(self.person[which[i]])
                if person in seen:
                    continue
                seen.add(person)
                score = 0.0
                for n in self.own[person]:
                    matcher.set_seqs(query, n)
                    score = max(score, matcher.ratio())
                if score >= least:
                    found = sorted([*found, (score, int(rank[i]), person)], key=lambda x: (-x[0], x[1]))[:most]
        return [(score, person) for score, _, person in found]

    @staticmethod
    def _ratio(common: np.ndarray, size: np.ndarray, query: int) -> np.ndarray:
        return np.where(size + query == 0, 1.0, 2.0 * common / np.maximum(size + query, 1))


def most_similar_people(people: DataFrame, queries: DataFrame, most: int = MOST_CANDIDATES, least: float = LEAST_RATIO) -> DataFrame:
    """``(query_id, person_id, short_name, score, rank)``: the ``most`` people like each query ``(query_id, query)``, as ``similar_people`` scores them.

    Of people of the same names only the first can have a place, and queries of
    the same text are one. Groups of names meet groups of queries, each in a
    task: names are a tree that queries go down, and leave where the longest
    common subsequence excludes all below. Each query meets one group first, of
    names from everywhere; then all groups, of neighbours in order, where nothing
    is of use that scores less than its last place in the first. So the result is
    exact, and a group gives no more than the places there are. Null names and
    queries match nothing.
    """
    spark = people.sparkSession
    ship_package(spark)
    same = Window.partitionBy("short_name", "display_name").orderBy("person_id")
    rows = people.select("person_id", "short_name", "display_name").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most)
    rows = rows.groupBy("short_name", "display_name").agg(F.sort_array(F.collect_list(F.struct("person_id"))).alias("same"))
    rows = rows.select(F.col("same")[0]["person_id"].alias("person_id"), "same", "short_name", F.lower("short_name").alias("a"), F.lower("display_name").alias("b"))
    wanted = queries.where(F.col("query").isNotNull()).select("query_id", F.lower("query").alias("query"))
    asked = wanted.select("query").distinct()
    n, q = rows.count(), asked.count()
    names = max(1, -(-n // NAMES_AT_ONCE))
    parts = max(1, -(-q // QUERIES_AT_ONCE), min(-(-4 * spark.sparkContext.defaultParallelism // names), -(-q // QUERIES_AT_LEAST)))
    schema = StructType().add("query", "string").add("same", rows.schema["same"].dataType).add("short_name", "string").add("score", "double")

    def compared(folk: pa.Table, wanted: pa.Table) -> pa.Table:
        texts, which, scores, people = wanted.column("query").to_pylist(), [], [], []
        if folk.num_rows and texts:
            own = _Names(*(folk.column(c).to_pylist() for c in ("person_id", "short_name", "a", "b")))
            for query, best in enumerate(own.bests(texts, wanted.column("floor").to_pylist(), most, least)):
                for score, i in best:
                    which.append(query)
                    scores.append(score)
                    people.append(i)
        told = folk.select(["same", "short_name"]).take(pa.array(people, pa.int64()))
        query = wanted.column("query").take(pa.array(which, pa.int64()))
        return pa.table([query, *told.columns, pa.array(scores, pa.float64())], ["query", "same", "short_name", "score"])

    def met(asked: DataFrame, once: bool) -> DataFrame:
        """What groups find: each query's own one, or all."""
        part, group = F.pmod(F.xxhash64("query"), F.lit(parts)), F.pmod(F.xxhash64(F.concat(F.lit("g"), "query")), F.lit(names))
        where = F.xxhash64("person_id", "short_name") if once else F.spark_partition_id()
        left = rows if once or names == 1 else rows.repartitionByRange(names, "a", "b")
        left = left.withColumn("_group", F.pmod(where, F.lit(names)).cast("long")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = asked.withColumn("_group", group if once else F.explode(F.sequence(F.lit(0), F.lit(names - 1)))).withColumn("_part", part)
        left, right = (
            # Several partitions for each pair, so that few pairs share one.
            side.withColumn("_pair", (F.col("_group") * parts + F.col("_part")).cast("int")).drop("_group", "_part").repartition(min(4 * names * parts, 4096), "_pair").groupBy("_pair")
            for side in (left, right)
        )
        return left.cogroup(right).applyInArrow(compared, schema)

    asked = asked.withColumn("floor", F.lit(None).cast("double"))
    if names > 1:
        floors = met(asked, True).groupBy("query").agg(F.when(F.count("*") == most, F.min("score")).alias("floor"))
        asked = asked.drop("floor").join(floors, "query", "left")
    found = met(asked, False).select("query", F.explode("same").alias("one"), "short_name", "score").select("query", "one.person_id", "short_name", "score")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "short_name", "person_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return wanted.join(found, "query").select("query_id", "person_id", "short_name", "score", "rank")


def short_names(people: DataFrame, name: str = "display_name", by: str = "person_id") -> DataFrame:
    """Adds ``short_name``: the slug of the name, with -2, -3, ... for those that share it, in order of ``by``."""
    base = people.withColumn("_s", F.when(slug(F.col(name)) == "", "person").otherwise(slug(F.col(name))))
    n = F.row_number().over(Window.partitionBy("_s").orderBy(by))
    return base.withColumn("short_name", F.when(n == 1, F.col("_s")).otherwise(F.concat(F.col("_s"), F.lit("-"), n.cast("string")))).drop("_s")


def resolve_handles(handles: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(source_handle_id, kind, normalized_value, contact)`` of raw handles; a contact where exactly one has the value."""
    kind, value = normalize_handle(F.col("raw_value"))
    normal = handles.select("source_handle_id", kind.alias("kind"), value.alias("normalized_value"))
    known = unique_match(normal, contacts, "normalized_value", "contact")
    return normal.join(known, "normalized_value", "left").select("source_handle_id", "kind", "normalized_value", "contact")


def resolve_people(handles: DataFrame, contacts: DataFrame, known: DataFrame) -> DataFrame:
    """``(source_handle_id, kind, normalized_value, person_id, new_person)`` of raw handles, whatever their order.

    ``contacts`` ``(contact, normalized_value)`` lists all identifiers of each
    contact, ``known`` ``(normalized_value, person_id)`` what earlier runs
    resolved. A handle that is known stays with its person. Others that exactly
    one contact has are that contact's; contacts and the people to whom any of
    their identifiers is known are one component, which gets its least person,
    or else a new one named by its least contact. What no contact has, or
    several have, is a person of its own. A null value is nobody's identifier.
    """
    kind, value = normalize_handle(F.col("raw_value"))
    normal = handles.select("source_handle_id", kind.alias("kind"), value.alias("normalized_value"))
    before = known.where(F.col("normalized_value").isNotNull()).groupBy("normalized_value").agg(F.min("person_id").alias("_known"))
    listed = contacts.where(F.col("normalized_value").isNotNull()).select("contact", "normalized_value").distinct()
    # People before contacts, so that the least node of a component is a person if it has one.
    person = F.struct(F.lit(0).alias("side"), F.col("_known").cast("long").alias("id"), F.lit(None).cast("string").alias("name"))
    contact = F.struct(F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), F.col("contact").cast("string").alias("name"))
    links = listed.join(before, "normalized_value").select(contact.alias("a"), person.alias("b"))
    groups = connected_components(links, "a", "b").where("node.side = 1").select(F.col("node.name").alias("contact"), "component")
    unique = unique_match(normal, listed, "normalized_value", "contact").join(groups, "contact", "left")
    told = normal.join(unique, "normalized_value", "left").join(before, "normalized_value", "left")
    person_id = F.coalesce("_known", "component.id")
    fresh = F.coalesce(F.concat(F.lit("contact:"), F.coalesce("component.name", "contact")), F.concat_ws(":", F.lit("handle"), "kind", "normalized_value"))
    return told.select("source_handle_id", "kind", "normalized_value", person_id.alias("person_id"), F.when(person_id.isNull(), fresh).alias("new_person"))


def people_of(resolved: DataFrame) -> DataFrame:
    """``(person_key, display_name, handles)``: handles of one contact are one person, others stand alone."""
    keyed = resolved.withColumn("person_key", F.coalesce(F.concat(F.lit("contact:"), F.col("contact")), F.concat_ws(":", F.lit("handle"), "kind", "normalized_value")))
    return keyed.groupBy("person_key").agg(F.coalesce(F.min("contact"), F.min("normalized_value")).alias("display_name"), F.countDistinct("kind", "normalized_value").alias("handles"))


def merge_people(rows: DataFrame, merges: DataFrame, person: str = "person_id", unique_with: str | None = None, keep: str | None = None) -> DataFrame:
    """Rows with merged people's keys replaced; where that makes two rows of one key, the one that was there stays."""
    moved = rows.join(merges.select(F.col("from_id").alias(person), "into_id"), person, "left")
    moved = moved.withColumn("_moved", F.col("into_id").isNotNull()).withColumn(person, F.coalesce("into_id", person)).drop("into_id")
    if unique_with is None:
        return moved.drop("_moved").select(*rows.columns)
    order = Window.partitionBy(unique_with, person).orderBy("_moved", *( [keep] if keep else []))
    return moved.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*rows.columns)


def invariants(messages: DataFrame, people: DataFrame, handles: DataFrame, participants: DataFrame) -> DataFrame:
    """One row of counts that must be clean before segmentation: all 0, and one owner."""
    a = messages.agg(F.count_if(F.col("sender_person_id").isNull() & ~F.col("is_from_me")).alias("messages_without_sender"))
    b = people.agg(F.count_if("is_owner").alias("owners"))
    c = handles.agg(F.count_if(F.col("person_id").isNull()).alias("handles_without_person"))
    d = participants.join(people, "person_id", "left_anti").agg(F.count("*").alias("participants_without_person"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def require_clean(report: DataFrame) -> None:
    row = report.first()
    wrong = {k: v for k, v in row.asDict().items() if v != (1 if k == "owners" else 0)}
    if wrong:
        raise RuntimeError(f"identity is not resolved: {wrong}")


def list_people(people: DataFrame, messages: DataFrame, query: str | None, limit: int, sender: str = "sender_person_id", at: str = "sent_at") -> DataFrame:
    """People with their number of messages and first and last times; those without messages are listed too."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    if query:
        people = people.where(F.col("display_name").ilike(f"%{query}%") | F.col("short_name").ilike(f"%{query}%"))
    counts = messages.groupBy(F.col(sender).alias("person_id")).agg(F.count("*").alias("message_count"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    out = people.join(counts, "person_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    return out.select("person_id", "short_name", "display_name", "message_count", "first_at", "last_at").orderBy(F.col("message_count").desc(), "short_name").limit(limit)
