"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a whole text: densities of insulting words, plain and disguised
(look-alike digits and signs, stretched or spelled-out letters), and of words
with a stem that the labels show to be toxic; how near they stand to words of
the second person; capitals, punctuation and signs of obfuscation. Trees are
grown on histograms of the features by Newton boosting of the logistic loss; a
pool-adjacent-violators fit on rows that the trees did not see turns margins
into probabilities.

At most ``SAMPLE`` labelled rows, those with the least hash of their id, are
learned from: one half of them for the stems (near copies count once), the other
half for trees and calibration. The features of all rows are computed once and
written to the shared folder, and all rows are scored.

Defined cases: a null or empty text has the features of an empty text and a
score like any other; labels of one document that differ count as toxic if half
of them or more are; without labels every score is 0; a label without a document,
or a null one, teaches nothing; repeated rows are scored each; of equal gains
and odds the first feature and the last stem win, so that a fit can be repeated;
texts and tokens of any length are read whole; an empty table gives an empty
result. Only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, cut, held_out, kept, ship_package, text_groups

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.15, 32, 3
#: Words either side of an insult that are searched for the second person.
NEAR = 6
#: Lengths of stems that are learned from labels; and the least documents and log odds of each.
STEM_SIZES, STEM_DOCS, STEM_ODDS = (4, 5, 6, 7), 6, 1.6
#: Tokens that a worker remembers.
REMEMBERED = 200_000

# Mild to strong insults in four languages, as written in lower case.
INSULTS = """
arse arsehole asshole bastard bitch bonehead braindead bullshit clown coward crap creep cretin dickhead dimwit dipshit
disgusting dolt douche dumb dumbass dumbo dunce dunderhead fool freak fuck fucker fucking halfwit idiot idiotic idiots
imbecile jackass jerk knucklehead lame leech liar loser losers lowlife lunatic maggot moron moronic morons numbskull
nutcase pathetic pig piss prick psycho punk pussy rat rubbish scum scumbag shit shithead sicko simpleton slut sucker
stupid trash twat twit ugly useless vermin wanker weirdo whore wimp worthless wretch
abschaum arsch arschloch blödmann depp dummkopf dreckskerl drecksau esel feigling hirnlos hurensohn idioten
miststück penner scheisse scheiße schlampe schwachkopf schwein trottel vollidiot versager wichser widerlich wertlos
abruti batard bâtard bouffon connard connasse conne crétin débile enculé enfoiré imbécile merde minable ordure
pourriture pute raclure salaud salope taré
basura bastardo cabrón cobarde cretino escoria estúpida estúpido gilipollas hijoputa idiota imbécil inútil mierda
patético payaso pendejo perdedor puta puto repugnante subnormal tonto zorra
""".split()
# Words of the second person in the same languages.
SECOND_PERSON = """
you your yours yourself yourselves u ur youre you're ya
du dich dir dein deine deiner deinem deinen euch euer eure ihr
tu te toi ton ta tes vous votre vos
tú usted ustedes vosotros vuestro vuestra tus contigo
""".split()
# Signs that stand in for letters.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "8": "b"})

FEATURES = [
    "learned_per_100", "log_learned", "distinct_learned",
    "insults_per_100", "log_insults", "distinct_insults", "disguised_per_100", "log_disguised", "second_person_per_100", "log_insults_near_second_person",
    "capital_rate", "shouted_word_rate", "exclamation_rate", "question_rate", "punctuation_rate", "mixed_word_rate", "stretched_word_rate", "digit_rate", "log_words",
]
_EDGE = "".join(chr(i) for i in range(0x21, 0x7F) if not chr(i).isalnum()) + "«»“”„‘’…–—¡¿"
_SHOUT = re.compile(r"\b[A-ZÄÖÜÉÈÀÇÑ]{3,}\b")
_SPELLED = re.compile(r"(?:\b\w[ .*_\-]){2,}\w\b")
_SEPARATORS = re.compile(r"[ .*_\-]")
_LONG_INSULT = re.compile("|".join(sorted((w for w in INSULTS if len(w) > 4), key=lambda w: (-len(w), w))))
_STRETCH = re.compile(r"(.)\1{2,}")
_MASK = re.compile(r"[*#%_.\-]+")
_INSULTS, _SECOND = frozenset(INSULTS), frozenset(SECOND_PERSON)
_SIGNATURES = frozenset(re.sub(r"(.)\1+", r"\1", w) for w in INSULTS if len(w) >= 4)
_MASKED = {(w[0], w[-1], len(w)) for w in INSULTS if len(w) >= 4}
_LETTERS = re.compile(r"[^\W\d_]+")
PLAIN, DISGUISED, SECOND, MIXED, STRETCHED, LEARNED = 1, 2, 4, 8, 16, 32


def classify(token: str) -> int:
    """What a token between white space is, as a sum of flags."""
    flags = 0
    word = token.strip(_EDGE)
    if word in _INSULTS:
        return PLAIN
    if word in _SECOND or word.replace("’", "'") in _SECOND:
        return SECOND
    core = token.strip(",.;:?\"'()[]{}«»“”„‘’…–—¡¿")
    letters = sum(map(str.isalpha, core))
    odd = len(core) - letters
    if len(core) < 4 or not letters:
        return flags
    if odd and letters >= 2 and core[:1].isalnum() and any(c in "0134578@$!|*#%€" for c in core[1:-1]) and "://" not in core and core.count("@") + core.count(".") < 2:
        flags |= MIXED
        turned = core.translate(LOOK_ALIKE)
        bare = _MASK.sub("", turned)
        if turned in _INSULTS or bare in _INSULTS or turned.strip(_EDGE) in _INSULTS:
            return flags | DISGUISED
        if "*" in core and core[0].isalpha() and (core[0], core[-1], len(core)) in _MASKED and letters >= 2:
            return flags | DISGUISED
    if _STRETCH.search(word):
        flags |= STRETCHED
        if re.sub(r"(.)\1+", r"\1", word) in _SIGNATURES:
            flags |= DISGUISED
    elif any(c in "*.-_" for c in word) and _MASK.sub("", word) in _INSULTS:
        flags |= DISGUISED
    return flags


def spelled_out(run: str) -> int:
    """Insults in a run of single letters: the run itself, or else those of five letters or more within it."""
    word = _SEPARATORS.sub("", run)
    return 1 if word in _INSULTS else len(_LONG_INSULT.findall(word)) if len(word) > 5 else 0


def stems(text: str) -> set[str]:
    """Words of letters, and their beginnings of ``STEM_SIZES`` letters, in lower case."""
    words = {w for w in _LETTERS.findall(text.lower()) if len(w) > 3}
    return words | {w[:n] for w in words for n in STEM_SIZES if len(w) > n}


def has_stem(token: str, learned: frozenset[str]) -> bool:
    for word in _LETTERS.findall(token):
        if word in learned or any(word[:n] in learned for n in STEM_SIZES):
            return True
    return False


def near_copy_key(text: str) -> int:
    """The least hash of a text's three-word shingles: near copies mostly share it."""
    from xxhash import xxh64_intdigest as hashed

    words = text.lower().split()
    return min((hashed(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def features(text: str | None, learned: frozenset[str] = frozenset()) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    text = text or ""
    low = text.lower()
    tokens = low.split()
    known = kept(f"toxicity {hash(learned)}", dict)
    if len(known) > REMEMBERED:
        known.clear()
    flags = []
    for t in tokens:
        f = known.get(t)
        if f is None:
            f = classify(t) | (LEARNED if learned and has_stem(t, learned) else 0)
            if len(t) <= 64:
                known[t] = f
        flags.append(f)
    kinds = np.array(flags, dtype=np.int8)
    n, size = len(tokens), max(1, len(text))
    plain, disguised, second = np.flatnonzero(kinds & PLAIN), np.flatnonzero(kinds & DISGUISED), np.flatnonzero(kinds & SECOND)
    spelled = sum(spelled_out(m[0]) for m in _SPELLED.finditer(low))
    bad = np.sort(np.concatenate([plain, disguised]))
    near = 0
    if len(bad) and len(second):
        at = np.searchsorted(second, bad)
        gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - bad), np.abs(bad - second[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    taught = np.flatnonzero(kinds & LEARNED)
    distinct = len({tokens[i].strip(_EDGE) for i in plain.tolist()})
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    is_ascii = codes < 128
    small = codes[is_ascii]
    counts = np.bincount(small, minlength=128)
    capitals, digits = counts[65:91].sum(), counts[48:58].sum()
    letters = capitals + counts[97:123].sum() + (len(codes) - len(small))
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    words, hidden = max(1, n), len(disguised) + spelled
    return [
        100.0 * len(taught) / words, float(np.log1p(len(taught))), float(len({tokens[i].strip(_EDGE) for i in taught.tolist()})),
        100.0 * len(plain) / words, float(np.log1p(len(plain))), float(distinct), 100.0 * hidden / words, float(np.log1p(hidden)), 100.0 * len(second) / words, float(np.log1p(near)),
        capitals / max(1, letters), len(_SHOUT.findall(text)) / words, counts[33] / size, counts[63] / size, marks / size,
        int((kinds & MIXED > 0).sum()) / words, int((kinds & STRETCHED > 0).sum()) / words, digits / size, float(np.log1p(n)),
    ]


# the trees


class BoostedTrees:
    """Newton-boosted trees over histograms; a complete binary tree of ``depth`` each."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: float = LEAST_LEAF, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _edges(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) if len(np.unique(c)) > 1 else np.zeros(0) for c in x.T]

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.base = float(np.log(mean / (1 - mean)))
        edges = self._edges(x)
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        margin, width, n_features = np.full(len(y), self.base), self.bins + 1, x.shape[1]
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            feature = np.full(2**self.depth - 1, -1)
            cutoff = np.zeros(2**self.depth - 1)
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, nodes = 2**level - 1, 2**level
                slot = at - first
                best, choice = np.zeros(nodes), [None] * nodes
                for f in range(n_features):
                    if not len(edges[f]):
                        continue
                    key = slot * width + binned[:, f]
                    gs = np.cumsum(np.bincount(key, g, nodes * width).reshape(nodes, width), axis=1)
                    hs = np.cumsum(np.bincount(key, h, nodes * width).reshape(nodes, width), axis=1)
                    ns = np.cumsum(np.bincount(key, minlength=nodes * width).reshape(nodes, width), axis=1)
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(ns < self.least) | (nt - ns < self.least)] = -1.0
                    gain[:, len(edges[f]) :] = -1.0
                    top = gain.argmax(axis=1)
                    for node in range(nodes):
                        if gain[node, top[node]] > best[node] + 1e-12:
                            best[node], choice[node] = gain[node, top[node]], (f, top[node])
                right = np.zeros(len(y), dtype=bool)
                for node, found in enumerate(choice):
                    if found is not None:
                        f, b = found
                        feature[first + node], cutoff[first + node] = f, edges[f][b]
                        right |= (slot == node) & (binned[:, f] > b)
                at = 2 * at + 1 + right
            leaf = at - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            margin += value[leaf]
            self.trees.append((feature, cutoff, value))
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cutoff, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cutoff[at]))
            out += value[at - (2**self.depth - 1)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising step function, by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    knots, first = np.unique(margin[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    sizes = np.diff(np.append(first, len(y))).astype(float)
    blocks: list[list[float]] = []
    for k, s, w in zip(knots.tolist(), sums.tolist(), sizes.tolist(), strict=True):
        blocks.append([s, w, k, k])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s2, w2, _, high = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += w2
            blocks[-1][3] = high
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.repeat([b[0] / b[1] for b in blocks], 2)
    return xs, ys


class Model:
    """Trees and their calibration. Without rows to learn from every score is 0.

    Every row is used for both: it is calibrated by the margin of trees that were
    grown without its quarter of the rows.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.trees: BoostedTrees | None = None
        if len(y) == 0:
            return
        self.trees, margins = BoostedTrees().fit(x, y), np.zeros(len(y))
        quarter = np.arange(len(y)) % 4
        for q in range(4):
            rest = quarter != q
            if rest.any() and (~rest).any():
                margins[~rest] = BoostedTrees().fit(x[rest], y[rest]).margins(x[~rest])
        self.xs, self.ys = isotonic(margins, y)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        return np.clip(np.interp(self.trees.margins(x), self.xs, self.ys), 0.0, 1.0)


# the Spark side


def choose_stems(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> frozenset[str]:
    """Stems of ``(stem, toxic documents, clean documents)`` that speak for toxicity most, none within another's words."""
    def odds(t: int, c: int) -> float:
        return float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))

    ranked = sorted(((odds(t, c) * np.sqrt(t), t, s) for s, t, c in counts if t >= STEM_DOCS and odds(t, c) >= STEM_ODDS), reverse=True)
    chosen: set[str] = set()
    beginnings: set[str] = set()
    for _, _, s in ranked:
        if not any(s[:n] in chosen for n in range(1, len(s) + 1)) and s not in beginnings:
            chosen.add(s)
            beginnings |= {s[:n] for n in range(1, len(s))}
    return frozenset(chosen)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """``(id, y, part)`` of the labelled documents to learn from, ``sample`` at most; part 0 is for stems, 1 for trees."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    marked = known.agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    there = marked.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    return cut(there.orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))))


def learn_stems(docs: DataFrame, picked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> frozenset[str]:
    """The stems that the rows ``(id, y)`` of ``picked``, of bounded number, teach."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(picked.select("id", "y")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "text", 2 << 20):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = [pa.array([near_copy_key(t) for t in texts], pa.int64()), batch.column(batch.schema.get_field_index("y")), pa.array([sorted(stems(t)) for t in texts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(found, ["near", "y", "stems"])

    each = arrow_map(rows.select("text", "y"), run, "near long, y int, stems array<string>")
    once = cut(each.groupBy("near", "y").agg(F.min("stems").alias("stems")))
    totals = once.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    toxic = int(totals["t"] or 0)
    counted = once.select("y", F.explode("stems").alias("stem")).groupBy("stem").agg(F.sum("y").cast("long").alias("t"), F.count("*").alias("n"))
    # The sample is bounded, and so is what can reach the threshold.
    strong = counted.where((F.col("t") >= STEM_DOCS) & (F.col("t") * (totals["n"] - toxic + 1) > 3.0 * (F.col("n") - F.col("t")) * (toxic + 1)))
    return choose_stems([(r["stem"], r["t"], r["n"] - r["t"]) for r in strong.collect()], toxic, int(totals["n"]) - toxic)


def feature_table(docs: DataFrame, learned: frozenset[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, features)`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "text", 4 << 20):
            found = [features(t, learned) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["id", "features"])

    return arrow_map(rows, run, "id long, features array<double>")


def fit(table: DataFrame, picked: DataFrame) -> Model:
    """A model from the rows of a feature table whose ids are in ``picked``, of bounded number."""
    rows = table.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("features").alias("features"), F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").collect()
    x = np.array([r["features"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return Model(x, np.array([r["y"] for r in rows], dtype=np.int64))


def score(table: DataFrame, model: Model) -> DataFrame:
    """``(id, score)`` of every row of a feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], ["id", "score"])

    return arrow_map(table.select("id", "features"), run, "id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row; learned from labels of rows that are not held out."""
    ship_package(docs.sparkSession)
    picked = labelled(docs, labels.where(~held_out(F.col(id_col))), id_col, label_col, sample)
    learned = learn_stems(docs, picked.where("part = 0"), id_col, text_col)
    table = cut(feature_table(docs, learned, id_col, text_col))
    model = fit(table, picked.where("part = 1").select("id", "y"))
    return score(table, model).select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
