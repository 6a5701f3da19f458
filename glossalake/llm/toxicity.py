"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import materialise, ship, table, whole

THRESHOLD = 0.3
#: About so many labelled rows, chosen by a hash of the id, are enough to learn the lexicon; more are left aside.
MAX_LABELLED = 20_000

#: A word or stem of the lexicon is in so many toxic texts at least, is so many times as frequent among their words, and is so by chance with these
#: log-likelihood ratios (of words, of texts) at most. No share of all toxic texts is asked for: a language with few texts counts by itself.
LEAST_TEXTS, LEAST_RATIO, SURE_WORDS, SURE_TEXTS = 5, 5.0, 25.0, 15.0

# The grammar's closed word classes.
THREATS = ("kill", "hurt", "destroy", "beat", "shoot", "stab", "strangle", "töten", "töte", "umbringen", "schlagen", "verprügeln", "tuer", "frapper", "détruire", "matar", "golpear", "destruir")
YOU = ("you", "your", "du", "toi", "vous", "tú", "usted", "ustedes")
OBJECTS = ("dich", "dir", "euch", "te", "ti")
THEM = ("they", "them", "him", "her", "sie", "ihn", "ihnen", "les", "los", "las")
MODALS = ("will", "ll", "gonna", "shall", "werde", "werden", "vais", "allons", "voy", "vamos")
NEGATIONS = ("not", "no", "never", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "ningún")
REPORTS = ("said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "nannte", "dit", "écrit", "dijo", "escribió")

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, output symbol, factor). Unknown pairs copy the symbol."""

    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)
    idle: Callable[[int], int] = lambda s: s  # the state after a symbol without an arc

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.idle(state), symbol, 1.0)


@dataclass
class Composed:
    """One transducer's output is the next one's input; factors multiply."""

    parts: tuple[Transducer, ...]

    def run(self, symbols: list[tuple[str, float]]) -> dict[str, float]:
        """The weights of a clause by kind of hit: a symbol that leaves the last transducer as a hit counts, times the factors it met on the way."""
        states, total = [0] * len(self.parts), {"insult!": 0.0, "threat!": 0.0}
        for symbol, weight in symbols:
            for i, part in enumerate(self.parts):
                states[i], symbol, factor = part.step(states[i], symbol)
                weight *= factor
            if symbol in total:
                total[symbol] += weight
        return total


#: What a threat has met before it: nothing, a negation, a report of speech, or both; and the factor of that.
SOFTENED = {"threat": 1.0, "threat negated": 0.25, "threat reported": 0.4, "threat negated reported": 0.1}


def negations(factor: float = 0.5, scope: int = 3) -> Transducer:
    """A negation holds for `scope` words: insults weigh less, threats are marked."""
    out = Transducer(idle=lambda s: max(0, s - 1))
    for s in range(scope + 1):
        out.arcs[s, "negation"] = (scope, "other", 1.0)
        if s:
            out.arcs[s, "insult"] = (s - 1, "insult", factor)
            out.arcs[s, "threat"] = (s - 1, "threat negated", 1.0)
    return out


def reports(factor: float = 0.6) -> Transducer:
    """Reported speech goes to the end of its clause: insults weigh less, threats are marked."""
    out = Transducer()
    for s in (0, 1):
        out.arcs[s, "report"] = (1, "other", 1.0)
    out.arcs[1, "insult"] = (1, "insult", factor)
    for x in ("threat", "threat negated"):
        out.arcs[1, x] = (1, f"{x} reported", 1.0)
    return out


def insults(aimed: float = 1.25, near: int = 4) -> Transducer:
    """Every insult is a hit; one within `near` words after a person weighs more."""
    out = Transducer(idle=lambda s: max(0, s - 1))
    for s in range(near + 1):
        out.arcs[s, "insult"] = (max(0, s - 1), "insult!", aimed if s else 1.0)
        for x in ("you", "object", "them"):
            out.arcs[s, x] = (near, x, 1.0)
    return out


def threats(reach: int = 3) -> Transducer:
    """A threat is a hit only with its target: a verb and, within `reach` words, the one addressed, or after a modal any person; or a
    modal and the one addressed as an object, in either order, and then the verb. Marks on the verb lessen the pair."""
    names: dict[tuple, int] = {("rest", 0): 0}
    at = lambda *s: names.setdefault(s if s[-1] else ("rest", 0), len(names))
    verbs = [(f"{m}{v}", f) for v, f in SOFTENED.items() for m in ("", "will ")]
    out = Transducer()
    after: dict[int, int] = {0: 0}
    for d in range(reach, 0, -1):
        for kind in ("modal", "object", "ready", *(v for v, _ in verbs)):
            after[at(kind, d)] = at(kind, d - 1)
    out.idle = lambda s: after[s]
    for state, s in [(k, v) for k, v in names.items()]:
        kind = state[0]
        out.arcs[s, "modal"] = (at("ready" if kind == "object" else "modal", reach), "other", 1.0)
        out.arcs[s, "object"] = (at("ready" if kind in ("modal", "ready") else "object", reach), "other", 1.0)
        for v, f in SOFTENED.items():
            out.arcs[s, v] = (0, "threat!", f) if kind == "ready" else (at(f"{'will ' if kind == 'modal' else ''}{v}", reach), "other", 1.0)
    for v, f in verbs:
        for d in range(1, reach + 1):
            for x in ("you", "object", *(("them",) if v.startswith("will ") else ())):
                out.arcs[at(v, d), x] = (0, "threat!", f)
    return out


def grammar() -> Composed:
    return Composed((negations(), reports(), insults(), threats()))


@dataclass
class Model:
    """A lexicon with weights, and what a text's insults say: log odds of a text without any, and those of one with, from their weight and their weight a word."""

    words: dict[str, float]
    stems: dict[str, float]
    none: float
    slopes: tuple[float, float, float] = (-3.0, 2.0, 1.0)
    threat: float = 4.0

    def __post_init__(self):
        import ahocorasick

        self.grammar = grammar()
        kinds = (("threat", THREATS), ("you", YOU), ("object", OBJECTS), ("them", THEM), ("modal", MODALS), ("negation", NEGATIONS), ("report", REPORTS))
        self.classes = {w: k for k, ws in kinds for w in ws}
        self.find = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *THREATS]:
            self.find.add_word(w, w)
        self.find.make_automaton()
        self.sizes = sorted({len(s) for s in self.stems}, reverse=True)

    def __reduce__(self):
        return Model, (self.words, self.stems, self.none, self.slopes, self.threat)

    def insult(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        for n in self.sizes:
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return 0.0

    def clause(self, clause: str) -> dict[str, float]:
        symbols = []
        for word in _WORD.findall(clause):
            if w := self.insult(word):
                symbols.append(("insult", w))
            else:
                symbols.append((self.classes.get(word, "other"), self.threat))
        return self.grammar.run(symbols)

    def weigh(self, text: str | None) -> tuple[float, float, int]:
        """(weight of insults, weight of threats, words if there are any of these). The whole text is searched; only its clauses with a hit are parsed."""
        low = (text or "").lower()
        insult, threat = 0.0, 0.0
        if next(self.find.iter(low), None):
            for clause in _CLAUSE.split(low):
                if next(self.find.iter(clause), None):
                    found = self.clause(clause)
                    insult += found["insult!"]
                    threat += found["threat!"]
        return insult, threat, sum(1 for _ in _WORD.finditer(low)) if insult else 0

    def score(self, text: str | None) -> float:
        """Probability of label 1: that its insults or its threats make it toxic."""
        insult, threat, words = self.weigh(text)
        odds = float(np.dot(self.slopes, features(insult, words))) if insult > 0 else self.none
        return 1 - (1 - _chance(odds)) * (1 - (_chance(threat - 2.0) if threat > 0 else 0.0))


def features(insult: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(insult), math.log1p(100 * insult / max(1, words))


def _chance(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, shortest: int = 4, longest: int = 9) -> Model:
    """Learns the insult lexicon, whole words and stems with weights, and the slopes, from labelled rows that are not held out.

    Equal texts count once, with label 1 if any of them has it. A word or stem enters by its frequency among the words of toxic and of clean
    texts and by the texts that hold it; its weight is the log ratio of the frequencies. A stem is lengthened as long as it
    keeps nearly all its texts. Only those that enter reach the driver, and two numbers for each of the `max_labelled` rows or so.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), "toxic")
    share = min(1.0, max_labelled / max(1, known.count()))
    some = known.filter(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = docs.select("doc_id", whole(F.col("text")).alias("text"))
    rows = text.join(some, F.col("doc_id") == F.col("l_id")).select("text", F.col("toxic").cast("long").alias("toxic"))
    rows = rows.groupBy(F.xxhash64(F.lower("text")).alias("t")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    rows = materialise(rows.select("toxic", "text", F.filter(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}]+', 0)"), lambda w: F.length(w) > 2).alias("words")))
    size = F.size("words")
    n1, n0, t1, t0 = rows.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("toxic"), 1 - F.col("toxic"), F.col("toxic") * size, (1 - F.col("toxic")) * size)]).first()
    if not n1 or not n0:
        return Model({}, {}, -2.0)
    uses = materialise(rows.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("at"), F.sum(1 - F.col("toxic")).alias("ct")))
    prefixes = F.flatten(F.transform(F.array_distinct("words"), lambda w: F.when(F.length(w) >= shortest, F.transform(F.sequence(F.lit(shortest), F.least(F.length(w), F.lit(longest))), lambda n: F.substring(w, 1, n))).otherwise(F.array().cast("array<string>"))))
    spans = uses.select("at", "ct", "w", F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("n")).filter("n <= length(w)").groupBy(F.expr("substring(w, 1, n)").alias("w")).agg(F.sum("at").alias("at"), F.sum("ct").alias("ct"))

    def entering(counts: DataFrame, each: Column) -> dict[str, tuple]:
        """w -> (toxic texts, weight) of those that enter; texts are counted for those alone that are frequent enough among the words."""
        frequent = counts.filter((F.col("at") >= LEAST_TEXTS) & (F.expr(f"(at + 0.5) / {t1 + 1} >= {LEAST_RATIO} * (ct + 0.5) / {t0 + 1}")) & (_surprise("at", "ct", t1, t0) >= SURE_WORDS))
        in_texts = rows.select("toxic", F.explode(F.array_distinct(each)).alias("x")).join(frequent, F.col("x") == F.col("w")).groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c"), F.min("at").alias("at"), F.min("ct").alias("ct"))
        good = in_texts.filter((F.col("a") >= LEAST_TEXTS) & (F.col("a") * n0 > F.col("c") * n1) & (_surprise("a", "c", n1, n0) >= SURE_TEXTS))
        return {r.w: (r.a, math.log((r["at"] + 0.5) / (t1 + 1)) - math.log((r.ct + 0.5) / (t0 + 1))) for r in good.collect()}

    full, found = entering(uses, F.col("words")), entering(spans, prefixes)
    stems, chosen = {}, {}
    for root in sorted(found, key=lambda x: (len(x), x)):
        if any(root[:k] in found for k in range(shortest, len(root))):
            continue
        best = root
        while longer := [s for s in sorted(found) if len(s) == len(best) + 1 and s.startswith(best) and found[s][0] >= 0.9 * found[root][0]]:
            best = max(longer, key=lambda s: found[s][0])
        if best in full and full[best][0] >= 0.9 * found[root][0]:
            chosen[best] = full[best][1]
        else:
            stems[best] = found[best][1]
    for w, (_, v) in full.items():
        if not any(w[:k] in stems for k in range(shortest, len(w) + 1)):
            chosen.setdefault(w, v)
    model = Model(chosen, stems, 0.0)
    ship(docs.sparkSession)

    @F.pandas_udf("insult double, words long")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        found = [model.weigh(x) for x in texts]
        return pd.DataFrame({"insult": [float(f[0]) for f in found], "words": [f[2] for f in found]})

    seen = rows.select("toxic", weigh("text").alias("m")).select("toxic", "m.*").toPandas()
    hit = seen["insult"] > 0
    m1, m0 = int(seen.loc[~hit, "toxic"].sum()), int((1 - seen.loc[~hit, "toxic"]).sum())
    x = np.array([features(a, b) for a, b in zip(seen.loc[hit, "insult"], seen.loc[hit, "words"], strict=True)]).reshape(-1, 3)
    return Model(chosen, stems, min(-2.0, math.log((m1 + 0.5) / (m0 + 0.5))), _slopes(x, seen.loc[hit, "toxic"].to_numpy(float)) if len(x) else model.slopes)


def _surprise(a: str, c: str, n1: float, n0: float) -> Column:
    """Log-likelihood ratio of counts a of n1 and c of n0 against one rate for both."""
    rate = (F.col(a) + F.col(c)) / float(n1 + n0)
    part = lambda x, n: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (rate * float(n)))).otherwise(0.0)
    return 2 * (part(a, n1) + part(c, n0))


def _slopes(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return tuple(float(v) for v in w)


def scorer(model: Model) -> Callable[[Column], Column]:
    ship(SparkSession.active())

    @F.pandas_udf(DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([model.score(x) for x in part], float))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.3 on).

    Only texts are scored; label, language, source and id are no inputs. Null, empty and wordless texts get the score of
    a text without a hit. Very long texts are searched whole, clause by clause. Without labels of both kinds there is no lexicon and only aimed threats
    count. Repeated rows score alike; equal texts with different labels are learned as toxic; of several labels of an id the highest counts. Null ids are
    no label's and count as not held out unless the empty text's crc says so. Other columns are not read.
    """
    score = scorer(fit(docs, labels, **options))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the grammar predicts toxic; all columns stay as they are. Null and empty texts stay, repeated rows share their fate, and an empty table stays one."""
    score = scorer(fit(docs, labels))
    return docs.select(F.struct("*").alias("row"), score(F.col("text")).alias("score")).filter(F.col("score") < THRESHOLD).select("row.*")


def op6_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
