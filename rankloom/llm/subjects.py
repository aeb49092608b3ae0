"""Problem 9: subject areas of documents, from labelling functions weighed by a model that learns their accuracy.

Lexicons of terms are learnt from hand-labelled documents. Each labelling function looks at one thing only - the terms
of the claims, of the first claim, of the title, the abstract or the description, the applicant, who stands in for an
address line (no column has one), or the source - and gives one of a few outcomes for each subject. A latent model has, for each function, how often each
outcome comes with a true and with a false subject; it is fitted by expectation and maximisation, in which the hand
labels are one more function, as some of them are wrong. Documents get the subjects whose posterior is high enough.
Where there are few labelled documents, the lexicon is learnt once more with others, of which the first model is sure.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..arrow import ready

#: Documents that the lexicon and the model are fitted on, at most (the labelled ones of least hash, then others of least hash),
#: and characters of all of them.
FITTED, FITTED_CHARS = 5_000, 256_000_000
#: Rows up to which the list of subjects may grow.
MOST_SUBJECTS = 1_000
#: A term belongs to a subject that has at least this share of its documents, by so many documents.
PURITY, LEAST_DOCUMENTS = 0.5, 2
#: Posterior of each of its subjects from which a document without labels teaches the lexicon.
SURE = 0.9
#: Posterior from which a subject is given; the likeliest is given from LEAST on.
GIVEN, LEAST = 0.5, 0.1
MOST_GIVEN = 2

_WORD = re.compile(r"[^\W\d_]{2,}")
_SPLIT = re.compile(r"\r\n|\r|\n")
_NUMBERED = re.compile(r"^\s*([\dlo]{1,3})\s?[.)]")
# Headings of sections, without spaces and with confused characters folded.
HEADINGS = {"abstract": "abstract", "(57)abstract": "abstract", "abstract:": "abstract", "description": "description", "detaileddescription": "description", "claims": "claims", "whatisclaimedis:": "claims"}
# Characters that scanning takes for one another, folded to one of them.
_CONFUSED = (("li", "h"), ("ii", "u"), ("rn", "m"), ("1", "l"), ("0", "o"), ("f", "t"), ("c", "e"))


def fold(text: str) -> str:
    """Lower case, with characters that scanning confuses as one."""
    text = text.lower()
    for a, b in _CONFUSED:
        text = text.replace(a, b)
    return text


_HEADS = {fold(k): v for k, v in HEADINGS.items()}


def heading(line: str) -> str | None:
    """The section that a folded line opens, if it is a heading in spite of one or two wrong characters."""
    if len(line) > 32:
        return None
    key = "".join(line.split())
    if key in _HEADS:
        return _HEADS[key]
    if len(key) < 5:
        return None
    for k, v in _HEADS.items():
        if abs(len(k) - len(key)) <= 2 and k[0] == key[0] and sum(a != b for a, b in zip(k, key)) + abs(len(k) - len(key)) <= max(1, len(k) // 6):
            return v
    return None


def sections(text: str) -> dict[str, str]:
    """title, abstract, description, claims and first (the first claim) of a folded text, as far as it has them.

    Claims begin at their heading or, without one, at a line numbered 1 that the next numbered line follows with 2.
    """
    parts: dict[str, list[str]] = {}
    rows = parts["title"] = []
    for line in _SPLIT.split(text):
        if len(line) <= 32 and (h := heading(line)) is not None:
            rows = parts.setdefault(h, [])
        elif line and not line.isspace():
            rows.append(line)
    if "claims" not in parts:
        for rows in (parts.get("description", []), parts.get("abstract", []), parts["title"]):
            numbers = [(i, m[1]) for i, r in enumerate(rows) if (m := _NUMBERED.match(r))]
            starts = [i for (i, a), (_, b) in zip(numbers, numbers[1:]) if a == "l" and b == "2"]
            if starts:
                parts["claims"] = rows[starts[0] :]
                del rows[starts[0] :]
                break
    first = []
    for r in parts.get("claims", []):
        if (m := _NUMBERED.match(r)) and m[1] != "l":
            break
        first.append(r)
    parts["first"] = first
    return {k: "\n".join(v) for k, v in parts.items() if v}


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def terms(text: str) -> set[str]:
    """Words and pairs of neighbouring words of a folded text."""
    w = words(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def scope(parts: dict[str, str]) -> str:
    """What a document's subjects are taken from: its claims, or else title and abstract."""
    return parts.get("claims") or "\n".join(parts[k] for k in ("title", "abstract") if k in parts)


def learn_lexicon(labelled: list[tuple[str, frozenset[str]]]) -> dict[str, str]:
    """term -> subject, from texts with their subjects.

    A document of one subject counts once for each of its terms, one of two subjects half for either.
    """
    of: dict[str, Counter] = defaultdict(Counter)
    size: Counter = Counter()
    for text, subjects in labelled:
        if not text or not subjects:
            continue
        w = 1 / len(subjects)
        for s in subjects:
            size[s] += w
        for t in terms(text):
            for s in subjects:
                of[t][s] += w
    mean = sum(size.values()) / max(1, len(size))
    out = {}
    for t, c in of.items():
        if sum(c.values()) < LEAST_DOCUMENTS:
            continue
        even = {s: n * mean / size[s] for s, n in c.items()}  # as if each subject had as many documents
        s = max(even, key=lambda k: (even[k], k))
        if even[s] / sum(even.values()) >= PURITY:
            out[t] = s
    return out


#: What each labelling function looks at; ``spread`` is how many different terms the claims have.
FUNCTIONS = ("claims", "first", "title", "abstract", "description", "spread", "address", "source", "label")
PARTS = FUNCTIONS[:5]
_SHARES = (0.0, 0.08, 0.16, 0.24, 0.34, 0.6)
_TALLIES = (0.0, 1.0, 2.0, 3.0, 5.0, 8.0)
_LIFTS = (0.0, 0.5, 1.0, 2.0, 4.0)
LEVELS = len(_SHARES) + 2


def _bins(x: np.ndarray, edges: tuple) -> np.ndarray:
    """1 for none of it, then one more for each edge passed; 0 is kept for a function that has nothing to look at."""
    return 1 + np.searchsorted(edges, x, side="left")


class Subjects:
    """Labelling functions and the latent model over their outcomes."""

    def __init__(self, names: list[str], lexicon: dict[str, str], sources: dict, addresses: dict) -> None:
        self.names = sorted(names)
        index = {s: i for i, s in enumerate(self.names)}
        self.single: dict[str, int] = {}
        self.pairs: dict[str, dict[str, int]] = {}
        self.subject: list[int] = []
        for term, s in sorted(lexicon.items()):
            if s not in index:
                continue
            a, _, b = term.partition(" ")
            if b:
                self.pairs.setdefault(a, {})[b] = len(self.subject)
            else:
                self.single[a] = len(self.subject)
            self.subject.append(index[s])
        self.lifts = {"source": sources, "address": addresses}
        self.log = np.zeros((2, len(FUNCTIONS), LEVELS))
        self.prior = 0.1

    def hits(self, text: str) -> list[int]:
        """The lexicon's terms in a folded text, in order."""
        out: list[int] = []
        single, pair, before = self.single.get, self.pairs.get, None
        for w in words(text):
            if (t := single(w)) is not None:
                out.append(t)
            if before is not None and (t := before.get(w)) is not None:
                out.append(t)
            before = pair(w)
        return out

    def outcomes(self, texts: list, sources: list, applicants: list) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have an invention that some subject's term names, their outcomes: rows x subjects x functions)."""
        n = len(self.names)
        rows, counts, spread, there = [], [], [], []
        for i, text in enumerate(texts):
            if not text or text.isspace():
                continue
            parts = sections(fold(text))
            c = [[0] * n for _ in PARTS]
            k = [0] * n
            some = False
            for j, f in enumerate(PARTS):
                if f in parts:
                    hits = self.hits(parts[f])
                    for t in hits:
                        c[j][self.subject[t]] += 1
                    if f == "claims":
                        for t in set(hits):
                            k[self.subject[t]] += 1
                    some |= bool(hits) and f != "description"
            if some:
                rows.append(i)
                counts.append(c)
                spread.append(k)
        x = np.zeros((len(rows), n, len(FUNCTIONS)), np.int64)
        if rows:
            c = np.array(counts, float).transpose(0, 2, 1)
            total = c.sum(axis=1, keepdims=True)
            x[:, :, : len(PARTS)] = np.where(total > 0, _bins(c / np.maximum(total, 1), _SHARES), 0)
            tallies = np.array(spread, float)
            x[:, :, 5] = np.where(tallies.sum(axis=1, keepdims=True) > 0, _bins(tallies, _TALLIES), 0)
            for j, f, values in ((6, "address", applicants), (7, "source", sources)):
                for r, i in enumerate(rows):
                    if (lift := self.lifts[f].get(values[i])) is not None:
                        x[r, :, j] = _bins(lift, _LIFTS)
        return np.array(rows, np.int64), x

    def fit(self, outcomes: np.ndarray, labelled: np.ndarray, rounds: int = 12) -> None:
        """Expectation and maximisation; ``outcomes``: documents x subjects x functions, ``labelled``: documents x subjects, as labelled by hand."""
        x = outcomes.copy()
        x[:, :, -1] = 1 + labelled
        y = np.where(labelled, 0.95, 0.02)
        for _ in range(rounds):
            self.prior = float(np.clip(y.mean(), 1e-3, 0.5))
            for j in range(len(FUNCTIONS)):
                for k, w in enumerate((1 - y, y)):
                    n = np.bincount(x[:, :, j].ravel(), weights=w.ravel(), minlength=LEVELS) + 0.5
                    self.log[k, j] = np.log(n / n.sum())
            y = self.posterior(x)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """The probability of each subject; a function without an outcome says nothing."""
        d = (self.log[1] - self.log[0]).copy()
        d[:, 0] = 0
        z = sum(d[j][x[..., j]] for j in range(len(FUNCTIONS))) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def choose(self, x: np.ndarray) -> list[list[str]]:
        """The subjects of each row: up to MOST_GIVEN of a posterior of GIVEN, or the likeliest from LEAST on."""
        p = self.posterior(x)
        out = []
        for q, order in zip(p, np.argsort(-p, axis=1, kind="stable")):
            best = order[:MOST_GIVEN]
            out.append([self.names[i] for i in best if q[i] >= GIVEN] or [self.names[i] for i in best[:1] if q[i] >= LEAST])
        return out


def _lifts(rows: list[tuple], at: int, names: list[str]) -> dict:
    """How many times as often as elsewhere each subject comes with a value, smoothed by one label of the usual mix."""
    names = sorted(names)
    total, by = Counter(), defaultdict(Counter)
    for r in rows:
        for s in r[3]:
            total[s] += 1
            if r[at] is not None:
                by[r[at]][s] += 1
    n = sum(total.values())
    return {v: np.array([(c[s] + total[s] / n) / (sum(c.values()) + 1) / max(total[s] / n, 1e-6) for s in names]) for v, c in by.items()}


def fit(rows: list[tuple[str, str, str, frozenset[str]]], names: list[str]) -> Subjects:
    """A model from (text, source, applicant, subjects). Half of the documents teach the lexicon and the lifts that judge the other half."""
    rows = [r for r in rows if r[0] and r[0].strip() and r[3]]
    texts = [(scope(sections(fold(r[0]))), r[3]) for r in rows]
    final = Subjects(names, learn_lexicon(texts), _lifts(rows, 1, names), _lifts(rows, 2, names))
    xs, ys = [], []
    for half in (0, 1):
        own = rows[half::2]
        m = Subjects(names, learn_lexicon(texts[half::2]), _lifts(own, 1, names), _lifts(own, 2, names))
        other = rows[1 - half :: 2]
        at, x = m.outcomes([r[0] for r in other], [r[1] for r in other], [r[2] for r in other])
        xs.append(x)
        ys += [[s in other[i][3] for s in m.names] for i in at]
    if ys:
        final.fit(np.concatenate(xs), np.array(ys, np.int64))
    return final


def fit_with(rows: list[tuple[str, str, str, frozenset[str]]], others: list[tuple[str, str, str]], names: list[str]) -> Subjects:
    """``fit``, then once more with those of ``others`` (text, source, applicant) of whose subjects the first model is sure."""
    first = fit(rows, names)
    at, x = first.outcomes([r[0] for r in others], [r[1] for r in others], [r[2] for r in others])
    if not len(at):
        return first
    place = {s: k for k, s in enumerate(first.names)}
    sure = [(*others[i], frozenset(chosen)) for i, chosen, p in zip(at, first.choose(x), first.posterior(x)) if chosen and all(p[place[s]] >= SURE for s in chosen)]
    return fit([*rows, *sure], names) if sure else first


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> Subjects:
    """The model, fitted on the driver on at most FITTED documents, and FITTED_CHARS of their texts: the labelled ones of least hash and,
    if these are fewer, others of least hash; the same in every run."""
    names = [r.subject for r in areas.select("subject").filter("trim(subject) <> ''").distinct().limit(MOST_SUBJECTS + 1).collect()]
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    by_hand = labels.filter(F.col("subject").isin(names)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = by_hand.filter("doc_id is not null").orderBy(*order).limit(FITTED)
    labelled = sample.count()
    if 0 < labelled < FITTED:
        others = documents.select(F.col("doc_id").cast(by_hand.schema["doc_id"].dataType).alias("doc_id")).filter("doc_id is not null").join(by_hand, "doc_id", "left_anti")
        sample = sample.unionByName(others.distinct().orderBy(*order).limit(FITTED - labelled), allowMissingColumns=True)
    given = documents.select("doc_id", "text", "source", "applicant").join(F.broadcast(sample), "doc_id")
    rows, chars = [], 0
    for r in given.sort(F.col("subjects").isNull(), *order).toLocalIterator():
        chars += len(r.text or "")
        if rows and chars > FITTED_CHARS:
            break
        rows.append((r.doc_id, r.text, r.source, r.applicant, r.subjects))
    rows.sort(key=lambda r: r[0])
    by_label = [(*r[1:4], frozenset(r[4])) for r in rows if r[4] is not None]
    return fit_with(by_label, [r[1:4] for r in rows if r[4] is None], names)


def assign(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject): one or two subjects of each document that has an invention.

    Null, empty and blank texts, notices, and texts in which no term of any subject's lexicon occurs outside the
    description have no row. Without labels nothing can be learnt, and no document has a row.
    """
    spark = documents.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(train(documents, labels, areas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sources, applicants = (batch.column(i).to_pylist() for i in range(4))
            at, x = model.value.outcomes(texts, sources, applicants)
            found = [(ids[i], s) for i, chosen in zip(at, model.value.choose(x)) for s in chosen]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())], names=["doc_id", "subject"])

    given = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("applicant").cast("string"))
    return given.mapInArrow(run, "doc_id bigint, subject string")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return assign(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "subject_label", "subject_area")))


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each subject has, and their share of all assignments."""
    counts = p9_found(spark, sf).groupBy("subject").agg(F.count("*").alias("documents"))
    return counts.withColumn("share", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 6))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
SQL: dict[str, str] = {}
