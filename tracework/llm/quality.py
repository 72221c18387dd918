"""Quality by co-training: a text view and a metadata view teach each other.

Two logistic classifiers see different views of a document: one its content
(shape statistics, hashed word shapes, words and pairs of words of the whole
text), one its metadata (source, language, length). Each round, each view adds
the unlabelled documents it is surest of, with its labels, to the training set
of the other; all unlabelled documents are asked. Both are then calibrated on
held-out labelled documents, and a last logistic step weighs the calibrated
views, so a view that tells nothing weighs nothing.

A text is read once: its features are written, and the rounds and the final
score work on them. Only labelled documents are sampled (parameter below).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.llm.common import bounded_sample, held, map_rows
from tracework.llm.models import Logistic, logit
from tracework.plans.materialize import drop, materialize

#: Labelled documents that the fit may use.
LABELLED = 8_000
#: Rounds, pseudo-labels a view gives in each round, and the confidence they need.
ROUNDS, PER_ROUND, SURE = 4, 200, 0.95
#: Buckets of hashed word shapes, words, pairs of words; of sources and languages.
SHAPES, WORDS, PAIRS = 64, 128, 64
SOURCES, LANGUAGES = 128, 64
_PLAIN = 10
#: Hashed words and pairs weigh less than shapes: there are many of them for few labels.
_SCALE = np.repeat([1.0, 0.2], [_PLAIN + SHAPES, WORDS + PAIRS])
_SQUASH = (re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+"))
_KNOWN_WORDS = 200_000


def _shape(word: str) -> str:
    """Case and marks of a word: letters as a or A, digits as 9, the rest as it is."""
    inner = _SQUASH[1].sub("9", _SQUASH[0].sub(lambda m: _case(m.group()), word))
    return inner[-8:]


def _case(letters: str) -> str:
    return "A" if len(letters) > 1 and letters.isupper() else "Aa" if letters[0].isupper() else "a"


def _code(word: str) -> int:
    """The shape bucket and 32 bits of the word in lower case."""
    return zlib.crc32(_shape(word).encode()) % SHAPES << 32 | zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))


def text_view(text: str | None, known: dict[str, int] | None = None) -> np.ndarray:
    """Content features of a whole text; ``known`` remembers the codes of words from text to text."""
    out = np.zeros(_PLAIN + SHAPES + WORDS + PAIRS, np.float32)
    words = (text or "").split()
    n = len(words)
    if not n:
        return out
    known = {} if known is None else known
    distinct = set(words)
    if len(known) > _KNOWN_WORDS:
        known.clear()
    for w in distinct.difference(known):
        known[w] = _code(w)
    raw = np.fromiter(map(len, words), np.int32, n)
    code = np.fromiter(map(known.__getitem__, words), np.int64, n)
    word = code & 0xFFFFFFFF
    lines = text.split("\n")
    out[:_PLAIN] = (
        np.log1p(n),
        raw.mean(),
        raw.std(),
        len(distinct) / n,
        len(distinct) / n**0.7,
        np.count_nonzero(word[1:] == word[:-1]) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isupper, words)) / n,
        len(set(lines)) / len(lines),
        len(text) / n,
    )
    at = _PLAIN
    out[at : at + SHAPES] = np.bincount(code >> 32, minlength=SHAPES) / n
    at += SHAPES
    out[at : at + WORDS] = np.sqrt(np.bincount(word % WORDS, minlength=WORDS) / n)
    at += WORDS
    out[at:] = np.sqrt(np.bincount((word[:-1] * 31 + word[1:]) % PAIRS, minlength=PAIRS) / n)
    return out


def metadata_view(source: list, lang: list, chars: list) -> np.ndarray:
    """Features of the metadata of many pages; their texts are not looked at, only the lengths."""
    out = np.zeros((len(source), SOURCES + LANGUAGES + 4))
    rows = np.arange(len(source))
    for at, size, mark, column in ((0, SOURCES, "s", source), (SOURCES, LANGUAGES, "l", lang)):
        bucket = {v: at + zlib.crc32((mark + (v or "")).encode()) % size for v in set(column)}
        out[rows, [bucket[v] for v in column]] = 1.0
    length = np.log1p([max(c or 0, 0) for c in chars])
    out[:, -4], out[:, -3] = length, length**2
    out[:, -2], out[:, -1] = [s is None for s in source], [v is None for v in lang]
    return out


def _views(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of the feature table."""
    a = np.frombuffer(b"".join(r["xa"]), np.float32).reshape(len(r["xa"]), -1).astype(float)
    return a, metadata_view(r["source"], r["lang"], r["n_chars"])


class CoTraining:
    """The two views, their calibrations, and the step that combines them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, y: np.ndarray):
        held_out = np.arange(len(y)) % 3 == 0
        if min(np.bincount(y[~held_out].astype(int), minlength=2)) == 0 or min(np.bincount(y[held_out].astype(int), minlength=2)) == 0:
            held_out = np.zeros(len(y), bool)
        self.test = held_out if held_out.any() else ~held_out
        self.views, self.y, self.train = (a, b), y, ~held_out
        self.base = float(y.mean())
        #: Rows and pseudo-labels that each view has received.
        self.given = [(np.empty((0, v.shape[1])), np.empty(0)) for v in self.views]

    def fit_views(self) -> None:
        """Fit both views, and calibrate them on the labelled documents that they have not learnt from."""
        self.models = []
        for view, (x, t), scale in zip(self.views, self.given, (_SCALE, 1.0)):
            weight = np.concatenate([np.ones(self.train.sum()), np.full(len(t), 0.5)])
            self.models.append(
                Logistic(scale).fit(np.vstack([view[self.train], x]), np.concatenate([self.y[self.train], t]), weight, l2=5.0)
            )
        z = [m.decision(v[self.test])[:, None] for m, v in zip(self.models, self.views)]
        self.calibration = [Logistic().fit(s, self.y[self.test], l2=0.1) for s in z]

    def receive(self, view: int, rows: np.ndarray, labels: np.ndarray) -> None:
        """Pseudo-labels from the other view."""
        x, t = self.given[view]
        self.given[view] = np.vstack([x, rows]), np.concatenate([t, labels])

    def combine(self) -> CoTraining:
        z = [m.decision(v[self.test])[:, None] for m, v in zip(self.models, self.views)]
        y = self.y[self.test]
        both = np.hstack([logit(c.predict(s))[:, None] for c, s in zip(self.calibration, z)])
        self.final = Logistic().fit(both, y, l2=0.5)
        self.exchanged = [len(t) for _, t in self.given]
        del self.views, self.y, self.given
        return self

    def each(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Calibrated probabilities of good quality of the two views; one that knows nothing is sure of nothing."""
        return [c.predict(m.decision(v)[:, None]) for c, m, v in zip(self.calibration, self.models, (a, b))]

    def predict(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: text view, metadata view, both."""
        p = self.each(a, b)
        return p[0], p[1], self.final.predict(np.hstack([logit(q)[:, None] for q in p]))


_SEEN = ("h", "xa", "source", "lang", "n_chars")


def describe(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The feature table: doc_id, the columns in ``keep``, metadata, ``xa`` (text view), ``full``, and ``h`` of the content."""
    columns = list(dict.fromkeys(("doc_id", *keep, "source", "lang", "n_chars")))
    names = list(dict.fromkeys((*columns, "text")))
    rows = docs.select(*names, F.xxhash64("text", "source", "lang", "n_chars").alias("h"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def make():
        known = held("words", dict)

        def run(r: dict) -> list:
            full = [bool(t and not t.isspace()) for t in r["text"]]
            return [*(r[c] for c in columns), r["h"], [text_view(t, known).tobytes() for t in r["text"]], full]

        return run

    return materialize(map_rows(rows, f"{schema}, h long, xa binary, full boolean", make))


def learn(rows: DataFrame, labels: DataFrame) -> CoTraining | None:
    """Fit from a feature table and labels (doc_id, quality); None if they lack one of the two classes."""
    rated = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = bounded_sample(rated, "doc_id", LABELLED, seed=2)
    # At most LABELLED ids, one row of each.
    sample = rows.select("doc_id", *_SEEN).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.first("quality").alias("y"), F.min_by(F.struct("xa", "source", "lang", "n_chars"), "h").alias("x"), F.min("h").alias("h")
    )
    pdf = sample.select("y", "h", "doc_id", "x.*").toPandas().sort_values(["h", "doc_id"])
    y = pdf["y"].to_numpy(float)
    if len(np.unique(y)) < 2:
        return None
    model = CoTraining(*_views(_lists(pdf)), y)
    pool = materialize(rows.select("doc_id", *_SEEN).join(rated.select("doc_id"), "doc_id", "left_anti").drop("doc_id"))
    taken: list[list[int]] = [[], []]
    for step in range(ROUNDS + 1):
        model.fit_views()
        if step < ROUNDS:
            _exchange(model, pool, taken)
    drop(pool)
    return model.combine()


def _lists(pdf) -> dict:
    return {c: [None if v is None or v != v else v for v in pdf[c]] for c in ("xa", "source", "lang", "n_chars")}


def _exchange(model: CoTraining, pool: DataFrame, taken: list[list[int]]) -> None:
    """One round: every unlabelled row is scored; each view's surest go to the other, equal contents once."""
    shared = pool.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(r: dict) -> list:
            return [r["h"], *(p.tolist() for p in shared.value.each(*_views(r)))]

        return run

    scored = materialize(map_rows(pool, "h long, p0 double, p1 double", make))
    picks = []
    for view in (0, 1):  # what this view has learnt from the other already is not given again
        p, free = f"p{1 - view}", scored.where(~F.col("h").isin(taken[view])) if taken[view] else scored
        for label, order, share in ((1.0, F.desc(p), model.base), (0.0, F.asc(p), 1 - model.base)):
            sure = free.where(F.col(p) >= SURE if label else F.col(p) <= 1 - SURE)
            once = sure.groupBy("h").agg(F.first(p).alias(p)).orderBy(order, "h").limit(max(1, int(PER_ROUND * share)))
            picks.append(once.select("h", F.lit(view).alias("view"), F.lit(label).alias("label")))
    top = picks[0]
    for p in picks[1:]:
        top = top.unionByName(p)
    # At most 2 * PER_ROUND rows.
    pdf = pool.join(F.broadcast(top), "h").dropDuplicates(["h", "view", "label"]).toPandas().sort_values(["view", "label", "h"])
    for view in (0, 1):
        part = pdf[pdf["view"] == view]
        if len(part):
            model.receive(view, _views(_lists(part))[view], part["label"].to_numpy(float))
            taken[view] += part["h"].tolist()
    shared.unpersist()
    drop(scored)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score all documents.

    ``docs`` has doc_id, text, source, lang, n_chars; ``labels`` doc_id and
    quality (0 or 1; others and repeats are ignored, the best label of an id
    counts; of rows that repeat a labelled id, one is learnt from). Returns a
    row for every row: ``doc_id``, the columns in ``keep``, ``p_text``,
    ``p_meta``, ``p_quality`` and ``good``. Null texts count as empty and are
    never good. Without labels of both classes, probabilities are null and all
    but null and blank texts are good. Lengths come from n_chars. Very long texts are read whole;
    an empty table gives no rows. Other columns of ``docs`` and ``labels`` are
    ignored; ``keep`` must not name ``h``, ``xa``, ``full`` or a result column.
    """
    rows = describe(docs, keep)
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows, labels))
    columns = list(dict.fromkeys(("doc_id", *keep)))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def make():
        model = shared.value

        def run(r: dict) -> list:
            out = [r[c] for c in columns]
            if model is None:
                none = [None] * len(r["full"])
                return [*out, none, none, none, r["full"]]
            p = model.predict(*_views(r))
            return [*out, *(q.tolist() for q in p), [bool(f and q >= threshold) for f, q in zip(r["full"], p[2])]]

        return run

    return map_rows(
        rows.select(*dict.fromkeys((*columns, *_SEEN[1:], "full"))),
        f"{schema}, p_text double, p_meta double, p_quality double, good boolean",
        make,
    )
