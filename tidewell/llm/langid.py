"""Language identification by interpolated Kneser-Ney models of characters.

Each language has a model of the characters of lower-case words, with marks at both ends; histories
stay within the word. All n-grams of an order lie in one sorted array of hashes, beside it a row of
log probabilities, one for each language; the same for histories and their back-off weights. A word's
score is looked up once for each worker and added up over a text. The language of least cross-entropy
a character wins; texts whose cross-entropy is beyond what held-back training texts show are rejected.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import worker_cache, keep_rows, mixed, stored

_U = np.uint64
WORD = re.compile(r"[^\W\d_]+")
ORDER = 5
UNKNOWN = "und"


def text_words(text: str | None) -> list[str]:
    """Lower-case words of letters; none if the text has no letter."""
    words = WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between the marks 2 and 3, and where each begins (the end added)."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return codes, np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])]).astype(np.int64)


def _grams(codes: np.ndarray, at: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: the hashes of the n-grams that begin at each place, and which of them lie within a word."""
    end = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(codes))
    out, key = [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, order + 1):
        ahead = np.concatenate([codes[n - 1 :], np.zeros(n - 1, dtype=np.uint64)])[: len(codes)]
        key = mixed(key ^ (ahead + _U(1)), n)
        out.append((key, place + n <= end))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands in the sorted keys; -1 if it does not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, i, -1)


@dataclass
class Model:
    """keys[n], logp[n]: n-grams and their log probabilities; histories[n], weight[n]: n-grams as histories and their log back-off weights."""

    languages: list[str]
    keys: list = field(default_factory=list)
    logp: list = field(default_factory=list)
    histories: list = field(default_factory=list)
    weight: list = field(default_factory=list)
    floor: float = -14.0
    random: float = 4.0  # cross-entropy of characters drawn at random from the alphabet
    limits: list = field(default_factory=list)  # per language: the usual cross-entropy, and where rejection begins

    def scores(self, words: list[str]) -> np.ndarray:
        """Per word: the log probability in each language, then the number of characters predicted (letters and the end)."""
        out = np.zeros((len(words), len(self.languages) + 1), dtype=np.float64)
        if not words:
            return out
        codes, at = _codes(words)
        grams = _grams(codes, at, ORDER)
        start = np.repeat(at[:-1], np.diff(at))
        place = np.flatnonzero(np.arange(len(codes)) > start)  # every character but the mark at the start
        got = np.zeros((len(place), len(self.languages)), dtype=np.float64)
        todo = np.arange(len(place))
        for n in range(ORDER, 0, -1):
            p = place[todo]
            long = p - (n - 1) >= start[p]
            first = np.maximum(p - (n - 1), 0)
            hit = np.where(long, _find(self.keys[n], grams[n - 1][0][first]), -1)
            got[todo[hit >= 0]] += self.logp[n][hit[hit >= 0]]
            if n > 1:
                miss = long & (hit < 0)
                h = _find(self.histories[n - 1], grams[n - 2][0][first[miss]])
                rows = todo[miss]
                got[rows[h >= 0]] += self.weight[n - 1][h[h >= 0]]
            else:
                got[todo[hit < 0]] += self.floor
            todo = todo[hit < 0]
        owner = np.repeat(np.arange(len(words)), np.diff(at))[place]
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, weights=got[:, k], minlength=len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out


def trained(counts: dict[str, Counter], discount: float = 0.75) -> Model:
    """Interpolated Kneser-Ney models of word counts by language: plain counts at the top order and where a word begins, continuation counts below."""
    model = Model(sorted(counts))
    size = len(model.languages)
    grams: list[list] = [[] for _ in range(ORDER + 1)]  # per order, per language: (keys, history keys, shorter keys, counts)
    alphabet = set()
    for language in model.languages:
        words = sorted(counts[language])
        weights = np.array([counts[language][w] for w in words], dtype=np.float64)
        codes, at = _codes(words)
        alphabet.update(codes.tolist())
        at_start = np.zeros(len(codes), dtype=bool)
        at_start[at[:-1]] = True
        times = np.repeat(weights, np.diff(at))
        all_grams = _grams(codes, at, ORDER)
        for n in range(1, ORDER + 1):
            key, inside = all_grams[n - 1]
            rows = np.flatnonzero(inside & ~at_start) if n == 1 else np.flatnonzero(inside)
            keys, first, group = np.unique(key[rows], return_index=True, return_inverse=True)
            plain = np.bincount(group, weights=times[rows])
            count = plain
            if n < ORDER:  # how many different characters stand before it
                before = rows[rows > 0]
                before = before[~at_start[before]] - 1
                longer = all_grams[n][0][before]
                _, one = np.unique(longer, return_index=True)
                pairs = all_grams[n - 1][0][before[one] + 1]
                spot = _find(keys, pairs)
                continued = np.bincount(spot[spot >= 0], minlength=len(keys)).astype(np.float64)
                count = np.where(continued > 0, continued, plain)  # a gram at the start of a word has nothing before it
            place = rows[first]
            history = all_grams[n - 2][0][place] if n > 1 else np.zeros(len(keys), dtype=np.uint64)
            shorter = all_grams[n - 2][0][place + 1] if n > 1 else np.zeros(len(keys), dtype=np.uint64)
            grams[n].append((keys, history, shorter, count))
    model.floor, model.random = -float(np.log(len(alphabet) + 1000)), float(np.log(len(alphabet)))
    model.keys, model.logp = [None] * (ORDER + 1), [None] * (ORDER + 1)
    model.histories, model.weight = [None] * ORDER, [None] * ORDER
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([g[0] for g in grams[n]]))
        history, shorter = np.zeros(len(keys), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
        for g in grams[n]:
            spot = _find(keys, g[0])
            history[spot], shorter[spot] = g[1], g[2]
        histories = np.unique(history)
        row = _find(histories, history)
        own, back = np.zeros((len(keys), size)), np.zeros((len(histories), size))
        for k, g in enumerate(grams[n]):
            count = np.zeros(len(keys))
            count[_find(keys, g[0])] = g[3]
            total = np.bincount(row, weights=count, minlength=len(histories))
            kinds = np.bincount(row, weights=count > 0, minlength=len(histories))
            seen = total > 0
            lam = np.where(seen, discount * kinds / np.where(seen, total, 1), 1.0)
            back[:, k] = lam
            own[:, k] = np.where(seen[row], np.maximum(count - discount, 0) / np.where(seen, total, 1)[row], 0)
        if n == 1:
            lower = np.full((len(keys), size), np.exp(model.floor))
        else:
            # The next shorter gram's probability; where it is at a word's start only, back off once more.
            i = _find(model.keys[n - 1], shorter)
            lower = np.where((i >= 0)[:, None], np.exp(model.logp[n - 1][np.maximum(i, 0)]), np.exp(model.floor))
        p = own + back[row] * lower
        model.keys[n], model.logp[n] = keys, np.log(np.maximum(p, 1e-12)).astype(np.float32)
        if n > 1:
            model.histories[n - 1], model.weight[n - 1] = histories, np.log(back).astype(np.float32)
    return model


def calibrate(model: Model, texts: list[tuple[str, list[str]]], share: float = 0.75, room: float = 1.3) -> None:
    """Sets, from texts that the model was not trained on, what cross-entropy is usual for each language and where rejection begins:
    `room` times the highest seen, and at least `share` of the way to characters drawn at random from the alphabet."""
    found: dict[str, list] = {language: [] for language in model.languages}
    for language, words in texts:
        if words and language in found:
            s = model.scores(words).sum(axis=0)
            found[language].append(-s[model.languages.index(language)] / s[-1])
    everything = [x for v in found.values() for x in v] or [0.5 * model.random]
    for language in model.languages:
        values = found[language] or everything
        mean = float(np.median(values))
        model.limits.append((mean, max(room * max(values), mean + share * max(0.1, model.random - mean))))


class Judge:
    """Scores texts with a model, looking each distinct word up once."""

    def __init__(self, model: Model, limit: int = 100_000, short: float = 2.0):
        self.model, self.limit, self.short = model, limit, short
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages) + 1))

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.ids) > self.limit:
            self.ids, self.table = {}, self.table[:0]
        ids, fresh = self.ids, []
        places = []
        for words in texts:
            for w in words:
                if (i := ids.get(w)) is None:
                    i = ids[w] = len(ids)
                    fresh.append(w)
                places.append(i)
        if fresh:
            self.table = np.concatenate([self.table, *(self.model.scores(fresh[i : i + 50_000]) for i in range(0, len(fresh), 50_000))])
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        places = np.array(places, dtype=np.int64)
        return np.stack([np.bincount(owner, weights=self.table[places, k], minlength=len(texts)) for k in range(self.table.shape[1])], axis=1)

    def judge(self, texts: list[list[str]]) -> list[tuple[str, float, float | None, bool]]:
        """Per text: language, score, cross-entropy (nats a character), rejected."""
        out = []
        for row in self.sums(texts) if texts else ():
            n = row[-1]
            if not n:
                out.append((UNKNOWN, 0.0, None, True))
                continue
            entropy = -row[:-1] / n
            k = int(np.argmin(entropy))
            relative = np.exp(-(entropy - entropy[k]) * min(n, 40.0))
            usual, limit = self.model.limits[k]
            apart = (entropy[k] - usual) / (limit - usual + usual * self.short / np.sqrt(n))  # short texts vary more
            out.append((self.model.languages[k], float(1 / relative.sum() / (1 + max(0.0, apart) ** 4)), float(entropy[k]), bool(apart > 1)))
        return out


def _count_words(batches):
    schema = pa.schema([("part", pa.string()), ("lang", pa.string()), ("doc_id", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
    for batch in batches:
        for language, doc, own, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "own", "text"))):
            counted = Counter(text_words(text))
            size = len(counted)
            yield pa.record_batch([pa.array(["test" if own else "train"] * size), pa.array([language] * size), pa.array([doc] * size, pa.int64()), pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], schema=schema)


def training_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """At most `per_language` labelled documents of each language, those of least hash; held-out rows never. Their ids (that bounded number) are
    broadcast, so no other text moves. Rows repeated with one doc_id and language are one document, with the least of their texts."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    rate = labelled.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(2.0 * per_language + 50) / F.col("n")).alias("rate"))
    thin = labelled.join(F.broadcast(rate), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) < F.col("rate")).distinct()  # a row for each language is broadcast; bounds what each language sorts
    best = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= per_language)
    picked = docs.join(F.broadcast(best.select("doc_id", "lang", "k")), ["doc_id", "lang"]).where("text IS NOT NULL")
    return picked.groupBy("doc_id", "lang", "k").agg(F.min("text").alias("text")).select("doc_id", "lang", "text", (F.col("k") % 5 == 0).alias("own"))


def fit(docs: DataFrame, per_language: int = 250) -> Model | None:
    """A model of a bounded sample: at most `per_language` documents of a language, a fifth of them for calibration."""
    rows = stored(training_rows(docs, per_language).mapInArrow(_count_words, "part string, lang string, doc_id long, word string, n long"), "words")
    train = rows.where("part = 'train'").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    test = rows.where("part = 'test'").select("lang", "doc_id", "word", "n")
    counts: dict[str, Counter] = {}
    for language, word, n in train.toPandas().itertuples(index=False):
        counts.setdefault(language, Counter())[word] = n
    if not counts:
        return None
    model = trained(counts)
    texts: dict[tuple, list] = {}
    for language, doc, word, n in test.toPandas().itertuples(index=False):
        texts.setdefault((language, doc), []).extend([word] * int(n))
    calibrate(model, [(language, sorted(words)) for (language, _), words in sorted(texts.items())])
    return model


class _Shared:
    """A broadcast value and a name for it that workers can keep things by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _predict(shared: _Shared, limit: int = 1 << 16):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        judge = worker_cache("langid", shared.id, lambda: Judge(shared.value))
        for batch in batches:
            found, held, size = [], [], 0
            for text in batch.column("text"):
                held.append(text_words(text.as_py()))
                size += len(held[-1])
                if size > limit:
                    found += judge.judge(held)
                    held, size = [], 0
            found += judge.judge(held)
            columns = list(zip(*found)) or [(), (), (), ()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:]))], schema=schema)

    return run


def identified(docs: DataFrame, per_language: int = 250, learn_from: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score, entropy, rejected.

    The model is fitted to a bounded sample of `learn_from` (by default `docs`), never of held-out rows
    (crc32 of doc_id as text mod 3 is 1), and broadcast; its size is bounded by the sample's. Prediction
    sees texts only. Null texts and texts without a letter: `und`, score 0, rejected. No labelled rows:
    `und` everywhere. Null doc_id: not held out, never learned from. Ties: the first language by name.
    Repeated rows: each is returned; in training they are one. Very long texts are counted whole. An empty
    table: no rows. The model has a column for each value of lang, so these should be few, as languages are.
    Other columns are ignored.
    """
    clean = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = clean(docs)
    model = fit(docs if learn_from is None else clean(learn_from), per_language)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(_Shared(shared)), "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean")


def recognised(docs: DataFrame, per_language: int = 250) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang) that identified() doesn't reject, with all their columns; without any labelled row, all."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), per_language)
    if model is None:
        return docs
    return keep_rows(docs, _predict(_Shared(docs.sparkSession.sparkContext.broadcast(model))), verdict="rejected", wanted=False, cache="langid")
