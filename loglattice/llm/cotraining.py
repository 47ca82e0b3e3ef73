"""Quality classifier by co-training a text-content view and a page-metadata view.

Two targets (quality, toxicity) each get two logistic classifiers: the text view sees which words and word beginnings a
document holds, the metadata view its language, source, size and layout.  They are fitted on at most ``LABELLED``
labelled rows, taken by a hash of their id, with a pool of at most ``POOL`` unlabelled ones.  In each round a view whose
confident predictions prove right on held-out rows hands its most confident pool rows to the other view as
pseudo-labels.  The calibrated views are then combined, and every document is scored.

The model is the only bounded thing.  Its bounds are parameters of every function here: ``labelled`` and ``pool`` rows to
fit on, ``features`` of the text view a target, and ``handed`` pseudo-labels a class and round.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm import _tokens
from loglattice.llm._words import blocks, word_hashes

LABELLED = 8_000
POOL = 2_000
ROUNDS = 3
FEATURES = 600  # of the text view, a target
CONFIDENT = 0.97
PROVEN = 0.98  # held-out precision a view needs to teach the other
HANDED = 200  # pool rows a view hands over, a class and round
OFTEN = 5  # labelled rows that must hold a word of the text view
BINS = 16
_HASHED = 64  # buckets of languages and of sources
TARGETS = ("quality", "toxic")

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_CLASSES = [range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100), range(0x30, 0x3A), (0x20,), (0x0A,), (0x7C,), tuple(b"*#$%&~^_=+<>@"), (0x21,), tuple(b".,;:?"), tuple(b"'\"()[]{}-/\\")]
_KIND = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES):
    _KIND[list(_members)] = _i
NUMBERS = len(_CLASSES) + 1 + 6


def text_view(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of the words and five-byte word beginnings of each row, repeats included."""
    words, first = word_hashes(offsets, data, lower=True, between=_BETWEEN)
    starts, _ = word_hashes(offsets, data, lower=True, between=_BETWEEN, prefix=5)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return np.concatenate([row, row]), np.concatenate([words, starts ^ np.uint64(0x5851F42D4C957F2D)])


def metadata_view(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Numbers of each row: shares of character classes, sizes, and repetition."""
    rows, n = len(offsets) - 1, np.diff(offsets)
    kinds = len(_CLASSES) + 1
    row = np.repeat(np.arange(rows), n)
    shares = np.bincount(row * kinds + _KIND[data], minlength=rows * kinds).reshape(rows, kinds) / np.maximum(n, 1)[:, None]
    words, first = word_hashes(offsets, data)
    count = np.diff(first)
    own = np.repeat(np.arange(rows), count)
    repeats = []
    for back in (1, 2, 5):
        same = (words[back:] == words[:-back]) & (own[back:] == own[:-back])
        repeats.append(np.bincount(own[back:][same], minlength=rows) / np.maximum(count, 1))
    more = [np.log1p(n), np.log1p(count), n / np.maximum(count, 1), *repeats]
    return np.concatenate([shares, np.stack(more, 1)], 1)


def _bucket(values: list) -> np.ndarray:
    from zlib import crc32

    return np.array([crc32((v or "").encode()) % _HASHED for v in values], np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _parts(rows, most: int = 1_024):
    """Consecutive rows, few at once; at least one part."""
    return [rows[at : at + most] for at in range(0, max(1, len(rows)), most)]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, ridge: float = 2.0) -> np.ndarray:
    """A weight a column of x, float32 with ones in the last one, by accelerated gradient descent on the ridge-penalised
    mean log loss."""
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    across = np.ascontiguousarray(x.T)
    penalty = np.full(x.shape[1], ridge / max(weight.sum(), 1.0), np.float32)
    penalty[-1] = 0
    squares = np.concatenate([(part * part).sum(1) for part in _parts(x)])
    rate = 1 / (0.25 * float((weight * squares).sum() / max(weight.sum(), 1e-9)) + penalty.max() + 1e-9)
    rate = np.float32(rate)
    beta = look = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        gradient = across @ (weight * (_sigmoid(x @ look) - y)) / np.float32(max(weight.sum(), 1e-9)) + penalty * look
        step = look - rate * gradient
        look = step + np.float32(k / (k + 3)) * (step - beta)
        beta = step
    return beta.astype(np.float64)


def _sample_rows(batches):
    """Features of the sampled documents."""
    _tokens.forget()
    for batch in batches:
        for at, offsets, data in blocks(batch.column("text"), 1 << 20):
            rows = len(offsets) - 1
            row, feature = text_view(offsets, data)
            numbers = metadata_view(offsets, data)
            parts = []
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(rows + 1))
            for i in range(rows):
                parts.append(np.unique(feature[order[cut[i] : cut[i + 1]]]).tobytes())
            own = batch.slice(at, rows)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), pa.array(_bucket(own.column("lang").to_pylist())), pa.array(_bucket(own.column("source").to_pylist())), pa.array(parts, pa.binary()), pa.array([x.tobytes() for x in numbers], pa.binary()), own.column("quality"), own.column("toxic")],
                ["doc_id", "lang", "source", "words", "numbers", "quality", "toxic"],
            )


def _meta_matrix(numbers: np.ndarray, lang: np.ndarray, source: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros((len(numbers), NUMBERS * BINS + 2 * _HASHED + 1), np.float32)
    out[:, -1] = 1
    row = np.arange(len(numbers))
    for j in range(NUMBERS):
        out[row, j * BINS + np.searchsorted(edges[j], numbers[:, j], "right")] = 1
    out[row, NUMBERS * BINS + lang] = 1
    out[row, NUMBERS * BINS + _HASHED + source] = 1
    return out


def _common(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values that at least OFTEN rows hold, ascending, and the row and value number of each of their occurrences).

    A sample holds millions of words, most of them in one row only: those are never numbered, and rows are looked up few
    at once.
    """
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    flat.sort()
    values = flat[np.flatnonzero(flat[OFTEN - 1 :] == flat[: max(0, len(flat) - OFTEN + 1)])]  # a row holds a word once
    del flat
    values = values[np.append(True, values[1:] != values[:-1])] if len(values) else values
    owner, place = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    if len(values):
        for at, part in zip(range(0, len(words), 1_024), _parts(words), strict=True):
            own = np.concatenate(part)
            found = np.searchsorted(values, own)
            found[found == len(values)] = 0
            hit = values[found] == own
            owner.append(np.repeat(np.arange(at, at + len(part), dtype=np.int32), [len(w) for w in part])[hit])
            place.append(found[hit].astype(np.int32))
    return values, np.concatenate(owner), np.concatenate(place)


def _logits(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.concatenate([part @ beta for part in _parts(x)])


def fit(words: list[np.ndarray], numbers: np.ndarray, lang: np.ndarray, source: np.ndarray, labels: dict[str, np.ndarray], rounds: int = ROUNDS, features: int = FEATURES, handed: int = HANDED) -> dict[str, np.ndarray]:
    """The model's arrays; labels hold 0, 1 or -1 (pool).  A target with one class only gets its constant.

    ``<target>_handed`` counts the pseudo-labels given by each view, a row for text and one for metadata, a column a class.
    """
    model: dict[str, np.ndarray] = {}
    edges = np.stack([np.quantile(numbers[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(NUMBERS)]) if len(numbers) else np.zeros((NUMBERS, BINS - 1))
    model["edges"] = edges
    meta = _meta_matrix(numbers, lang, source, edges)
    values, owner, place = _common(words)
    fold = np.arange(len(words)) % 4 == 3  # held out, rows being in hash order
    for target in TARGETS:
        y = labels[target]
        known = y >= 0
        train, held = known & ~fold, known & fold
        positive = float((y[known] == 1).mean()) if known.any() else float(target == "quality")
        model[f"{target}_prior"] = np.array([positive])
        model[f"{target}_vocabulary"], model[f"{target}_text"] = np.zeros(0, np.uint64), np.zeros(1)
        model[f"{target}_meta"], model[f"{target}_join"] = np.zeros(meta.shape[1]), np.zeros(3)
        model[f"{target}_handed"] = np.zeros((2, 2), np.int64)
        if len(set(y[train].tolist())) < 2 or len(set(y[held].tolist())) < 2:
            model[f"{target}_join"][2] = 30.0 if positive >= 0.5 else -30.0
            continue
        pos = np.bincount(place[(train & (y == 1))[owner]], minlength=len(values))
        neg = np.bincount(place[(train & (y == 0))[owner]], minlength=len(values))
        p, n = (y[train] == 1).sum(), (y[train] == 0).sum()
        expected = (pos + neg) * (p / (p + n))
        gain = np.abs(np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (n + 1))) * np.sqrt(np.abs(pos - expected))
        gain[pos + neg < OFTEN] = 0
        best = np.sort(np.argsort(-gain, kind="stable")[:features])
        best = best[gain[best] > 0]
        index = np.full(len(values), -1, np.int32)
        index[best] = np.arange(len(best))
        text = views = None  # the last target's go first
        text = np.zeros((len(words), len(best) + 1), np.float32)
        used = np.flatnonzero(index[place] >= 0)
        text[owner[used], index[place[used]]] = 1
        text[:, -1] = 1
        views = {"text": text, "meta": meta}
        truth = {v: np.where(train, y, -1) for v in views}
        weight = {v: train.astype(float) for v in views}
        betas = {}
        for turn in range(rounds + 1):
            for v, x in views.items():
                rows = truth[v] >= 0
                betas[v] = fit_logistic(x[rows], truth[v][rows].astype(float), weight[v][rows])
            if turn == rounds:
                break
            for v, other in (("text", "meta"), ("meta", "text")):
                chance = _sigmoid(_logits(views[v], betas[v]))
                for value, sure in ((1, chance >= CONFIDENT), (0, chance <= 1 - CONFIDENT)):
                    proof = held & sure
                    if proof.sum() < 20 or (y[proof] == value).mean() < PROVEN:
                        continue
                    free = np.flatnonzero(sure & ~known & (truth[other] < 0))
                    taken = free[np.argsort(-np.abs(chance[free] - 0.5), kind="stable")[:handed]]
                    truth[other][taken], weight[other][taken] = value, 0.5
                    model[f"{target}_handed"][int(v == "meta"), value] += len(taken)
        logits = np.stack([_logits(views[v][held], betas[v]) for v in ("text", "meta")], 1)
        both = np.concatenate([np.clip(logits, -20, 20), np.ones((len(logits), 1))], 1, dtype=np.float32)
        joint = fit_logistic(both, y[held].astype(float), np.ones(held.sum()), steps=2000, ridge=0.5)
        model[f"{target}_vocabulary"], model[f"{target}_text"] = values[best], betas["text"]
        model[f"{target}_meta"], model[f"{target}_join"] = betas["meta"], joint
    return model


def _train(rounds: int, features: int, handed: int):
    def run(table: pa.Table) -> pa.Table:
        _tokens.forget()
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        words = [np.frombuffer(w.as_buffer(), np.uint64) for chunk in table.column("words").chunks for w in chunk]  # where Arrow holds them
        words = [words[i] for i in order]
        table = table.drop_columns("words").take(pa.array(order))
        numbers = np.array([np.frombuffer(x, np.float64) for x in table.column("numbers").to_pylist()])
        labels = {t: np.array([-1 if v is None else int(v > 0) for v in table.column(t).to_pylist()]) for t in TARGETS}
        out = io.BytesIO()
        np.savez_compressed(out, **fit(words, numbers, table.column("lang").to_numpy(), table.column("source").to_numpy(), labels, rounds, features, handed))
        return pa.table({"model": pa.array([out.getvalue()], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, features: int = FEATURES, handed: int = HANDED) -> bytes | None:
    """The fitted model; None without a labelled document.  Rows of one doc_id with different labels: the largest counts; of rows
    that repeat a doc_id one is fitted on."""
    text = docs.select("doc_id", "text", "lang", "source").where("doc_id is not null and text is not null")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"), F.max("toxic").cast("long").alias("toxic"))
    ids = text.select("doc_id").distinct()
    place = F.xxhash64("doc_id", F.lit(11))
    some = known.join(ids, "doc_id", "left_semi").withColumn("place", place).orderBy("place").limit(labelled)
    others = ids.join(known, "doc_id", "left_anti").withColumn("place", place).orderBy("place").limit(pool)
    sample = some.unionByName(others.withColumns({"quality": F.lit(None).cast("long"), "toxic": F.lit(None).cast("long")}))
    rows = text.join(F.broadcast(sample), "doc_id")  # at most labelled + pool ids
    one = F.min_by(F.struct("text", "lang", "source"), F.xxhash64("text", "lang", "source")).alias("own")
    rows = rows.groupBy("doc_id", "quality", "toxic").agg(one).select("doc_id", "own.text", "own.lang", "own.source", "quality", "toxic")
    kind = "doc_id long, lang long, source long, words binary, numbers binary, quality long, toxic long"
    sample_rows = rows.select("doc_id", "text", "lang", "source", "quality", "toxic").mapInArrow(_sample_rows, kind).withColumn("place", place)
    found = sample_rows.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(_train(rounds, features, handed), "model binary").collect()  # one row
    return found[0]["model"] if found else None


class Scorer:
    def __init__(self, model: bytes | None):
        self.model = dict(np.load(io.BytesIO(model))) if model else None

    def chances(self, offsets: np.ndarray, data: np.ndarray, lang: list, source: list) -> dict[str, np.ndarray]:
        rows = len(offsets) - 1
        if self.model is None:  # nothing to learn from: everything is kept
            return {"quality": np.ones(rows), "toxic": np.zeros(rows)}
        row, feature = text_view(offsets, data)
        numbers = metadata_view(offsets, data)
        places = [j * BINS + np.searchsorted(self.model["edges"][j], numbers[:, j], "right") for j in range(NUMBERS)]
        places += [NUMBERS * BINS + _bucket(lang), NUMBERS * BINS + _HASHED + _bucket(source)]
        out = {}
        for target in TARGETS:
            vocabulary, beta = self.model[f"{target}_vocabulary"], self.model[f"{target}_text"]
            words = np.full(rows, beta[-1])
            if len(vocabulary):
                at = np.searchsorted(vocabulary, feature)
                at[at == len(vocabulary)] = 0
                hit = vocabulary[at] == feature
                pairs = np.unique(row[hit] * len(vocabulary) + at[hit])
                words += np.bincount(pairs // len(vocabulary), weights=beta[pairs % len(vocabulary)], minlength=rows)
            meta = self.model[f"{target}_meta"]
            joint = self.model[f"{target}_join"]
            layout = meta[-1] + sum(meta[p] for p in places)
            out[target] = _sigmoid(joint[0] * np.clip(words, -20, 20) + joint[1] * np.clip(layout, -20, 20) + joint[2])
        return out


def _scored(batches, scorer: Scorer):
    _tokens.forget()
    for batch in batches:
        lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for at, offsets, data in blocks(batch.column("text"), 1 << 20):
            rows = len(offsets) - 1
            chance = scorer.chances(offsets, data, lang[at : at + rows], source[at : at + rows])
            # without words there is nothing to judge by, and nothing to train on
            empty = np.diff(offsets) == 0
            yield batch.slice(at, rows), np.where(empty, 0.0, chance["quality"]), np.where(empty, 0.0, chance["toxic"])


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, p_quality, p_toxic, score, keep.

    docs(doc_id, text, lang, source, ...), labels(doc_id, quality, toxic): keep where p_quality >= 0.5 and p_toxic < 0.5;
    score is p_quality * (1 - p_toxic).  Null and empty texts get p_quality 0 and are not kept; a null language or source
    is a value of its own; whole texts of any length are read; repeated rows get the same row each; without any labelled
    document all others are kept; other columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels, **options)

    def run(batches):
        for own, good, bad in _scored(batches, Scorer(model)):
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(good), pa.array(bad), pa.array(good * (1 - bad)), pa.array((good >= 0.5) & (bad < 0.5))], ["doc_id", "p_quality", "p_toxic", "score", "keep"])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, "doc_id long, p_quality double, p_toxic double, score double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that quality() keeps, with their columns, whatever their names; see there for all other cases."""
    model = train(docs, labels, **options)

    def run(batches):
        for own, good, bad in _scored(batches, Scorer(model)):
            yield own.filter(pa.array((good >= 0.5) & (bad < 0.5)))

    return docs.mapInArrow(run, docs.schema)
