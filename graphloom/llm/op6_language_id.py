"""Language identification by interpolated Kneser-Ney character models.

For each language a character model of order 4 is trained on a bounded sample of labelled
texts: absolute discounts from the counts of counts, continuation counts below the
highest order, a uniform floor. All models live in sorted arrays of n-gram hashes, one
set of arrays for all languages, with a row of log-probabilities a language; a text is
scored by one search a character, and by shorter n-grams where that misses. The language
of the lowest cross-entropy a character wins. Texts whose best cross-entropy lies above
what calibration texts of that language, kept out of the counts, make likely, for their
length, are rejected (column rejected), as are texts more than half of whose characters no
language's sample has.

The sample is bounded by SAMPLE_BYTES a language, taken in the order of a hash from texts
and pieces of long texts; each labelled language with a letter outside the held-out fold
has at least one in it. Calibration takes what follows, of other documents. So the
broadcast models are bounded too: at most 4 n-grams a sampled character at 8 bytes, with
4 bytes a language.

Results for edge cases: a null text, or one without a letter (fractions and raised or
circled numbers are none), is und with score 0 and is
rejected, as are all texts where no labelled text was learned from; a null doc_id is not
held out and not learned from; rows with a null lang are not learned from; ties go to the
first language in code point order; repeated rows are each returned; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.staging import give_back, prepare, tidy

ORDER = 4
SAMPLE_BYTES = 1 << 20  # of text that a language's counts are taken from
CALIBRATION_BYTES = 1 << 18
PIECE_CHARS = 1 << 16  # of long texts, drawn each by itself
SPARE = 2  # times the wanted bytes are drawn, so that the order of the hash decides
FOLDS = 5
CHUNK_CHARS = 1 << 17  # scored at once
PAD = 2
DEVIATIONS, SLACK = 8.0, 0.5  # of the calibration texts; nats a character
UNSEEN = 0.5  # of a text's characters, beyond which it is in no learned script
CONFIDENCE_CHARS = 50.0  # characters that the score counts as independent, at most
_BASE = np.uint64(0x9E3779B97F4A7C15)
LETTER = r"\p{L}"  # what normalise asks for, to the engine
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str | None) -> str:
    """Lower-case letters, with one space for whatever lies between; empty without a letter.

    Numbers that are no digits, such as fractions, stay between letters but are none.
    """
    left = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return left if any(map(str.isalpha, left)) else ""


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, ORDER - 1 pads before each, and where each begins."""
    pad = chr(PAD) * (ORDER - 1)
    joined = "".join(pad + t for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1
    return codes, np.cumsum(length) - length


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points that end at each place; the first k - 1 places are not valid."""
    h = codes.copy()
    for i in range(1, k):
        h[i:] += codes[: len(codes) - i] * _power(i)
    return h ^ (h >> np.uint64(29))


def _power(i: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), i, 2**64))


def places(begin: np.ndarray, texts: list[str]) -> np.ndarray:
    """Places of the texts' own characters."""
    return np.concatenate([np.arange(b + ORDER - 1, b + ORDER - 1 + len(t)) for b, t in zip(begin, texts, strict=True)]) if texts else np.zeros(0, int)


def train(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: n-gram hashes and log-probabilities, context hashes and log back-off weights.

    For order 1 the only context is 0, with the weight of the uniform floor.
    """
    codes, begin = code_points(texts)
    at = places(begin, texts)
    grams = {k: gram_hashes(codes, k)[at] for k in range(1, ORDER + 1)}
    contexts = {k: (gram_hashes(codes, k - 1)[at - 1] if k > 1 else np.zeros(len(at), np.uint64)) for k in range(1, ORDER + 1)}
    lower, lower_keys = np.zeros(0), np.zeros(0, np.uint64)
    out = []
    for k in range(1, ORDER + 1):
        keys, first, counts = np.unique(grams[k], return_index=True, return_counts=True)
        if k < ORDER:  # in how many different characters it is seen behind
            _, at_one = np.unique(grams[k + 1], return_index=True)
            follow = np.searchsorted(keys, grams[k][at_one])
            counts = np.bincount(follow, minlength=len(keys))
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        discount = float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5
        ctx, back = np.unique(contexts[k][first], return_inverse=True)
        total = np.bincount(back, weights=counts)
        kinds = np.bincount(back)
        weight = discount * kinds / total
        if k == 1:
            base = np.full(len(keys), 1.0 / (len(keys) + 1))
        else:
            base = lower[np.searchsorted(lower_keys, grams[k - 1][first])]
        p = (counts - discount) / total[back] + weight[back] * base
        lower, lower_keys = p, keys
        out.append((keys, np.log(p), ctx, np.log(weight)))
    return out


class Models:
    """All languages in common sorted arrays; a score for each language is a column."""

    def __init__(self, trained: dict[str, list], limits: dict[str, tuple[float, float, float]]):
        self.languages = sorted(trained)
        self.limits = np.array([limits[x] for x in self.languages])
        self.grams, self.contexts = [], []
        size = len(self.languages)
        for k in range(ORDER):
            keys = np.unique(np.concatenate([trained[x][k][0] for x in self.languages]))
            ctx = np.unique(np.concatenate([trained[x][k][2] for x in self.languages]))
            weight = np.zeros((len(ctx), size), np.float32)
            for j, x in enumerate(self.languages):
                weight[np.searchsorted(ctx, trained[x][k][2]), j] = trained[x][k][3]
            self.grams.append([keys, np.full((len(keys), size), np.nan, np.float32)])
            self.contexts.append((ctx, weight))
            for j, x in enumerate(self.languages):
                self.grams[k][1][np.searchsorted(keys, trained[x][k][0]), j] = trained[x][k][1]
        self.floor = np.array([-np.log(len(trained[x][0][0]) + 1) for x in self.languages], np.float32)

    def complete(self, links: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Fill in what a language has not seen: its back-off. links: context and shorter n-gram of each key."""
        for k in range(ORDER):
            keys, table = self.grams[k]
            ctx, weight = self.contexts[k]
            context, shorter = links[k]
            at = np.minimum(np.searchsorted(ctx, context), len(ctx) - 1)
            back = np.where((ctx[at] == context)[:, None], weight[at], 0)
            below = self.floor[None] if k == 0 else self.grams[k - 1][1][np.searchsorted(self.grams[k - 1][0], shorter)]
            self.grams[k][1] = np.where(np.isnan(table), back + below, table).astype(np.float32)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy a character, in nats: a row a text, a column a language."""
        return self.measure(texts)[0]

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies, and the share of each text's characters that no language's sample has."""
        codes, begin = code_points(texts)
        at = places(begin, texts)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        score = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            h = gram_hashes(codes, k)[at[left]]
            keys, table = self.grams[k - 1]
            i = np.searchsorted(keys, h)
            i[i == len(keys)] = 0
            hit = keys[i] == h
            if k == ORDER and hit.all():
                score = table[i]
                left = left[:0]
                break
            score[left[hit]] += table[i[hit]]
            left = left[~hit]
            if not len(left):
                break
            ctx, weight = self.contexts[k - 1]
            c = gram_hashes(codes, k - 1)[at[left] - 1] if k > 1 else np.zeros(len(left), np.uint64)
            i = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            seen = ctx[i] == c
            score[left[seen]] += weight[i[seen]]
        score[left] += self.floor
        edge = np.cumsum(n) - n
        sums = np.add.reduceat(score, edge, axis=0, dtype=np.float64) if len(at) else np.zeros((len(texts), len(self.languages)))
        unseen = np.bincount(np.searchsorted(edge, left, "right") - 1, minlength=len(texts)) if len(left) else np.zeros(len(texts))
        return -sums / np.maximum(n, 1)[:, None], unseen / np.maximum(n, 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of normalised texts that are not empty."""
        h, unseen = self.measure(texts)
        n = np.fromiter(map(len, texts), float, len(texts))
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        near = np.exp(-np.minimum(n, CONFIDENCE_CHARS)[:, None] * (h - low[:, None]))
        mean, spread, each = self.limits[best].T
        rejected = (low > mean + SLACK + DEVIATIONS * (spread + each / np.sqrt(n))) | (unseen > UNSEEN)
        return [self.languages[i] for i in best], 1 / near.sum(1), rejected


def limits_of(entropies: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Mean and deviation of calibration texts, and what one character adds to the latter."""
    if not len(n):
        return 3.0, 1.0, 3.0
    mean = float((entropies * n).sum() / n.sum())
    return mean, float(np.sqrt((n * (entropies - mean) ** 2).sum() / n.sum())), float(np.sqrt(np.mean(n * (entropies - mean) ** 2)))


def fit(sample: pd.DataFrame) -> Models | None:
    """Models of a sample with lang, text and calibration."""
    trained, limits = {}, {}
    kept: dict[str, list[str]] = {}
    for lang, part in sample[~sample["calibration"]].groupby("lang"):
        texts = [t for t in map(normalise, part["text"]) if t]
        if texts:
            trained[lang], kept[lang] = train(texts), texts
    if not trained:
        return None
    parts = [([], [], []) for _ in range(ORDER)]
    for texts in kept.values():
        codes, begin = code_points(texts)
        at = places(begin, texts)
        for k in range(1, ORDER + 1):
            g, first = np.unique(gram_hashes(codes, k)[at], return_index=True)
            own = at[first]
            parts[k - 1][0].append(g)
            parts[k - 1][1].append(gram_hashes(codes, k - 1)[own - 1] if k > 1 else np.zeros(len(g), np.uint64))
            parts[k - 1][2].append(gram_hashes(codes, k - 1)[own] if k > 1 else np.zeros(len(g), np.uint64))
    links = []
    for g, c, s in parts:
        _, first = np.unique(np.concatenate(g), return_index=True)
        links.append((np.concatenate(c)[first], np.concatenate(s)[first]))
    models = Models(trained, {x: (0.0, 0.0, 0.0) for x in trained})
    models.complete(links)
    for j, lang in enumerate(models.languages):
        own = [t for t in map(normalise, sample[sample["calibration"] & (sample["lang"] == lang)]["text"]) if t]
        limits[lang] = limits_of(models.entropies(own)[:, j] if own else np.zeros(0), np.fromiter(map(len, own), float, len(own)))
    models.limits = np.array([limits[x] for x in models.languages])
    return models


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def pieces(docs: DataFrame) -> DataFrame:
    """lang, doc_id, text, u: labelled rows outside the held-out fold, long texts cut, each with a hash from 0 to 1.

    The hash covers the text too, so that texts of one doc_id are drawn each by itself.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    parts = F.when(F.octet_length("text") > PIECE_CHARS, cut).otherwise(F.array("text"))
    cuts = usable.select("lang", "doc_id", F.posexplode(parts).alias("k", "text")).filter(F.col("text").rlike(LETTER))
    name = F.concat_ws(":", F.lit("sample"), F.col("doc_id").cast("string"), F.col("k").cast("string"), F.xxhash64("text").cast("string"))
    u = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return cuts.select("lang", "doc_id", "text", u.alias("u"))


def draw(drawn: pd.DataFrame, sample_bytes: int, calibration_bytes: int) -> pd.DataFrame:
    """lang, text, calibration: of each language, in the order of the hash, training texts up to the limit, then calibration.

    A language always has a training text. Where there is not enough for both, they share
    what there is in proportion. Calibration takes no piece of a document learned from.
    """
    out = []
    for _, part in drawn.groupby("lang"):
        part = part.sort_values(["u", "text"])
        size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in part["text"]), np.int64, len(part))
        scale = min(1.0, size.sum() / (sample_bytes + calibration_bytes))
        train = np.cumsum(size) - size < sample_bytes * scale
        train[0] = True
        rest = ~train & ~part["doc_id"].isin(part["doc_id"][train]).to_numpy()
        more = np.where(rest, size, 0)
        rest &= np.cumsum(more) - more < calibration_bytes
        out.append(part.assign(calibration=rest)[train | rest])
    return pd.concat(out)[["lang", "text", "calibration"]].sort_values(["lang", "text"]) if out else pd.DataFrame({"lang": [], "text": [], "calibration": np.zeros(0, bool)})


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, calibration_bytes: int = CALIBRATION_BYTES) -> Models | None:
    """Models from labelled rows outside the held-out fold; a bounded sample of each language, of which each has a text."""
    cut = pieces(docs)
    size = cut.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.min("u").alias("least"))
    want = cut.join(F.broadcast(size), "lang")  # a row a language
    share = F.lit(float(SPARE * (sample_bytes + calibration_bytes))) / F.col("b")
    drawn = want.filter((F.col("u") < share) | (F.col("u") == F.col("least"))).select("lang", "doc_id", "text", "u")
    return fit(draw(drawn.dropDuplicates(["lang", "u"]).toPandas(), sample_bytes, calibration_bytes))


PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def predicting(shared):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for part in parts:
            texts = [normalise(t) for t in part["text"]]
            lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            own = [i for i, t in enumerate(texts) if t] if models else []
            at = 0
            while at < len(own):
                size, stop = 0, at
                while stop < len(own) and (stop == at or size + len(texts[own[stop]]) <= CHUNK_CHARS):
                    size += len(texts[own[stop]])
                    stop += 1
                ids = own[at:stop]
                names, s, r = models.predict([texts[i] for i in ids])
                score[ids], rejected[ids] = s, r
                for i, x in zip(ids, names, strict=True):
                    lang[i] = x
                at = stop
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": lang, "score": score, "rejected": rejected})

    return run


def predict(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(tidy(predicting(shared)), PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs."""
    prepare(docs.sparkSession)
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the documents whose language is rejected; all columns stay.

    Null, empty and letterless texts are rejected, and all texts where nothing could be learned
    from; a very long text is scored whole; a tie goes to the first language; repeated rows and an
    empty table stay as they are; clashing column names are not touched.
    """
    prepare(docs.sparkSession)
    models = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.pandas_udf("boolean")
    def rejected(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step = predicting(models)
        try:
            yield from known(step, parts)
        finally:
            give_back()

    def known(step, parts):
        for part in parts:
            frame = pd.DataFrame({"doc_id": np.arange(len(part)), "text": part.to_numpy()})
            yield pd.concat(list(step(iter([frame]))) or [pd.DataFrame({"rejected": []})])["rejected"].astype(bool).reset_index(drop=True)

    return docs.filter(~rejected("text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
