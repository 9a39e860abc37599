"""Problem 3: missing or wrong language labels of messages that may mix languages.

Per language and script an interpolated Kneser-Ney model of characters is trained on a bounded sample of
labelled sentences. All models share one sorted hash array per order: a gram's row holds its discounted
probability in each language, a context's row its back-off weights. A sentence takes the language of the
lowest cross-entropy per character among those of its script; its confidence is a softmax whose scale is
calibrated on held-out sentences, and it is rejected (``accepted`` false) where even the best
cross-entropy is above what held-out sentences of that language have.

Names, numbers and borrowed words: digits and marks are dropped, and in a sentence with letters of an Indian
script only those count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LANGUAGES = ("en", "hi", "mr", "ta", "te", "kn", "ml")
#: Model classes: language and script.
CLASSES = ("en-Latn", "hi-Latn", "hi-Deva", "mr-Deva", "ta-Taml", "te-Telu", "kn-Knda", "ml-Mlym")
LANGUAGE_OF = np.array([LANGUAGES.index(c[:2]) for c in CLASSES])
INDIC = re.compile("[ऀ-ൿ‌‍]+")
LATIN = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"\n|\||[.?।]+(?=\s|$)")
MULT = np.uint64(0x9E3779B97F4A7C15)


def sentences(message: str) -> list[tuple[int, int]]:
    """Places of the sentences: each ends at a line break, a bar, or a mark before a space or the end."""
    out, at = [], 0
    for m in SENTENCE.finditer(message):
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(message)))
    return [(a, b) for a, b in out if LATIN.search(message, a, b) or INDIC.search(message, a, b)]


def letters(sentence: str) -> tuple[str, bool]:
    """The letters that tell the language, words parted by spaces, and whether they are of an Indian script."""
    found = INDIC.findall(sentence)
    if found:
        return " " + " ".join(found).replace("‌", "").replace("‍", "") + " ", True
    return " " + " ".join(LATIN.findall(sentence.lower())) + " ", False


def _flat(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, ``pad`` zeros before each; starts of the texts' own characters."""
    parts = [np.frombuffer(("\0" * pad + t).encode("utf-32-le"), np.uint32) for t in texts]
    size = np.array([len(p) for p in parts])
    return np.concatenate(parts).astype(np.uint64) if parts else np.empty(0, np.uint64), np.cumsum(size) - size + pad


def gram_hashes(flat: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order: hash of the k characters that end at each place."""
    h = [np.zeros(len(flat), np.uint64)]
    back = np.zeros(len(flat), np.uint64)
    weight = np.uint64(1)
    for k in range(order):
        c = np.zeros(len(flat), np.uint64)
        c[k:] = flat[: len(flat) - k] + np.uint64(1)
        x = c * MULT
        x ^= x >> np.uint64(27)
        with np.errstate(over="ignore"):
            back = back + x * weight
            weight = weight * np.uint64(0xD6E8FEB86659FD93)
        h.append(back)
    return h


def _before(h: np.ndarray) -> np.ndarray:
    out = np.zeros_like(h)
    out[1:] = h[:-1]
    return out


@dataclass
class Model:
    order: int
    grams: list[np.ndarray]
    probability: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    scale: float = 1.0
    limit: np.ndarray | None = None

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Mean negative log probability per character, a row per text and a column per class."""
        if not texts:
            return np.empty((0, len(CLASSES)))
        flat, starts = _flat(texts, self.order - 1)
        h = gram_hashes(flat, self.order)
        size = np.array([len(t) for t in texts], np.int64)
        own = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        p = np.full((len(own), len(CLASSES)), self.floor, np.float32)
        for k in range(1, self.order + 1):
            context, gram = _before(h[k - 1])[own] if k > 1 else np.zeros(len(own), np.uint64), h[k][own]
            p *= _rows(self.contexts[k - 1], self.backoff[k - 1], context, 1.0)
            p += _rows(self.grams[k - 1], self.probability[k - 1], gram, 0.0)
        return np.add.reduceat(-np.log(p.astype(np.float64)), np.cumsum(size) - size, axis=0) / size[:, None]

    def classify(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, confidence, whether accepted, and cross-entropy of each sentence."""
        if not raw:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty((0, len(CLASSES)))
        found = [letters(s) for s in raw]
        h = self.cross_entropy([t for t, _ in found])
        indic = np.array([i for _, i in found], bool)
        latin = np.array([c.endswith("Latn") for c in CLASSES])
        h = np.where(indic[:, None] == latin[None, :], np.inf, h)
        best, least = h.argmin(1), h.min(1)
        n = np.array([len(t) for t, _ in found])
        z = np.exp(-self.scale * np.sqrt(n)[:, None] * (h - least[:, None]))
        sure = 1 / np.stack([z[:, LANGUAGE_OF == v].max(1) for v in range(len(LANGUAGES))], 1).sum(1)
        ok = least <= self.limit[best] if self.limit is not None else np.ones(len(best), bool)
        return best, sure, ok, h


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at]
    out[keys[at] != wanted] = missing
    return out


def _counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


def train(samples: list[tuple[str, int]], order: int = 5, discount: float = 0.75) -> Model:
    """Interpolated Kneser-Ney models of prepared texts (letters, class)."""
    tables: list[list] = [[] for _ in range(order)]
    symbols = len({c for t, _ in samples for c in t}) + 1
    for c in range(len(CLASSES)):
        texts = [t for t, k in samples if k == c]
        flat, starts = _flat(texts, order - 1)
        size = np.array([len(t) for t in texts], np.int64)
        own = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) if len(texts) else np.empty(0, np.int64)
        h = gram_hashes(flat, order)
        for k in range(1, order + 1):
            gram = h[k][own]
            context = _before(h[k - 1])[own] if k > 1 else np.zeros(len(own), np.uint64)
            if k == order:
                g, first, n = np.unique(gram, return_index=True, return_counts=True)
            else:  # continuation count: in how many longer grams it ends
                _, at = np.unique(h[k + 1][own], return_index=True)
                g, f, n = np.unique(gram[at], return_index=True, return_counts=True)
                first = at[f]
            ctx = context[first] if len(g) else np.empty(0, np.uint64)
            cu, inverse = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(inverse, n, minlength=len(cu)), np.bincount(inverse, minlength=len(cu))
            prob = np.maximum(n - discount, 0) / total[inverse] if len(g) else np.empty(0)
            tables[k - 1].append((g, prob, cu, discount * kinds / total if len(cu) else np.empty(0)))
    grams, probability, contexts, backoff = [], [], [], []
    for per in tables:
        for keys, values, at, missing in ((grams, probability, 0, 0.0), (contexts, backoff, 2, 1.0)):
            all_keys = np.unique(np.concatenate([t[at] for t in per]))
            if not len(all_keys):
                all_keys = np.zeros(1, np.uint64)
            m = np.full((len(all_keys), len(CLASSES)), missing, np.float32)
            for c, t in enumerate(per):
                m[np.searchsorted(all_keys, t[at]), c] = t[at + 1]
            keys.append(all_keys), values.append(m)
    return Model(order, grams, probability, contexts, backoff, 1.0 / symbols)


def like_english(english: list[str], others: list[str], order: int, margin: float = 0.5) -> np.ndarray:
    """Whether each prepared text has a cross-entropy that held-out English has, too."""
    model = train([(t, 0) for i, t in enumerate(english) if i % 5 or len(english) == 1], order)
    limit = np.quantile(model.cross_entropy(english[::5])[:, 0], 0.995) + margin
    return model.cross_entropy(others)[:, 0] <= limit


def fit(labelled: list[tuple[str, str]], rounds: int = 2, order: int = 5, english: list[str] = ()) -> Model:
    """Model of (sentence, language) rows, some of them labelled wrongly.

    Two languages in one script are the hard case, since a message labelled Hindi in Latin letters is often English:
    with sentences known to be ``english``, those in Latin letters are kept only where their label agrees with whether
    they are like English. Sentences that the model, trained on the rest, puts to another language are dropped before
    the last training. A fifth is held out for the scale and the limits.
    """
    rows = []
    sure = sorted({letters(s)[0] for s in english if not letters(s)[1]})
    if sure:
        latin = [(s, lang) for s, lang in labelled if not letters(s)[1]]
        same = like_english([sure[i] for i in np.random.default_rng(2).permutation(len(sure))], [letters(s)[0] for s, _ in latin], order)
        labelled = [x for x in labelled if letters(x[0])[1]] + [x for x, e in zip(latin, same) if e == (x[1] == "en")] + [(s, "en") for s in english]
    for s, lang in labelled:
        t, indic = letters(s)
        c = next((i for i, name in enumerate(CLASSES) if name.startswith(lang) and name.endswith("Latn") != indic), None)
        if c is not None and len(t) > 12 and _script_fits(t, c):
            rows.append((t, c, s))
    rows = sorted(set(rows))
    rows = [rows[i] for i in np.random.default_rng(3).permutation(len(rows))]
    held, rest = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    model = train([(t, c) for t, c, _ in rest], order)
    for _ in range(rounds):
        halves = [rest[::2], rest[1::2]]
        kept = []
        for a, b in (halves, halves[::-1]):
            m = train([(t, c) for t, c, _ in a], order)
            best = m.classify([s for *_, s in b])[0] if b else []
            kept += [r for r, k in zip(b, best) if k == r[1]]
        rest = kept or rest
        model = train([(t, c) for t, c, _ in rest], order)
    if held:
        best, _, _, h = model.classify([s for *_, s in held])
        truth = np.array([c for _, c, _ in held])
        right = best == truth
        n = np.sqrt([len(t) for t, *_ in held])
        def loss(scale: float) -> float:
            z = -scale * n[:, None] * (h - h.min(1, keepdims=True))
            return float(np.mean(np.log(np.exp(z).sum(1)) - np.maximum(z[np.arange(len(z)), truth], -50)))
        model.scale = min((0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
        own = h.min(1)
        model.limit = np.array([np.quantile(own[right & (truth == c)], 0.995) + 0.5 if (right & (truth == c)).any() else np.inf for c in range(len(CLASSES))])
    return model


def _script_fits(text: str, c: int) -> bool:
    block = {"Deva": (0x900, 0x97F), "Taml": (0xB80, 0xBFF), "Telu": (0xC00, 0xC7F), "Knda": (0xC80, 0xCFF), "Mlym": (0xD00, 0xD7F)}.get(CLASSES[c][3:])
    own = sum(block[0] <= ord(x) <= block[1] for x in text) if block else 1
    return own * 2 > sum(x != " " for x in text) if block else True


def label(c: str) -> F.Column:
    """A stored label in lower case without region; null where blank."""
    x = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(c), r"[\s ]+", " "))), r"[-_].*$", "")
    return F.when(x != "", x)


def labelled_sentences(chats: DataFrame, pairs: DataFrame, bound: int = 1500) -> tuple[list[tuple[str, str]], list[str]]:
    """Training sentences with their label, and sentences that are English for sure: at most ``bound`` rows of each
    language, script and source, in order of a hash.

    From messages, those of one language by their label where no hint led the label astray; from pairs, the answers
    in Indian scripts by the pair's language. Wrong ones among them are weeded out by ``fit``. Prompts are English.
    """
    lang = label("detected_lang")
    # Hindi in Latin letters counts as a class of its own when the bound is applied
    latin = ~F.col("text").rlike("[\\u0900-\\u0D7F]")
    chat = chats.where((F.coalesce(F.col("lang"), F.lit("auto")) == "auto") & ~F.coalesce(F.col("is_mixed"), F.lit(False))).select(F.col("message").alias("text"), lang.alias("language"))
    answers = pairs.select(F.col("tgt").alias("text"), F.col("lang").alias("language"))
    prompts = pairs.select(F.col("src").alias("text"), F.lit("en").alias("language"))
    parts = chat.withColumn("part", F.lit("chat")).unionByName(answers.withColumn("part", F.lit("answer"))).unionByName(prompts.withColumn("part", F.lit("prompt")))
    parts = parts.where(F.col("text").isNotNull() & F.col("language").isin(*LANGUAGES)).withColumn("latin", latin)
    wanted = F.when(F.col("part") == "answer", ~F.col("latin") & (F.col("language") != "en")).when(F.col("part") == "prompt", F.col("latin")).otherwise(F.when(F.col("latin"), F.col("language").isin("en", "hi")).otherwise(F.col("language") != "en"))
    kind = ["part", "language", "latin"]
    # copies have one hash: the dense rank counts texts, and is cut in each partition before the shuffle
    rank = F.dense_rank().over(Window.partitionBy(*kind).orderBy(F.xxhash64("text"), "text"))
    rows = parts.where(wanted).withColumn("at", rank).where(F.col("at") <= bound).select(*kind, "text").distinct().collect()  # at most 14 kinds of ``bound``
    found = [(r["text"][x:y], r["language"], r["part"]) for r in sorted(rows) for x, y in sentences(r["text"])]
    return [(s, lang) for s, lang, part in found if part != "prompt"], [s for s, _, part in found if part == "prompt"]


SEGMENTS = "request_id long, seg_no int, lang string, confidence double, accepted boolean, start int, stop int, n_segments int, stored string"


def segments(messages: DataFrame, model: Model, id: str = "request_id", text: str = "message", stored: str | None = None) -> DataFrame:
    """Per message a row with seg_no 0 and its language (``mixed`` if several), and rows 1.. for its segments.

    A segment is a longest run of sentences in one language. A sentence that isn't accepted takes the language of
    the sentence before it, or after it. ``n_segments`` is the message's number of them, ``stored`` its label in the
    column of that name, so what is wrong can be told row by row. Null texts and texts without letters give no row; rows
    with a repeated id give each their rows; other columns are ignored.
    """
    shared = messages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                yield _segment(shared.value, *(c.to_pylist() for c in batch.columns))

    own = label(stored) if stored else F.lit(None).cast("string")
    return messages.where(F.col(text).isNotNull()).select(F.col(id).cast("long"), text, own.alias("stored")).mapInArrow(run, SEGMENTS)


def _segment(model: Model, ids: list, texts: list[str], stored: list) -> pa.RecordBatch:
    places = [sentences(t) for t in texts]
    raw = [t[a:b] for t, p in zip(texts, places) for a, b in p]
    best, sure, ok, _ = model.classify(raw)
    rows, at = [], 0
    for i, mark, p in zip(ids, stored, places):
        n = len(p)
        if not n:
            continue
        lang = LANGUAGE_OF[best[at : at + n]].copy()
        good = np.flatnonzero(ok[at : at + n])
        for j in range(n):
            if len(good) and not ok[at + j]:
                k = np.searchsorted(good, j)
                lang[j] = lang[good[k - 1] if k else good[0]]
        cut = [0, *[j for j in range(1, n) if lang[j] != lang[j - 1]], n]
        kinds = set(lang.tolist())
        conf, acc = sure[at : at + n], ok[at : at + n]
        rows.append((i, 0, "mixed" if len(kinds) > 1 else LANGUAGES[lang[0]], float(conf.min()), bool(acc.all()), p[0][0], p[-1][1], len(cut) - 1, mark))
        for s, (a, b) in enumerate(zip(cut, cut[1:]), 1):
            rows.append((i, s, LANGUAGES[lang[a]], float(conf[a:b].mean()), bool(acc[a:b].all()), p[a][0], p[b - 1][1], len(cut) - 1, mark))
        at += n
    types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), *[pa.int32()] * 3, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=[f.split()[0] for f in SEGMENTS.split(", ")])


def corrected_labels(chats: DataFrame, pairs: DataFrame, bound: int = 1500) -> DataFrame:
    """(request_id, seg_no, lang): the right label where the stored one is missing or wrong, and the segments of mixed messages.

    Every message is classified once and nothing of it is shuffled; a repeated request_id is judged row by row.
    """
    labelled, english = labelled_sentences(chats, pairs, bound)
    model = fit(labelled, english=english)
    found = segments(chats, model, stored="detected_lang")
    wrong = (F.col("seg_no") == 0) & ~F.col("lang").eqNullSafe(F.col("stored"))
    return found.where(wrong | ((F.col("seg_no") > 0) & (F.col("n_segments") > 1))).select("request_id", "seg_no", "lang")
