"""Problem 4: broken prompt and response pairs.

Defects in order, the first that fits: ``empty``, ``refusal``, ``copied``, ``wrong_language``, ``truncated``.

* refusal: an Aho-Corasick automaton of stock phrases in all languages runs over the response. A hit that is part of
  the prompt doesn't count, and one within the response only where nothing of the prompt (a name or a number) is said.
* copied: a suffix automaton of the folded prompt is traversed by the folded response; the share of the
  response, and of the prompt, that lies in long copied runs is measured.
* wrong language: letters vote by script; where languages share a script, their stopwords vote.
* truncated: the probability that a response breaks off, by how likely its last words end a sentence, its last mark, its
  length and sentences against the prompt's, the prompt's numbers and names it lacks, and a delimiter stack. How
  sentences end is counted over all responses, with partial aggregation, and smoothed: what was never seen at an end is
  judged by its last word, or by nothing. The weights are fitted on all responses as they are and the same ones cut off, in passes
  over their written features; how many of all break off is estimated from themselves, which sets the cut.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import Cuts

#: What stands for no answer, without marks and case (fixed values).
PLACEHOLDERS = frozenset("tbd na none null nil empty todo tgt blank pending missing unknown nan undefined".split())
#: Stock phrases of declining and apologising (fixed values).
REFUSALS = (
    "i'm sorry", "i am sorry", "sorry,", "so sorry", "apologies", "i apologise", "i apologize", "must decline", "have to decline", "unable to help", "unable to assist", "unable to translate", "unable to provide", "unable to comply",
    "not able to complete", "not able to help", "not able to translate", "not able to assist", "can't translate", "cannot translate", "can't help with", "cannot help with", "can't assist", "cannot assist", "cannot provide a translation", "can't provide a translation",
    "translation not possible", "translation is not possible", "do not have enough information", "don't have enough information", "guidelines prevent", "cannot be processed", "as an assistant", "as an ai", "as a language model", "consult a qualified translator", "cannot fulfil", "can't fulfil",
    "क्षमा करें", "क्षमा कीजिए", "माफ़ कीजिए", "माफ कीजिए", "माफ़ करें", "माफ करें", "अनुवाद नहीं कर सकत", "करने में असमर्थ हूँ", "खेद है", "माफ करा", "क्षमस्व", "भाषांतर करू शकत नाही", "मदत करू शकत नाही",
    "மன்னிக்கவும்", "என்னால் உதவ", "என்னால் மொழிபெயர்க்க", "క్షమించండి", "అనువదించలేను", "సహాయం చేయలేను", "ಕ್ಷಮಿಸಿ", "ಅನುವಾದಿಸಲಾರೆ", "ನಾನು ಸಹಾಯ ಮಾಡಲು", "ക്ഷമിക്കണം", "എനിക്ക് സഹായിക്കാനാവില്ല", "എനിക്ക് വിവർത്തനം",
)
SCRIPTS = {"ta": (0xB80, 0xBFF), "te": (0xC00, 0xC7F), "kn": (0xC80, 0xCFF), "ml": (0xD00, 0xD7F), "hi": (0x900, 0x97F), "mr": (0x900, 0x97F), "en": (0x41, 0x7A)}
#: Frequent small words of the languages that share a script (fixed values).
STOPWORDS = {
    "hi": frozenset("है हैं था थे की के का को में से पर ने और यह इस कि क्या कौन अब लिए एक करेगी करेगा गए गया दिए दिया हो रहा रही सकती सकता तो भी नहीं कितना क्यों किया की मुझे साल अगले".split()),
    "mr": frozenset("आहे आहेत होते होता च्या चे ची चा ला ना ने वर मध्ये आणि या की काय कोण आता साठी एक करणार गेले गेला दिली दिला झाले झाला शकते शकत तर ही हे नाही किती का केले केला मला वर्षी पुढील सांगा".split()),
}
OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}
OPENS = re.compile("[" + re.escape("".join(OPEN)) + "]")
WORD = re.compile(r"[^\W_]+(?:[̀-ͯऀ-ॿঀ-෿‌‍]+[^\W_]*)*|[ऀ-෿‌‍]+")
OTHER_DIGIT = re.compile(r"[^\D0-9]")
#: Runs of one script's letters, and the languages of each by the number of its block of 128.
RUNS = re.compile("|".join(f"[{chr(a)}-{chr(b)}]+" for a, b in sorted({*SCRIPTS.values()} - {SCRIPTS["en"]})))
BLOCKS: dict[int, list[str]] = {}
for _lang, (_first, _) in SCRIPTS.items():
    if _lang != "en":
        BLOCKS.setdefault(_first >> 7, []).append(_lang)
LATIN, CAPITAL, TAGS = re.compile("[A-Za-z]+"), re.compile(r"[A-Z](?<!\w\w)[a-z]+"), re.compile(r"(?:</?\w+>|\[\w+\]|\s)+")
NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")
POINT = re.compile(r"\.(?<=\d\.)(?=\d)")
END = re.compile(r"[.?!।|]+(?=\s|$|[\"”'’)])|\n")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in REFUSALS:
        a.add_word(unicodedata.normalize("NFC", p), p)
    a.make_automaton()
    return a


class SuffixAutomaton:
    """Least automaton of all substrings of a text."""

    def __init__(self, text: str):
        self.next, self.link, self.size = [{}], [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({}), self.link.append(0), self.size.append(self.size[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.size[q] == self.size[p] + 1:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.size.append(self.size[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def copied(self, text: str, least: int) -> int:
        """How many characters of ``text`` lie in runs of at least ``least`` that the automaton's text has, too."""
        state = n = total = covered = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                state = n = 0
            if n >= least:
                total += i + 1 - max(covered, i + 1 - n)
                covered = i + 1
        return total


def plain_digits(text: str) -> str:
    """Digits of all scripts as 0 to 9."""
    return text if text.isascii() else OTHER_DIGIT.sub(lambda m: str(unicodedata.digit(m.group())), text)


def fold(text: str, nfc: bool = False) -> str:
    return "".join(filter(str.isalnum, (text if nfc else unicodedata.normalize("NFC", text)).lower()))


@lru_cache(64)
def only(words: frozenset[str], others: frozenset[frozenset[str]]) -> frozenset[str]:
    """Those that are in no other set."""
    return words.difference(*others)


def names_in(text: str) -> frozenset[str]:
    """Capitalised words, but for those that begin the text or a sentence."""
    return frozenset(m.group().lower() for m in CAPITAL.finditer(text) if m.start() and text[max(0, m.start() - 2) : m.start()] not in (". ", "? ", "! "))


def word_shapes(text: str) -> list[str]:
    """Words; Latin ones as X and numbers as 0, since names and numbers vary."""
    out = []
    for w in WORD.findall(NUMBER.sub("0", unicodedata.normalize("NFC", text))):
        shape = "0" if w.isdigit() else "X" if w[0].isascii() else w
        if not (shape == "X" and out and out[-1] == "X"):
            out.append(shape)
    return out


def cut_sentences(text: str) -> list[str]:
    """The sentences of a text that hold a letter or digit."""
    out, at = [], 0
    text = POINT.sub("", text) if "." in text else text
    for m in END.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
    out.append(text[at:])
    return [s for s in out if WORD.search(s)]


def pieces(text: str) -> list[list[str]]:
    """Word shapes of each sentence."""
    return [p for s in cut_sentences(text) if (p := word_shapes(s))]


def ending(words: list[str]) -> str:
    return " ".join((["^"] + words)[-2:])


def language_of(text: str, wanted: str, stopwords: dict[str, frozenset[str]] = STOPWORDS, names: frozenset[str] = frozenset()) -> str | None:
    """The language the letters of ``text`` vote for, without those of ``names``; None without letters."""
    indic: dict[str, int] = {}
    for run in () if text.isascii() else RUNS.findall(text):
        for k in BLOCKS[ord(run[0]) >> 7]:
            indic[k] = indic.get(k, 0) + len(run)
    latin = LATIN.findall(text)
    if not indic:
        return "en" if latin else None
    english = sum(len(w) for w in latin if w.lower() not in names)
    top = max(indic.values())
    # names in Latin letters are normal: Latin wins only where it outweighs by far
    if english > 4 * top:
        return "en"
    best = [k for k in SCRIPTS if indic.get(k) == top]
    if len(best) > 1:
        words = WORD.findall(unicodedata.normalize("NFC", text))
        marks = {k: sum(map(only(stopwords[k], frozenset(stopwords[o] for o in best if o != k)).__contains__, words)) for k in best}
        first = max(marks.values())
        best = [k for k in best if marks[k] == first]
        return wanted if wanted in best else best[0]
    return best[0]


def last_shapes(sentence: str) -> list[str]:
    """The last shapes of a sentence, two at least if it has as many: numbers and words hold no blank, and shapes look back no further."""
    at = sentence.find(" ", len(sentence) - 40) if len(sentence) > 60 else -1
    words = word_shapes(sentence[at:]) if at > 0 else []
    return words if len(words) > 1 else word_shapes(sentence)


ENDINGS = "lang string, ending string, at_end long, total long, sentences long"


def ending_counts(pairs: DataFrame) -> DataFrame:
    """Per language and pair of words: how often it ends a sentence and occurs at all; sentences under the ending ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, total, n = Counter(), {}, Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for words in pieces(text):
                    n[lang] += 1
                    ends[lang, ending(words)] += 1
                    ends[lang, words[-1]] += 1
                    own = total.setdefault(lang, Counter())
                    own.update(map(" ".join, zip(["^", *words], words)))
                    own.update(words)
            rows = [(a, b, ends[a, b], t, 0) for a, own in total.items() for b, t in own.items()] + [(a, "", 0, 0, c) for a, c in n.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])], names=[f.split()[0] for f in ENDINGS.split(", ")])

    texts = pairs.where("lang is not null and tgt is not null").select(F.lower(F.trim("lang")).alias("lang"), "tgt")
    return texts.mapInArrow(run, ENDINGS).groupBy("lang", "ending").agg(*[F.sum(c).alias(c) for c in ("at_end", "total", "sentences")])


#: What is known of a sentence's end, beyond how likely its words are to be there (in order of ``Endings.weights``).
FEATURES = ("ending", "known", "mark", "length", "sentences", "numbers", "names", "unclosed")


#: The features of a pair as they are written: its language's number, whether the fit takes it, the response, the mark of
#: the response without its last mark, and two of its cuts (NaN where it is too short for one). A column for each pair.
WIDTH = 3 + 3 * len(FEATURES)
MARK, RATIO = FEATURES.index("mark"), FEATURES.index("length")


@dataclass(frozen=True)
class Asked:
    """What a prompt asks for: found once for all responses that are compared with it."""

    size: int
    numbers: Counter
    names: frozenset[str]
    sentences: int
    unclosed: bool

    @staticmethod
    def of(src: str, size: int) -> Asked | None:
        """``size``: the prompt's folded length."""
        if not src.strip():
            return None
        return Asked(size, Counter(numbers(plain_digits(src))), names_in(src.strip()), len(cut_sentences(src)), unclosed(src))


NOTHING = Asked(0, Counter(), frozenset(), 0, False)


def numbers(text: str) -> list[str]:
    return [n.replace(",", "").rstrip(".") for n in NUMBER.findall(text)]


def marked(text: str) -> bool:
    """Whether a final mark ends the text."""
    close = text.rstrip().rstrip("\"”'’)")
    return close[-1:] in ".?!।|" and not close.endswith("..")


def unmarked(text: str) -> str:
    return text.rstrip().rstrip(".?!।|")


@dataclass
class Endings:
    """How sentences of each language end, and what tells a response that breaks off."""

    counts: dict[tuple[str, str], tuple[int, int]]
    rate: dict[str, float]
    model: Model | None = None

    def features(self, asked: Asked | None, tgt: str, lang: str, size: int | None = None) -> list[float]:
        """In order of ``FEATURES``, the length as it is (NaN without a prompt); ``tgt`` in NFC with plain digits, ``size`` its folded length, where it is known."""
        base, known, low = self.rate.get(lang, 0.1), asked or NOTHING, tgt.lower()
        last = cut_sentences(tgt)
        words = last_shapes(last[-1]) if last else []
        e1, n1 = self.counts.get((lang, words[-1] if words else ""), (0, 0))
        e2, n2 = self.counts.get((lang, ending(words)), (0, 0))
        one = (e1 + 2 * base) / (n1 + 2)
        p = min(max((e2 + 2 * one) / (n2 + 2), 1e-4), 1 - 1e-4)
        there = numbers(tgt) if known.numbers else []
        lacks = sum(max(0, n - there.count(k)) for k, n in known.numbers.items())
        gone = sum(w not in low for w in known.names)
        ratio = math.log((1 + (sum(map(str.isalnum, low)) if size is None else size)) / (1 + known.size)) if asked else math.nan
        fewer = max(0, known.sentences - len(last))
        return [math.log(p / (1 - p)), float(n1 > 0), float(marked(tgt)), ratio, min(fewer, 3), min(lacks, 3), gone / len(known.names) if known.names else 0.0, float(unclosed(tgt) and not known.unclosed)]

    def column(self, src: str, tgt: str, lang: str, sizes: tuple[int, int], number: int, fits: bool) -> list[float]:
        """The pair's features as they are written; ``sizes``: folded lengths of both texts, in NFC."""
        asked, tgt = Asked.of(src, sizes[0]), plain_digits(tgt)
        out = [number, fits, *self.features(asked, tgt, lang, sizes[1]), marked(unmarked(tgt))]
        places = blake2b(f"{tgt}\n{src}".encode("utf-8", "replace"), digest_size=16).digest() if fits else b""
        for k in (0, 8):
            short = broken_off(tgt, int.from_bytes(places[k : k + 8])) if fits else ""
            out += self.features(asked, short, lang) if short else [math.nan] * len(FEATURES)
        return out

    def breaks_off(self, src: str, tgt: str, lang: str, sizes: tuple[int, int]) -> bool:
        if self.model is None:
            return False
        x = self.column(src, tgt, lang, sizes, self.model.langs.get(lang, len(self.model.langs)), False)
        return bool(self.model.broken(np.array([x], "<f4").T)[0])


@dataclass
class Model:
    """What tells a response that breaks off, by its written features: all sums are over all pairs."""

    langs: dict[str, int]
    length: np.ndarray  # the usual log ratio of lengths, by the number of a language; 0 for others
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    cut: float = 0.0

    def parts(self, x: np.ndarray, only_fit: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the responses, of those without a final mark, and of their cuts; scaled as soon as the scale is known."""
        if only_fit:
            x = x[:, x[1] > 0]
        x, n = x.astype(float), len(FEATURES)
        usual = self.length[x[0].astype(int)]
        own, *cuts = (x[k : k + n] for k in (2, 3 + n, 3 + 2 * n))
        for v in (own, *cuts):
            v[RATIO] = np.nan_to_num(np.clip(v[RATIO] - usual, -2.0, 1.0))
        # a missing final mark alone is no defect
        bare = own.copy()
        bare[MARK] = x[2 + n]
        cut = np.concatenate([v[:, ~np.isnan(v[0])] for v in cuts], 1)
        if self.centre is None:
            return own, bare, cut
        return tuple(np.concatenate([np.ones((1, v.shape[1])), (v - self.centre[:, None]) / self.spread[:, None]]) for v in (own, bare, cut))

    def broken(self, x: np.ndarray) -> np.ndarray:
        return self.weights @ self.parts(x, False)[0] > self.cut

    def moments(self, x: np.ndarray) -> np.ndarray:
        parts = self.parts(x)
        every = np.concatenate(parts, 1)
        return np.concatenate([[parts[0].shape[1], every.shape[1]], every.sum(1), (every**2).sum(1)])

    def slopes(self, x: np.ndarray, w: np.ndarray, last: np.ndarray | None) -> np.ndarray:
        """Loss, gradient and curvature of the logistic regression at ``w``; what broke off by ``last`` is left out."""
        own, bare, cut = self.parts(x)
        if last is not None:
            sound = last @ own < 0
            own, bare = own[:, sound], bare[:, sound]
        z, no = np.concatenate([own, bare, cut], 1), 2 * own.shape[1]
        odds = w @ z
        e = np.exp(-np.abs(odds))
        p = np.where(odds < 0, e, 1.0) / (1 + e)
        loss = np.log1p(e).sum() + np.maximum(odds, 0).sum() - odds[no:].sum()
        curve = (z * (p * (1 - p))) @ z.T
        p[no:] -= 1
        return np.concatenate([[loss], z @ p, curve.ravel()])

    def sizes(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        own, _, cut = self.parts(x)
        return np.array([cut.shape[1], (w @ own < 0).sum()], float)

    def expected(self, x: np.ndarray, w: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """How many of the responses are expected to break off, for each shift of their log odds."""
        e = np.exp(-(w @ self.parts(x)[0]).clip(-300, 300))
        return np.array([(1 / (1 + e * math.exp(-v))).sum() for v in shifts])

    def fit(self, total: Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray | None]) -> bool:
        """A penalised logistic regression of all responses, as they are and cut off; False where there are none.

        ``total`` sums what a function makes of the written features over all of them.
        """
        sums = total(self.moments)
        if sums is None or not sums[0]:
            return False
        (n, every), (first, second) = sums[:2], sums[2:].reshape(2, -1) / sums[1]
        self.centre, self.spread = first, np.maximum(np.sqrt(np.maximum(second - first**2, 0)), 0.05)
        w, last = np.zeros(len(FEATURES) + 1), None
        for _ in range(3):  # what breaks off in the corpus itself is left out of the next fit
            w = last = logistic(lambda v, last=last: total(lambda x: self.slopes(x, v, last)), w)
        # the corpus' own share of broken responses moves the cut
        cuts, sound = total(lambda x: self.sizes(x, w))
        base = math.log(max(cuts, 1) / max(1, 2 * sound))
        # the share that the responses' own probabilities add up to (and 1 of 20 more): there is one, and below it they add up to more
        low, high = -math.log(n + 20), math.log(n + 20)
        while high - low > 1e-6:
            odds = np.linspace(low, high, 34)
            more = (total(lambda x: self.expected(x, w, odds[1:-1] - base)) + 1) / (n + 20) > sigmoid(odds[1:-1])
            k = int(more.sum())
            low, high = odds[k], odds[k + 1]
        self.weights, self.cut = w, base - (low + high) / 2
        return True


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(slopes: Callable[[np.ndarray], np.ndarray], w: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Weights (the first a constant) of a penalised logistic regression, by Newton's method from ``w``."""
    n = len(w)
    ridge, least, step = np.diag([1e-6] + [penalty] * (n - 1)), math.inf, np.zeros(n)
    for _ in range(50):
        sums = slopes(w)
        loss = sums[0] + w @ ridge @ w / 2
        if loss > least + 1e-9 * abs(least):  # too far
            step = step / 2
            w = w + step
        else:
            least = loss
            step = np.linalg.solve(sums[1 + n :].reshape(n, n) + ridge, sums[1 : 1 + n] + ridge @ w)
            w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


#: What a response that breaks off may end in.
TAILS = ("", "", "", "...", "…", ",", " -")


def broken_off(text: str, place: int) -> str:
    """The text up to some place within it, as it is or with a mark that ends nothing; both follow from the number ``place``."""
    n = len(text.strip().rstrip(".?!।| "))
    if n < 8:
        return ""
    least = max(1, n // 8)
    at, tail = divmod(place, len(TAILS))
    return unmarked(text.strip()[: least + at % (n - 1 - least)]) + TAILS[tail]


def corpus_words(pairs: DataFrame, share: float = 0.0005, least: int = 3) -> tuple[Endings, dict[str, frozenset[str]]]:
    """How sentences end in this corpus, and stopwords of the languages that share a script.

    What is collected needs a share of ``share`` of its language's sentences, so a language has at most as many rows as
    its sentences have words on average, times 1 / share. A word that is four times as frequent in one of the languages
    that share a script votes for it, beside the listed ones.
    """
    cuts = Cuts(pairs.sparkSession, "pairs")
    counts = cuts.cut(ending_counts(pairs))
    n = {r["lang"]: r["sentences"] for r in counts.where("ending = ''").select("lang", "sentences").collect()}
    bound = F.lit(least)
    for lang, k in n.items():
        bound = F.when(F.col("lang") == lang, F.lit(max(least, int(k * share)))).otherwise(bound)
    words = F.sum(F.when(~F.col("ending").contains(" "), F.col("total"))).alias("words")
    rate = {r["lang"]: min(0.5, n[r["lang"]] / r["words"]) for r in counts.groupBy("lang").agg(words).collect() if r["words"]}
    rows = counts.where((F.col("total") >= bound) & (F.col("ending") != "")).select("lang", "ending", "at_end", "total").collect()
    cuts.clear()
    known = Endings({(r["lang"], r["ending"]): (r["at_end"], r["total"]) for r in rows}, rate)
    often: dict[str, dict[str, float]] = {}
    for r in rows:
        if r["lang"] in STOPWORDS and " " not in r["ending"] and r["ending"] not in ("X", "0"):
            often.setdefault(r["ending"], {})[r["lang"]] = r["total"] / n[r["lang"]]
    stopwords = {k: set(v) for k, v in STOPWORDS.items()}
    for w, per in often.items():
        top = max(per, key=per.get)
        if all(per[top] >= 4 * v for k, v in per.items() if k != top):
            for k in stopwords:
                stopwords[k].discard(w)
            stopwords[top].add(w)
    return known, {k: frozenset(v) for k, v in stopwords.items()}


def unclosed(text: str) -> bool:
    if not OPENS.search(text):
        return False
    stack = []
    for c in text:
        if c in OPEN:
            stack.append(OPEN[c])
        elif stack and c == stack[-1]:
            stack.pop()
    return bool(stack)


def refuses(low: str, src: str, refusals: ahocorasick.Automaton, capital: frozenset[str]) -> bool:
    """Whether a stock phrase opens the response, or stands in one that has nothing else of the prompt."""
    hits = [(end - len(p) + 1, end, p) for end, p in refusals.iter(low)]
    if not hits:
        return False
    prompt = spaced(src)
    hits = [h for h in hits if h[2] not in prompt]
    if not hits:
        return False
    # what may stand before it: two words, a label with a colon, or nothing but the prompt itself
    before = low[: min(hits)[0]]
    opens = len(before.rsplit(":", 1)[-1].split()) <= 2 or fold(before) in fold(prompt)
    rest = low[max(hits)[1] + 1 :]
    return opens or not any(w in before or w in rest for w in capital | set(NUMBER.findall(src)))


def spaced(text: str) -> str:
    return " ".join(text.lower().replace("’", "'").split())


def defect(src: str | None, tgt: str | None, lang: str, endings: Endings | None, refusals: ahocorasick.Automaton, stopwords: dict[str, frozenset[str]] = STOPWORDS) -> tuple[str | None, float]:
    """The defect of a pair, or None, and the share of the response that is copied from the prompt."""
    src, tgt = unicodedata.normalize("NFC", src or ""), unicodedata.normalize("NFC", tgt or "")
    found, share, sizes = defect_but_truncated(src, tgt, lang, refusals, stopwords)
    return found or ("truncated" if endings and endings.breaks_off(src, tgt, lang, sizes) else None), share


def defect_but_truncated(src: str, tgt: str, lang: str, refusals: ahocorasick.Automaton, stopwords: dict[str, frozenset[str]]) -> tuple[str | None, float, tuple[int, int]]:
    """The same of texts in NFC without a look at where the response ends, and the folded lengths of both texts."""
    folded, base = fold(tgt, True), fold(src, True)
    sizes = len(base), len(folded)
    if not folded or len(folded) <= 12 and folded in PLACEHOLDERS or TAGS.fullmatch(tgt) is not None:
        return "empty", 0.0, sizes
    capital = frozenset(w.lower() for w in CAPITAL.findall(src))
    if refuses(spaced(tgt), src, refusals, capital):
        return "refusal", 0.0, sizes
    found = language_of(tgt, lang, stopwords, capital)
    share = 0.0
    least = min(16, len(base))
    # what both texts can share at most, by their letters: only where that is enough are they traversed. A common run of 16
    # holds one of the prompt's blocks of 8
    most = sum(map(folded.count, set(base)))
    enough = most >= min(len(folded), len(base)) / 2 if found == "en" else most >= len(base)
    if base and enough and (base in folded if least < 16 else any(base[i : i + 8] in folded for i in range(0, len(base) - 7, 8))):
        share = SuffixAutomaton(base).copied(folded, least) / len(folded)
        back = 1.0 if base in folded else SuffixAutomaton(folded).copied(base, least) / len(base)
        # without English votes (a headline reads like names) the response must hold the whole prompt, as half of it may be
        # a name that translations keep; a short prompt may be a name itself and must fill the response
        if max(share, back) >= 0.5 if found == "en" else back == 1 and (least == 16 or share >= 0.5):
            return "copied", share, sizes
    return "wrong_language" if found is not None and found != lang and lang != "en" else None, share, sizes


FOUND = "pair_id long, defect string, copied_share double"
JUDGED = FOUND + ", ids array<long>, shares array<double>, x binary"


def judged_pairs(pairs: DataFrame, known: Endings, stopwords: dict[str, frozenset[str]], langs: dict[str, int]) -> DataFrame:
    """A row for each pair with a defect other than breaking off, and one for each batch of others, with their written features ``x``."""
    shared = pairs.sparkSession.sparkContext.broadcast((known, stopwords))
    types = [pa.int64(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refusals, (known, stopwords) = _automaton(), shared.value
        for batch in batches:
            rows, rest, x = [], [], []
            for i, lang, src, tgt in zip(*(c.to_pylist() for c in batch.columns)):
                src, tgt, used = unicodedata.normalize("NFC", src or ""), unicodedata.normalize("NFC", tgt or ""), lang or "en"
                d, share, sizes = defect_but_truncated(src, tgt, used, refusals, stopwords)
                if d:
                    rows.append((i, d, share, None, None, None))
                else:
                    rest.append((i, share))
                    x.append(known.column(src, tgt, used, sizes, langs.get(used, len(langs)), bool(lang)))
            if rest:
                rows.append((None, None, None, *map(list, zip(*rest)), np.array(x, "<f4").T.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=["pair_id", "defect", "copied_share", "ids", "shares", "x"])

    return pairs.select(F.col("pair_id").cast("long"), F.lower(F.trim("lang")), "src", "tgt").mapInArrow(run, JUDGED)


def written(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The features in the column ``x`` of a batch: a table for each row."""
    for x in batch.column("x"):
        yield np.frombuffer(x.as_buffer(), "<f4").reshape(WIDTH, -1)


def medians(rows: DataFrame, langs: int) -> np.ndarray:
    """Median log ratio of lengths by the number of a language: counted by thousandths first, then the values of the one or two that hold it."""

    def counted(wanted: dict[int, set[float]] | None) -> dict[int, list[tuple[float, int]]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in written(batch):
                    x = x[:, (x[1] > 0) & ~np.isnan(x[2 + RATIO])].astype(float)
                    for lang in np.unique(x[0]).astype(int).tolist():
                        ratio = x[2 + RATIO][x[0] == lang]
                        bins = np.floor(ratio * 1000)
                        values, n = np.unique(bins if wanted is None else ratio[np.isin(bins, list(wanted[lang]))], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.int64()), pa.array(values, pa.float64()), pa.array(n, pa.int64())], names=["lang", "value", "n"])

        per: dict[int, list[tuple[float, int]]] = {}
        for r in rows.mapInArrow(run, "lang long, value double, n long").groupBy("lang", "value").agg(F.sum("n").alias("n")).collect():
            per.setdefault(r["lang"], []).append((r["value"], r["n"]))
        return {lang: sorted(values) for lang, values in per.items()}

    def at(values: list[tuple[float, int]], rank: int) -> tuple[float, int]:
        """The value of that rank, and how many are less."""
        less = 0
        for v, n in values:
            if rank < less + n:
                return v, less
            less += n
        raise IndexError(rank)

    bins = counted(None)
    places = {lang: [(rank, *at(v, rank)) for n in [sum(n for _, n in v)] for rank in ((n - 1) // 2, n // 2)] for lang, v in bins.items()}
    values = counted({lang: {b for _, b, _ in two} for lang, two in places.items()}) if places else {}
    out = np.zeros(langs + 1)
    for lang, two in places.items():
        out[lang] = sum(at([v for v in values[lang] if math.floor(v[0] * 1000) == b], rank - less)[0] for rank, b, less in two) / 2
    return out


def fitted(judged: DataFrame, langs: dict[str, int]) -> Model | None:
    """The model of all pairs of ``judged``; None where none is without another defect. What reaches the driver is one sum a partition."""
    rows = judged.where("x is not null").select("x")

    def total(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [f(x) for batch in batches for x in written(batch)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, 0).tobytes()], pa.binary())], names=["part"])

        parts = [np.frombuffer(bytes(r["part"])) for r in rows.mapInArrow(run, "part binary").collect()]
        return np.sum(parts, 0) if parts else None

    model = Model(langs, medians(rows, len(langs)))
    return model if model.fit(total) else None


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, defect, copied_share) of the defective pairs; the share is 0 where too few letters are common for a copy.

    A null or blank response is empty; a null or blank prompt can't be copied and misses no number; a pair without
    a language is judged only for the other defects; repeated rows give one row each; other columns are ignored.
    """
    known, stopwords = corpus_words(pairs)
    langs = {lang: i for i, lang in enumerate(sorted({*known.rate, "en"}))}
    judged = Cuts(pairs.sparkSession, "judged").cut(judged_pairs(pairs, known, stopwords, langs))
    model = fitted(judged, langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, shares, x in zip(batch.column("ids"), batch.column("shares"), written(batch)):
                at = pa.array(np.flatnonzero(model.broken(x)))
                yield pa.RecordBatch.from_arrays([ids.values.take(at), pa.array(["truncated"] * len(at), pa.string()), shares.values.take(at)], names=["pair_id", "defect", "copied_share"])

    found = judged.where("defect is not null").select("pair_id", "defect", "copied_share")
    if model is None:
        return found
    return found.unionByName(judged.where("x is not null").select("ids", "shares", "x").mapInArrow(run, FOUND))
