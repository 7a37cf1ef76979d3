"""Toxicity by gradient-boosted trees over dense text features.

Features are densities and counts over the whole text: insults, profanity and
threats from short fixed lists (several languages), their nearness to words in
the second person, their clustering, capitals, punctuation, and obfuscation
(letters swapped for digits or signs, stretched letters, mixed words). A second
lexicon is learned: words that toxic documents of the sample hold far more often
than others, weighted by log odds, at most ``MAX_LEARNED`` of them. So that trees
do not trust it more than it deserves, each training document is seen through
words counted on the other thirds of the sample. Trees are grown in numpy on quantile bins with Newton steps on the logistic loss; a
quarter of the sample, unseen by the trees, calibrates their sum by isotonic
regression, read off by linear interpolation.

Only the feature rows of a bounded sample (``max_train``) reach the driver. Texts
are read in slices, word by word through a cache of bounded size, so of a long text no
more is held than a slice's words and the places of listed ones.

Defined cases: null and empty texts have all features 0 and are scored as such.
Labels, lang, source and ids are no inputs. With no rows or one class in the
sample every score is that class's share (0.5 if none).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marlstone.llm.common import materialise, trimmed
from marlstone.llm.labelled import training_rows

MAX_TRAIN, THRESHOLD, CACHE_WORDS, SLICE, NEAR, CLUSTER = 20_000, 0.5, 200_000, 1 << 18, 6, 20
MAX_LEARNED, LEARN_DOCS, LEARN_ODDS, FOLDS = 5000, 3, 2.0, 3
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 80, 3, 32, 0.15, 1.0, 10

# Word lists.
INSULTS = frozenset(
    """
    airhead asshat bastard bimbo blockhead bonehead bozo brainless brat buffoon bum chump clown clueless coward creep
    cretin deadbeat degenerate delusional deranged despicable dimwit disgrace disgusting dolt dope dork dumb dumbass
    dummy dunce dweeb failure fatso fool freak garbage goon gross halfwit hideous horrible hypocrite idiot idiotic
    ignorant imbecile incompetent inferior jackass jerk junk kook lame laughable leech liar loser lowlife lunatic
    maggot moron moronic nasty nitwit nobody numbskull oaf obnoxious parasite pathetic pig pitiful psycho punk rat
    repulsive revolting rubbish schmuck scum scumbag shameful sicko simpleton skank sleazy slimy slob snake spineless
    stupid stupidity subhuman swine trash twit twisted ugly useless vermin weasel weirdo wimp worthless wretch
    arschloch blödmann depp dummkopf idioten trottel versager widerlich wertlos abschaum
    abruti connard crétin débile imbécile ordure pathétique minable nul salaud
    basura cabrón cretino estúpido idiota imbécil inútil patético perdedor asqueroso
    """.split()
)
PROFANITY = frozenset("arse arsehole ass asshole bitch bollocks bullshit crap damn dick douche fuck fucker fucking hell motherfucker piss prick shit shitty slut twat wanker whore merde putain mierda puta scheisse scheiße".split())
THREATS = frozenset("burn choke crush destroy hate hurt kill killed murder punch rot shoot smash stab strangle suffer hasse stirb meurs muere odio déteste".split())
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur youre you're ya du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
NAMES = (
    "insults_per_100 log_insults distinct_insults profanity_per_100 threats_per_100 second_person_per_100 near_second_person_per_100 most_in_window "
    "caps_word_share capital_share exclamations_per_100 questions_per_100 punctuation_share obfuscated_per_100 mixed_per_100 stretched_per_100 log_words mean_word_length learned_per_100 log_learned distinct_learned learned_weight"
).split()

_EDGE = re.compile(r"^\W+|\W+$")
_TWICE = re.compile(r"(.)\1")
_STRETCH = re.compile(r"(.)\1\1")
_SQUEEZE = re.compile(r"(.)\1+")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_BLANK = re.compile(r"\s")
INSULT, PROFANE, THREAT, SECOND, CAPS, HIDDEN, MIXED, STRETCHED = (1 << k for k in range(8))
BAD = INSULT | PROFANE | THREAT
#: What each listed word is.
KINDS = {w: INSULT * (w in INSULTS) | PROFANE * (w in PROFANITY) | THREAT * (w in THREATS) for w in INSULTS | PROFANITY | THREATS}


def _found(bare: str) -> int:
    return KINDS.get(bare, 0) or (KINDS.get(bare[:-1], 0) if bare.endswith("s") else 0)


def _hidden(forms: set[str]) -> int:
    return max((KINDS.get(f, 0) for f in forms), default=0)


def _of_letters(word: str, low: str, length: int, stop: bool) -> tuple[int, str, int, int, int]:
    """Traits of a token that is a word of letters, with one stop after it or none: most tokens, so in few steps."""
    bits = SECOND if low in SECOND_PERSON else 0
    upper = 0
    if low != word:
        upper = sum(map(str.isupper, word))
        if len(low) > 1 and word.isupper():
            bits |= CAPS
    found = KINDS.get(low, 0) or (KINDS.get(low[:-1], 0) if low[-1] == "s" else 0)
    if stop and not found and low[-1] == "i" and length <= 40 and (found := KINDS.get(low.rstrip("i"), 0)):
        bits |= HIDDEN
    if _TWICE.search(low):
        if _STRETCH.search(low):
            bits |= STRETCHED
        # Spelled with letters doubled.
        if not found and length <= 40 and (found := KINDS.get(_SQUEEZE.sub(r"\1", low), 0)):
            bits |= HIDDEN
    return bits | found, low, upper, len(word), stop


def word_traits(token: str) -> tuple[int, str, int, int, int]:
    """(bits, plain form, letters in upper case, letters, signs) of a token between blanks."""
    stop = token[-1] in ".,;:?"
    word = token[:-1] if stop else token
    if word.isalpha() and (low := word.lower()).isalpha():
        return _of_letters(word, low, len(token), stop)
    low = token.lower()
    bare = _EDGE.sub("", low)
    upper, letters = sum(map(str.isupper, token)), sum(map(str.isalpha, token))
    signs = len(token) - letters - sum(map(str.isdigit, token))
    if bare and bare.isalpha():
        bare_letters = len(bare)
    else:
        bare_letters = sum(map(str.isalpha, bare))
    bits = SECOND if bare in SECOND_PERSON else 0
    if bare_letters > 1 and upper and token.isupper():
        bits |= CAPS
    if 0 < bare_letters < len(bare):
        bits |= MIXED
    if _STRETCH.search(bare):
        bits |= STRETCHED
    found = _found(bare)
    if not found and letters and len(token) <= 40:
        # Spelled with signs or digits for letters, with signs between letters, or with letters doubled.
        swapped = low.strip(".,;:?\"'()").translate(LEET)
        forms = {_NOT_LETTER.sub("", swapped), _NOT_LETTER.sub("", swapped.rstrip("i")), _NOT_LETTER.sub("", low), _SQUEEZE.sub(r"\1", bare)}
        found = _hidden(forms - {bare})
        if found:
            bits |= HIDDEN
    return bits | found, bare, upper, letters, signs


def word_bits(token: str) -> int:
    """What a token between blanks is, as bits."""
    return word_traits(token)[0]


class WordCache(dict):
    """Token -> row of a table (bits, letters in upper case, letters, signs, characters, id of the plain form, hundredths of learned log odds)."""

    COLUMNS = 7

    def __init__(self, learned: dict[str, float] | None = None) -> None:
        self.learned = {w: int(100 * o) for w, o in (learned or {}).items()}
        self.table = array("i")
        self.forms: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        bits, bare, upper, letters, signs = word_traits(token)
        learned = self.learned.get(bare, 0)
        form = self.forms.setdefault(bare, len(self.forms) + 1) if bits & BAD or learned else 0
        self[token] = at = len(self.table) // self.COLUMNS
        self.table.extend((bits, upper, letters, signs, len(token), form, learned))
        return at

    def trim(self) -> None:
        """Starts anew when too many words are held. Called between texts, for ids of forms are those of one text."""
        if len(self) > CACHE_WORDS:
            self.clear()
            self.table, self.forms = array("i"), {}

    def rows(self, tokens: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return np.frombuffer(self.table, np.int32).reshape(-1, self.COLUMNS)[at]


def _slices(text: str) -> Iterator[str]:
    """Parts of about SLICE characters, cut at white space, so that few tokens are held as objects at once."""
    at = 0
    while at < len(text):
        found = _BLANK.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def dense_features(text: str | None, cache: WordCache) -> np.ndarray:
    """The features in the order of NAMES."""
    cache.trim()
    n, sums, counts = 0, np.zeros(4, np.int64), np.zeros(8, np.int64)
    bad, second, forms, learned_forms, learned, learned_words_seen = [], [], [], [], 0, 0
    for part in _slices(text or ""):
        tokens = part.split()
        if not tokens:
            continue
        rows = cache.rows(tokens)
        bits = rows[:, 0]
        sums += rows[:, 1:5].sum(0, dtype=np.int64)
        marked = np.flatnonzero(bits)
        if len(marked):
            some = bits[marked]
            counts += ((some[:, None] >> np.arange(8)) & 1).sum(0)
            at = marked[(some & BAD) > 0]
            bad.append(at + n)
            forms.append(rows[at, 5])
            second.append(marked[(some & SECOND) > 0] + n)
        taught = np.flatnonzero(rows[:, 6])
        if len(taught):
            learned += int(rows[taught, 6].sum())
            learned_words_seen += len(taught)
            learned_forms.append(rows[taught, 5])
        n += len(tokens)
    if not n:
        return np.zeros(len(NAMES))
    none = [np.zeros(0, np.int64)]
    bad, second, forms, learned_forms = (np.concatenate(x or none) for x in (bad, second, forms, learned_forms))
    insults, profane, threats, seconds, caps, hidden, mixed, stretched = counts.tolist()
    per, near, most = 100 / n, 0, 0
    if len(bad) and len(second):
        after = np.searchsorted(second, bad)
        gap = np.minimum(np.abs(second[np.minimum(after, len(second) - 1)] - bad), np.abs(bad - second[np.maximum(after - 1, 0)]))
        near = int(np.count_nonzero(gap <= NEAR))
    if len(bad):
        most = int((np.searchsorted(bad, bad + CLUSTER) - np.arange(len(bad))).max())
    upper, letters, signs, chars = sums.tolist()
    return np.array(
        [
            insults * per, np.log1p(insults), len(np.unique(forms)), profane * per, threats * per, seconds * per, near * per, most,
            caps / n, upper / max(1, letters), text.count("!") * per, text.count("?") * per, signs / max(1, chars), hidden * per, mixed * per, stretched * per, np.log1p(n), chars / n,
            learned_words_seen * per, np.log1p(learned_words_seen), len(np.unique(learned_forms)), learned / 100,
        ]
    )


# ---------------------------------------------------------------- trees


class Forest:
    """Boosted trees of one depth, as arrays; ``calibrate`` adds isotonic steps."""

    def __init__(self) -> None:
        self.base, self.feature, self.cut, self.leaf = 0.0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0))
        self.x, self.y = np.array([-50.0, 50.0]), None

    def margin(self, data: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(data), self.base), np.arange(len(data))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(data), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (data[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def fit(self, data: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in data.T]
        binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, data.T)], 1)
        inner, margin = 2**DEPTH - 1, np.full(len(y), self.base)
        features, limits, leaves = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for depth in range(DEPTH):
                first, width = 2**depth - 1, 2**depth
                best = np.full(width, 1e-9)
                at = np.full((width, 2), -1)
                for f in range(data.shape[1]):
                    key = (node - first) * BINS + binned[:, f]
                    gs, hs, ns = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, np.ones(len(y))))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                    gain[(ns < MIN_ROWS) | (nt - ns < MIN_ROWS)] = 0
                    gain = gain[:, : len(cuts[f])]
                    if gain.shape[1]:
                        top = gain.argmax(1)
                        better = gain[np.arange(width), top] > best
                        best[better] = gain[np.arange(width), top][better]
                        at[better] = np.stack([np.full(width, f), top], 1)[better]
                for k, (f, b) in enumerate(at):
                    if f >= 0:
                        feature[first + k], cut[first + k] = f, cuts[f][b]
                node = 2 * node + 1 + (data[np.arange(len(y)), feature[node]] > cut[node])
            leaf_of = node - inner
            leaf = -RATE * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + L2)
            margin += leaf[leaf_of]
            features.append(feature)
            limits.append(cut)
            leaves.append(leaf)
        self.feature, self.cut, self.leaf = np.array(features), np.array(limits), np.array(leaves)
        return self

    def calibrate(self, data: np.ndarray, y: np.ndarray) -> Forest:
        """Pools adjacent violators; a block stands at its mean margin."""
        m = self.margin(data)
        blocks: list[list[float]] = []  # sum of y, sum of margins, rows
        for i in np.argsort(m, kind="stable"):
            blocks.append([float(y[i]), float(m[i]), 1.0])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x, self.y = np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])
        return self

    def score(self, data: np.ndarray) -> np.ndarray:
        m = self.margin(data)
        return 1 / (1 + np.exp(-m)) if self.y is None else np.interp(m, self.x, self.y)


def train(data: np.ndarray, y: np.ndarray) -> Forest:
    if len(set(y.tolist())) < 2:
        forest = Forest()
        share = float(y.mean()) if len(y) else 0.5
        forest.base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return forest
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        return Forest().fit(data, y)
    return Forest().fit(data[~held], y[~held]).calibrate(data[held], y[held])


def learned_words(sample: DataFrame, max_words: int = MAX_LEARNED) -> list[dict[str, float]]:
    """Log odds of the words typical of label 1: counted without each fold of the sample, and last over all of it."""
    words = sample.select("fold", "y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))).alias("word"))
    cells = [(k, c) for k in range(FOLDS) for c in (0, 1)]
    counts = words.groupBy("word").agg(*[F.count_if((F.col("fold") == k) & (F.col("y") == c)).alias(f"n{k}_{c}") for k, c in cells])
    ones, zeros = (sum((F.col(f"n{k}_{c}") for k in range(FOLDS)), F.lit(0)) for c in (1, 0))
    top = counts.where(ones >= LEARN_DOCS).orderBy((ones / (zeros + 1)).desc(), ones.desc(), "word").limit(max_words).toPandas()
    docs = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    out = []
    for left_out in (*range(FOLDS), None):
        kept = [k for k in range(FOLDS) if k != left_out]
        a, b = (sum(top[f"n{k}_{c}"] for k in kept) for c in (1, 0))
        n1, n0 = (sum(docs.get((k, c), 0) for k in kept) for c in (1, 0))
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        out.append({w: float(o) for w, o, n in zip(top["word"], odds, a) if n >= LEARN_DOCS - (left_out is not None) and o >= LEARN_ODDS})
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN) -> tuple[Forest, dict[str, float]]:
    """The trees and the learned lexicon."""
    sample = materialise(training_rows(docs, labels, label, max_train).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "toxicity-sample")
    lexicons = learned_words(sample)

    def extract(batches):
        caches = [WordCache(x) for x in lexicons]
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [dense_features(t, caches[k]).tolist() for t, k in zip(pdf["text"], pdf["fold"])], "y": pdf["y"]})

    got = sample.mapInPandas(trimmed(extract), "doc_id long, x array<double>, y int").toPandas().sort_values("doc_id", kind="stable")
    order = np.random.default_rng(3).permutation(len(got))
    data = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))[order]
    return train(data, got["y"].to_numpy(float)[order]), lexicons[-1]


def scored(docs: DataFrame, model: tuple[Forest, dict[str, float]], text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def work(parts):
            forest, learned = held.value
            cache = WordCache(learned)
            for texts in parts:
                data = np.array([dense_features(t, cache) for t in texts]).reshape(len(texts), len(NAMES))
                yield pd.Series(forest.score(data), dtype="float64")

        yield from trimmed(work)(batches)

    return docs.withColumn(score_col, score(text_col)).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
