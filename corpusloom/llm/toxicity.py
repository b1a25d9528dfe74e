"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of lexicon words by kind, how near they stand to a second person, shares of
capitals and punctuation, rates of obfuscated spellings (digits and signs for letters, stretched letters, signs
or spaces between letters, masked letters), and the densest stretch of hits. Beside the fixed lexicon there is a
learned one: words and stems that stand more often in the toxic texts of a bounded sample. Trees are fitted on
histograms of that sample; scores of rows that a fold's trees haven't seen give the steps of the calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, staged

#: Labelled documents that the trees are fitted on at most, those with the smallest hashes of their ids.
MAX_TRAIN = 8_000
THRESHOLD = 0.5
#: Parts of the sample that lexicons and calibration are crossed by.
FOLDS = 4
#: Words and stems that are learned at most; toxic texts that a word must stand in (a stem: twice as many), and its log-odds.
LEARNED, LEAST_TEXTS, LEAST_WEIGHT = 4_096, 4, 1.5
#: Lengths of stems.
STEMS = range(4, 8)
#: Words on either side within which a second person counts as near; words of a stretch whose hits are counted together.
NEAR, STRETCH = 6, 60
#: Characters of a text that are worked on at once.
_BLOCK = 1 << 20
#: Longer words are in no lexicon, however they are spelt.
_LONGEST = 40

# Words of abuse in English, German, French and Spanish, by kind.
LEXICON = {
    "insult": "idiot idiots idiotic moron morons moronic imbecile stupid stupidity dumb dumbass dumbest fool fools foolish clown clowns loser losers pathetic worthless useless scum trash garbage jerk jerks creep creeps coward cowards liar liars disgusting disgrace dimwit halfwit nitwit blockhead airhead retard retarded cretin lunatic psycho weirdo freak freaks fatso pig pigs swine dumpster brainless spineless gutless ugly lowlife scumbag scumbags dirtbag sleazebag buffoon dunce dolt ignoramus nincompoop simpleton wimp sissy hypocrite crybaby braindead "
    "dummkopf blödmann trottel depp deppen vollidiot versager abschaum dreckig drecksau schwein schweine widerlich erbärmlich wertlos blöd dämlich doof schwachkopf penner lügner feigling "
    "idiote imbécile crétin crétine abruti abrutie débile connard connasse minable pathétique dégoûtant dégoûtante ordure raclure nul nulle bouffon clochard "
    "idiota imbécil estúpido estúpida tonto tonta tarado tarada basura asqueroso asquerosa patético patética inútil payaso perdedor perdedora escoria cobarde miserable",
    "obscene": "fuck fucks fucked fucker fuckers fucking motherfucker shit shits shitty bullshit horseshit ass asses asshole assholes bitch bitches bastard bastards crap crappy damn damned dick dickhead prick piss pissed cunt cunts whore whores slut sluts twat wanker wankers bollocks douche douchebag jackass arse arsehole wtf stfu "
    "scheiße scheisse scheiß arschloch arschlöcher arsch wichser hurensohn fotze schlampe hure verpiss fick ficken verdammt "
    "merde putain salope salaud enculé bordel pute foutre chier bâtard "
    "mierda puta puto cabrón cabrona pendejo pendeja joder coño gilipollas hijueputa maricón zorra",
    "threat": "kill kills killed murder strangle stab shoot burn suffer destroy beat punch smash slaughter execute exterminate lynch töte töten umbringen verrecke krepier verbrennen tuer tuerai crève crever matar mataré muérete quemar ahorcar",
    "hate": "vermin subhuman subhumans parasite parasites cockroach cockroaches savages filth filthy animals infest invaders hate hated hateful despise loathe deport untermensch untermenschen ungeziefer parasiten hasse hass vermine cafards sous-hommes haine déteste alimañas cucarachas odio subhumano",
}
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur ya thou du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus vuestro".split())
#: Signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})
KINDS = tuple(LEXICON)
_KIND = {word: k for k, words in enumerate(LEXICON.values()) for word in words.split()}
_BY_SHAPE: dict[tuple[int, str], list[str]] = {}
for _word in _KIND:
    _BY_SHAPE.setdefault((len(_word), _word[0]), []).append(_word)
_EDGES = ".,;:?!\"'()[]{}<>-–—…*#%&$|/\\~`^_=+«»¿¡"
#: Signs that stand for letters also at the start of a word.
_LEADING = frozenset("$!|+@€0123456789")
_STRETCHED = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:\w[ ._-]){2,}\w(?!\S)")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = re.compile(r"[!?]{2,}")

NAMES = (
    "log_words", "mean_length", *(f"{k}_density" for k in KINDS), *(f"{k}_count" for k in KINDS), "different_hits", "hit_density", "densest_stretch", "hits_near_you", "near_share", "you_density",
    "capitals", "capital_words", "capital_hits", "exclamations", "questions", "runs_of_marks", "other_marks", "digits", "mixed_words", "inner_marks", "stretched", "spaced", "masked", "obfuscated_hits", "obfuscated_density",
    "word_density", "word_sum", "different_words", "stem_density", "stem_sum", "different_stems",
)


def find(token: str) -> tuple[int, bool]:
    """(kind, spelt otherwise) of a word in lower case: kind -1 for one that is in no lexicon."""
    if token in _KIND:
        return _KIND[token], False
    bare = token.strip(_EDGES)
    if bare in _KIND:
        return _KIND[bare], False
    if not bare or len(token) > _LONGEST or bare.isalpha() and token[0] not in _LEADING and not _STRETCHED.search(bare):
        return -1, False
    if "*" in bare[1:] and bare[0].isalpha():
        shape = re.compile("".join("." if c == "*" else re.escape(c) for c in bare))
        letters = len(bare.replace("*", ""))
        for word in _BY_SHAPE.get((len(bare), bare[0]), ()) if 2 * letters >= len(bare) else ():
            if shape.fullmatch(word):
                return _KIND[word], True
    plain = "".join(c for c in token.strip(".,;:?\"'()[]{}<>-#%&*").rstrip("!").translate(LEET) if c.isalpha())
    for way in (plain, _STRETCHED.sub(r"\1", plain), _STRETCHED.sub(r"\1\1", plain)):
        if way in _KIND:
            return _KIND[way], True
    return -1, False


@dataclass(frozen=True)
class Learned:
    """Words and stems (beginnings of words) that stand more often in toxic documents, with their log-odds."""

    words: dict[str, float]
    stems: dict[str, float]

    def weigh(self, bare: str) -> tuple[float, float]:
        """What a word weighs by itself, and by the longest stem it begins with."""
        stem = 0.0
        for n in STEMS:
            if len(bare) > n and (w := self.stems.get(bare[:n])):
                stem = w
        return self.words.get(bare, 0.0), stem


NOTHING = Learned({}, {})


class Reader:
    """What a word is, remembered while there is room; None for one that nothing is to be said of."""

    def __init__(self, learned: Learned = NOTHING, room: int = 1 << 17):
        self.learned, self.room, self.known = learned, room, {}
        self.heads = {stem[: STEMS[0]] for stem in learned.stems}

    def __call__(self, token: str) -> tuple | None:
        got = self.known.get(token, self)
        if got is self:
            got = self.look(token)
            if len(self.known) >= self.room:
                self.known.clear()
            if len(token) <= _LONGEST:
                self.known[token] = got
        return got

    def look(self, token: str) -> tuple | None:
        """(bare, kind, spelt otherwise, capitals, second person, mixed, inner marks, masked, stretched, weight, weight of the stem)"""
        bare = token if token.isalpha() else token.strip(_EDGES)
        low, plain, run = bare.lower(), bare.isalpha(), _STRETCHED.search(bare)
        upper = len(bare) > 2 and bare.isupper()
        if plain and not run and token[0] not in _LEADING and not upper and low not in _KIND and low not in SECOND_PERSON:
            if low not in self.learned.words and low[: STEMS[0]] not in self.heads:
                return None
            word, stem = self.learned.weigh(low)
            return (low, -1, False, False, False, False, False, False, False, word, stem) if word or stem else None
        has_letter = plain or any(map(str.isalpha, bare))
        kind, other = find(token.lower())
        return (low, kind, other, upper, low in SECOND_PERSON, not plain and has_letter and any(map(str.isdigit, bare)), not plain and has_letter and not bare.isalnum(),
                not plain and has_letter and "*" in bare[1:-1], bool(run) and bare[0].isalpha(), *self.learned.weigh(low))


@cache
def _classes() -> np.ndarray:
    """What a character is, by code point: 1 letter, 2 capital, 3 digit, 4 white space, else 0; beyond the first plane all are 0."""
    out = np.zeros((1 << 16) + 1, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        out[code] = (2 if c.isupper() else 1) if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 0
    return out


def blocks(text: str, size: int = _BLOCK) -> Iterator[str]:
    """A text in blocks that end between words."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end


def features(text: str, read: Reader | None = None, block: int = _BLOCK) -> np.ndarray:
    """The values of ``NAMES``; what a text gives doesn't depend on its blocks, but for spellings with spaces across their ends."""
    read = read or Reader()
    hits, different, words, stems = [0] * len(KINDS), set(), {}, {}
    n = letters = capitals = digits = chars = exclaimed = asked = runs = spaces = 0
    words_capital = hits_capital = mixed = inner = stretched = spaced = masked = hidden = you = near = 0
    word_sum = stem_sum = 0.0
    last_you, waiting, recent, densest = None, deque(), deque(), 0
    for part in blocks(text, block):
        tokens = _WORD.findall(part)
        marks = {}
        known = read.known
        for token, k in Counter(tokens).items():
            found = known.get(token, read)
            if found is read:
                found = read(token)
            if found is None:
                continue
            bare, kind, other, upper, address, is_mixed, is_inner, is_masked, is_stretched, word, stem = found
            words_capital += k * upper
            mixed += k * is_mixed
            inner += k * is_inner
            masked += k * is_masked
            stretched += k * is_stretched
            if word:
                words[bare] = word
                word_sum += k * word
            if stem:
                stems[bare] = stem
                stem_sum += k * stem
            if kind >= 0 or address:
                marks[token] = (bare, kind, other, upper, address)
        for i, token in enumerate(tokens, n) if marks else ():
            if token not in marks:
                continue
            bare, kind, other, upper, address = marks[token]
            if address:
                you += 1
                last_you = i
                while waiting and waiting[0] < i - NEAR:
                    waiting.popleft()
                near += len(waiting)
                waiting.clear()
            if kind >= 0:
                hits[kind] += 1
                hidden += other
                hits_capital += upper
                different.add(bare)
                if last_you is not None and i - last_you <= NEAR:
                    near += 1
                else:
                    waiting.append(i)
                    if len(waiting) > 2 * NEAR:
                        waiting.popleft()  # too far from any word to come
                recent.append(i)
                while recent[0] <= i - STRETCH:
                    recent.popleft()
                densest = max(densest, len(recent))
        for m in _SPACED.finditer(part.lower()):
            word = re.sub(r"[ ._-]", "", m.group())
            kind, _ = find(word)
            spaced += 1
            if kind >= 0:
                hits[kind] += 1
                hidden += 1
                different.add(word)
        n += len(tokens)
        codes = np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)
        kinds = np.bincount(_classes()[codes], minlength=5)
        chars += len(part)
        letters += int(kinds[1] + kinds[2])
        capitals += int(kinds[2])
        digits += int(kinds[3])
        spaces += int(kinds[4])
        exclaimed += part.count("!")
        asked += part.count("?")
        runs += sum(1 for _ in _MARKS.finditer(part))
    total, some, of = sum(hits), max(n, 1), max(chars, 1)
    other = chars - letters - digits - spaces
    return np.array([
        math.log1p(n), (chars - spaces) / some, *(100 * h / some for h in hits), *(math.log1p(h) for h in hits), math.log1p(len(different)), 100 * total / some, densest, near, near / max(total, 1), 100 * you / some,
        capitals / max(letters, 1), words_capital / some, hits_capital, 100 * exclaimed / of, 100 * asked / of, 100 * runs / some, 100 * other / of, 100 * digits / of, 100 * mixed / some, 100 * inner / some, 100 * stretched / some, 100 * spaced / some, 100 * masked / some, hidden, 100 * hidden / some,
        100 * word_sum / some, sum(words.values()), math.log1p(len(words)), 100 * stem_sum / some, sum(stems.values()), math.log1p(len(stems)),
    ], dtype=np.float64)


@dataclass
class Trees:
    """Boosted trees of one depth: ``split`` (trees, inner nodes) names a feature and ``bound`` what goes right, over it; ``leaf`` has the steps."""

    bias: float
    depth: int
    split: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for split, bound, leaf in zip(self.split, self.bound, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), split[at]] > bound[at])
            out += leaf[at - (len(split))]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, weight: float = 1.0, least: float = 2.0) -> Trees:
    """Trees for the logistic loss, each level's splits chosen from histograms of gradients; the first of equally good splits.

    Labels of one value only give that value's share, smoothed, and no trees."""
    n, m = x.shape
    share = (y.sum() + 1) / (n + 2)
    bias, nodes = math.log(share / (1 - share)), 2**depth - 1
    if not 0 < y.sum() < n:
        return Trees(bias, depth, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = []
    for f in range(m):
        values = np.unique(x[:, f])
        middles = (values[1:] + values[:-1]) / 2
        edges.append(middles if len(middles) < bins else np.unique(np.quantile(middles, np.linspace(0, 1, bins - 1))))
    code = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], axis=1)
    z = np.full(n, bias)
    out = Trees(bias, depth, np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1)))
    columns = np.arange(m) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        gradient, curve = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * m * bins + columns + code).ravel()
            g, h = (np.bincount(cell, np.repeat(v, m), width * m * bins).reshape(width, m, bins) for v in (gradient, curve))
            left, right = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
            all_g, all_h = left[:, :, -1:], right[:, :, -1:]
            gain = left**2 / (right + weight) + (all_g - left) ** 2 / (all_h - right + weight) - all_g**2 / (all_h + weight)
            gain[(right < least / 4) | (all_h - right < least / 4)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for node in range(width):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-9 and b < len(edges[f]):
                    out.split[t, first + node], out.bound[t, first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), out.split[t][at]] > out.bound[t][at])
        leaf = at - nodes
        g, h = (np.bincount(leaf, v, nodes + 1) for v in (gradient, curve))
        out.leaf[t] = rate * g / (h + weight)
        z += out.leaf[t][leaf]
    return out


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a rising line through the means of pooled neighbours that would fall."""
    pools: list[list[float]] = []
    values, inverse = np.unique(z, return_inverse=True)
    sums, sizes = np.bincount(inverse, y), np.bincount(inverse)
    for value, total, size in zip(values, sums, sizes):
        pools.append([total, size, value * size])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            for k, v in enumerate(pools.pop()):
                pools[-1][k] += v
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    trees: Trees
    places: np.ndarray
    values: np.ndarray
    learned: Learned = NOTHING

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.logits(x), self.places, self.values)


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray, learned: Learned = NOTHING) -> Model:
    """Trees of all rows, calibrated on logits from trees that hadn't seen the row's fold. With too few rows of either label, the trees' own probability."""
    trees = boost(x, y)
    if min(y.sum(), len(y) - y.sum()) < 2 * FOLDS:
        grid = np.linspace(-12, 12, 97)
        return Model(trees, grid, 1 / (1 + np.exp(-grid)), learned)
    z = np.empty(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            z[fold == k] = boost(x[fold != k], y[fold != k]).logits(x[fold == k])
    return Model(trees, *isotonic(z, y), learned)


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that no model is fitted on: crc32 of the id as text is divisible by 5. Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _tokens(text: str) -> set[str]:
    """A text's words, and its stems behind a space sign."""
    words = {w.strip(_EDGES).lower() for part in blocks(text) for w in _WORD.findall(part)}
    words = {w for w in words if 2 < len(w) <= _LONGEST}
    return words | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def learn_words(sample: DataFrame, size: int = LEARNED) -> list[Learned]:
    """Lexicons from (y, fold, text): one for each fold from the other folds' texts, then one from all.

    Log-odds of standing in a toxic text, of words and stems that do in enough of them; the ``size`` that say most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            token, y, fold = zip(*counts)
            return pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(y, pa.int32()), pa.array(fold, pa.int32()), pa.array(counts.values(), pa.int64())], ["token", "y", "fold", "n"])

        for batch in small_batches(batches, 64):
            for y, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                counts.update((t, y, fold) for t in _tokens(text.decode()))
                if len(counts) > 1 << 18:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    total = {(r["y"], r["fold"]): r["n"] for r in sample.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    texts = [sum(n for (y, _), n in total.items() if y == of) for of in (0, 1)]
    cells = [F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{y}{k}") for y in (0, 1) for k in range(FOLDS)]
    seen = sample.select("y", "fold", "text").mapInArrow(run, "token string, y int, fold int, n long").groupBy("token").agg(*cells)
    clean, toxic = (sum((F.col(f"n{y}{k}") for k in range(FOLDS)), F.lit(0)) for y in (0, 1))
    weight = F.log((toxic + 0.5) / (texts[1] + 1)) - F.log((clean + 0.5) / (texts[0] + 1))
    best = seen.filter((toxic >= LEAST_TEXTS) & (weight >= LEAST_WEIGHT)).withColumn("says", toxic * weight).orderBy(F.desc("says"), "token").limit(size).collect()
    out = []
    for left_out in (*range(FOLDS), None):
        folds = [k for k in range(FOLDS) if k != left_out]
        of = [sum(total.get((y, k), 0) for k in folds) for y in (0, 1)]
        words, stems = {}, {}
        for r in best:
            c, t = (sum(r[f"n{y}{k}"] for k in folds) for y in (0, 1))
            w = math.log((t + 0.5) / (of[1] + 1)) - math.log((c + 0.5) / (of[0] + 1))
            if w >= LEAST_WEIGHT and r["token"][0] != " " and t >= LEAST_TEXTS:
                words[r["token"]] = w
            elif w >= LEAST_WEIGHT and r["token"][0] == " " and t >= 2 * LEAST_TEXTS:
                stems[r["token"][1:]] = w
        out.append(Learned(words, stems))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model of ``labels.toxic`` from at most ``max_train`` labelled documents that aren't held out.

    Only this bounded sample's features and its most telling words reach the driver. Folds go by the text, so that
    copies share one; a row's features use words that were learned from the other folds. An id labelled twice counts by
    its mean (0.5: 1), one with several documents by the last of their features in order; null labels and ids are
    left out; without any label all scores are 0.5."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    known = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "labels")
    fold = F.pmod(F.xxhash64(F.coalesce(F.lower("text"), F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")
    # a doc_id that many rows repeat is read once for each different text
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "y", fold, "text").distinct(), "sample")
    lexicons = learn_words(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x) for x in lexicons]
        for batch in small_batches(batches, 256):
            found = [features(t.decode(), readers[k]).tolist() for t, k in zip(as_bytes(batch.column(3)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "y", "fold", "x"])

    found = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, fold int, x array<double>")
    got = found.groupBy("doc_id").agg(F.max(F.struct("x", "y", "fold")).alias("row")).select("doc_id", "row.*").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(NAMES))
    return train(x, got["y"].to_numpy(dtype=np.float64), got["fold"].to_numpy(), lexicons[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row from its whole text; null and empty texts are scored like any other, repeated ids row by row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    t, words = model.trees, model.learned
    shared = docs.sparkSession.sparkContext.broadcast((t.bias, t.depth, t.split, t.bound, t.leaf, model.places, model.values, words.words, words.stems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *trees, places, values, known, stems = shared.value
        own, read = Model(Trees(*trees), places, values), Reader(Learned(known, stems))
        for batch in small_batches(batches, 64):
            if batch.num_rows:
                x = np.stack([features(t.decode(), read) for t in as_bytes(batch.column(1))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(x), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double")
