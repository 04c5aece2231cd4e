"""Toxicity scores from a subsequence string kernel, an SVM and Nystroem landmarks.

The unit is a word of the text in lower case, with edge punctuation cut off and ``^`` and ``$`` set
around it; a run of three or more one-letter words (``i d i o t``) is one more unit, and so is a
word without the other characters inside it (``i.d.i.o.t``). Neighbouring words are joined where one
of them is no common word of clean texts (``id iot``), and where the labels name the pair though
neither word alone. The kernel of two units counts their
common subsequences of four letters, each occurrence weighted by decay ** span with spans up to
``MAX_SPAN``, so gaps and inserted characters cost weight but don't break a match; it is normalised
by each unit's own weights.

Labels are given for texts, not units. Which units of a toxic text are toxic is estimated from the labels of all
texts that share their parts: a unit's evidence is the log odds, lower end, of its best part (four letters or a
beginning) in toxic against clean texts. That evidence chooses landmarks and the first positives, and the SVM does the rest.

Landmarks are the units whose parts differ most between the classes, clean units that look like
them, and common units.
The Nystroem map of a unit is K_mm^(-1/2) k_m(x). The SVM (squared hinge, primal Newton) is
trained on labelled texts as bags of units: a toxic text stands for its most toxic unit, which is
chosen again after each fit, clean texts for units drawn from them, their highest-scoring ones and
units that look like toxic ones.
A text's score is its highest unit score through a logistic curve fitted on the training texts.

As the kernel is a sum over subsequences, landmarks, map and SVM fold exactly into one weight for
each 4-letter subsequence (:class:`Model`), so units are scored by table look-ups.

Fitting reads at most ``per_class`` labelled texts of each class (those with the least hash of the id)
and, of these, the shortest up to ``class_bytes`` bytes; all texts are scored. Scoring is one narrow Arrow pass; the model is a sparse
table of some ten thousand subsequences, spread to 67 MB in each worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import pieces, tidy

DECAY, MAX_SPAN = 0.6, 7
#: Letters and digits known to the kernel; 0 stands for all else, which matches nothing and has no weight.
SIZE = 64
#: Longest unit that is made of two neighbouring words because one of them isn't common.
MAX_JOIN = 16
EDGE = ".,;:!?\"'`()[]{}<>*#$%&|/\\_~^+=-@«»“”‘’…"


@dataclass
class Model:
    letters: np.ndarray  # sorted code points; number + 1 is the letter's code
    index: np.ndarray  # subsequence codes, sorted
    weights: np.ndarray  # their weights
    bias: float
    slope: float
    offset: float
    plain: frozenset[str] | None = None  # words of which two neighbours aren't joined; None: no words are joined
    phrases: frozenset[tuple[str, str]] = frozenset()  # pairs that are joined in any case

    def table(self) -> np.ndarray:
        out = np.zeros(SIZE**4, np.float32)
        out[self.index] = self.weights
        return out

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))


def encode_units(units: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all units one after the other, with edge marks, and their n + 1 offsets."""
    marked = [f"^{u}$" for u in units]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    i = np.searchsorted(letters, points)
    i[i == len(letters)] = 0
    codes = np.where(letters[i] == points, i + 1, 0) if len(letters) else np.zeros(len(points))
    return codes.astype(np.int32), np.concatenate(([0], np.cumsum([len(m) for m in marked]))).astype(np.int64)


def _occurrences(codes: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each triple of steps: first positions, subsequence codes, weight; spans up to MAX_SPAN."""
    n = len(codes)
    end = np.repeat(off[1:], np.diff(off))
    for a in range(1, MAX_SPAN - 2):
        for b in range(1, MAX_SPAN - 1 - a):
            for c in range(1, MAX_SPAN - a - b):
                r = a + b + c
                if n <= r:
                    continue
                w, x, y, z = codes[: n - r], codes[a : n - b - c], codes[a + b : n - c], codes[r:]
                ok = np.flatnonzero((np.arange(r, n) < end[: n - r]) & (w > 0) & (x > 0) & (y > 0) & (z > 0))
                yield ok, ((w[ok] * SIZE + x[ok]) * SIZE + y[ok]) * SIZE + z[ok], DECAY ** (r + 1)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[off[1:]] - total[off[:-1]]


def subsequence_sums(coded: tuple[np.ndarray, np.ndarray], table: np.ndarray) -> np.ndarray:
    """Normalised sum of the table's weights over the subsequences of each unit."""
    codes, off = coded
    total, own = np.zeros(len(codes)), np.zeros(len(codes))
    for at, u, w in _occurrences(codes, off):
        total[at] += w * table[u]
        own[at] += w * w
    return _sums(total, off) / np.sqrt(np.maximum(_sums(own, off), 1e-12))


class Landmarks:
    """Kernel values between units and landmarks, through an index from subsequences to landmarks."""

    def __init__(self, units: list[str], letters: np.ndarray):
        self.letters, self.m = letters, len(units)
        codes, off = encode_units(units, letters)
        owner = np.repeat(np.arange(self.m), np.diff(off))
        found = [(u, owner[at], np.full(len(at), w)) for at, u, w in _occurrences(codes, off)]
        code, who, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        own = np.bincount(who, weight * weight, self.m)
        key, inverse = np.unique(code.astype(np.int64) * self.m + who, return_inverse=True)
        self.value = np.bincount(inverse, weight) / np.sqrt(np.maximum(own, 1e-12))[key % self.m]
        self.who = key % self.m
        self.code = key // self.m
        self.index, self.at = np.unique(self.code, return_index=True)
        self.at = np.append(self.at, len(key))

    def kernel(self, units: list[str]) -> np.ndarray:
        codes, off = encode_units(units, self.letters)
        owner = np.repeat(np.arange(len(units)), np.diff(off))
        out, own = np.zeros(len(units) * self.m), np.zeros(len(codes))
        for at, u, w in _occurrences(codes, off):
            own[at] += w * w
            i = np.searchsorted(self.index, u)
            i[i == len(self.index)] = 0
            good = self.index[i] == u
            i, row = i[good], owner[at[good]]
            size = self.at[i + 1] - self.at[i]
            flat = np.repeat(self.at[i] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out += np.bincount(np.repeat(row, size) * self.m + self.who[flat], w * self.value[flat], len(out))
        return out.reshape(-1, self.m) / np.sqrt(np.maximum(_sums(own, off), 1e-12))[:, None]

    def fold(self, alpha: np.ndarray) -> np.ndarray:
        """Weights of ``index`` such that sums over subsequences equal kernel values times ``alpha``."""
        return np.add.reduceat(self.value * alpha[self.who], self.at[:-1])


def text_units(text: str) -> list[str]:
    """The distinct units of a text."""
    words = text.lower().split()
    units = {w.strip(EDGE) for w in words}
    run: list[str] = []
    for w in [*words, "##"]:
        if len(w.strip(EDGE) or w) == 1 and w.strip(EDGE).isalpha():
            run.append(w.strip(EDGE))
            continue
        if len(run) >= 3:
            units.add("".join(run))
        run = []
    units.discard("")
    return sorted(units)


def text_words(text: str) -> list[str]:
    return [w.strip(EDGE) for w in text.lower().split()]


def joined_units(words: list[str], plain: frozenset[str], phrases: frozenset[tuple[str, str]]) -> set[str]:
    """Units of two neighbouring words."""
    return {a + b for a, b in zip(words, words[1:]) if a and b and ((a, b) in phrases or len(a) + len(b) <= MAX_JOIN and not (a in plain and b in plain))}


def _phrases(words: list[list[str]], y: np.ndarray, seen: list[Counter]) -> frozenset[tuple[str, str]]:
    """Pairs of neighbours that toxic texts surely have more often than clean ones, though neither word alone."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    sure = lambda p, n, by: float(np.log((p + 0.5) / (n1 + 1)) - np.log((n + 0.5) / (n0 + 1)) - by * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)))
    number = {w: i for i, w in enumerate(sorted({*seen[0], *seen[1]}))}
    names, k = list(number), len(number)
    codes: list[list[np.ndarray]] = [[], []]
    for ws, label in zip(words, y.tolist(), strict=True):
        i = np.array([number.get(w, -1) for w in ws], np.int64)
        codes[label].append(np.unique((i[:-1] * k + i[1:])[(i[:-1] >= 0) & (i[1:] >= 0)]))
    toxic, p = np.unique(np.concatenate(codes[1]), return_counts=True)
    clean, n = np.unique(np.concatenate(codes[0]), return_counts=True)
    out = []
    for code, count in zip(toxic[p > 2].tolist(), p[p > 2].tolist(), strict=True):
        at = int(np.searchsorted(clean, code))
        other = int(n[at]) if at < len(clean) and clean[at] == code else 0
        a, b = names[code // k], names[code % k]
        if sure(count, other, 3.0) > 0 and max(sure(seen[1][w], seen[0][w], 1.5) for w in (a, b)) <= 0:
            out.append((a, b))
    return frozenset(out)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Primal Newton steps for an L2-regularised squared-hinge SVM; the bias isn't penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za = z[active] * (c * weight[active])[:, None]
        new = np.linalg.solve(ridge + za.T @ z[active], za.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve by Newton steps with smoothed targets."""
    p, n = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = np.array([((q - t) * score).sum() + 1e-3 * a, (q - t).sum()])
        v = q * (1 - q)
        h = np.array([[(v * score * score).sum() + 1e-3, (v * score).sum()], [(v * score).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def fit(texts: list[tuple[str, int]], *, landmarks: int = 240, c: float = 4.0, rounds: int = 4, seed: int = 3) -> Model:
    """A model from (text, 1 for toxic or 0). With one class only, all scores are that class's share."""
    y = np.array([t for _, t in texts])
    if not len(texts) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99))
        return Model(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    bags = [text_units(t) for t, _ in texts]
    seen = [Counter(), Counter()]
    for bag, k in zip(bags, y.tolist(), strict=True):
        seen[k].update(bag)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    words = [text_words(t) for t, _ in texts]
    plain, phrases = frozenset(u for u, n in seen[0].items() if n > 1), _phrases(words, y, seen)
    near = []  # other pairs can be clean look-alikes only: what is toxic in them is one of the units
    for i, k in enumerate(y.tolist()):
        named = {a + b for a, b in zip(words[i], words[i][1:]) if (a, b) in phrases} - set(bags[i])
        bags[i] = sorted({*bags[i], *named})
        seen[k].update(named)
        near.append(sorted(joined_units(words[i], plain, frozenset()) - set(bags[i])))
    # evidence of a unit: that of its best part (four letters, or a longer beginning), so inflected forms share it; of a
    # part: the lower end of its log odds, so that neither rare accidents nor common words lead
    every = sorted({*seen[0], *seen[1]})

    def parts(u: str) -> set[str]:
        m = f"^{u}$"
        return {m[i : i + 4] for i in range(max(1, len(m) - 3))} | {m[:k] for k in range(5, 10)}

    held = [Counter(), Counter()]
    for bag, k in zip(bags, y.tolist(), strict=True):
        held[k].update(set().union(*map(parts, bag)) if bag else ())

    def low_odds(p: int, n: int) -> float:
        return float(np.log((p + 0.5) / (n1 + 1)) - np.log((n + 0.5) / (n0 + 1)) - 1.5 * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)))

    value = {p: low_odds(held[1][p], held[0][p]) for p in {*held[0], *held[1]}}
    lead = {u: max(value[p] for p in parts(u)) for u in every}
    # a unit that is no more common in toxic texts itself isn't toxic, whatever it looks like
    own = {u: float(np.log((seen[1][u] + 0.5) / (n1 + 1)) - np.log((seen[0][u] + 0.5) / (n0 + 1))) for u in every}
    by_lead = sorted((u for u in every if own[u] > 0.5), key=lambda u: (-lead[u], u))
    common = [u for u, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if lead[u] <= 0.5]
    # clean look-alikes of toxic units are landmarks and negatives, too
    alike = sorted((u for u in every if lead[u] > 1.0 and own[u] <= 0.5 and seen[0][u] > 1), key=lambda u: (-seen[0][u], u))
    chosen = [*by_lead[: landmarks // 2], *alike[: landmarks // 6]]
    chosen += common[: landmarks - len(chosen)]
    chosen = sorted(dict.fromkeys(chosen))
    counts = Counter(ch for bag in bags for u in bag for ch in u if ch.isalnum())
    top = sorted(counts, key=lambda ch: (-counts[ch], ch))[: SIZE - 3]
    letters = np.array(sorted({ord(ch) for ch in top} | {ord("^"), ord("$")}), np.uint32)
    marks = Landmarks(chosen, letters)
    values, vectors = np.linalg.eigh(marks.kernel(chosen))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K^(-1/2) up to a rotation
    step = 4000

    def mapped(units: list[str]) -> np.ndarray:
        return np.vstack([marks.kernel(units[i : i + step]) for i in range(0, len(units), step)]) @ root

    rng = np.random.default_rng(seed)
    toxic, clean = [b for b, k in zip(bags, y, strict=True) if k and b], [b for b, k in zip(bags, y, strict=True) if not k and b]
    negatives = {u for b in clean for u in rng.choice(b, min(len(b), 6), replace=False).tolist()}
    negatives |= set(alike)
    # a toxic text names its best units, first by evidence, then by the last fit
    score = lead
    pairs = sorted({u for b in near for u in b} - set(every))
    scored, step_of = [*every, *pairs], 50_000
    for turn in range(rounds):
        positives: Counter = Counter()
        for b in toxic:
            able = [u for u in b if own[u] > 1.5 and lead[u] > 0]
            if able:
                best = max(able, key=lambda u: (score[u], u))
                positives.update(u for u in able if u == best or lead[u] > 1.0 and score[u] > 0.6 * score[best] > 0)
        negatives |= {max(b, key=lambda u: (score[u], u)) for b in clean}
        if turn:
            negatives |= {max(b, key=lambda u: (score[u], u)) for b, k in zip(near, y, strict=True) if b and not k}
        negatives = {u for u in negatives if not positives[u]}
        # gapped, doubled and interrupted forms of the surest units count as toxic, too
        for u in sorted(positives, key=lambda u: (-positives[u], u))[:200]:
            if len(u) >= 4:
                k = len(u) // 2
                for v in (".".join(u), u[:k] + "-" + u[k:], u[:k] + u[k - 1] + u[k:], u[:k] + "x" + u[k:]):
                    positives[v] = max(positives[v], 1)
        units = [*sorted(positives), *sorted(negatives)]
        label = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        size = np.array([float(np.sqrt(positives[u])) for u in sorted(positives)] + [min(3.0, float(np.sqrt(max(1, seen[0][u])))) for u in sorted(negatives)])
        w, bias = _svm(mapped(units), label, size, c)
        model = Model(letters, marks.index, marks.fold(root @ w), bias, 1.0, 0.0, plain, phrases)
        table, score = model.table(), {}
        for i in range(0, len(scored), step_of):
            part = scored[i : i + step_of]
            score.update(zip(part, (subsequence_sums(encode_units(part, letters), table) + bias).tolist(), strict=True))
    best = np.array([max((score[u] for u in (*b, *more)), default=_EMPTY) for b, more in zip(bags, near, strict=True)])
    model.slope, model.offset = _logistic(best, y)
    return model


#: Unit score of a text without units.
_EMPTY = -3.0
KNOWN_LIMIT = 500_000


class _Scorer:
    """Highest unit score of each text; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model, self.table = model, model.table()
        self.words, self.scores = pa.array([], pa.string()), np.zeros(0)
        self.plain = None if model.plain is None else pa.array(sorted(model.plain), pa.string())
        self.phrase_words = pa.array(sorted({w for p in model.phrases for w in p}), pa.string())
        number = {w: i for i, w in enumerate(self.phrase_words.to_pylist())}
        self.phrases = np.array(sorted(number[a] * len(number) + number[b] for a, b in model.phrases), np.int64)

    def units(self, units: list[str]) -> np.ndarray:
        return subsequence_sums(encode_units(units, self.model.letters), self.table) + self.model.bias

    def _score(self, new: pa.Array) -> np.ndarray:
        """Scores of words; a word with other characters inside also counts without them."""
        score = np.where(pc.match_substring_regex(new, r"[\pL\pN]").to_numpy(zero_copy_only=False), self.units(new.to_pylist()), _EMPTY)
        mixed = np.flatnonzero(pc.match_substring_regex(new, r"[\pL\pN][^\pL\pN]+[\pL\pN]").to_numpy(zero_copy_only=False))
        if len(mixed):
            bare = pc.replace_substring_regex(new.take(pa.array(mixed)), r"[^\pL\pN]+", "")
            score[mixed] = np.maximum(score[mixed], self.units(bare.to_pylist()))
        return score

    def known(self, words: pa.Array) -> np.ndarray:
        """Scores of distinct words, kept for later batches."""
        where = pc.index_in(words, value_set=self.words)
        if where.null_count:
            if len(self.words) + where.null_count > KNOWN_LIMIT:
                self.words, self.scores = pa.array([], pa.string()), np.zeros(0)
                where = pa.nulls(len(words), pa.int32())
            new = words.filter(pc.is_null(where))
            self.words = pa.concat_arrays([self.words, new])
            self.scores = np.concatenate([self.scores, self._score(new)])
            where = pc.index_in(words, value_set=self.words)
        return self.scores[where.to_numpy()]

    def joined(self, words: pa.Array, code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and scores of the units of two neighbours; ``code``: numbers in ``words`` of all words in order."""
        inside = np.ones(len(code) + 1, bool)
        inside[off] = False
        size = pc.utf8_length(words).to_numpy()
        plain = pc.is_in(words, value_set=self.plain).to_numpy(zero_copy_only=False)
        a, b = code[:-1], code[1:]
        take = ~(plain[a] & plain[b]) & (size[a] + size[b] <= MAX_JOIN)
        if len(self.phrases):
            w = pc.fill_null(pc.index_in(words, value_set=self.phrase_words), -1).to_numpy().astype(np.int64)
            take |= (w[a] >= 0) & (w[b] >= 0) & np.isin(w[a] * len(self.phrase_words) + w[b], self.phrases)
        at = np.flatnonzero(take & inside[1:-1] & (size[a] > 0) & (size[b] > 0))
        pair, which = np.unique(a[at].astype(np.int64) * len(words) + b[at], return_inverse=True)
        each = np.full(len(pair), _EMPTY)
        for i in range(0, len(pair), KNOWN_LIMIT // 5):
            part = pair[i : i + KNOWN_LIMIT // 5]
            text = pc.binary_join_element_wise(words.take(pa.array(part // len(words))), words.take(pa.array(part % len(words))), "").dictionary_encode()
            each[i : i + len(part)] = self.known(text.dictionary)[text.indices.to_numpy()]
        return np.searchsorted(off, at, side="right") - 1, each[which]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        chunks = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.string())))
        off = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1, chunks.offset * 4).astype(np.int64)
        off -= off[0]
        words = pc.utf8_trim(chunks.flatten(), characters=EDGE)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        each = self.known(coded.dictionary)[code] if len(words) else np.zeros(0)
        best = np.full(len(texts), _EMPTY)
        some = np.flatnonzero(off[1:] > off[:-1])
        if len(some):
            best[some] = np.maximum.reduceat(each, off[some])
        if self.plain is not None and len(code) > 1:
            np.maximum.at(best, *self.joined(coded.dictionary, code, off))
        single = pc.equal(pc.utf8_length(words), 1).to_numpy(zero_copy_only=False)
        if single.any():
            # runs of one-letter words within a text
            border = np.zeros(len(single) + 1, bool)
            border[off] = True
            start = single & ~np.concatenate(([False], single[:-1] & ~border[1:-1]))
            at = np.flatnonzero(start)
            stop = np.flatnonzero(single & ~np.concatenate((single[1:] & ~border[1:-1], [False]))) + 1
            long_ = stop - at >= 3
            if long_.any():
                units = ["".join(words.slice(a, b - a).to_pylist()) for a, b in zip(at[long_].tolist(), stop[long_].tolist(), strict=True)]
                owner = np.searchsorted(off, at[long_], side="right") - 1
                np.maximum.at(best, owner, np.where([u.isalpha() for u in units], self.units(units), _EMPTY))
        return best


def _score(text_col: str, box, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(box.value)
        for whole in batches:
            for batch in pieces(whole, text_col, 4 << 20):
                p = box.value.probability(scorer(batch.column(batch.schema.get_field_index(text_col))))
                columns = [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    return tidy(run)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000, class_bytes: int = 32 << 20) -> Model:
    """Fit on at most ``per_class`` texts and ``class_bytes`` bytes of each class, none of them held out. Null labels, ids and texts are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = None
    for k in (1, 0):
        part = known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # 2 * per_class rows of two numbers, so the sample may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").where("text is not null")
    # one text for each id, the shortest, so that the window below has 2 * per_class rows at most, however often ids repeat
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(F.octet_length("text"), "text")).alias("least")).select("id", "label", "least.text")
    # whole texts, the shortest first, as far as the bytes go, so that a long text takes no other's place; the driver holds
    # no more than that, or the shortest text of a class
    order = Window.partitionBy("label").orderBy(F.octet_length("text"), F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumns({"bytes": F.sum(F.octet_length("text")).over(order), "nth": F.count("*").over(order)})
    rows = sized.where((F.col("bytes") <= class_bytes) | (F.col("nth") == 1)).collect()
    rows.sort(key=lambda r: (r.id, r.text))
    return fit([(r.text, r.label) for r in rows])


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on) added, replacing such columns.

    Null, empty and wordless texts get the score of no evidence; very long texts are scored whole; repeated rows get
    equal scores; a score at the threshold (a tie) predicts 1; an empty table gives no rows. Columns besides these pass
    through.
    """
    docs = docs.drop("score", "predicted").withColumn(text_col, F.col(text_col).cast("string"))
    box = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score(text_col, box, threshold), schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
