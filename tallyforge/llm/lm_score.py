"""Language-model scoring: a gated recurrent network with a class-factored softmax, trained in numpy.

Tokens are the lower-cased words of a text and one end. The WORDS most frequent ones of the training documents are
symbols of their own, in classes of WORDS_IN_CLASS by rank; every other word belongs to one of RARE classes by its
spelling, within which its probability is its smoothed share of the class's count. So the whole vocabulary, however
large, has a proper distribution: P(class | state), then P(word | class, state) or the share.

Counts cover all training documents, and the network reads each of them once: a hash of the id deals them to ROUNDS
rounds, and in a round every task runs truncated backpropagation over its partition's documents from the weights so
far, and the results are averaged by tokens. So the score, unlike the base figures, varies with how rows lie in
partitions, within the noise of training; a lost executor's tasks give the same weights again.
Scoring runs documents in lanes, with the state carried from window to window to a document's end.

Defined results: null or empty text is one end token; a null id belongs to no fold and is read as training; rows that
repeat an id are scored one by one; without training documents every count is 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import HashIndex, batch_runs, checkpointed, mix64

WORDS, WORDS_IN_CLASS, RARE, HIDDEN = 4096, 64, 64, 16
CLASSES, RARE_BITS = WORDS // WORDS_IN_CLASS + RARE, 6
START = WORDS + RARE
#: Most frequent words whose counts all tasks are told (24 bytes each); the counts of others are joined.
TOLD = 1 << 18
#: Rounds of training, least steps of a window of backpropagation, and the most where few lanes are left.
ROUNDS, WINDOW, LONGEST = 4, 16, 512
#: Symbols for each lane of training, and the least and most lanes.
LANE, TRAIN_LANES = 1200, (32, 512)
#: Learning rate of the first round, and the bound of a score before exp.
RATE, LOGIT = 0.06, 60.0
#: Rows of states scored at a time.
BLOCK = 1024
#: Most models trained side by side in a round; more partitions than that are read several to a task.
MODELS = 4096
#: Lanes and window of scoring, and tokens gathered before lanes are filled.
LANES, CHUNK, GATHER = 384, 64, 1_500_000
END_HASH = int(mix64(np.array([0xE0D], np.uint64))[0])


# --- network ------------------------------------------------------------------------------------------------------


class Lanes:
    """Documents dealt to lanes, longest first to the shortest lane; lanes are in order of length, longest first."""

    def __init__(self, sizes: np.ndarray, lanes: int):
        heap = [(0, k) for k in range(lanes)]
        own: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-sizes, kind="stable").tolist():
            n, k = heap[0]
            own[k].append(d)
            heapq.heapreplace(heap, (n + int(sizes[d]), k))
        total = {k: n for n, k in heap}
        order = sorted((k for k in range(lanes) if own[k]), key=lambda k: -total[k])
        self.docs = np.array([d for k in order for d in own[k]], np.int64)
        self.size = np.array([total[k] for k in order], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def flat(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols lane by lane, the symbol before each (START at a document's begin), and where documents begin."""
        target = np.concatenate([docs[d] for d in self.docs])
        starts = np.cumsum([0, *(len(docs[d]) for d in self.docs[:-1])])
        before = np.empty_like(target)
        before[1:] = target[:-1]
        before[starts] = START
        return target, before, starts

    def windows(self, least: int, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (steps, active lanes) of each window, and which are within their lane.

        A window has `least` steps, and more where few lanes are left, up to about `symbols` symbols.
        """
        top, t = (int(self.size[0]) if len(self.size) else 0), 0
        while t < top:
            active = int(np.searchsorted(-self.size, -t, "left"))
            n = min(max(least, min(symbols // active, LONGEST)), top - t)
            steps = t + np.arange(n)[:, None]
            yield self.begin[:active] + steps, steps < self.size[:active]
            t += n


class Gru:
    """Gates z and r are kept at half scale: a logistic function is then one tanh."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {
            "x": rng.normal(0, 0.3, (START + 1, 3 * h)),
            "u": rng.normal(0, 0.25, (h, 3 * h)),
            "c": rng.normal(0, 0.05, (h, CLASSES)),
            "cb": np.zeros(CLASSES),
            "w": rng.normal(0, 0.05, (WORDS, h)),
            "wb": np.zeros(WORDS),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.steps, self.m, self.v = 0, {}, {}

    def start_from(self, words: np.ndarray, rare: np.ndarray) -> None:
        """Output biases that give the unigram distribution; words without a count are ruled out."""
        mass = np.zeros(WORDS)
        mass[: len(words)] = words
        of_class = np.concatenate((mass.reshape(-1, WORDS_IN_CLASS).sum(1), rare + 0.1))
        with np.errstate(divide="ignore"):
            self.p["cb"] = np.maximum(np.log(of_class / of_class.sum()), -LOGIT).astype(np.float32)
            of_word = np.repeat(of_class[: WORDS // WORDS_IN_CLASS], WORDS_IN_CLASS)
            self.p["wb"] = np.maximum(np.log(mass / np.maximum(of_word, 1)), -LOGIT).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def states(self, before: np.ndarray, h: np.ndarray, memo: dict | None = None) -> np.ndarray:
        """States after each step (steps, lanes); a lane's state is cleared where a document begins."""
        n = HIDDEN
        u, fed = self.p["u"], self.p["x"][before]
        out = np.empty((*before.shape, n), np.float32)
        fresh = before == START
        clears = fresh.any(1).tolist()
        if memo is not None:
            old, gates, inner, newer = np.empty_like(out), np.empty((*before.shape, 2 * n), np.float32), np.empty_like(out), np.empty_like(out)
            memo.update(old=old, gates=gates, inner=inner, new=newer, fresh=fresh, clears=clears)
        for t in range(len(before)):
            if clears[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            b, a = h @ u, fed[t]
            g = np.add(a[:, : 2 * n], b[:, : 2 * n], out=None if memo is None else gates[t])
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            c = b[:, 2 * n :]
            if memo is not None:
                old[t], inner[t] = h, c
            new = g[:, n:] * c
            new += a[:, 2 * n :]
            np.tanh(new, out=new)
            if memo is not None:
                newer[t] = new
            h = h - new
            h *= g[:, :n]
            h = np.add(h, new, out=out[t])
        return out

    def log_probabilities(self, states: np.ndarray, target: np.ndarray, grad: dict | None = None):
        """Natural log probability of each target symbol, given rows of states; with grad, also what flows back.

        Scores are held within LOGIT of 0, so that no maximum need be taken out of them before exp; states lie within 1,
        so where weights and bias cannot sum to more they are within it anyway. Rows are taken BLOCK at a time through
        the same buffers, which stay in a core's cache.
        """
        p, n = self.p, len(target)
        word = target < WORDS
        of = np.where(word, target // WORDS_IN_CLASS, target - WORDS + WORDS // WORDS_IN_CLASS)
        each, ones = np.arange(BLOCK), np.ones(CLASSES, np.float32)
        wide = np.ones((n, HIDDEN + 1), np.float32)
        wide[:, :-1] = states
        c = np.concatenate((p["c"], p["cb"][None]))
        w = np.concatenate((p["w"], p["wb"][:, None]), axis=1)
        far_class = bool(np.abs(c).sum(0).max() > LOGIT - 1)
        far_word = (np.abs(w).sum(1).reshape(-1, WORDS_IN_CLASS).max(1) > LOGIT - 1).tolist()
        out, held = np.empty(n, np.float32), np.empty((BLOCK, CLASSES), np.float32)
        d_states = None
        if grad is not None:
            d_states, d_c, d_w = np.empty((n, HIDDEN), np.float32), np.zeros_like(c), np.zeros_like(w)
            turned = np.ascontiguousarray(p["c"].T)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            scores = np.matmul(wide[a:b], c, out=held[: b - a])
            if far_class:
                np.clip(scores, -LOGIT, LOGIT, out=scores)
            at = (each[: b - a], of[a:b])
            picked = scores[at]
            np.exp(scores, out=scores)
            total = scores @ ones
            np.subtract(picked, np.log(total), out=out[a:b])
            if grad is not None:
                # What is left of probabilities, times the total, which is divided out of the narrow side.
                scores[at] -= total
                part = (1 / total)[:, None]
                d_c += (wide[a:b] * part).T @ scores
                np.multiply(scores @ turned, part, out=d_states[a:b])
        rows = np.flatnonzero(word)
        rows = rows[np.argsort(of[rows].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(of[rows], np.arange(WORDS // WORDS_IN_CLASS + 1)).tolist()
        ordered, place = wide[rows], target[rows] % WORDS_IN_CLASS
        found = np.empty(len(rows), np.float32)
        flow = None if grad is None else np.empty((len(rows), HIDDEN), np.float32)
        held = np.empty((BLOCK, WORDS_IN_CLASS), np.float32)
        for k in range(WORDS // WORDS_IN_CLASS):
            span = slice(k * WORDS_IN_CLASS, (k + 1) * WORDS_IN_CLASS)
            for a in range(cuts[k], cuts[k + 1], BLOCK):
                b = min(cuts[k + 1], a + BLOCK)
                inner = np.matmul(ordered[a:b], w[span].T, out=held[: b - a])
                if far_word[k]:
                    np.clip(inner, -LOGIT, LOGIT, out=inner)
                at = (each[: b - a], place[a:b])
                own = inner[at]
                np.exp(inner, out=inner)
                total = inner @ ones[:WORDS_IN_CLASS]
                np.subtract(own, np.log(total), out=found[a:b])
                if grad is not None:
                    inner[at] -= total
                    part = (1 / total)[:, None]
                    d_w[span] += inner.T @ (ordered[a:b] * part)
                    np.multiply(inner @ p["w"][span], part, out=flow[a:b])
        out[rows] += found
        if grad is not None:
            d_states[rows] += flow
            grad["c"], grad["cb"] = d_c[:-1], d_c[-1]
            grad["w"], grad["wb"] = np.ascontiguousarray(d_w[:, :-1]), np.ascontiguousarray(d_w[:, -1])
        return out, d_states

    def back(self, before: np.ndarray, memo: dict, out: np.ndarray, d_out: np.ndarray, grad: dict) -> None:
        """Gradients of u and x from those of the states; only what follows the state goes step by step."""
        n = HIDDEN
        turned = np.ascontiguousarray(self.p["u"].T)
        old, inner = memo["old"], memo["inner"]
        z, r = memo["gates"][..., :n], memo["gates"][..., n:]
        new = memo["new"]
        to_new = (1 - z) * (1 - new * new)
        # Half scale: the derivative of a gate by its stored sum is twice z * (1 - z).
        to_z = 2 * (old - new) * z * (1 - z)
        to_r = 2 * inner * r * (1 - r)
        flow = np.empty((*before.shape, 3 * n), np.float32)
        fed = np.empty_like(flow)
        dh = np.zeros_like(d_out[0])
        for t in range(len(before) - 1, -1, -1):
            dh += d_out[t]
            f = flow[t]
            d_new = np.multiply(dh, to_new[t], out=fed[t][:, 2 * n :])
            np.multiply(dh, to_z[t], out=f[:, :n])
            np.multiply(d_new, to_r[t], out=f[:, n : 2 * n])
            np.multiply(d_new, r[t], out=f[:, 2 * n :])
            dh *= z[t]
            dh += f @ turned
            if memo["clears"][t]:
                dh[memo["fresh"][t]] = 0
        fed[..., : 2 * n] = flow[..., : 2 * n]
        grad["u"] = old.reshape(-1, n).T @ flow.reshape(-1, 3 * n)
        grad["x"] = np.zeros_like(self.p["x"])
        rows = before.ravel()
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        grad["x"][ordered[heads]] = np.add.reduceat(fed.reshape(-1, 3 * n)[order], heads)

    def score(self, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
        """Natural log probability of each document's symbols."""
        if not docs:
            return np.zeros(0)
        deal = Lanes(np.array([len(d) for d in docs]), lanes)
        target, before, starts = deal.flat(docs)
        logs = np.empty(len(target), np.float32)
        h = np.zeros((len(deal.size), HIDDEN), np.float32)
        for places, within in deal.windows(CHUNK, CHUNK * lanes):
            inside = np.where(within, before[np.minimum(places, len(before) - 1)], 0)
            out = self.states(inside, h[: places.shape[1]])
            h = out[-1]
            rows = out[within]
            logs[places[within]], _ = self.log_probabilities(rows, target[places[within]])
        sums = np.add.reduceat(logs.astype(np.float64), starts)
        result = np.empty(len(docs))
        result[deal.docs] = sums
        return result

    def fit(self, docs: list[np.ndarray], rate: float) -> int:
        """One pass of truncated backpropagation over whole documents with Adam; the number of symbols read.

        The state runs on from window to window to a document's end, however long it is. The number of lanes follows
        the symbols at hand, so that small and large tasks make about as many steps.
        """
        sizes = np.array([len(d) for d in docs])
        deal = Lanes(sizes, int(np.clip(sizes.sum() // LANE, *TRAIN_LANES)))
        target, before, _ = deal.flat(docs)
        h = np.zeros((len(deal.size), HIDDEN), np.float32)
        for places, within in deal.windows(WINDOW, WINDOW * len(deal.size)):
            h, grad = self.window_gradient(places, within, target, before, h)
            self.update(grad, int(within.sum()), rate)
        return len(target)

    def update(self, grad: dict, n: int, rate: float) -> None:
        self.steps += 1
        up, down = 1 / (1 - 0.9**self.steps), 1 / (1 - 0.98**self.steps)
        for k, g in grad.items():
            g = g * np.float32(1 / n)
            np.clip(g, -0.05, 0.05, out=g)
            m, v = self.m.setdefault(k, np.zeros_like(g)), self.v.setdefault(k, np.zeros_like(g))
            m *= 0.9
            m += 0.1 * g
            g *= g
            v *= 0.98
            v += 0.02 * g
            np.multiply(v, down, out=g)
            np.sqrt(g, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= rate * up
            self.p[k] -= g

    def window_gradient(self, places, within, target, before, h):
        memo: dict = {}
        inside = np.where(within, before[np.minimum(places, len(before) - 1)], 0)
        out = self.states(inside, h[: places.shape[1]], memo)
        grad: dict = {}
        _, d_rows = self.log_probabilities(out[within], target[places[within]], grad)
        d_out = np.zeros_like(out)
        d_out[within] = d_rows
        self.back(inside, memo, out, d_out, grad)
        return out[-1], grad


# --- corpus -------------------------------------------------------------------------------------------------------


def rare_class(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Class of a word by its spelling: a hash of its last three bytes (fewer, if it is shorter), A-Z lower-cased.

    Endings tell languages, kinds of words and closing marks apart.
    """
    folded = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    key = np.zeros(len(stops), np.uint64)
    for k in range(1, 4):
        key = key << np.uint64(8) | np.where(stops - k >= starts, folded[np.maximum(stops - k, 0)] if len(raw) else 0, 0).astype(np.uint64)
    return (mix64(key) >> np.uint64(64 - RARE_BITS)).astype(np.int64)


def _hash_runs(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: word hashes, rare classes, and the first word's place of each text and one beyond."""
    for raw, starts, stops, hashes, places in batch_runs(column):
        yield hashes, rare_class(raw, starts, stops), places


def training(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 != 0, F.lit(True))


def token_counts(docs: DataFrame) -> DataFrame:
    """(k, c): count of each word key in the training documents; ends are not counted here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["k", "c"])

        for batch in batches:
            for hashes, rare, _ in _hash_runs(batch.column(0)):
                held.append(word_key(hashes, rare))
                size += len(hashes)
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.where("training").select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def word_key(hashes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """58 bits of a word's hash, and its rare class, which depends on the word alone."""
    return hashes >> np.uint64(RARE_BITS) << np.uint64(RARE_BITS) | rare.astype(np.uint64)


class Vocabulary:
    """What tasks are told: keys and counts of the most frequent words, and totals."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int, of_rare: np.ndarray, distinct_rare: np.ndarray, ends: int):
        self.end = np.uint64(END_HASH >> RARE_BITS << RARE_BITS)
        if ends:
            keys, counts = np.append(keys, self.end), np.append(counts, ends)
        order = np.lexsort((keys, -counts))
        self.keys, self.counts = keys[order], counts[order]
        self.index = HashIndex(self.keys)
        self.total, self.distinct = total + ends, distinct + (ends > 0)
        explicit = self.keys[:WORDS]
        rare = (explicit & np.uint64(RARE - 1)).astype(np.int64)
        own = explicit != self.end
        self.rare_total = of_rare - np.bincount(rare[own], self.counts[:WORDS][own], RARE)
        self.rare_distinct = distinct_rare - np.bincount(rare[own], minlength=RARE)
        self.log_all = np.log10(self.total + 0.1 * (self.distinct + 1))
        self.log_rare = np.log10(self.rare_total + 0.1 * (self.rare_distinct + 1))

    def symbols(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each key, and its place among the words told (-1: not told)."""
        place = self.index(keys)
        rare = WORDS + (keys & np.uint64(RARE - 1)).astype(np.int64)
        return np.where((place >= 0) & (place < WORDS), place, rare).astype(np.int16), place


def vocabulary(docs: DataFrame, counts: DataFrame) -> Vocabulary:
    """counts: (k, c), materialised. At most TOLD of its rows reach the driver."""
    rare = F.col("k").bitwiseAND(F.lit(RARE - 1).cast("long"))
    sums = counts.groupBy(rare.alias("r")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    of_rare, distinct_rare = np.zeros(RARE), np.zeros(RARE)
    for r in sums:
        of_rare[r.r], distinct_rare[r.r] = r.n, r.v
    bits = {r.b: r.n for r in counts.groupBy(F.floor(4 * F.log2("c")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, kept = None, 0
    for b in sorted(bits, reverse=True):
        if kept + bits[b] > TOLD and kept >= WORDS:
            break
        least, kept = b, kept + bits[b]
    if kept > 4 * TOLD:  # more equal counts than may be told: the words of least hash, the others are joined
        found = counts.orderBy(F.desc("c"), "k").limit(TOLD).toPandas()
    else:
        found = counts.where(F.floor(4 * F.log2("c")) >= (least or 0)).toPandas()
    ends = docs.where("training").count()
    keys = found["k"].to_numpy(np.int64).view(np.uint64)
    return Vocabulary(keys, found["c"].to_numpy(np.int64), int(of_rare.sum()), int(distinct_rare.sum()), of_rare, distinct_rare, ends)


def _symbol_docs(column, vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, symbols and places told of each text's tokens, its end included."""
    end_symbol, end_place = vocab.symbols(np.array([vocab.end]))
    if end_place[0] < 0:
        end_symbol[:] = WORDS
    for hashes, rare, cuts in _hash_runs(column):
        keys = word_key(hashes, rare)
        symbols, places = vocab.symbols(keys)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.append(keys[a:b], vocab.end), np.append(symbols[a:b], end_symbol), np.append(places[a:b], end_place)


def train(docs: DataFrame, told) -> Gru:
    """A network of the training documents; told: broadcast Vocabulary."""
    spark = docs.sparkSession
    vocab = told.value
    model = Gru()
    model.start_from(vocab.counts[:WORDS], np.maximum(vocab.rare_total, 0))
    for k in range(ROUNDS):
        weights = spark.sparkContext.broadcast(model.flat())
        rate = RATE / (1 + k)

        def run(batches: Iterator[pa.RecordBatch], weights=weights, rate=rate) -> Iterator[pa.RecordBatch]:
            own, n, held, size = Gru().load(weights.value), 0, [], 0
            for batch in batches:
                for _, symbols, _ in _symbol_docs(batch.column(0), told.value):
                    held.append(symbols)
                    size += len(symbols)
                if size > GATHER:
                    n += own.fit(held, rate)
                    held, size = [], 0
            if held:
                n += own.fit(held, rate)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([own.flat().tolist()], pa.list_(pa.float32()))], names=["n", "w"])

        part = docs.where("training").where(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == k)
        each = part.select("text").coalesce(MODELS).mapInArrow(run, "n long, w array<float>").select("n", F.posexplode("w").alias("i", "x"))
        mean = each.groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).toPandas()
        if len(mean):
            model.load(mean.sort_values("i")["x"].to_numpy())
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), training(id_col).alias("training"))
    counts = checkpointed(token_counts(source))
    told = docs.sparkSession.sparkContext.broadcast(vocabulary(source, counts))
    weights = docs.sparkSession.sparkContext.broadcast(train(source, told).flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = told.value, Gru().load(weights.value)
        logs = np.append(np.log10(vocab.counts + 0.1), 0.0)
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            scores = model.score(held) / np.log(10)
            out = [(*r[:5], r[5] + s, r[6]) for r, s in zip(rows, scores.tolist(), strict=True)]
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
            names = ["doc_id", "held_out", "n_tokens", "n_told", "base", "model", "others"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            meta = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _symbol_docs(batch.column(1), vocab), strict=True)
            for doc, in_training, (keys, symbols, places) in meta:
                own = logs[places]
                rare = symbols >= WORDS
                base = float(own.sum()) - len(keys) * vocab.log_all
                share = float(own[rare].sum()) - float(vocab.log_rare[symbols[rare] - WORDS].sum())
                others = keys[places < 0].view(np.int64)
                rows.append((doc, not in_training, len(keys), int((places >= 0).sum()), base, share, others))
                held.append(symbols)
                size += len(symbols)
                if size > GATHER:
                    yield flush()
                    rows, held, size = [], [], 0
        if rows:
            yield flush()

    scored = source.select("id", "text", "training").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_told long, base double, model double, others array<long>"
    )
    scored = checkpointed(scored.withColumn("row", F.monotonically_increasing_id()))
    rest = scored.select("row", F.explode("others").alias("k")).join(counts, "k", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("s"), F.count("c").alias("n"))
    whole = scored.join(rest, "row", "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_told") + F.coalesce("n", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(told.value.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
