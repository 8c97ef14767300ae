"""Gated recurrent language model over words, with a class-factored output.

Counts of all words of the training documents are gathered by a shuffle. The most frequent VOCABULARY - 2 words, the end of a text
and one symbol for all other words are what the recurrent model predicts: first the symbol's class, then the symbol within its
class; the symbol for all other words is a class of its own. Another word's probability is that of this symbol times the word's
add-one share among such words, so that the probabilities of all words and of one unseen word sum to 1.

Training is truncated back-propagation in numpy: each task runs once through all of its training documents, from the same start.
Documents are laid end to end in lanes; a lane's state is carried from window to window and starts anew with each document. The
tasks' parameters, weighted by their tokens, are then averaged over a tree of partial sums, in a fixed order: the model depends on how
the input is split into tasks, and on nothing else. Scoring carries the state through each complete document too.

Counts of the KEPT most frequent words, a fixed number, are broadcast; counts of all other words meet their texts in a join.

Defined cases: a null or empty text is its end alone; a null doc_id counts as the text '' for the fold; without training documents
all counts are 0 and the model is uniform; each row has a row of its own in the result, whatever its doc_id; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, id_text, let_go, slices, stored

VOCABULARY, CLASSES, HIDDEN = 1024, 32, 16
LANES, STEPS, RATE, CLIP = 512, 16, 0.02, 5.0
#: How long the means of gradients and of their squares remember.
FIRST, SECOND = 0.9, 0.99
#: Tokens of a window at least, where few lanes are left.
LEAST_TOKENS = 1024
#: The most frequent words whose counts are broadcast, at most so many.
KEPT = 100_000
#: Rows of slices' word counts that a task adds up before it hands them on.
MOST_COUNTED = 600_000
#: Tokens of documents that are laid out in lanes together.
BLOCK = 1 << 21
END, OTHER = 0, VOCABULARY - 1
#: Symbols of a class but that of OTHER, and rows of one class that go through its weights together.
PER_CLASS, TILE = -(-OTHER // (CLASSES - 1)), 32
#: The class of each symbol.
CLASS = np.append(np.arange(OTHER) % (CLASSES - 1), CLASSES - 1).astype(np.int8 if CLASSES < 128 else np.int16)
#: Logits are held within this, so that sums of exponentials stay finite without a maximum for each row.
LOGIT = 60.0


class Model:
    """Parameters: G (what a symbol adds to the three gates, by gate), U (what the state adds), and the output's
    class and word weights. Symbol s is number s // (CLASSES - 1) of class s % (CLASSES - 1); OTHER is the last class."""

    def __init__(self, unigram: np.ndarray):
        rng, h = np.random.default_rng(3), HIDDEN
        share = (unigram + 0.5) / (unigram + 0.5).sum()
        by_class = np.zeros((CLASSES - 1, PER_CLASS))
        by_class[np.arange(OTHER) % (CLASSES - 1), np.arange(OTHER) // (CLASSES - 1)] = share[:OTHER]
        within = by_class / by_class.sum(1, keepdims=True)
        self.p = {
            "G": rng.normal(0, 0.3, (VOCABULARY, 3 * h)), "U": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            "Wc": rng.normal(0, 0.1, (h, CLASSES)), "bc": np.log(np.append(by_class.sum(1), share[OTHER])),
            "Wo": rng.normal(0, 0.1, (CLASSES - 1, h, PER_CLASS)), "bo": np.where(within > 0, np.log(np.maximum(within, 1e-30)), -LOGIT),
        }
        for k in ("G", "U"):  # by gate, so that each gate's numbers lie side by side
            self.p[k] = self.p[k].reshape(-1, 3, h).transpose(1, 0, 2)
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> "Model":
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def gates(self, x: np.ndarray, go_on: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """States after each of the inputs x (steps, lanes) from the state h, the last of them, and what backward() needs. go_on is 0 where
        a document begins."""
        u, half = self.p["U"], np.float32(0.5)
        gx, begins = np.take(self.p["G"], x, axis=1), go_on[:, :, 0] == 0
        out, held = np.empty((*x.shape, HIDDEN), np.float32), []
        for t in range(len(x)):
            if begins[t].any():
                h = h.copy()
                h[begins[t]] = 0
            hu = np.matmul(h, u)
            zr = hu[:2]
            zr += gx[:2, t]
            zr *= half  # the logistic function by way of tanh
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            z, r, hn = zr[0], zr[1], hu[2]
            new = r * hn
            new += gx[2, t]
            np.tanh(new, out=new)
            if keep:
                held.append((h, z, r, new, hn))
            h = np.subtract(h, new, out=out[t])
            h *= z
            h += new
        return out, h, held

    def output(self, s: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the symbols y after the states s; with grad, also the states' gradient of minus their sum. Rows go
        through their class's weights in tiles, all tiles at once."""
        s, c = np.ascontiguousarray(s), CLASS[y]
        logits = s @ self.p["Wc"]
        logits += self.p["bc"]
        np.clip(logits, -LOGIT, LOGIT, out=logits)
        rows = np.arange(len(y))
        logp = logits[rows, c]
        e = np.exp(logits, out=logits)
        total = e @ np.ones(CLASSES, e.dtype)
        logp -= np.log(total)
        ds = None
        if grad is not None:
            e /= total[:, None]
            e[rows, c] -= 1
            ds = e @ self.p["Wc"].T
            grad["Wc"] += s.T @ e
            grad["bc"] += np.ones(len(e), e.dtype) @ e
        order = np.argsort(c, kind="stable")
        times = np.bincount(c, minlength=CLASSES)[: CLASSES - 1]
        order = order[: times.sum()]
        if not len(order):
            return logp, ds
        tiles = -(-times // TILE)
        first = np.cumsum(tiles) - tiles
        place = np.arange(len(order)) + np.repeat(first * TILE - (np.cumsum(times) - times), times)  # where each row is in the tiles
        of = np.repeat(np.arange(CLASSES - 1), tiles)
        st = np.zeros((len(of) * TILE, HIDDEN), np.float32)
        st[place] = s[order]
        st = st.reshape(len(of), TILE, HIDDEN)
        w = self.p["Wo"][of]
        a = st @ w
        a += self.p["bo"][of][:, None, :]
        np.clip(a, -LOGIT, LOGIT, out=a)
        flat, k = a.reshape(-1, PER_CLASS), y[order] // (CLASSES - 1)
        own = flat[place, k]
        e = np.exp(flat, out=flat)
        total = e @ np.ones(PER_CLASS, e.dtype)
        logp[order] += own - np.log(total[place])
        if grad is not None:
            scale = np.zeros(len(e), np.float32)
            scale[place] = 1 / total[place]
            e *= scale[:, None]
            e[place, k] -= 1
            e = e.reshape(a.shape)
            ds[order] += (e @ w.transpose(0, 2, 1)).reshape(-1, HIDDEN)[place]
            some = np.flatnonzero(tiles)
            grad["Wo"][some] += np.add.reduceat(st.transpose(0, 2, 1) @ e, first[some], axis=0)
            grad["bo"][some] += np.add.reduceat(e.sum(1), first[some], axis=0)
        return logp, ds

    def backward(self, x: np.ndarray, go_on: np.ndarray, held: list, dout: np.ndarray, grad: dict) -> None:
        back = self.p["U"][[2, 0, 1]].transpose(0, 2, 1).copy()
        d = np.empty((4, *x.shape, HIDDEN), np.float32)  # of the new state's part in U, of z, of r, of the new state's part in G
        dh, begins = np.zeros_like(dout[0]), go_on[:, :, 0] == 0
        for t in range(len(x) - 1, -1, -1):
            h, z, r, new, hn = held[t]
            dr, dz, dn = d[0, t], d[1, t], d[3, t]
            dh += dout[t]
            dhz = dh * z
            np.subtract(dh, dhz, out=dn)
            np.multiply(new, new, out=dh)
            dn *= np.subtract(1, dh, out=dh)
            np.subtract(h, new, out=dz)
            dz *= dhz
            dz *= np.subtract(1, z, out=dh)
            np.multiply(dn, r, out=dr)
            np.subtract(1, r, out=dh)
            dh *= hn
            np.multiply(dr, dh, out=d[2, t])
            by_gate = np.matmul(d[:3, t], back)
            dh = dhz
            for part in by_gate:
                dh += part
            dh[begins[t]] = 0
        hs = np.concatenate([h for h, *_ in held])
        grad["U"][[2, 0, 1]] += np.matmul(hs.T, d[:3].reshape(3, -1, HIDDEN))
        flat, dg = x.ravel(), d[1:].reshape(3, -1, HIDDEN)
        other = flat == OTHER
        grad["G"][:, OTHER] += np.matmul(other.astype(np.float32), dg)
        order = np.argsort(flat.astype(np.int16), kind="stable")[: len(flat) - np.count_nonzero(other)]  # OTHER is the last
        if len(order):
            sorted_x = flat[order]
            new = np.flatnonzero(np.concatenate([[True], sorted_x[1:] != sorted_x[:-1]]))
            grad["G"][:, sorted_x[new]] += np.add.reduceat(np.take(dg, order, axis=1), new, axis=1)


def lanes(size: np.ndarray, most: int) -> list[list[int]]:
    """Documents of these sizes, laid end to end in lanes: the longest first, each into the shortest lane; the longest lane first."""
    width = int(min(len(size), most, max(8, size.sum() // (256 * STEPS))))  # few documents get narrow windows, and so as many of them
    heap, of = [(0, k) for k in range(width)], [[] for _ in range(width)]
    for i in np.argsort(-size, kind="stable").tolist():
        length, k = heap[0]
        of[k].append(i)
        heapq.heapreplace(heap, (length + int(size[i]), k))
    return sorted(of, key=lambda some: -int(size[some].sum()))


def windows(docs: list[np.ndarray], most: int, steps: int):
    """(inputs, targets, which of them count, documents, go_on, lanes) by step and lane for each window, in order; lanes that have ended fall
    away, and where few are left windows are longer. Memory is some bytes a token, whatever the lanes' lengths."""
    size = np.array([len(d) for d in docs])
    of = lanes(size, most)
    order = [i for some in of for i in some]
    total = np.array([int(size[some].sum()) for some in of])
    first = np.cumsum(total) - total
    y, doc, go_on = np.concatenate([docs[i] for i in order]), np.repeat(order, size[order]).astype(np.int32), np.ones(int(total.sum()), np.int8)
    go_on[np.cumsum(size[order]) - size[order]] = 0
    t = 0
    while t < total[0]:
        n = int(np.count_nonzero(total > t))
        at = np.arange(t, min(t + max(steps, LEAST_TOKENS // n), total[0]))[:, None]
        on = at < total[:n]
        place = first[:n] + np.minimum(at, total[:n] - 1)
        on_going = go_on[place]
        x = y[np.maximum(place - 1, 0)].astype(np.int64) * on_going  # END is 0: what a document begins after
        yield x, y[place].astype(np.int64), on, doc[place], on_going.astype(np.float32)[:, :, None], n
        t += len(at)


class Steps:
    """Step sizes from running means of each parameter's gradients and of their squares."""

    def __init__(self, model: Model):
        self.first, self.second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
        self.n = 0

    def take(self, model: Model, grad: dict[str, np.ndarray]) -> None:
        self.n += 1
        rate = RATE * np.sqrt(1 - SECOND**self.n) / (1 - FIRST**self.n)
        for k, g in grad.items():
            m, v = self.first[k], self.second[k]
            m *= FIRST
            m += (1 - FIRST) * g
            g *= g
            v *= SECOND
            v += (1 - SECOND) * g
            np.sqrt(v, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= rate
            model.p[k] -= g


def train(model: Model, docs: list[np.ndarray], steps: Steps) -> None:
    """One pass over docs (symbols, each ended by END): back-propagation through STEPS steps at a time."""
    h = np.zeros((LANES, HIDDEN), np.float32)
    for xs, ys, on, _, go_on, n in windows(docs, LANES, STEPS):
        out, h, held = model.gates(xs, go_on, h[:n], True)
        grad = {k: np.zeros_like(v) for k, v in model.p.items()}
        if on.all():
            dout = model.output(out.reshape(-1, HIDDEN), ys.ravel(), grad)[1].reshape(out.shape)
        else:
            dout = np.zeros_like(out)
            dout[on] = model.output(out[on], ys[on], grad)[1]
        model.backward(xs, go_on, held, dout, grad)
        scale = 1 / max(1, int(on.sum()))
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())) * scale
        scale *= min(1, CLIP / max(norm, 1e-9))
        for g in grad.values():
            g *= scale
        steps.take(model, grad)


def likelihoods(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each document, its state carried through from its first symbol to its last."""
    out, h = np.zeros(len(docs)), np.zeros((LANES, HIDDEN), np.float32)
    for xs, ys, on, doc, go_on, n in windows(docs, LANES, 2 * STEPS):
        s, h, _ = model.gates(xs, go_on, h[:n], False)
        out += np.bincount(doc[on], model.output(s[on], ys[on])[0], len(docs))
    return out


def folds(df: DataFrame) -> DataFrame:
    """(doc_id, text, held_out)."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return id_text(df).withColumn("held_out", held)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, as binary, A-Z in lower case, and the number of each one's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten().cast(pa.binary())
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    some = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends makes empty ones
    return flat.filter(some), text[some.to_numpy(zero_copy_only=False)]


def counted(docs: DataFrame) -> DataFrame:
    """(word, c) over training documents; the word b'' stands for the end of a text."""

    def make(batches):
        schema = arrow_schema("word binary, n long")
        held, ends = [], 0

        def give():
            ended = pa.Table.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], schema=schema)
            sums = pa.concat_tables([ended, *held]).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return sums.select(["word", "n_sum"]).rename_columns(schema.names).cast(schema).to_batches()

        let_go()
        for batch in slices(batches, by=0):
            counts = words_of(batch.column(0))[0].value_counts()
            held.append(pa.Table.from_arrays([counts.field("values"), counts.field("counts")], schema=schema))
            ends += batch.num_rows
            if sum(map(len, held)) > MOST_COUNTED:
                yield from give()
                held, ends = [], 0
        if ends:
            yield from give()

    rows = docs.where("not held_out").select("text").mapInArrow(make, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """Rows of the most frequent words, most frequent first: all words of the highest frequency steps that make up `most` at most. Steps are
    eighths of a power of two, so their table has a few hundred rows, and no task sorts or sends more than what is kept."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = dict(counts.groupBy(step.alias("s")).agg(F.count("*")).collect())
    total, least = 0, None
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            break
        least = s
    if least is None:
        return []
    return sorted(counts.where(step >= least).collect(), key=lambda r: (-r.c, bytes(r.word)))


def ranked(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Each word's place in `known`, -1 for others."""
    return pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)


def to_symbols(ranks: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    """Symbols of each of n texts, from the ranks of all of their words and the number of each one's text."""
    ends = np.cumsum(np.bincount(text, minlength=n) + 1)
    out = np.full(len(ranks) + n, END, np.int16)
    out[np.arange(len(ranks)) + text] = np.where((ranks >= 0) & (ranks < VOCABULARY - 2), ranks + 1, OTHER)
    return np.split(out, ends[:-1])


def fitted(spark: SparkSession, docs: DataFrame, known: pa.Array, start: Model) -> Model:
    """The average of what each task learns from all of its training documents."""
    first = start.flat()

    def learn(batches):
        model = Model(np.ones(VOCABULARY)).load(first)
        steps = Steps(model)
        held, size, tokens = [], 0, 0
        for batch in slices(batches, by=0):
            words, text = words_of(batch.column(0))
            for doc in to_symbols(ranked(words, known), text, batch.num_rows):
                held.append(doc)
                size += len(doc)
                if size >= BLOCK:
                    train(model, held, steps)
                    tokens, held, size = tokens + size, [], 0
        if held:
            train(model, held, steps)
        if tokens + size:
            yield row(float(tokens + size), model.flat().astype(np.float64) * (tokens + size), TaskContext.get().partitionId())

    def row(weight: float, total: np.ndarray, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary()), pa.array([part])], schema=arrow_schema(schema))

    def add(batches):
        weight, total, first = 0.0, None, 0
        for batch in batches:
            for w, v, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if total is None:
                    first = part
                weight, total = weight + w, np.frombuffer(v) if total is None else total + np.frombuffer(v)
        if total is not None:
            yield row(weight, total, first)

    schema = "weight double, total binary, part long"
    rows = stored(spark, docs.where("not held_out").select("text").mapInArrow(learn, schema), "replicas")
    left = rows.count()
    while left > 16:  # sums of sixteen, of sums of sixteen, ...
        left = -(-left // 16)
        rows = stored(spark, rows.repartition(left, F.col("part") % left).sortWithinPartitions("part").mapInArrow(add, schema), "replicas")
        left = min(left, rows.count())
    found = sorted(rows.collect(), key=lambda r: r.part)  # at most sixteen rows of the model's fixed size
    if not found:
        return start
    return start.load(sum(np.frombuffer(r.total) for r in found) / sum(r.weight for r in found))


def scores(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document; scores are log10."""
    docs = folds(df)
    counts = stored(spark, counted(docs), "counts")
    words = F.col("word") != F.lit(b"")
    n, v, docs_n = counts.select(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(~words, F.col("c"))), F.lit(0))).first()
    top = most_frequent(counts.where(words), KEPT)
    known = pa.array([bytes(r.word) for r in top], pa.binary())
    c = np.array([r.c for r in top] or [0], np.float64)
    shown = c[: VOCABULARY - 2] if top else c[:0]
    unigram = np.zeros(VOCABULARY)
    unigram[END], unigram[1 : 1 + len(shown)], unigram[OTHER] = docs_n, shown, max(0.0, n - docs_n - shown.sum())
    others = np.log10(max(0.0, n - docs_n - shown.sum()) + max(0, v - 1 - len(shown)) + 1)  # words under OTHER, and one unseen
    model = fitted(spark, docs, known[: VOCABULARY - 2], Model(unigram))
    base = float(np.log10(n + v + 1))
    end_known, end_log = int(docs_n > 0), float(np.log10(docs_n + 1))
    flat = model.flat()
    log_c = np.append(np.log10(c + 1), 0.0)  # the last for words that are not in `known`

    names = "row long, doc_id long, held_out boolean, word binary, times long, n_tokens long, n_known long, base_score double, score double"

    def score(batches):
        own, schema = Model(np.ones(VOCABULARY)).load(flat), arrow_schema(names)
        let_go()
        held, kept, size = [], [], 0

        def batch_of(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, (list, np.ndarray)) else c for c, f in zip(columns, schema)], schema=schema)

        def give():
            doc, fold = (pa.concat_arrays([k[i] for k in kept]) for i in range(2))
            row, n_words, n_known, by_counts, part = (np.concatenate([k[i] for k in kept]) for i in range(2, 7))
            own_key = [b"\0%d" % r for r in row.tolist()]  # met by no word, and no two rows' alike, so that the join spreads them
            more = part + likelihoods(own, held) / np.log(10)
            return batch_of(row, doc, fold, own_key, np.zeros(len(row), np.int64), n_words + 1, n_known + end_known, by_counts, more)

        for batch in slices(batches, by=1):
            m, row = batch.num_rows, batch.column(3).to_numpy()
            words, text = words_of(batch.column(1))
            ranks = ranked(words, known)
            away = ranks < 0
            beyond = np.flatnonzero(away | (ranks >= VOCABULARY - 2))
            n_words, of = np.bincount(text, minlength=m), text[beyond]
            kept.append((
                batch.column(0), batch.column(2), row, n_words, n_words - np.bincount(text[away], minlength=m),
                np.bincount(text, log_c[ranks], m) + end_log - base * (n_words + 1), np.bincount(of, log_c[ranks[beyond]], m) - float(others) * np.bincount(of, minlength=m),
            ))
            held += to_symbols(ranks, text, m)
            size += len(words) + m
            if away.any():
                coded = words.filter(pa.array(away)).dictionary_encode()
                n = len(coded.dictionary)
                pair, times = np.unique(text[away] * n + coded.indices.to_numpy(), return_counts=True)  # a text's word, and how often it is there
                zero, nothing = np.zeros(len(pair), np.int64), np.zeros(len(pair))
                none = (pa.nulls(len(pair), t) for t in (pa.int64(), pa.bool_()))
                yield batch_of(row[pair // n], *none, coded.dictionary.take(pa.array(pair % n)), times, zero, zero, nothing, nothing)
            if size >= BLOCK:
                yield give()
                held, kept, size = [], [], 0
        if held:
            yield give()

    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, names)
    met = rows.join(counts, "word", "left")
    known = F.when(F.col("c") > 0, F.col("times")).otherwise(0)
    more = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    out = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + known).alias("n_known"),
        F.sum(F.col("base_score") + more).alias("base_score"), F.sum(F.col("score") + more).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
