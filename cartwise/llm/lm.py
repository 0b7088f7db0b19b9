"""Language-model scoring: a small causal self-attention model over subword ids, in numpy.

A text is its words (A-Z lower-cased) joined by single spaces, and one end.
Each word with a space in front is cut to subword ids by a public vocabulary.
The model predicts the class of the next id with one masked attention layer
and a feed-forward layer; a frequent id is a class of its own, and within the
other classes the ids follow their share in all training documents.
"""

from __future__ import annotations

import ctypes
import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.quality import fold
from cartwise.llm.text import slices, text_bytes
from cartwise.llm.token_counts import VOCABULARY, encoder, forget_encoders
from cartwise.session import materialize

IDS = 50257
END = 50256
#: Tokens of a context window, and by how many the next window is ahead.
WINDOW, STRIDE = 20, 15
DIM, HIDDEN = 16, 32
#: Ids with an input vector of their own; the others share REST_INPUTS by id.
OWN_INPUTS, REST_INPUTS = 4000, 96
#: The next id is predicted as a group, then a member of it; the last members share the rare ids.
GROUPS, MEMBERS, REST_CLASSES = 32, 32, 32
CLASSES = GROUPS * MEMBERS
STEPS, BATCH, RATE, SEED = 800, 192, 0.01, 5
#: The training texts are dealt over shards of about SHARD_TOKENS.  In each of ROUNDS rounds every shard is trained on
#: its next windows from common weights, whose changes are averaged; all windows are used once at least, those of a
#: small corpus up to MOST_PASSES times, until there are STEPS batches.
SHARD_TOKENS, ROUNDS, MOST_PASSES = 1_000_000, 8, 8
#: Parts that the tasks' sums are cut into to be added up.
BLOCKS = 64
FOLDS, TEST_FOLD = 10, 0
#: Exponents up to which sums of powers stay finite without a shift.
EXPONENT = 60
#: Weight of the groups' overall share in what a previous id says about the next group.
PRIOR = 20
SMOOTH = 0.1
#: The most frequent words, looked up in a broadcast; all others are joined.
HEAVY_WORDS = 200_000
#: Distinct words that a task holds before it passes its counts on, and cuts that a worker remembers (twice).
HELD_WORDS = 300_000
HELD_CUTS = 100_000


class Cuts(dict):
    """word (bytes) -> its subword ids as uint16 bytes.

    Holds two generations of words; a full one becomes the older and what is
    still in use moves on from there, so frequent words are cut once.
    """

    def __init__(self, vocabulary: bytes):
        super().__init__()
        self.vocabulary = vocabulary
        self.encode = encoder(vocabulary).encode_ordinary
        self.older: dict[bytes, bytes] = {}
        self.lengths: np.ndarray | None = None

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("H", self.encode(" " + word.decode("utf-8", "replace"))).tobytes()
        if len(self) >= HELD_CUTS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def learn(self, words: Iterable[bytes]) -> None:
        """Cut all new words in one call, which is much cheaper than one by one.

        A piece never reaches over the space in front of a word, so the ids
        fall apart at the words' ends; words for which they do not are left
        to be cut alone.
        """
        new = [w for w in words if w not in self and w not in self.older]
        if not new:
            return
        if self.lengths is None:
            decode = encoder(self.vocabulary).decode_single_token_bytes
            self.lengths = np.array([len(decode(i)) for i in range(END)])
        ids = np.array(self.encode(b"".join(b" " + w for w in new).decode("utf-8", "replace")), dtype=np.uint16)
        ends, want = np.cumsum(self.lengths[ids]), np.cumsum([len(w) + 1 for w in new])
        at = np.minimum(np.searchsorted(ends, want), len(ends) - 1)
        if not (ends[at] == want).all():
            return
        raw, at = ids.tobytes(), (2 * (at + 1)).tolist()
        if len(self) + len(new) > HELD_CUTS:
            self.older = dict(self)
            self.clear()
        self.update((w, raw[a:b]) for w, a, b in zip(new, [0, *at], at))


class Lexicon:
    """How the ids map to model inputs and output classes, from their counts in all training documents."""

    def __init__(self, counts: np.ndarray, starts_word: np.ndarray):
        order = np.lexsort((np.arange(IDS), -counts))
        ids = np.arange(IDS)
        self.input = (OWN_INPUTS + ids % REST_INPUTS).astype(np.int32)
        self.input[order[:OWN_INPUTS]] = np.arange(OWN_INPUTS)
        self.begin = OWN_INPUTS + REST_INPUTS
        own, rare = order[: CLASSES - REST_CLASSES], order[CLASSES - REST_CLASSES :]
        self.cls = np.empty(IDS, dtype=np.int32)
        self.cls[own[np.argsort(~starts_word[own], kind="stable")]] = np.arange(len(own))
        half = np.array_split(rare[starts_word[rare]], REST_CLASSES // 2)
        half += np.array_split(rare[~starts_word[rare]], REST_CLASSES // 2)
        for k, part in enumerate(half):
            self.cls[part] = len(own) + k
        mass = counts + SMOOTH
        by_class = np.bincount(self.cls, weights=mass, minlength=CLASSES)
        self.inside = np.log(mass / by_class[self.cls])
        by_class = np.maximum(by_class, SMOOTH).reshape(GROUPS, MEMBERS)
        self.group_share = by_class.sum(axis=1) / by_class.sum()
        self.member_share = by_class / by_class.sum(axis=1, keepdims=True)

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Model inputs and classes at each place, and the first place of each text, of texts with these ids."""
        offsets = np.cumsum(lengths) - lengths
        inputs = np.empty(len(ids), dtype=np.int32)
        inputs[1:] = self.input[ids[:-1]]
        inputs[offsets] = self.begin
        return inputs, self.cls[ids], offsets


def _log_softmax(z: np.ndarray, rows: np.ndarray, chosen: np.ndarray, probabilities: bool) -> np.ndarray:
    """Log softmax of ``z`` at the chosen columns; ``z`` is overwritten, by the probabilities if asked for."""
    if z.max() > EXPONENT or z.min() < -EXPONENT:
        z -= z.max(axis=1, keepdims=True)
    picked = z[rows, chosen]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    if probabilities:
        z *= (1 / total)[:, None]
    return picked - np.log(total)


def _column_sums(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x), x.dtype) @ x


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w over the last axis, as one matrix product."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[-1])


def _sums_by_key(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of the rows of each."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows over texts of these token counts; each token is new in one window."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    text = np.repeat(np.arange(len(lengths)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride


class Model:
    """One layer of causal self-attention and one feed-forward layer, both residual."""

    def __init__(self, lexicon: Lexicon, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.lexicon = lexicon

        def init(*shape):
            return (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "emb": (rng.standard_normal((lexicon.begin + 1, DIM)) * 0.3).astype(np.float32),
            "pos": (rng.standard_normal((WINDOW, DIM)) * 0.1).astype(np.float32),
            "q": init(DIM, DIM), "k": init(DIM, DIM), "v": init(DIM, DIM), "o": init(DIM, DIM),
            "w1": init(DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": init(HIDDEN, DIM),
            "pair": np.zeros((lexicon.begin + 1, GROUPS), np.float32),
            "out": np.zeros((DIM, GROUPS), np.float32), "bias": np.log(lexicon.group_share).astype(np.float32),
            "mout": np.zeros((GROUPS, DIM, MEMBERS), np.float32),
            "mbias": np.log(lexicon.member_share).astype(np.float32),
        }

    def forward(self, x: np.ndarray, first: int, training: bool = False) -> dict:
        """Hidden states and class scores at the positions from ``first`` on of the windows ``x`` (B, WINDOW)."""
        p = self.p
        e = p["emb"].take(x, axis=0)
        e += p["pos"]
        r = e[:, first:]
        q = _times(r, p["q"] * np.float32(1 / math.sqrt(DIM)))
        k, v = _times(e, p["k"]), _times(e, p["v"])
        s = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(s, -EXPONENT, EXPONENT, out=s)
        np.exp(s, out=s)
        s *= np.tri(WINDOW, dtype=np.float32)[first:]
        weight = 1 / _times(s, np.ones((WINDOW, 1), s.dtype))
        if training:
            s *= weight
            weight = np.float32(1)
        c = np.matmul(s, v) * weight
        h1 = _times(c, p["o"])
        h1 += r
        a = _times(h1, p["w1"])
        a += p["b1"]
        np.maximum(a, 0, out=a)
        h2 = _times(a, p["w2"])
        h2 += h1
        return {"e": e, "q": q, "k": k, "v": v, "s": s, "c": c, "h1": h1, "a": a, "h2": h2}

    def classes(self, h: np.ndarray, last: np.ndarray, cls: np.ndarray, grad: dict | None = None,
                keep: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each class after hidden state ``h`` and input ``last``: its group, then its member.

        The previous input also votes for the group directly, as counted.
        With ``grad`` the gradients of the loss over the rows with weight
        ``keep`` are put there, that of ``h`` under "h".
        """
        p = self.p
        group, member = np.divmod(cls, MEMBERS)
        at = np.arange(len(h))
        z = h @ p["out"]
        z += p["bias"]
        z += p["pair"].take(last, axis=0)
        out = _log_softmax(z, at, group, grad is not None)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        ranges = [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
        sorted_h, sorted_member = h.take(order, axis=0), member[order]
        zm = np.empty((len(h), MEMBERS), dtype=h.dtype)
        for g, a, b in ranges:
            np.matmul(sorted_h[a:b], p["mout"][g], out=zm[a:b])
            zm[a:b] += p["mbias"][g]
        out[order] += _log_softmax(zm, at, sorted_member, grad is not None)
        if grad is not None:
            z[at, group] -= 1
            z *= keep[:, None]
            grad["out"], grad["bias"], grad["h"] = h.T @ z, _column_sums(z), z @ p["out"].T
            grad["mout"], grad["mbias"] = np.zeros_like(p["mout"]), np.zeros_like(p["mbias"])
            zm[at, sorted_member] -= 1
            zm *= keep[order][:, None]
            for g, a, b in ranges:
                np.matmul(sorted_h[a:b].T, zm[a:b], out=grad["mout"][g])
                grad["mbias"][g] = _column_sums(zm[a:b])
                np.matmul(zm[a:b], p["mout"][g].T, out=sorted_h[a:b])
            back = np.empty_like(order)
            back[order] = at
            grad["h"] += sorted_h.take(back, axis=0)
        return out

    def step(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, state: dict, rate: float) -> float:
        """One Adam step on windows ``x`` with class targets ``y`` where ``real``; the mean loss.

        Only the input vectors that occur move; what a previous input says
        about the group is a count and does not.
        """
        p, f = self.p, self.forward(x, 0, training=True)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        keep = (real.reshape(-1) / max(1, real.sum())).astype(np.float32)
        g: dict[str, np.ndarray] = {}
        loss = -float(self.classes(flat(f["h2"]), x.reshape(-1), y.reshape(-1), g, keep) @ keep)
        dh2 = g.pop("h")
        g["w2"] = flat(f["a"]).T @ dh2
        da = dh2 @ p["w2"].T
        da *= flat(f["a"]) > 0
        g["w1"], g["b1"] = flat(f["h1"]).T @ da, _column_sums(da)
        dh1 = dh2
        dh1 += da @ p["w1"].T
        g["o"] = flat(f["c"]).T @ dh1
        dc = (dh1 @ p["o"].T).reshape(f["c"].shape)
        dv = np.matmul(f["s"].transpose(0, 2, 1), dc)
        ds = np.matmul(dc, f["v"].transpose(0, 2, 1))
        dc *= f["c"]
        ds -= _times(dc, np.ones((DIM, 1), dc.dtype))
        ds *= f["s"]
        dq, dk = np.matmul(ds, f["k"]), np.matmul(ds.transpose(0, 2, 1), f["q"])
        dq *= np.float32(1 / math.sqrt(DIM))
        e, de = flat(f["e"]), dh1
        for name, d in (("q", flat(dq)), ("k", flat(dk)), ("v", flat(dv))):
            g[name] = e.T @ d
            de += d @ p[name].T
        g["pos"] = de.reshape(f["e"].shape).sum(axis=0)
        used, g["emb"] = _sums_by_key(x.reshape(-1), de)
        state["t"] = state.get("t", 0) + 1
        fix = rate * math.sqrt(1 - 0.99 ** state["t"]) / (1 - 0.9 ** state["t"])
        for name, grad in g.items():
            m, v = state.setdefault(name, [np.zeros_like(p[name]), np.zeros_like(p[name])])
            if name == "emb":
                whole, m, v = (m, v), m.take(used, axis=0), v.take(used, axis=0)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            change = (fix * m / (np.sqrt(v) + 1e-8)).astype(p[name].dtype)
            if name == "emb":
                whole[0][used], whole[1][used] = m, v
                p[name][used] -= change
            else:
                p[name] -= change
        return loss

    def trained(self) -> list[str]:
        """Names of the weights that training moves."""
        return sorted(self.p.keys() - {"pair"})

    def pair_counts(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How often each group follows each input in texts with these ids."""
        inputs, classes, _ = self.lexicon.encode(ids, lengths)
        cells = inputs.astype(np.int64) * GROUPS + classes // MEMBERS
        return np.bincount(cells, minlength=(self.lexicon.begin + 1) * GROUPS).astype(np.float64)

    def set_pairs(self, counts: np.ndarray) -> None:
        """What a previous input says about the next group, from the counts of all training documents."""
        groups = counts.reshape(self.lexicon.begin + 1, GROUPS)
        share = self.lexicon.group_share
        self.p["pair"] = np.log(
            (groups / share + PRIOR) / (groups.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)

    def train(self, ids: np.ndarray, lengths: np.ndarray, shard: int, turn: int, rounds: int, passes: int) -> np.ndarray:
        """Train on the windows of a shard that are up in this round, and put the weights back.

        The windows of a round lie side by side, so a token is learned once a
        pass.  Returns the number of windows, and it times the weights'
        changes (by name, one after the other).
        """
        if not len(lengths):
            return np.zeros(1 + sum(self.p[name].size for name in self.trained()))
        inputs, classes, offsets = self.lexicon.encode(ids, lengths)
        text, start = windows(lengths, WINDOW)
        before, state = {name: p.copy() for name, p in self.p.items()}, {}
        order = np.random.default_rng([SEED, shard]).permutation(len(text))
        each = -(-len(text) * passes // rounds)
        mine = order[(turn * each + np.arange(each)) % len(text)]
        for b in range(0, each, BATCH):
            w = mine[b : b + BATCH]
            at = (offsets[text[w]] + start[w])[:, None] + np.arange(WINDOW)
            real = start[w][:, None] + np.arange(WINDOW) < lengths[text[w]][:, None]
            at = np.minimum(at, len(ids) - 1)
            self.step(inputs[at], classes[at], real, state, RATE * (1 - (turn + b / each) / rounds))
        moved = [(self.p[name] - before[name]).ravel() for name in self.trained()]
        self.p = before
        return each * np.concatenate([[1.0], *moved])

    def move(self, total: np.ndarray) -> None:
        """Move the weights by the mean of the shards' changes."""
        at = 1
        for name in self.trained():
            p = self.p[name]
            self.p[name] = p + (total[at : at + p.size].reshape(p.shape) / total[0]).astype(np.float32)
            at += p.size

    def fit(self, texts: list[np.ndarray], steps: int = STEPS, seed: int = SEED) -> None:
        """Train on the ids of texts at hand (each with its end); windows are drawn with a fixed seed."""
        if not texts:
            return
        rng, state = np.random.default_rng(seed), {}
        y, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
        inputs, classes, offsets = self.lexicon.encode(y, lengths)
        self.set_pairs(self.pair_counts(y, lengths))
        text, start = windows(lengths)
        for n in range(steps):
            pick = rng.integers(0, len(text), BATCH)
            at = (offsets[text[pick]] + start[pick])[:, None] + np.arange(WINDOW)
            real = start[pick][:, None] + np.arange(WINDOW) < lengths[text[pick]][:, None]
            at = np.minimum(at, len(y) - 1)
            self.step(inputs[at], classes[at], real, state, RATE * (1 - n / steps))

    def log_probs(self, ids: np.ndarray, lengths: np.ndarray, batch: int = 512) -> np.ndarray:
        """Natural log probability of each text; ``ids`` are all texts' ids, each with its end."""
        inputs, classes, offsets = self.lexicon.encode(ids, lengths)
        token = np.zeros(len(ids))
        text, start = windows(lengths)
        for later in (False, True):
            own = np.flatnonzero((start > 0) == later)
            first = WINDOW - STRIDE if later else 0
            for b in range(0, len(own), batch):
                w = own[b : b + batch]
                at = (offsets[text[w]] + start[w])[:, None] + np.arange(WINDOW)
                real = (start[w][:, None] + np.arange(WINDOW) < lengths[text[w]][:, None])[:, first:].reshape(-1)
                at = np.minimum(at, len(ids) - 1)
                x = inputs[at]
                h = self.forward(x, first)["h2"].reshape(-1, DIM)
                to = at[:, first:].reshape(-1)[real]
                token[to] = self.classes(h[real], x[:, first:].reshape(-1)[real], classes[to])
        token += self.lexicon.inside[ids]
        return np.add.reduceat(token, offsets)


def starts_word(cuts: Cuts) -> np.ndarray:
    """Of each id, whether it begins with the space in front of a word."""
    decode = encoder(cuts.vocabulary).decode_single_token_bytes
    return np.array([i < END and decode(i).startswith(b" ") for i in range(IDS)])


_CUTS: dict[int, Cuts] = {}


def cuts_of(vocabulary: bytes) -> Cuts:
    """The cuts of a vocabulary; a worker keeps them from task to task."""
    key = hash(vocabulary)
    if key not in _CUTS:
        _CUTS[key] = Cuts(vocabulary)
    return _CUTS[key]


def forget_cuts() -> None:
    """Before a pass that cuts no texts: a worker drops its cuts and tokenizers and gives their memory back."""
    _CUTS.clear()
    forget_encoders()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim is not None:
        trim(0)


def _ids(words: list[bytes], cuts: Cuts) -> np.ndarray:
    return np.append(np.frombuffer(b"".join(map(cuts.__getitem__, words)), dtype=np.uint16), np.uint16(END))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, text, and two hashes that tell unequal rows apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == TEST_FOLD).alias("held_out"), "text",
                       F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", "doc_id").alias("key2"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n_train, n_all) over all documents; counted map-side, so a frequent word is one row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, test = Counter(), Counter()

        def out():
            words = list(train.keys() | test.keys())
            rows = pa.RecordBatch.from_pydict({
                "word": pa.array(words, pa.binary()).cast(pa.string()),
                "n_train": pa.array([train[w] for w in words], pa.int64()),
                "n_all": pa.array([train[w] + test[w] for w in words], pa.int64())})
            train.clear()
            test.clear()
            return rows

        for b in batches:
            for part in slices(b, 2):
                for text, held in zip(text_bytes(part.column(2)), part.column(1).to_pylist()):
                    (test if held else train).update(text.lower().split())
                if len(train) + len(test) >= HELD_WORDS:
                    yield out()
        yield out()

    found = rows.mapInArrow(run, "word string, n_train long, n_all long")
    return found.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def id_counts(counts: DataFrame, vocabulary) -> np.ndarray:
    """How often each subword id occurs in the training words; IDS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, total = cuts_of(vocabulary.value), np.zeros(IDS, dtype=np.int64)
        for b in batches:
            words = text_bytes(b.column(0))
            cuts.learn(words)
            cut = [np.frombuffer(cuts[w], dtype=np.uint16) for w in words]
            n = np.repeat(b.column(1).to_numpy(), [len(c) for c in cut])
            if len(cut):
                total += np.bincount(np.concatenate(cut), weights=n, minlength=IDS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": at, "n": total[at]})

    found = counts.select("word", "n_train").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(IDS)
    for r in found.toLocalIterator():
        out[r["id"]] = r["n"]
    return out


def shards(rows: DataFrame, vocabulary, n: int) -> DataFrame:
    """The subword ids of all texts, dealt over ``n`` shards by hash of the row.

    One row a shard: shard, and one after the other its texts' ids, lengths,
    held_out flags, key and key2.  Texts are cut here and nowhere else.
    """
    dealt = rows.select("key", "key2", F.pmod("key", F.lit(n)).cast("int").alias("shard"), "held_out", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = cuts_of(vocabulary.value)
        for b in batches:
            for part in slices(b, 4):
                words = [t.lower().split() for t in text_bytes(part.column(4))]
                cuts.learn(set().union(*words))
                ids = pa.array([_ids(w, cuts).tobytes() for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], ids], names=["key", "key2", "shard", "held_out", "ids"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("key2", "ascending")])
        texts = table["ids"].to_pylist()
        columns = {"ids": b"".join(texts), "lengths": np.array([len(t) // 2 for t in texts], dtype=np.int64).tobytes(),
                   "held": np.array(table["held_out"].to_pylist(), dtype=bool).tobytes(),
                   "key": table["key"].to_numpy().tobytes(), "key2": table["key2"].to_numpy().tobytes()}
        return pa.table({"shard": table["shard"][:1], **{k: pa.array([v], pa.binary()) for k, v in columns.items()}})

    return dealt.mapInArrow(cut, "key long, key2 long, shard int, held_out boolean, ids binary").groupBy("shard").applyInArrow(
        pack, "shard int, ids binary, lengths binary, held binary, key binary, key2 binary")


def _training(ids: bytes, lengths: bytes, held: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of the training texts of a shard."""
    n, train = np.frombuffer(lengths, dtype=np.int64), ~np.frombuffer(held, dtype=bool)
    return np.frombuffer(ids, dtype=np.uint16)[np.repeat(train, n)], n[train]


def _summed(rows: DataFrame, of, label: str) -> np.ndarray:
    """The sum of ``of(ids, lengths, shard)``, a vector, over the training texts of all shards.

    Each task adds up its own shards and passes one vector on, in blocks; the
    blocks are added up on the executors, in the order of the tasks, and one
    vector reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_cuts()
        total = None
        for b in batches:
            for k in range(b.num_rows):
                shard, *texts = (c[k].as_py() for c in b.columns)
                found = of(*_training(*texts), shard)
                total = found if total is None else total + found
        if total is not None:
            parts = [p.tobytes() for p in np.array_split(total.astype(np.float64), BLOCKS)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(range(BLOCKS), pa.int32()), "task": pa.array([task] * BLOCKS, pa.int32()),
                "data": pa.array(parts, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d.as_py()) for d in table.sort_by("task")["data"])
        return pa.table({"block": table["block"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("shard", "ids", "lengths", "held").mapInArrow(run, "block int, task int, data binary").groupBy("block").applyInArrow(
        add, "block int, data binary")
    found = materialize(parts, label).toArrow().sort_by("block")
    return np.frombuffer(b"".join(found["data"].to_pylist()))


def fit(rows: DataFrame, counts: DataFrame, n_docs: int, vocabulary, shard_tokens: int = SHARD_TOKENS,
        rounds: int = ROUNDS) -> Model:
    """Classes, what an id says about the next group, and weights, all from all training documents."""
    return _fit(rows, counts, n_docs, vocabulary, shard_tokens, rounds)[0]


def _fit(rows: DataFrame, counts: DataFrame, n_docs: int, vocabulary, shard_tokens: int,
         rounds: int) -> tuple[Model, DataFrame]:
    """The model and the shards.

    The weights are trained where the shards are; one vector of changes a round reaches the driver.
    """
    share = id_counts(counts, vocabulary)
    share[END] += n_docs
    model = Model(Lexicon(share, starts_word(cuts_of(vocabulary.value))))
    texts = materialize(shards(rows, vocabulary, max(1, round(share.sum() / shard_tokens))), "lm-shards")
    if not n_docs:
        return model, texts
    context = rows.sparkSession.sparkContext
    lexicon = context.broadcast(model.lexicon)
    model.set_pairs(_summed(texts, lambda ids, lengths, _: Model(lexicon.value).pair_counts(ids, lengths),
                            "lm-pairs"))
    passes = int(min(MOST_PASSES, max(1, -(-STEPS * BATCH * STRIDE // share.sum()))))
    for turn in range(rounds):
        weights = context.broadcast(model.p)

        def changes(ids: np.ndarray, lengths: np.ndarray, shard: int) -> np.ndarray:
            lm = Model(lexicon.value)
            lm.p = dict(weights.value)
            return lm.train(ids, lengths, shard, turn, rounds, passes)

        model.move(_summed(texts, changes, "lm-changes"))
        weights.destroy()
    return model, texts


def text_scores(texts: DataFrame, model) -> DataFrame:
    """(key, key2, score) of the distinct rows whose texts are in these shards; log10 probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_cuts()
        for b in batches:
            for k in range(b.num_rows):
                ids, lengths, key, key2 = (c[k].as_py() for c in b.columns)
                key, key2 = np.frombuffer(key, dtype=np.int64), np.frombuffer(key2, dtype=np.int64)
                probs = model.value.log_probs(np.frombuffer(ids, dtype=np.uint16), np.frombuffer(lengths, dtype=np.int64))
                new = np.append(True, (key[1:] != key[:-1]) | (key2[1:] != key2[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(key2[new]), pa.array(probs[new] / math.log(10))],
                                                 names=["key", "key2", "score"])

    return texts.select("ids", "lengths", "key", "key2").mapInArrow(run, "key long, key2 long, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Whole texts are scored; a null text is an empty one, which is its end
    alone.  A null id counts as an empty id.  Repeated rows each give a row.
    Other columns are not read; no rows give no rows.  Words and their counts
    are gathered from all documents; the HEAVY_WORDS most frequent ones are
    looked up in a broadcast, so no hot word meets in one task, and the rest
    is joined.  Texts are cut to ids once, for training and scoring, and meet
    their scores again by two 64-bit hashes of the row.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    counts = materialize(word_counts(rows), "word-counts")
    n_docs = rows.where("not held_out").count()
    known = counts.where("n_train > 0").agg(F.sum("n_train").alias("n"), F.count("*").alias("v")).first()
    n, v = (known["n"] or 0) + n_docs, known["v"] + (n_docs > 0)
    model, texts = _fit(rows, counts, n_docs, ranks, SHARD_TOKENS, ROUNDS)
    scores = materialize(text_scores(texts, spark.sparkContext.broadcast(model)), "lm-scores")
    heavy_rows = counts.orderBy(F.desc("n_all"), "word").limit(HEAVY_WORDS)
    heavy_words = heavy_rows.select(F.encode("word", "UTF-8").alias("word"), "n_train").toArrow()
    below = math.log10(n + SMOOTH * (v + 1))
    unknown = math.log10(SMOOTH) - below
    heavy = spark.sparkContext.broadcast({w: math.log10(c + SMOOTH) - below for w, c in zip(
        heavy_words["word"].to_pylist(), heavy_words["n_train"].to_pylist())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_cuts()
        logs, end = heavy.value, math.log10(n_docs + SMOOTH) - below
        for b in batches:
            for part in slices(b, 4):
                n_tokens, n_known, base, others, times = [], [], [], [], []
                for words in (t.lower().split() for t in text_bytes(part.column(4))):
                    n_tokens.append(len(words) + 1)
                    seen, total, rest = (1 if n_docs else 0), end, []
                    for w, k in Counter(words).items():
                        log = logs.get(w)
                        if log is None:
                            rest.append((w, k))
                        else:
                            total += k * log
                            seen += k if log > unknown else 0
                    n_known.append(seen)
                    base.append(total)
                    others.append([w for w, _ in rest])
                    times.append([k for _, k in rest])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(others, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                     pa.array(times, pa.list_(pa.int32()))],
                    names=["doc_id", "held_out", "key", "key2", "n_tokens", "top_known", "top_base", "words", "times"])

    scored = rows.select("doc_id", "held_out", "key", "key2", "text").mapInArrow(
        run, "doc_id long, held_out boolean, key long, key2 long, n_tokens long, top_known long, top_base double, "
             "words array<string>, times array<int>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    rest = rest.join(counts.select("word", "n_train"), "word").groupBy("row").agg(
        F.sum(F.when(F.col("n_train") > 0, F.col("k")).otherwise(F.lit(0))).alias("rest_known"),
        F.sum(F.col("k") * (F.log10(F.col("n_train") + F.lit(SMOOTH)) - F.lit(below))).alias("rest_base"))
    return scored.drop("words", "times").join(rest, "row", "left").join(scores, ["key", "key2"]).select(
        "doc_id", "held_out", "n_tokens",
        (F.col("top_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("top_base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"), "score")
