"""Secret scans: fixed patterns, and a character convolutional network over every other candidate in context.

A candidate is a run of 16 or more characters of keys and tokens, or what is left of one outside the
patterns' spans if that is as long. The network sees it with the characters around it, a long one in
overlapping windows up to its end, of which the highest score counts: one-hot character classes, one convolution,
maximum and mean over places, one hidden layer. It is trained in NumPy, its weights decaying, on labelled findings
(made by a seeded generator: keys, tokens and digests in the contexts that carry them, against long words, paths,
addresses, numbers, identifiers and digests that are named as versions or sums), calibrated on a second set, and its
threshold is the highest that still finds the wanted share of every kind of secret of a third set. The patterns' spans
always stay. Shorter runs are left to the patterns: under 16 characters words and keys are too alike.

Null and empty texts have no spans; repeated ids give a row each; an empty table gives no rows; other columns
are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, texts_of

#: The patterns of the base findings (fixed values).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
MIN_ASSIGN, MIN_ACCESS, MIN_CANDIDATE = 12, 18, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
KINDS = ("assign", "access", "hex", "model")

BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Distance of a long candidate's windows, and windows that are scored at once.
STRIDE, AT_ONCE = 8, 4096
KERNEL, FILTERS, HIDDEN = 5, 16, 16
RECALL = 0.98
DECAY = 1e-3
FINDINGS = 6_000
SEED = 11

#: Class of each character code up to 127; beyond, one class; and none (0) past either end.
_CLASSES = np.full(129, 1, np.int64)
for _i, _c in enumerate("etaoinshrdlucmfwypvbgkjqxz"):
    _CLASSES[ord(_c)] = 2 + _i // 4
    _CLASSES[ord(_c.upper())] = 9 + _i // 4
for _c in string.digits:
    _CLASSES[ord(_c)] = 16
for _i, _c in enumerate("/+=_-.:'\"@ \n"):
    _CLASSES[ord(_c)] = 17 + _i
N_CLASSES = 30


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings in order."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character classes around a candidate; a long one shows the INSIDE characters from start."""
    before = text[max(0, start - BEFORE) : start]
    rest = text[start : min(start + INSIDE, end)]
    after = text[end : end + AFTER]
    codes = lambda s: _CLASSES[np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]
    out = np.zeros(WIDTH, np.int64)
    out[BEFORE - len(before) : BEFORE] = codes(before)
    out[BEFORE : BEFORE + len(rest)] = codes(rest)
    out[BEFORE + INSIDE : BEFORE + INSIDE + len(after)] = codes(after)
    return out


def window_starts(start: int, end: int) -> list[int]:
    """Where a candidate's windows start; the last one is anchored to its end."""
    last = max(start, end - INSIDE)
    return [*range(start, last, STRIDE), last]


def candidates(text: str, base: list[tuple[int, int, int]]):
    """(start, end) of the runs' parts outside the base spans, which are in order."""
    j = 0
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while j < len(base) and base[j][0] < m.end():
            s, _, e = base[j]
            if s - at >= MIN_CANDIDATE:
                yield at, s
            at = max(at, e)
            if e > m.end():
                break  # it may reach the next run too
            j += 1
        if m.end() - at >= MIN_CANDIDATE:
            yield at, m.end()


class Network:
    """Weights of the network, its calibration and its threshold."""

    def __init__(self, params: dict, scale: float = 1.0, shift: float = 0.0, threshold: float = 0.5):
        self.params, self.scale, self.shift, self.threshold = params, scale, shift, threshold

    def forward(self, x: np.ndarray) -> tuple:
        p = self.params
        places = WIDTH - KERNEL + 1
        z = np.repeat(p["b"][None, None], len(x), 0).repeat(places, 1)
        for k in range(KERNEL):
            z += p["w"][k][x[:, k : k + places]]
        a = np.maximum(z, 0)
        pooled = np.concatenate((a.max(axis=1), a.mean(axis=1)), axis=1)
        h = np.maximum(pooled @ p["v"] + p["c"], 0)
        return z, a, pooled, h, h @ p["u"] + p["d"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -50, 50)))

    def scores(self, some: list[tuple[str, int, int]]) -> np.ndarray:
        """The highest probability among each candidate's windows, for (text, start, end)."""
        best, every = np.zeros(len(some)), ((k, t, at, e) for k, (t, s, e) in enumerate(some) for at in window_starts(s, e))
        while part := list(itertools.islice(every, AT_ONCE)):
            np.maximum.at(best, [k for k, *_ in part], self.probabilities(np.array([window(t, at, e) for _, t, at, e in part])))
        return best


def train(x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 4e-3, seed: int = SEED) -> Network:
    """Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    params = {"w": rng.normal(0, 0.15, (KERNEL, N_CLASSES, FILTERS)), "b": np.zeros(FILTERS), "v": rng.normal(0, 0.25, (2 * FILTERS, HIDDEN)), "c": np.zeros(HIDDEN), "u": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    net, first, second, step = Network(params), {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    places = WIDTH - KERNEL + 1
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            own, step = order[at : at + 64], step + 1
            xb = x[own]
            z, a, pooled, h, logit = net.forward(xb)
            g = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[own]) / len(own)
            grad = {"u": h.T @ g, "d": g.sum(keepdims=True)}
            gh = g[:, None] * params["u"] * (h > 0)
            grad["v"], grad["c"] = pooled.T @ gh, gh.sum(0)
            gp = gh @ params["v"].T
            gz = np.repeat(gp[:, None, FILTERS:] / places, places, 1)
            i, j = np.indices((len(own), FILTERS))
            gz[i, a.argmax(axis=1), j] += gp[:, :FILTERS]
            gz *= z > 0
            grad["b"] = gz.sum((0, 1))
            grad["w"] = np.zeros_like(params["w"])
            for k in range(KERNEL):
                np.add.at(grad["w"][k], xb[:, k : k + places].ravel(), gz.reshape(-1, FILTERS))
            for k, v in params.items():
                grad[k] = grad[k] + (DECAY * v if k in "wvu" else 0)
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling by Newton steps, on findings that training did not see."""
    z, w = net.logits(x), np.array([1.0, 0.0])
    f = np.stack((z, np.ones_like(z)), 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -50, 50)))
        w = w - np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2), f.T @ (p - y) + 1e-3 * (w - [1, 0]))
    net.scale, net.shift = float(w[0]), float(w[1])


def findings(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """Labelled findings: text, start, end, 1 for a secret, and its kind. Half of them are secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), int(k)))
    one = lambda xs: xs[rng.integers(len(xs))]
    parts = ["tion", "ment", "ing", "er", "lich", "keit", "ver", "ción", "the", "an", "re", "eau", "qu", "sch", "or", "ou", "in", "es"]
    onset, middle, coda = "b br c ch cl d dr f fr g gr h j k l m n p pl pr qu r s sh sl sp st str t th tr v w wh y z".split(), "a e i o u ai ea ee ie oa oo ou io".split(), ", ,n,r,s,t,l,m,ng,st,ck,nt,rd,ct,ns,th,x,g,y".replace(" ", "").split(",")
    syllable = lambda: one(parts) if rng.random() < 0.3 else one(onset) + one(middle) + one(coda)
    word = lambda k: "".join(syllable() for _ in range(int(k))).encode("ascii", "ignore").decode()
    mixed = string.ascii_letters + string.digits
    secret = [
        lambda: pick(mixed, rng.integers(20, 45)), lambda: pick(mixed + "+/", rng.integers(24, 64)) + one(["", "=", "=="]),
        lambda: pick("0123456789ABCDEF", rng.integers(24, 64)), lambda: one(["ghp_", "sk-", "xoxb-", "glpat-", "AIza", "pk_live_"]) + pick(mixed, rng.integers(20, 40)),
        lambda: "eyJ" + pick(mixed + "_-", rng.integers(30, 90)), lambda: pick(mixed + "_-", rng.integers(20, 48)),
    ]
    plain = [
        lambda: word(rng.integers(5, 10)), lambda: word(rng.integers(4, 8)).upper(), lambda: "_".join(word(2) for _ in range(rng.integers(3, 6))), lambda: "-".join(word(2) for _ in range(rng.integers(3, 6))),
        lambda: "/".join([one(["usr", "home", "src", "en"]), *[word(2) for _ in range(rng.integers(2, 5))]]), lambda: pick(string.digits, rng.integers(16, 20)),
        lambda: "".join(word(2).capitalize() for _ in range(rng.integers(2, 5))), lambda: one("=-_/+") * int(rng.integers(16, 40)), lambda: "-".join(pick(string.digits, 4) for _ in range(4)), lambda: word(3) + pick(string.digits, 4) + "_" + word(4),
        lambda: pick("0123456789ABCDEF", 8) + "-" + "-".join(pick("0123456789ABCDEF", 4) for _ in range(3)) + "-" + pick("0123456789ABCDEF", 12),
    ]
    lead = ["auth ", "bearer ", "key is ", "Authorization: ", "signature ", "export KEY=", "id:"]
    out = []
    for i in range(n):
        bad = i % 2
        kind = int(rng.integers(len(secret if bad else plain)))
        made = (secret if bad else plain)[kind]()
        before = " ".join(word(rng.integers(1, 4)) for _ in range(rng.integers(1, 7))) + one([" ", " ", ": ", " \"", "\n"])
        if rng.random() < (0.5 if bad else 0.1):
            before += one(lead)
        after = one([" ", "\"", ". ", "\n", "!! ", ", "]) + word(3)
        found = [m for m in CANDIDATE.finditer(before + made + after) if m.start() < len(before) + len(made) and m.end() > len(before)]
        if found:
            m = max(found, key=lambda m: m.end() - m.start())
            out.append((before + made + after, m.start(), m.end(), bad, kind))
    return out


def _arrays(some: list) -> tuple[np.ndarray, np.ndarray]:
    """A window of each finding, and all of a plain one's: whatever part of it is seen is plain."""
    cut = [(window(t, at, e), float(bad)) for t, s, e, bad, _ in some for at in ([s] if bad else window_starts(s, e))]
    return np.array([x for x, _ in cut]), np.array([y for _, y in cut])


@functools.lru_cache(2)
def fitted(n: int = FINDINGS, recall: float = RECALL, seed: int = SEED) -> Network:
    """The network trained, calibrated and given its threshold on three separate sets of findings."""
    net = train(*_arrays(findings(n, seed)), seed=seed)
    calibrate(net, *_arrays(findings(n // 3, seed + 1)))
    held = [x for x in findings(n // 3, seed + 2) if x[3]]
    p, kind = net.scores([x[:3] for x in held]), np.array([x[4] for x in held])
    lowest = lambda own: float(np.sort(own)[int(len(own) * (1 - recall))])
    net.threshold = min(lowest(p[kind == k]) for k in np.unique(kind))
    return net


def scan(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """For each text the patterns' spans, and all spans with those that the network adds."""
    base = [base_spans(text) for text in texts]
    asked = [(i, s, e) for i, text in enumerate(texts) for s, e in candidates(text, base[i])]
    every = [list(b) for b in base]
    for (i, s, e), p in zip(asked, net.scores([(texts[i], s, e) for i, s, e in asked]), strict=True):
        if p >= net.threshold:
            every[i].append((s, 3, e))
    return [(b, sorted(x)) for b, x in zip(base, every, strict=True)]


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_model of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(net or fitted())
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            found = scan(texts_of(batch, text_col), shared.value)
            count = lambda k, found=found: pa.array([sum(x[1] == k for x in every) for _, every in found], pa.int64())
            digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), count(0), count(1), count(2), digest, pa.array([_joined(x) for _, x in found], pa.string()), count(3)], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return docs.select(id_col, text_col).mapInArrow(apply, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
