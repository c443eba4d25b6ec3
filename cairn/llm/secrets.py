"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

The base patterns (assign, access, hex) always count. Besides, every run of 16 or more key characters
that no base finding holds whole is a candidate: its characters and those around it go through a small convolutional
network (embedding, one convolution with maximum over places, one dense layer), in numpy. The
network is trained here on labelled findings: generated keys of many kinds in many contexts against
numbers, addresses, paths, versions, identifiers, rulers and words. Scores are calibrated on held-back
findings by a scale and an offset, and the threshold is the highest one that keeps the asked recall
there. Candidates longer than a view are read in several views.

Defined cases: null and empty texts have no finding; places are in code points, ends exclusive; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_texts

#: The fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
KEY_CHARS = string.ascii_letters + string.digits + "+/_.=-"
#: Least characters of a candidate, those of a view into it, and those around it that the network sees.
LEAST, VIEW, AROUND = 16, 64, 16
WIDTH = VIEW + 2 * AROUND
#: The recall that the threshold keeps on held-back findings, and the labelled findings that are made.
RECALL, FINDINGS = 0.97, 12000
_HEX = np.zeros(128, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_KEY = np.zeros(128, bool)
_KEY[[ord(c) for c in KEY_CHARS]] = True
#: Character classes that are embedded: 0 nothing, 1 other than ASCII, then the printable characters.
_CODE = np.zeros(128, np.int64)
_CODE[32:127] = np.arange(2, 97)


def _maximal(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def base_findings(text: str, points: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    starts, ends = _maximal(_HEX[np.minimum(points, 127)], 32)
    out += [(s, 2, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return sorted(out)


def candidates(points: np.ndarray) -> list[tuple[int, int]]:
    """Runs of key characters that are long enough."""
    starts, ends = _maximal(_KEY[np.minimum(points, 127)], LEAST)
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def views(points: np.ndarray, start: int, end: int) -> np.ndarray:
    """The candidate with what is around it, in rows of WIDTH character classes; several rows where it is long."""
    codes = np.where(points < 128, _CODE[np.minimum(points, 127)], 1) if len(points) < 4096 else None
    rows = []
    for at in range(start, max(start + 1, end), VIEW):
        lo, hi = at - AROUND, min(end, at + VIEW) + AROUND
        part = points[max(0, lo) : hi]
        part = codes[max(0, lo) : hi] if codes is not None else np.where(part < 128, _CODE[np.minimum(part, 127)], 1)
        row = np.zeros(WIDTH, np.int64)
        row[max(0, -lo) : max(0, -lo) + len(part)] = part
        rows.append(row)
    return np.stack(rows)


@dataclass
class Network:
    """Weights, calibration (scale and offset) and threshold."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def _forward(self, rows: np.ndarray):
        x = self.embed[rows]  # rows, places, channels
        span = self.kernel.shape[0]
        cols = np.lib.stride_tricks.sliding_window_view(x, span, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), WIDTH - span + 1, -1)
        conv = cols @ self.kernel.reshape(-1, self.kernel.shape[2]) + self.bias
        best = conv.argmax(1)
        top = np.maximum(np.take_along_axis(conv, best[:, None, :], 1)[:, 0], 0)
        hidden = np.maximum(top @ self.dense + self.dense_bias, 0)
        return cols, best, top, hidden, hidden @ self.out + self.out_bias

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(rows[i : i + 256])[-1] for i in range(0, len(rows), 256)]) if len(rows) else np.zeros(0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(rows) + self.offset, -30, 30)))

    def step(self, rows: np.ndarray, labels: np.ndarray, state: dict, rate: float) -> None:
        """One step of Adam on the logistic loss."""
        cols, best, top, hidden, logit = self._forward(rows)
        n = len(rows)
        d = (1 / (1 + np.exp(-logit)) - labels) / n
        g = {"out": hidden.T @ d, "out_bias": d.sum()}
        dh = np.outer(d, self.out) * (hidden > 0)
        g["dense"], g["dense_bias"] = top.T @ dh, dh.sum(0)
        dt = (dh @ self.dense.T) * (top > 0)
        span, channels, filters = self.kernel.shape
        picked = cols[np.arange(n)[:, None], best]  # rows, filters, span * channels
        g["kernel"] = np.einsum("nf,nfc->cf", dt, picked).reshape(span, channels, filters)
        g["bias"] = dt.sum(0)
        back = dt[:, :, None] * self.kernel.reshape(-1, filters).T[None]  # rows, filters, span * channels
        places = best[:, :, None] + np.arange(span)
        codes = rows[np.arange(n)[:, None, None], places]
        ge = np.zeros_like(self.embed)
        np.add.at(ge, codes.reshape(-1), back.reshape(-1, channels))
        g["embed"] = ge
        state["t"] = state.get("t", 0) + 1
        for name, grad in g.items():
            m, v = state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            state[name] = (m, v)
            now = getattr(self, name) - rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)
            setattr(self, name, now)


def _word(r: random.Random, low: int = 2, high: int = 9) -> str:
    letters = "aeioubcdfghlmnprstvw"
    return "".join(r.choice(letters) for _ in range(r.randint(low, high)))


def _long_word(r: random.Random, low: int = 16, high: int = 34) -> str:
    """A word of many syllables, as compounds and derivations have them."""
    heads, middles, tails = "b c ch d f g h j k l m n p qu r s sch st t tr v w z".split() + [""] * 6, "a e i o u ei au ie ou eau io".split(), "n r s t ng ch tz nt x l m lich keit tion ment".split() + [""] * 10
    size, out = r.randint(low, high), ""
    while len(out) < size:
        out += r.choice(heads) + r.choice(middles) + r.choice(tails)
    return out


def _prose(r: random.Random) -> str:
    """Words around a finding; some have letters beyond ASCII."""
    words = [_word(r) for _ in range(r.randint(0, 5))]
    text = " ".join(w + r.choice(["", "é", "ñ", "üß", "ç", ".", "!!", "$$$", " |"]) if r.random() < 0.4 else w for w in words)
    return text.upper() if r.random() < 0.25 else text


def _run(r: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(r.choices(alphabet, k=r.randint(low, high)))


def labelled_findings(count: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): as many keys as other candidates, each in its context."""
    r, out = random.Random(seed), []
    b64, low, up, hexa = string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
    keys = [
        lambda: r.choice(["ghp_", "gho_", "glpat-"]) + _run(r, string.ascii_letters + string.digits, 32, 44),
        lambda: r.choice(["ghp_", "sk-", "pk_test_", ""]) + _run(r, string.ascii_letters + string.digits, 7, 10) * r.randint(3, 6),
        lambda: r.choice(["sk-", "pk_live_", "sk_test_", "rk_"]) + _run(r, string.ascii_letters + string.digits, 24, 48),
        lambda: "xox" + r.choice("abp") + "-" + _run(r, string.digits, 10, 12) + "-" + _run(r, string.ascii_letters + string.digits, 20, 28),
        lambda: "eyJ" + _run(r, b64[:-2], 20, 60) + "." + _run(r, b64[:-2], 30, 90) + "." + _run(r, b64[:-2] + "_-", 30, 50),
        lambda: _run(r, b64, 28, 80) + r.choice(["", "=", "=="]),
        lambda: "AIza" + _run(r, b64[:-2] + "_-", 35, 35),
        lambda: _run(r, hexa, 32, 64),
        lambda: _run(r, hexa, 40, 40).upper(),
        lambda: _run(r, up, 20, 32),
        lambda: _run(r, low, 24, 40),
        lambda: _run(r, string.ascii_letters + string.digits, 20, 44),
        lambda: _run(r, r.choice([string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase]), 20, 44),
        lambda: _run(r, r.choice([string.ascii_letters, string.ascii_letters + string.digits]), 16, 19),
    ]
    others = [
        lambda: _run(r, string.digits, 16, 24),
        lambda: r.choice("3456") + _run(r, string.digits, 15, 15),
        lambda: r.choice("45") + _run(r, string.digits, 15, 15) + r.choice(["", "", "."]),
        lambda: r.choice(["", "www."]) + _word(r) + str(r.randint(0, 9)) + "." + r.choice(["example", _word(r, 5, 9)]) + "." + r.choice(["com", "org", "net", "de"]),
        lambda: ".".join(_word(r) for _ in range(3)) + str(r.randint(1, 99)) + "." + r.choice(["com", "org", "net", "example"]),
        lambda: "/".join(_word(r) for _ in range(r.randint(3, 6))) + "/" + str(r.randint(1, 2030)),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}-{r.randint(0, 59):02d}-00",
        lambda: "-".join(_word(r) for _ in range(r.randint(3, 6))) + "-" + str(r.randint(1, 999)),
        lambda: "_".join(_word(r) for _ in range(r.randint(3, 6))) + "_" + str(r.randint(1, 99)),
        lambda: _word(r, 14, 24) + str(r.randint(1, 99)) + r.choice(["", "."]),
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(r.randint(5, 8))),
        lambda: r.choice("-=_.") * r.randint(12, 40) + str(r.randint(1, 9)),
        lambda: str(r.randint(1, 9)) + r.choice("0123456789xX.") * r.randint(16, 40),
        lambda: "+".join(str(r.randint(1, 9999)) for _ in range(r.randint(4, 8))),
        lambda: _word(r, 8, 12) + "." + _word(r, 8, 12) + "." + str(r.randint(1, 99)),
        lambda: _word(r, 2, 4) * r.randint(5, 9) + str(r.randint(0, 9)),
        lambda: "-".join(_word(r, 4, 9) for _ in range(r.randint(3, 6))),
        lambda: "".join(_word(r, 3, 7) for _ in range(r.randint(4, 7))).capitalize() + r.choice(["", ".", "..."]),
        lambda: r.choice([str, str.capitalize, str.upper])(_long_word(r)) + r.choice(["", "", ".", "-", "="]),
        lambda: _long_word(r) + r.choice("./-_") + _long_word(r, 4, 12),
        lambda: r.choice("-=_./+") * r.randint(16, 80),
        lambda: "/".join(_word(r) for _ in range(r.randint(3, 7))) + r.choice(["", "/", ".html", ".txt"]),
    ]
    leads = ["", "key: ", "Bearer ", "export KEY=", "auth=", "Authorization ", "credential ", "private: "]
    for i in range(count):
        label = i % 2
        core = _run(r, string.digits, 16, 16) if not label and r.random() < 0.25 else r.choice(keys if label else others)()
        lead = r.choice(leads) if r.random() < (0.5 if label else 0.3) else ""
        quote = r.choice(["", "", '"', "'", "`", "(", "<"])
        before = _prose(r) + r.choice([" ", "\n", ". ", ", ", " | "]) + lead + quote
        after = quote + r.choice([" ", "\n", ".\n", ", ", "### ", "!! "]) + _prose(r)
        out.append((before + core + after, len(before), len(before) + len(core), label))
    return out


def finding_scores(net: Network, findings: list[np.ndarray]) -> np.ndarray:
    """The score of each finding (its views): the best one of them, as a scan takes it."""
    at = np.cumsum([0, *map(len, findings)])[:-1]
    return np.maximum.reduceat(net.scores(np.concatenate(findings)), at)


@functools.lru_cache(maxsize=4)
def train(findings: int = FINDINGS, epochs: int = 8, seed: int = 11, recall: float = RECALL) -> Network:
    """A network fitted on three quarters of the labelled findings, calibrated and given its threshold on the rest.

    All views of a finding are on one side. The threshold is the highest one by which the share `recall` of the held-back keys is found.
    """
    parts = [(views(code_points(text), start, end), label) for text, start, end, label in labelled_findings(findings, seed)]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(parts)).tolist()
    held, used = [parts[i] for i in order[: len(parts) // 4]], [parts[i] for i in order[len(parts) // 4 :]]
    x, y = np.concatenate([v for v, _ in used]), np.repeat([float(label) for _, label in used], [len(v) for v, _ in used])
    channels, span, filters, hidden = 8, 5, 24, 16
    net = Network(
        rng.normal(0, 0.5, (97, channels)), rng.normal(0, (span * channels) ** -0.5, (span, channels, filters)), np.zeros(filters),
        rng.normal(0, filters**-0.5, (filters, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0,
    )
    state: dict = {}
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            net.step(x[part], y[part], state, 0.004 if epoch < epochs - 2 else 0.001)
    raw, label = net.logits(np.concatenate([v for v, _ in held])), np.repeat([float(k) for _, k in held], [len(v) for v, _ in held])
    for _ in range(300):  # scale and offset by gradient descent on the held-back loss
        d = 1 / (1 + np.exp(-(net.scale * raw + net.offset))) - label
        net.scale -= 0.05 * float((d * raw).mean())
        net.offset -= 0.1 * float(d.mean())
    good = np.sort(finding_scores(net, [v for v, k in held if k]))
    net.threshold = float(good[int((1 - recall) * len(good))])
    return net


def scan_text(text: str | None, net: Network) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all findings of a text, by start and then by kind."""
    return scan_texts([text], net)[0]


def scan_texts(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int]]]:
    found, rows, owner = [], [], []
    for i, text in enumerate(texts):
        points = code_points(text or "")
        base = base_findings(text or "", points)
        found.append(base)
        starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
        for s, e in candidates(points):
            k = bisect.bisect_right(starts, s)
            if not k or reach[k - 1] < e:  # what a pattern has whole needs no score
                part = views(points, s, e)
                rows.append(part)
                owner += [(i, s, e)] * len(part)
    if rows:
        scores = net.scores(np.concatenate(rows))
        for i, s, e in sorted({o for o, v in zip(owner, scores.tolist(), strict=True) if v >= net.threshold}):
            bisect.insort(found[i], (s, 3, e))
    return found


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net or train())  # a few thousand weights

    def scan(batches):
        for batch in batches:
            texts = batch_texts(batch)
            rows = []
            for at in range(0, len(texts), 256):
                for spans in scan_texts(texts.slice(at, 256).to_pylist(), shared.value):
                    counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                    base = _said([x for x in spans if x[1] < 3])
                    rows.append((*counts[:3], hashlib.sha256(base.encode()).hexdigest(), _said(spans), counts[3]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
