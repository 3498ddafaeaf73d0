"""Abusive, hateful or sexual content (problem 10).

A bidirectional gated recurrent network with attention pooling reads overlapping windows of tokens. A token's input is the sum of what its
word and its character trigrams embed to. The network is trained here, in numpy, from seed phrases and a bounded sample of labelled
documents; every window of every document is scored and a document has the score of its worst window.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import toxic_seeds
from codeloom.session import shared_dir, table

#: Labelled documents that are used at most, by the order of a hash of their id.
LABELLED_DOCS = 3000
#: Windows of harmless labelled documents that the network is trained on at most, taken at random with a fixed seed.
HARMLESS_WINDOWS = 6000
#: Of all windows of harmless labelled documents, the most alarming that it is trained on again at most.
HARD_WINDOWS = 1500
WINDOW, STRIDE = 16, 8
THRESHOLD = 0.7
WORDS, TRIGRAMS, EMBED, HIDDEN = 8192, 4096, 32, 24
EPOCHS = 6

_ZERO_WIDTH = re.compile("[­​-‏⁠﻿᠎]")
# Letters of other scripts that look like Latin ones, and signs written for letters.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһӏкмтвнпгАЕОРСУХІЈЅВНКМТαοερτυικνβ", "aeopcyxijsdhlkmtbhnrAEOPCYXIJSBHKMTaoeptuiknb")
_LEET = str.maketrans("$@013457!|", "saoieastil")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CODE = re.compile(r"\S*(?:[a-z][A-Z]\w|[\w)]/\w|\w_\w|\w\.\w{2,4}\b|::|\(\))\S*")
#: A tag of HTML: a known name, then attributes with values.
_TAG = re.compile(
    r"</?(?:a|abbr|article|aside|b|blockquote|body|br|button|code|dd|div|dl|dt|em|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|kbd|label|li|link|main|meta|nav|ol|option|p|pre|s|samp|script|section|select|small|span|strong|style|sub|sup|table|tbody|td|textarea|tfoot|th|thead|title|tr|tt|u|ul|var|video)"
    r"(?:\s+[\w:.\-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+)){0,40}\s*/?>|<!--|-->",
    re.I,
)
_SPACED = re.compile(r"(?<![^\W_])[^\W_]([ ._\-*])(?:[^\W_]\1)+[^\W_](?![^\W_])")
#: Three single letters with the same sign between, which any spread word has.
_MAY_BE_SPACED = re.compile(r"[^\W_]([ ._\-*])[^\W_]\1[^\W_]")
_MIXED = re.compile(r"(?<!\S)(?=\S*[A-Za-z])(?=\S*[$@0-9!|*])[\w$@!|*]+(?!\S)")
_STRETCH = re.compile(r"(.)\1{2,}")


def _chunk_tokens(chunk: str) -> tuple[str, ...]:
    """Words of what stands between two spaces."""
    t = re.sub(r"https?://", " codeid ", chunk)
    # All capitals are shouting, not identifiers.
    t = _CODE.sub(lambda m: m[0] if m[0].isupper() and "/" not in m[0] and "_" not in m[0] else " codeid " + re.sub(r"[\W_]+", " ", m[0]) + " ", t)
    t = _MIXED.sub(lambda m: m[0].rstrip("!").translate(_LEET) if not m[0].rstrip("!.,;:").isdigit() else " ", t)
    t = re.sub(r"(?<=[^\W\d_])[*](?=[^\W\d_])", "", t)
    return tuple(_STRETCH.sub(r"\1", w) if not w.isdigit() else "0" for w in _TOKEN.findall(t.lower()))


#: Words of chunks seen lately; a text of any length is read whole, chunk by chunk.
_SEEN: dict[str, tuple[str, ...]] = {}


def tokens(text: str) -> list[str]:
    """Lower-case words of a text, with disguises undone: look-alike letters, hidden characters, spread letters, signs for letters.

    Before a path's or an identifier's words stands a token that says so. Words are split at separators, not at capitals, which may be a disguise.
    """
    t = text if text.isascii() else _ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", text)).translate(_LOOKALIKE)
    if _MAY_BE_SPACED.search(t):
        t = _SPACED.sub(lambda m: re.sub(r"[ ._\-*]", "", m[0]), t)
    if "<" in t or "-->" in t:
        t = _TAG.sub(" ", t)
    if len(_SEEN) > 200_000:
        _SEEN.clear()
    out: list[str] = []
    for c in t.split():
        words = _SEEN.get(c)
        if words is None:
            words = _SEEN[c] = _chunk_tokens(c)
        out += words
    return out


def windows(words: list[str], size: int = WINDOW, stride: int = STRIDE) -> list[list[str]]:
    """All overlapping windows; a short text is one window, an empty one has none."""
    if len(words) <= size:
        return [words] if words else []
    starts = list(range(0, len(words) - size, stride)) + [len(words) - size]
    return [words[a : a + size] for a in starts]


@lru_cache(maxsize=200_000)
def _hashed(word: str) -> tuple[int, list[int]]:
    w = f"<{word}>"
    return zlib.crc32(word.encode()) % WORDS, [zlib.crc32(b"t" + w[i : i + 3].encode()) % TRIGRAMS for i in range(len(w) - 2)]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The recurrent network: parameters, forward pass, gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * np.sqrt(1.0 / s[0])).astype(np.float32)
        self.p = {"Ew": (r.standard_normal((WORDS, EMBED)) * 0.1).astype(np.float32), "Ec": (r.standard_normal((TRIGRAMS, EMBED)) * 0.1).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": g(EMBED, 3 * HIDDEN), f"U{d}": g(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": g(2 * HIDDEN, HIDDEN), "v": g(HIDDEN, 1)[:, 0], "o": g(2 * HIDDEN, 1)[:, 0], "k": np.zeros(1, np.float32)}

    def embed(self, vocab: list[str]):
        """Vectors of the words; row 0 is padding."""
        ids = [_hashed(w) for w in vocab]
        flat = np.array([t for _, ts in ids for t in ts], np.int64)
        owner = np.repeat(np.arange(len(ids)), [len(ts) for _, ts in ids])
        count = np.maximum(1, np.bincount(owner, minlength=len(ids)))[:, None].astype(np.float32)
        x = np.zeros((len(vocab) + 1, EMBED), np.float32)
        chars = np.zeros((len(ids), EMBED), np.float32)
        np.add.at(chars, owner, self.p["Ec"][flat])
        words = np.array([w for w, _ in ids], np.int64)
        x[1:] = self.p["Ew"][words] + chars / count
        return x, (words, flat, owner, count)

    def forward(self, x, idx, keep: bool = False):
        """Probabilities of windows (rows of indices into x); steps of padding leave the state as it was."""
        n, t = idx.shape
        mask = (idx > 0).astype(np.float32)
        p, states, saved = self.p, [], {}
        for d in "fb":
            proj = x @ p[f"W{d}"] + p[f"c{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            out, steps = np.empty((n, t, HIDDEN), np.float32), []
            for s in range(t) if d == "f" else range(t - 1, -1, -1):
                a, u = proj[idx[:, s]], h @ p[f"U{d}"]
                zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                m = mask[:, s : s + 1]
                new = h + m * z * (c - h)
                if keep:
                    steps.append((s, h, z, r, c, u[:, 2 * HIDDEN :], m))
                h = new
                out[:, s] = h
            states.append(out)
            saved[d] = steps
        hs = np.concatenate(states, 2)
        e = np.tanh(hs @ p["A"])
        score = e @ p["v"] + (mask - 1) * 1e4
        w = np.exp(score - score.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        pooled = (w[:, :, None] * hs).sum(1)
        y = _sigmoid(pooled @ p["o"] + p["k"])
        return (y, (hs, e, w, pooled, saved)) if keep else y

    def infer(self, x, idx):
        """The same probabilities as ``forward``, with fewer passes over memory: time comes first, and a sigmoid is a hyperbolic tangent of half its argument."""
        n, t = idx.shape
        at, h2, p = np.ascontiguousarray(idx.T), 2 * HIDDEN, self.p
        mask = (at > 0).astype(np.float32)[:, :, None]
        full = bool(mask.all())
        hs = np.empty((t, n, h2), np.float32)
        half = np.concatenate([np.full(h2, 0.5, np.float32), np.ones(HIDDEN, np.float32)])
        for d, lane, steps in (("f", slice(0, HIDDEN), range(t)), ("b", slice(HIDDEN, h2), range(t - 1, -1, -1))):
            proj, u_d = (x @ p[f"W{d}"] + p[f"c{d}"]) * half, p[f"U{d}"] * half
            h = np.zeros((n, HIDDEN), np.float32)
            for s in steps:
                a, u = proj[at[s]], h @ u_d
                g = a[:, :h2] + u[:, :h2]
                np.tanh(g, out=g)
                g += 1
                g *= 0.5
                c = g[:, HIDDEN:] * u[:, h2:]
                c += a[:, h2:]
                np.tanh(c, out=c)
                c -= h
                c *= g[:, :HIDDEN]
                if not full:
                    c *= mask[s]
                h = h + c
                hs[s, :, lane] = h
        score = (np.tanh(hs.reshape(-1, h2) @ p["A"]) @ p["v"]).reshape(t, n)
        if not full:
            score += (mask[:, :, 0] - 1) * 1e4
        w = np.exp(score - score.max(0))
        w /= w.sum(0)
        return _sigmoid(np.einsum("tn,tnh->nh", w, hs) @ p["o"] + p["k"])

    def gradients(self, x, idx, y, weight):
        """Gradients of the weighted cross entropy, with those of the word vectors under 'x'."""
        p = self.p
        out, (hs, e, w, pooled, saved) = self.forward(x, idx, keep=True)
        n = len(y)
        dy = ((out - y) * weight / n).astype(np.float32)
        g = {"o": pooled.T @ dy, "k": np.array([dy.sum()], np.float32)}
        dpool = dy[:, None] * p["o"]
        dhs = w[:, :, None] * dpool[:, None, :]
        dw = (hs * dpool[:, None, :]).sum(2)
        ds = w * (dw - (w * dw).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nth->h", ds, e)
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["A"] = np.einsum("nti,ntj->ij", hs, de)
        dhs = dhs + de @ p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            dh = np.zeros((n, HIDDEN), np.float32)
            gu, dproj = np.zeros_like(p[f"U{d}"]), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for s, h, z, r, c, uc, m in reversed(saved[d]):
                dh = dh + dhs[:, s, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dh * m * z * (1 - c * c)
                dz = dh * m * (c - h) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                gu += h.T @ du
                np.add.at(dproj, idx[:, s], da)
                dh = dh * (1 - m * z) + du @ p[f"U{d}"].T
            g[f"U{d}"] = gu
            g[f"c{d}"] = dproj.sum(0)
            g[f"W{d}"] = x.T @ dproj
            dx += dproj @ p[f"W{d}"].T
        g["x"] = dx
        return g


def _indexed(batch: list[list[str]]) -> tuple[list[str], np.ndarray]:
    vocab: dict[str, int] = {}
    idx = np.zeros((len(batch), WINDOW), np.int64)
    for i, words in enumerate(batch):
        for j, w in enumerate(words[:WINDOW]):
            idx[i, j] = vocab.setdefault(w, len(vocab) + 1)
    return list(vocab), idx


def predict(net: Network, batch: list[list[str]], size: int = 1024) -> np.ndarray:
    """Probabilities of windows; equal windows are scored once, words are embedded once for all."""
    if not batch:
        return np.zeros(0, np.float32)
    place: dict[tuple[str, ...], int] = {}
    at = [place.setdefault(tuple(w[:WINDOW]), len(place)) for w in batch]
    vocab, idx = _indexed(list(place))
    x, _ = net.embed(vocab)
    return np.concatenate([net.infer(x, idx[a : a + size]) for a in range(0, len(idx), size)])[at]


def fit(data: list[tuple[list[str], float]], epochs: int = EPOCHS, seed: int = 7, batch: int = 128, rate: float = 4e-3, net: Network | None = None) -> Network:
    """Trains by Adam; of the word and trigram vectors, only the rows that a batch uses are changed."""
    net, rng = net or Network(seed), random.Random(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0

    def move(k: str, g: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        m[k][rows] = 0.9 * m[k][rows] + 0.1 * g
        s[k][rows] = 0.999 * s[k][rows] + 0.001 * g * g
        net.p[k][rows] -= (rate * (m[k][rows] / (1 - 0.9**step)) / (np.sqrt(s[k][rows] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def summed(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, inverse = np.unique(at, return_inverse=True)
        out = np.zeros((len(rows), g.shape[1]), np.float32)
        np.add.at(out, inverse, g)
        return out, rows

    for _ in range(epochs):
        rng.shuffle(data)
        for a in range(0, len(data), batch):
            part = data[a : a + batch]
            vocab, idx = _indexed([w for w, _ in part])
            x, (words, flat, owner, count) = net.embed(vocab)
            y = np.array([v for _, v in part], np.float32)
            g = net.gradients(x, idx, y, np.ones_like(y))
            dx = g.pop("x")[1:]
            step += 1
            for k, v in g.items():
                move(k, v)
            move("Ew", *summed(words, dx))
            move("Ec", *summed(flat, (dx / count)[owner]))
    return net


def seed_phrases(rng: random.Random, per_frame: int = 5) -> list[list[str]]:
    """Harmful phrases from the frames, with their slots filled at random."""
    out = []
    for lang, frames in toxic_seeds.HARMFUL.items():
        slots = toxic_seeds.SLOTS[lang]
        for f in frames:
            for _ in range(per_frame if "{" in f else 2 if lang == "en" else 3):
                out.append(tokens(f.format(**{k: rng.choice(v).replace("_", " ") for k, v in slots.items()})))
    return out


def train(labelled: list[tuple[str, int]], seed: int = 7) -> Network:
    """A network from labelled texts (some labels are wrong) and the seed phrases.

    First it learns from seeds among harmless windows. Then a harmful document's worst window, if it looks harmful at all, joins the harmful
    ones, and the windows of all harmless documents that look most harmful join the harmless ones.
    """
    rng = random.Random(seed)
    every = [w for t, y in labelled if not y for w in windows(tokens(t))]
    rng.shuffle(every)
    clean = every[:HARMLESS_WINDOWS]
    harmful = seed_phrases(rng)
    harmless = [tokens(x) for x in toxic_seeds.HARMLESS]

    def placed(phrase: list[str]) -> list[str]:
        """A phrase somewhere in a harmless window, or alone."""
        if not clean or rng.random() < 0.25:
            return phrase[:WINDOW]
        around = rng.choice(clean)
        room = max(0, WINDOW - len(phrase))
        a = rng.randrange(room + 1)
        return (around[:a] + phrase + around[a : a + room])[:WINDOW] if a else (phrase + around[:room])[:WINDOW]

    def cut_off(phrase: list[str]) -> list[str]:
        """The beginning of a harmless phrase at the end of a window, as overlapping windows show it too."""
        if not clean or len(phrase) < 4:
            return phrase[:WINDOW]
        n = rng.randrange(2, len(phrase))
        return (rng.choice(clean)[: WINDOW - n] + phrase[:n])[:WINDOW]

    def sets(pos: list[list[str]], neg: list[list[str]]) -> list[tuple[list[str], float]]:
        return [(placed(x), 1.0) for x in pos] + [(placed(x), 0.0) for x in harmless for _ in range(6)] + [(cut_off(x), 0.0) for x in harmless for _ in range(4)] + [(w, 0.0) for w in neg]

    net = fit(sets(harmful, clean), EPOCHS, seed)
    if labelled:
        # A label that calls a harmful text harmless is rare, so what alarms there falsely is learnt from; what alarms most may be such a label and counts once.
        score = predict(net, every)
        order = np.argsort(-score)[:HARD_WINDOWS]
        hard = [every[i] for i in order if score[i] > 0.02 for _ in range(1 if score[i] > 0.98 else 3)]
        found = []
        for t, y in labelled:
            if y:
                ws = windows(tokens(t))
                if ws:
                    p = predict(net, ws)
                    if p.max() > 0.3:
                        found.append(ws[int(p.argmax())])
        net = fit(sets(harmful, clean + hard) + [(w, 1.0) for w in found for _ in range(2)], EPOCHS, seed + 1)
    return net


def labelled_sample(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_DOCS) -> list[tuple[str, int]]:
    """Up to ``limit`` labelled texts with their label; documents whose labels disagree, null and empty texts are left out."""
    per_doc = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least")).where((F.col("toxic") > 0) == (F.col("least") > 0))
    rows = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).join(documents.select("doc_id", "text"), "doc_id").where(F.length(F.trim("text")) > 0)
    return sorted((r["text"], int(r["toxic"] > 0)) for r in rows.select("text", "toxic").distinct().collect())


SCORE_SCHEMA = "doc_id long, source string, score double, n_windows int"


def score_documents(documents: DataFrame, net: Network) -> DataFrame:
    """(doc_id, source, score, n_windows): the worst window's probability; documents without words have score 0.

    ``source`` is in lower case with underscores. Null ids give no rows; repeated rows repeat.
    """
    params = documents.sparkSession.sparkContext.broadcast(net.p)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Network.__new__(Network)
        model.p = params.value
        for pdf in batches:
            owner, batch, n = [], [], []
            best = np.zeros(len(pdf))
            for i, text in enumerate(pdf.text):
                ws = windows(tokens(text)) if text else []
                n.append(len(ws))
                batch += ws
                owner += [i] * len(ws)
                if len(batch) > 20000:
                    np.maximum.at(best, owner, predict(model, batch))
                    owner, batch = [], []
            if batch:
                np.maximum.at(best, owner, predict(model, batch))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "score": best, "n_windows": n})

    source = F.regexp_replace(F.trim(F.lower("source")), r"[\s\-]+", "_")
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", source.alias("source"), "text")
    return rows.mapInPandas(scored, SCORE_SCHEMA)


def fitted(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> Network:
    """The network for these labels: fitted once and stored in the shared folder under a hash of all it depends on, then loaded."""
    labelled = labelled_sample(documents, labels)
    made_of = [labelled, toxic_seeds.SLOTS, toxic_seeds.HARMFUL, toxic_seeds.HARMLESS, WINDOW, STRIDE, WORDS, TRIGRAMS, EMBED, HIDDEN, EPOCHS, HARMLESS_WINDOWS, HARD_WINDOWS]
    at = f"{shared_dir(spark)}/abuse-model-{hashlib.sha256(json.dumps(made_of).encode()).hexdigest()[:32]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = [(k, [int(n) for n in v.shape], bytearray(v.astype(np.float32).tobytes())) for k, v in train(labelled).p.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, value binary").coalesce(1).write.mode("overwrite").parquet(at)
    net = Network.__new__(Network)
    net.p = {r["name"]: np.frombuffer(bytes(r["value"]), np.float32).reshape(r["shape"]) for r in spark.read.parquet(at).collect()}
    return net


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels")
    return score_documents(documents, fitted(spark, documents, labels))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_docs, n_found, rate) per source."""
    docs = document_scores(spark, sf_dir).dropDuplicates(["doc_id"])
    found = F.sum((F.col("score") >= THRESHOLD).cast("long"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), found.alias("n_found")).withColumn("rate", F.round(F.col("n_found") / F.col("n_docs"), 6))


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
