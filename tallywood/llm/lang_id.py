"""Language ID by a bidirectional gated recurrent network over bytes (operator 6).

Two recurrent layers read the bytes of a chunk forward and backward; at every byte their states give
probabilities of the languages, and the mean over all bytes of a document gives its own. Texts are cut
into chunks of chunk_bytes, all of which are read. The network is trained in numpy by backpropagation
through time, on a part of sample_chars characters each of about per_language labelled documents of
each language: that is the bound of the sample. Every language that has a labelled row is learned.

Beside the languages the network learns one more label, "other": texts of the sample whose letters are
exchanged for others, and runs of random characters. The share a document gives it tells text of none of
the learned languages, whatever their number.

Defined results: null texts and texts without a letter (str.isalpha) get ``und``, score 0 and other 1, as all texts do where
no row has a language to learn from; rows without doc_id are never learned from; rows labelled ``und`` are
learned like any language; ties between languages go to the first in alphabetical order; repeated rows
are labelled alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended

#: Letters, and some characters that str.isalpha doesn't take for any.
WORDY = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in WORDY.finditer(text))


def strange(text: str, r: np.random.Generator) -> str:
    """The text with its letters exchanged for others, all alike or vowels for vowels; or as many random characters."""
    kind = int(r.integers(0, 4))
    if kind == 0:
        marks = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "qwrtzpsdfgjklmnbvcxy ", "".join(map(chr, range(at := int(r.integers(0x370, 0xD000)), at + 60))) + " " * 9)[int(r.integers(0, 4))]
        return "".join(r.choice(list(marks), len(text)))
    low = sorted({c for c in text.lower() if c.isalpha()} | set("abcdefghijklmnopqrstuvwxyz"))
    groups = [low] if kind == 1 else [[c for c in low if c in "aeiouyáéíóúàèùâêîôûäöü"], [c for c in low if c not in "aeiouyáéíóúàèùâêîôûäöü"]]
    to = {a: b for g in groups for a, b in zip(g, r.permutation(g).tolist(), strict=True)}
    return "".join(to.get(c, to.get(c.lower(), c).upper() if c.lower() in to else c) for c in text)


@dataclass
class Network:
    """Weights of both directions: bytes to gates, state to gates, state to candidate; then the output layer.

    Update and reset gates are kept at half scale, so that their sigmoid is (1 + tanh) / 2.
    """

    byte: np.ndarray  # (2, 256, 3 * hidden)
    gates: np.ndarray  # (2, hidden, 2 * hidden)
    cand: np.ndarray  # (2, hidden, hidden)
    out: np.ndarray  # (2 * hidden + 1, labels)

    @classmethod
    def fresh(cls, hidden: int, labels: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(f(2, 256, 3 * hidden, scale=0.3), f(2, hidden, 2 * hidden, scale=0.3 / hidden**0.5), f(2, hidden, hidden, scale=hidden**-0.5), f(2 * hidden + 1, labels, scale=0.1))

    def arrays(self) -> list[np.ndarray]:
        return [self.byte, self.gates, self.cand, self.out]

    def states(self, x: np.ndarray, on: np.ndarray | None = None, keep: bool = False):
        """States (steps, rows, 2 * hidden) after each byte of x (steps, rows); with keep also what backpropagation needs.

        Where on is false, at the end of a short chunk, there is no byte and the state stays zero.
        """
        steps, rows = x.shape
        hid = self.cand.shape[1]
        h_all = np.empty((steps, rows, 2 * hid), np.float32)
        tape = []
        for d in (0, 1):
            h = np.zeros((rows, hid), np.float32)
            order = range(steps) if d == 0 else range(steps - 1, -1, -1)
            kept = []
            for t in order:
                g = self.byte[d][x[t]]
                a = h @ self.gates[d]
                a += g[:, : 2 * hid]
                np.tanh(a, out=a)
                a *= 0.5
                a += 0.5
                z, r = a[:, :hid], a[:, hid:]
                c = (r * h) @ self.cand[d]
                c += g[:, 2 * hid :]
                np.tanh(c, out=c)
                if keep:
                    kept.append((t, h, z, r, c))
                h = h + z * (c - h)
                if d and on is not None and not on[t].all():
                    h *= on[t][:, None]
                h_all[t, :, d * hid : (d + 1) * hid] = h
            tape.append(kept)
        return (h_all, tape) if keep else h_all

    def probabilities(self, h: np.ndarray) -> np.ndarray:
        p = h @ self.out[:-1]
        p += self.out[-1]
        p -= p.max(axis=-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=-1, keepdims=True)
        return p

    def gradient(self, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the bytes where on, and its derivatives by backpropagation through time."""
        hid = self.cand.shape[1]
        h_all, tape = self.states(x, on, keep=True)
        p = self.probabilities(h_all)
        n = max(1, int(on.sum()))
        picked = np.take_along_axis(p, np.broadcast_to(y, x.shape)[..., None], -1)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * on).sum() / n)
        d_out = p.copy()
        np.put_along_axis(d_out, np.broadcast_to(y, x.shape)[..., None], picked[..., None] - 1, -1)
        d_out *= (on / n)[..., None].astype(np.float32)
        g_byte, g_gates, g_cand = (np.zeros_like(a) for a in (self.byte, self.gates, self.cand))
        flat = h_all.reshape(-1, 2 * hid)
        g_out = np.concatenate([flat.T @ d_out.reshape(len(flat), -1), d_out.sum(axis=(0, 1))[None]])
        d_states = d_out @ self.out[:-1].T
        for d in (0, 1):
            back = np.zeros((x.shape[1], hid), np.float32)
            pre = np.empty((*x.shape, 3 * hid), np.float32)
            for t, h, z, r, c in reversed(tape[d]):
                dh = d_states[t, :, d * hid : (d + 1) * hid] + back
                if d:
                    dh *= on[t][:, None]
                dc = dh * z * (1 - c * c)
                rh = dc @ self.cand[d].T
                dz = dh * (c - h) * z * (1 - z) * 2
                dr = rh * h * r * (1 - r) * 2
                da = np.concatenate([dz, dr], axis=1)
                back = dh * (1 - z) + rh * r + da @ self.gates[d].T
                g_gates[d] += h.T @ da
                g_cand[d] += (r * h).T @ dc
                pre[t, :, : 2 * hid], pre[t, :, 2 * hid :] = da, dc
            np.add.at(g_byte[d], x.ravel(), pre.reshape(-1, 3 * hid))
        return loss, [g_byte, g_gates, g_cand, g_out]


def train(texts: list[bytes], labels: np.ndarray, n_labels: int, hidden: int = 12, steps: int = 220, rows: int = 96, chunk: int = 64, rate: float = 0.02, seed: int = 1) -> Network:
    """A network fitted by Adam to chunks of texts, as many of each label in a batch."""
    net, r = Network.fresh(hidden, n_labels, seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(a) for a in net.arrays()] for _ in range(2))
    groups = [np.flatnonzero(labels == k) for k in range(n_labels)]
    groups = [g for g in groups if len(g)]
    for step in range(1, steps + 1):
        x, on, y = np.zeros((chunk, rows), np.uint8), np.zeros((chunk, rows), bool), np.zeros(rows, np.int64)
        for j in range(rows):
            i = r.choice(groups[j % len(groups)])
            t = texts[i]
            at = int(r.integers(0, max(1, len(t) - chunk + 1)))
            part = np.frombuffer(t[at : at + chunk], np.uint8)
            x[: len(part), j], on[: len(part), j], y[j] = part, True, labels[i]
        _, grads = net.gradient(x, y[None, :], on)
        for a, g, m, v in zip(net.arrays(), grads, first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes], chunk: int = 128, rows: int = 1024) -> np.ndarray:
    """The mean of the probabilities at all bytes of each text; an empty text gets zeros."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    parts = -(-sizes // chunk)
    total = np.zeros((len(texts), net.out.shape[1]))
    owner = np.repeat(np.arange(len(texts)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.frombuffer(b"".join(texts) + bytes(chunk), np.uint8)
    at, count = begin[owner] + nth * chunk, np.minimum(chunk, sizes[owner] - nth * chunk)
    for lo in range(0, len(owner), rows):
        a, n = at[lo : lo + rows], count[lo : lo + rows]
        x = flat[a[None, :] + np.arange(chunk)[:, None]]
        on = np.arange(chunk)[:, None] < n
        x = np.where(on, x, 0).astype(np.uint8)
        p = net.probabilities(net.states(x, on))
        p *= on[..., None]
        np.add.at(total, owner[lo : lo + rows], p.sum(axis=0))
    return total / np.maximum(sizes, 1)[:, None]


def held_out(id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2; or no id."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(4)) == 2, F.lit(True))


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 250, sample_chars: int = 600, **options) -> tuple[list[str], Network | None]:
    """(languages, network) learned from the rows of df that aren't held out and have a language.

    The sample: per_language documents of each language or so, chosen by the hash of their ids, and
    of each a part of sample_chars characters from a place that the hash gives.
    """
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # as many rows as there are languages
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], None
    names = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, per_language / counts[k]))])
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    start = F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.length("text") - sample_chars, F.lit(1))) + 1
    sample = rows.filter(chance < F.try_element_at(share, F.col("lang"))).select("lang", F.col("text").substr(start.cast("int"), F.lit(sample_chars)).alias("t"), "id", chance.alias("c"))
    # repeated ids have the same chance: beyond twice the number the bound holds by an order of its own
    sample = sample.orderBy("c", "id", "lang", "t").limit(2 * per_language * len(names)).collect()
    sample = sorted((r.id, r.t, r.lang) for r in sample if has_letter(r.t))
    if not sample:
        return [], None
    r = np.random.default_rng(11)
    none = [strange(sample[int(k)][1], r) for k in r.integers(0, len(sample), max(60, len(sample) // len(names)))]
    labels = np.array([names.index(x[2]) for x in sample] + [len(names)] * len(none))
    return names, train([x[1].encode() for x in sample] + [t.encode() for t in none], labels, len(names) + 1, **options)


def identify(df: DataFrame, model: tuple[list[str], Network | None], text: str = "text") -> DataFrame:
    """df with lang_pred, score and other; columns of these names are replaced.

    score is the mean probability of the language named, other that of none of the learned ones.
    """
    names, net = model

    def make():
        def f(texts: pa.Array) -> list[pa.Array]:
            known = [t.encode() if net is not None and has_letter(t) else b"" for t in texts.to_pylist()]
            p = pooled(net, known) if net is not None else np.zeros((len(known), 2))
            best = p[:, :-1].argmax(axis=1)
            some = np.array([len(t) > 0 for t in known], bool)
            score, other = np.clip(p[np.arange(len(p)), best], 0, 1), np.clip(p[:, -1], 0, 1)
            return [pa.array([names[k] if s else "und" for k, s in zip(best, some, strict=True)], pa.string()), pa.array(np.where(some, score, 0.0), pa.float64()), pa.array(np.where(some, other, 1.0), pa.float64())]

        return f

    return appended(df, make, [text], [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("other", T.DoubleType())])
