"""Language identification: a bidirectional gated recurrent network over bytes, trained by backpropagation
through time; it labels every position, and a document's languages are pooled over its positions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import bounded_sample, held_out, table, text_buffers

#: Bytes that are labelled at a time, and bytes before and behind that the states are brought up on.
WINDOW, CONTEXT = 128, 16
HIDDEN = 10
PAD = 256  # symbol before and behind a text


def init(classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Per direction: e (symbol to gate inputs, biases within), u (state to gates); o and ob: states to labels."""
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["e" + d] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
        p["u" + d] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
    p["o"] = rng.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32)
    p["ob"] = np.zeros(classes, np.float32)
    return p


def scan(x: np.ndarray, e: np.ndarray, u: np.ndarray, keep: bool):
    """States of one direction; x: (steps, lanes) symbols. Gates by tanh(a/2): z, r in one call."""
    steps, lanes = x.shape
    k = u.shape[0]
    h = np.zeros((lanes, k), np.float32)
    states = np.empty((steps, lanes, k), np.float32)
    tape = []
    uzr, un = np.ascontiguousarray(u[:, : 2 * k]), np.ascontiguousarray(u[:, 2 * k :])
    for t in range(steps):
        a = e[x[t]]
        g = h @ uzr
        g += a[:, : 2 * k]
        g *= 0.5
        np.tanh(g, out=g)
        g += 1
        g *= 0.5
        z, r = g[:, :k], g[:, k:]
        rh = r * h
        n = rh @ un
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        if keep:
            tape.append((h, z, r, rh, n))
        h = n + z * (h - n)
        states[t] = h
    return states, tape


def back(x, e, u, tape, dstates, de, du):
    """Backpropagation through time of one direction, adding to de and du."""
    k = u.shape[0]
    dh = np.zeros_like(tape[0][0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, rh, n = tape[t]
        dh = dh + dstates[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        drh = dn @ u[:, 2 * k :].T
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate((dz, dr), axis=1)
        du[:, 2 * k :] += rh.T @ dn
        du[:, : 2 * k] += h.T @ dzr
        np.add.at(de, x[t], np.concatenate((dzr, dn), axis=1))
        dh = dh * z + drh * r + dzr @ u[:, : 2 * k].T


def forward(p, x, keep=False, body=slice(None)):
    """Label probabilities of every position in ``body``: (steps, lanes, classes)."""
    f, tf = scan(x, p["ef"], p["uf"], keep)
    b, tb = scan(x[::-1], p["eb"], p["ub"], keep)
    k = f.shape[2]
    logits = f[body] @ p["o"][:k]
    logits += b[::-1][body] @ p["o"][k:]
    logits += p["ob"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits, (f, b, tf, tb)


def gradients(p, x, y):
    """Mean loss over the positions that are no padding, and its gradients. y: label of each lane."""
    prob, (f, b, tf, tb) = forward(p, x, True)
    real = (x != PAD)[:, :, None]
    n = max(1, int(real.sum()))
    lanes = np.arange(x.shape[1])
    loss = -float((np.log(prob[:, lanes, y] + 1e-9) * real[:, :, 0]).sum()) / n
    d = prob.copy()
    d[:, lanes, y] -= 1
    d = (d * real / n).astype(np.float32)
    k = f.shape[2]
    g = {name: np.zeros_like(v) for name, v in p.items()}
    flat = d.reshape(-1, d.shape[2])
    g["o"][:k] = f.reshape(-1, k).T @ flat
    g["o"][k:] = b[::-1].reshape(-1, k).T @ flat
    g["ob"] = flat.sum(axis=0)
    back(x, p["ef"], p["uf"], tf, d @ p["o"][:k].T, g["ef"], g["uf"])
    back(x[::-1], p["eb"], p["ub"], tb, (d @ p["o"][k:].T)[::-1], g["eb"], g["ub"])
    return loss, g


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (CONTEXT + WINDOW + CONTEXT, lanes) of all whole texts, a lane for every WINDOW bytes, and each lane's
    text. The bytes around come from the same text, so that no character is cut where it is labelled."""
    n = np.diff(offs)
    per = -(-n // WINDOW)
    doc = np.repeat(np.arange(len(n)), per)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW - CONTEXT
    at = first + np.arange(WINDOW + 2 * CONTEXT)[:, None]
    inside = (at >= 0) & (at < n[doc])
    return np.where(inside, np.append(data, 0).take(offs[:-1][doc] + at, mode="clip"), PAD).astype(np.int16), doc


@dataclass
class Model:
    languages: list[str]
    params: dict = field(default_factory=dict)

    def pooled(self, data: np.ndarray, offs: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Mean over each text's positions of the label probabilities: (texts, classes)."""
        x, doc = windows(data, offs)
        out = np.zeros((len(offs) - 1, len(self.languages)))
        for at in range(0, len(doc), lanes):
            part = np.ascontiguousarray(x[:, at : at + lanes])
            prob, _ = forward(self.params, part, body=slice(CONTEXT, CONTEXT + WINDOW))
            prob[part[CONTEXT : CONTEXT + WINDOW] == PAD] = 0
            sums = prob.sum(axis=0, dtype=np.float64)
            for c in range(out.shape[1]):
                out[:, c] += np.bincount(doc[at : at + lanes], sums[:, c], len(out))
        return out / np.maximum(1, np.diff(offs))[:, None]


def fit(texts: list[str], langs: list[str], steps: int = 240, lanes: int = 512, seed: int = 11, width: int = 64) -> Model:
    """Adam over random windows of ``width`` bytes that may begin before a text and end behind it, languages drawn
    evenly. No rows: a model that only knows ``und``."""
    names = sorted(set(langs))
    if not names:
        return Model(["und"], init(1))
    rng = np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    pools = [[r for r, lang in zip(raw, langs, strict=True) if lang == name and len(r)] for name in names]
    pools = [p or [np.array([32], np.uint8)] for p in pools]
    p = init(len(names))
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y = np.full((lanes, width), PAD, np.int16), rng.integers(0, len(names), lanes)
        for i, c in enumerate(y):
            r = pools[c][rng.integers(len(pools[c]))]
            at = int(rng.integers(-CONTEXT, max(1, len(r) - width // 2)))
            part = r[max(0, at) : at + width]
            x[i, max(0, -at) : max(0, -at) + len(part)] = part
        _, g = gradients(p, np.ascontiguousarray(x.T), y)
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k in p:
            grad = np.clip(g[k], -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return Model(names, p)


def training_rows(docs: DataFrame, per_language: int = 400, excerpt: int = 4000) -> tuple[list[str], list[str]]:
    """A bounded sample to fit on: of every language ``per_language`` rows, none held out, whose ids hash lowest, and of
    each an excerpt of ``excerpt`` characters from anywhere in the text; all of all texts is labelled later. Rows that
    repeat an id do not make it more."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    start = F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.lit(1), F.length("text") - excerpt + 1)) + 1
    rows = rows.select("doc_id", "lang", F.substr("text", start, F.lit(excerpt)).alias("part"))
    got = sorted(bounded_sample(rows, "lang", "doc_id", per_language), key=lambda r: (r.doc_id, r.lang, r.part))
    return [r.part for r in got], [r.lang for r in got]


def identify_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text: the language of the largest pooled probability and that
    probability. ``und`` with score 0 if the text is null or has no letter. Very long texts are labelled in windows, all
    of them; of languages that tie the first by name counts; rows that repeat give rows that repeat; other columns are
    ignored; an empty table gives an empty one."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"

    def run(batches):
        import pyarrow as pa

        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for t in text_buffers(batches, text_col, 1 << 19):
            prob = model.pooled(t.data, t.offs)
            seen = np.concatenate(([0], np.cumsum(ascii_letter[t.data])))
            letter = seen[t.offs[1:]] > seen[t.offs[:-1]]
            for i in np.flatnonzero(~letter):
                letter[i] = any(ch.isalpha() for ch in t.raw(i).decode("utf-8", "replace"))
            best = prob.argmax(axis=1)
            names = [model.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
            score = np.where(letter, np.round(np.clip(prob.max(axis=1), 0, 1), 4), 0.0)
            yield pa.RecordBatch.from_arrays([t.batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*training_rows(docs))
    return identify_language(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
