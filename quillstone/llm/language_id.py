"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in stretches of 32 steps. At each step and in either direction its input is
the sum of four byte embeddings, its state has eight units; from the states of both directions every byte of the
step gets a distribution over languages. A document's probabilities are the mean over all its bytes. Training
is plain numpy: backpropagation through time and Adam, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, byte_slices

STEP, STEPS, UNITS = 4, 32, 8
STRETCH = STEP * STEPS
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def init(n_lang: int, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    return {
        "E": draw(STEP, 256, 2 * 3 * UNITS, scale=0.3),  # byte embeddings times input weights, both directions
        "U": draw(2, UNITS, 3 * UNITS, scale=0.3), "b": np.zeros((2, UNITS, 1), np.float32),
        "W": draw(2 * UNITS, STEP * n_lang, scale=0.2), "c": np.zeros(STEP * n_lang, np.float32),
    }


def _inputs(m: dict, x: np.ndarray) -> np.ndarray:
    """(STEPS, 2, 3 UNITS, B) from (B, STRETCH) bytes; the second direction runs backwards."""
    by_step = np.ascontiguousarray(x.reshape(len(x), STEPS, STEP).transpose(2, 1, 0))
    a = np.empty((STEPS, 2, 3 * UNITS, len(x)), m["E"].dtype)
    sums = m["E"][0].take(by_step[0].ravel(), axis=0)
    for j in range(1, STEP):
        sums += m["E"][j].take(by_step[j].ravel(), axis=0)
    sums = sums.reshape(STEPS, len(x), 2, 3 * UNITS)
    for t in range(STEPS):
        a[t, 0] = sums[t, :, 0].T
        a[t, 1] = sums[STEPS - 1 - t, :, 1].T
    return a


def forward(m: dict, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """(STEP, languages, STEPS, B): for each byte a distribution over languages. Gates are kept if asked for."""
    a, k, kind = _inputs(m, x), UNITS, m["E"].dtype
    h = np.zeros((2, k, len(x)), kind)
    both = np.empty((2 * k, STEPS, len(x)), kind)
    into = np.ascontiguousarray(m["U"].transpose(0, 2, 1))
    for t in range(STEPS):
        u = into @ h
        gates = np.add(a[t, :, : 2 * k], u[:, : 2 * k])
        gates *= -1
        np.minimum(gates, 60, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        r, z = gates[:, :k], gates[:, k:]
        inner = u[:, 2 * k :]
        inner += m["b"]
        n = r * inner
        n += a[t, :, 2 * k :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((h, r, z, n, inner))
        h = h - n
        h *= z
        h += n
        both[:k, t] = h[0]
        both[k:, STEPS - 1 - t] = h[1]
    if keep is not None:
        keep.append(both)
    p = (m["W"].T @ both.reshape(2 * k, -1) + m["c"][:, None]).reshape(STEP, -1, STEPS, len(x))
    top = p[:, 0].copy()
    for i in range(1, p.shape[1]):
        np.maximum(top, p[:, i], out=top)
    p -= top[:, None]
    np.exp(p, out=p)
    top[:] = p[:, 0]
    for i in range(1, p.shape[1]):
        top += p[:, i]
    p /= top[:, None]
    return p


def gradients(m: dict, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the first ``size`` bytes of each stretch, and its gradients through time."""
    kept: list = []
    p, k, B = forward(m, x, kept), UNITS, len(x)
    both, n_lang = kept.pop(), p.shape[1]
    on = (np.arange(STRETCH) < size[:, None]).reshape(B, STEPS, STEP).transpose(2, 1, 0)[:, None].astype(p.dtype)
    total = on.sum()
    hit = np.eye(n_lang, dtype=p.dtype)[y].T[None, :, None, :]
    loss = float(-(np.log(np.maximum((p * hit).sum(1, keepdims=True), 1e-20)) * on).sum() / total)
    d = ((p - hit) * on / total).reshape(STEP * n_lang, -1)
    g = {"W": both.reshape(2 * k, -1) @ d.T, "c": d.sum(1), "U": np.zeros_like(m["U"]), "b": np.zeros_like(m["b"]), "E": np.zeros_like(m["E"])}
    back = (m["W"] @ d).reshape(2 * k, STEPS, B)
    da = np.empty((STEPS, 2, 3 * k, B), p.dtype)
    dh = np.zeros((2, k, B), p.dtype)
    for t in reversed(range(STEPS)):
        h, r, z, n, inner = kept[t]
        dh[0] += back[:k, t]
        dh[1] += back[k:, STEPS - 1 - t]
        dn = dh * (1 - z) * (1 - n * n)
        da[t, :, :k] = dn * inner * r * (1 - r)
        da[t, :, k : 2 * k] = dh * (h - n) * z * (1 - z)
        da[t, :, 2 * k :] = dn
        du = da[t].copy()
        du[:, 2 * k :] = dn * r
        g["U"] += h @ du.transpose(0, 2, 1)
        g["b"] += du[:, 2 * k :].sum(2, keepdims=True)
        dh = dh * z + m["U"] @ du
    flat = np.concatenate([da[:, 0], da[::-1, 1]], axis=1).transpose(0, 2, 1).reshape(STEPS * B, -1)
    by_step = x.reshape(B, STEPS, STEP).transpose(2, 1, 0).reshape(STEP, -1)
    for j in range(STEP):
        np.add.at(g["E"][j], by_step[j], flat)
    return loss, g


def train(x: np.ndarray, size: np.ndarray, y: np.ndarray, n_lang: int, rounds: int = 260, batch: int = 256, rate: float = 0.02, seed: int = 11) -> dict:
    """Adam over random batches in which every language is as likely; the same sample gives the same model."""
    m, rng = init(n_lang, seed), np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    share = 1 / np.bincount(y, minlength=n_lang)[y]
    share /= share.sum()
    for i in range(1, rounds + 1):
        pick = rng.choice(len(x), batch, p=share)
        _, g = gradients(m, x[pick], size[pick], y[pick])
        step = rate * min(1, 2 * (1 - i / (rounds + 1)))
        for k in m:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            m[k] -= (step * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return m


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes as (n, STRETCH) with zeros behind each text's end; bytes in each stretch; the text it is of."""
    count = np.array([-(-len(t) // STRETCH) for t in texts])
    x = np.frombuffer(b"".join(t + bytes(c * STRETCH - len(t)) for t, c in zip(texts, count)), np.uint8).reshape(-1, STRETCH)
    size = np.full(len(x), STRETCH)
    size[np.cumsum(count)[count > 0] - 1] = [(len(t) - 1) % STRETCH + 1 for t in texts if t]
    return x, size, np.repeat(np.arange(len(texts)), count)


def document_probabilities(m: dict, texts: list[bytes], chunk: int = 1024) -> np.ndarray:
    """(texts, languages): the mean of the bytes' probabilities; rows of empty texts are 0."""
    n_lang = len(m["c"]) // STEP
    total = np.zeros((len(texts), n_lang))
    x, size, of = stretches(texts)
    for at in range(0, len(x), chunk):
        p = forward(m, x[at : at + chunk])
        ends = size[at : at + chunk]
        for i in np.flatnonzero(ends < STRETCH):
            p[:, :, :, i] *= (np.arange(STRETCH) < ends[i]).reshape(STEPS, STEP).T[:, None]
        np.add.at(total, of[at : at + chunk], p.sum(axis=2).sum(axis=0).T)
    return total / np.maximum(1, [len(t) for t in texts])[:, None]


def fit(docs: DataFrame, per_lang: int = 400) -> tuple[list[str], dict | None]:
    """Languages and model. Needs text, lang and train; a hash of the text picks about ``per_lang`` different texts of each language, 1.5 times that at most, and four stretches of each go to the driver."""
    rows = docs.filter("train AND lang IS NOT NULL AND length(text) > 0")
    # Copies count once: they must not take the places of other texts.
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text", F.lit(5))).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], None
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, per_lang / n)])
    luck = F.pmod("h", F.lit(1 << 30)) / F.lit(1 << 30)
    raw = F.col("text").cast("binary")
    at = lambda i: (1 + F.greatest(F.lit(0), F.octet_length(raw) - STRETCH) * i / 3).cast("int")
    cut = F.array(*[F.substring(raw, at(i), STRETCH) for i in range(4)])
    picked = rows.withColumn("h", F.xxhash64("text", F.lit(5))).filter(luck < share[F.col("lang")]).select("lang", "h", luck.alias("luck"), cut.alias("cut"))
    picked = picked.groupBy("lang", "h", "luck").agg(F.first("cut").alias("cut"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("luck", "h"))
    sample = picked.withColumn("nth", nth).filter(F.col("nth") <= int(1.5 * per_lang)).orderBy("luck", "h", "lang").collect()
    texts, y = zip(*[(bytes(c), langs.index(r.lang)) for r in sample for c in sorted(set(map(bytes, r.cut)))])
    x, size, _ = stretches(list(texts))
    return langs, train(x, size, np.array(y), len(langs))


def _predictor(langs: list[str], model: dict):
    def run(batches):
        for batch in batches:
            ids, held, has = batch.column(0), batch.column(1), batch.column(3).to_pylist()
            texts = [t if t and ok else b"" for t, ok in zip(batch.column(2).to_pylist(), has)]
            names, scores = [], []
            for a, b in byte_slices(texts):
                p = document_probabilities(model, texts[a:b])
                best = p.argmax(axis=1)
                names += [langs[i] if t else "und" for i, t in zip(best, texts[a:b])]
                scores += np.clip(p[np.arange(len(p)), best], 0, 1).tolist()
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(names, pa.string()), pa.array(scores, pa.float64()), batch.column(4)], [*(f.split()[0] for f in SCHEMA.split(", ")), "row"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score; and row, if ``row_col`` names a column of row numbers.

    Rows whose crc32(id as text) mod 4 is 2 are held out of training; a null id is not. A text that is null or
    has no letter gets `und` and 0, as all do where nothing can be learned. Equal texts get equal predictions.
    The whole of each text is read, however long. Ties go to the language that sorts first. Repeated rows are rows of
    their own, and count once in the training sample, which ``per_lang`` bounds. One count per language comes to the
    driver. An empty table gives an empty table. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"))
    held = F.coalesce(bucket_of(F.col("doc_id")) % 4 == 2, F.lit(False))
    langs, model = fit(rows.withColumn("train", ~held), per_lang)
    if not langs:
        return rows.select("doc_id", held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *(["row"] if row_col else []))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = rows.select("doc_id", held.alias("held_out"), F.col("text").cast("binary"), letter.alias("letter"), "row").mapInArrow(_predictor(langs, model), f"{SCHEMA}, row long")
    return out if row_col else out.drop("row")
